"""Language ID, URL filter, nearest neighbours."""

import brute
import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from lumenmesh.llm import collision, langid, urlfilter


def test_language_held_out(spark, docs):
    got = langid.query(spark, SF).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(got) == docs.count() and len(held) > 20
    assert (held.lang_pred == held.lang).mean() >= 0.97
    assert got.score.between(0, 1).all()


def test_language_edges(odd_docs, no_docs, docs):
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd_docs, model).collect()]
    assert len(got) == odd_docs.count()
    for doc_id, lang, score in got:
        assert (lang == "und" and score == 0) == (doc_id in (1, 2, 3))
    assert langid.predict(no_docs, model).count() == 0
    nothing = langid.fit(no_docs.select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in langid.predict(odd_docs, nothing).collect()} == {"und"}
    single = langid.fit(docs.where("lang = 'en'").select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in langid.predict(docs, single).collect()} <= {"en", "und"}


def test_codebook_separates():
    for n in (2, 3, 4, 6, 9, 30):
        code = langid.codebook(n)
        assert all((code[i] != code[j]).sum() >= max(1, code.shape[1] // 4) for i in range(n) for j in range(i))


def test_batching_does_not_change_scores():
    rng = np.random.default_rng(1)
    weights = rng.standard_normal((langid.BUCKETS, 3)).astype(np.float32)
    texts = [bytes(rng.integers(97, 110, n).astype(np.uint8)) for n in (0, 1, 3, 50, 2000, 7)]
    together = langid.bit_scores(texts, weights)
    assert np.allclose(together, np.concatenate([langid.bit_scores([t], weights) for t in texts]))


def test_predictions_equal_a_plain_version():
    """Sums of the weights of every n-gram, byte by byte, and the decoding by its definition."""
    rng = np.random.default_rng(5)
    code = langid.codebook(4)
    weights = rng.standard_normal((langid.BUCKETS, code.shape[1])).astype(np.float32)
    trust = rng.uniform(0.5, 1.5, code.shape)
    texts = [b"Some text", "pr\u00eate-moi ta plume".encode(), b"x"]

    def plain(text):
        total, data = np.zeros(code.shape[1]), text.lower() + b" " * (langid.ORDERS - 1)
        for i in range(len(text)):
            h = 0
            for k in range(langid.ORDERS):
                h = (h + data[i + k] + 1) * 0x9E3779B1 % 2**32
                total += weights[((h ^ h >> 15) * 0x85EBCA6B % 2**32) >> 19]
        z = total * langid.TEMPER
        loss = [sum(t * np.logaddexp(0, -s * c) for t, s, c in zip(trust[i], z, code[i])) for i in range(4)]
        return np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()

    got = langid.decode(langid.bit_scores(texts, weights), code, trust)
    assert np.allclose(got, [plain(t) for t in texts], rtol=1e-4)


def test_url_edges(spark):
    """Null ids, repeated rows and clashing columns: every row is judged by its url."""
    rows = [(None, "http://a.net/es/", "x"), (1, "http://a.net/es/", "x"), (1, "http://a.net/es/", "x"), (2, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = sorted(((r.page_id or 0), r["rule"]) for r in urlfilter.judge(pages.select("page_id", "url"), urlfilter.RULES).collect())
    assert got == [(0, "net/es/"), (1, "net/es/"), (1, "net/es/"), (2, None)]


def test_url_rules(spark):
    urls = {
        "http://a.com/x": ("a.com", "/x", "com/", "allow"), "http://a.com": ("a.com", "", None, "allow"),
        "HTTPS://WWW.Example.COM/en/1?q": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://example.com/en/": ("example.com", "/en/", "example.com/en/", "block"), "http://m.x.net/fr/#a": ("m.x.net", "/fr/", "net/fr/", "block"),
        "http://xexample.com/en/": ("xexample.com", "/en/", "com/", "allow"), "http://net/fr": ("net", "/fr", None, "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "://": ("", "", None, "allow"), "a://b?c/d": ("b", "", None, "allow"),
        "x://y.example.com/EN/": ("y.example.com", "/EN/", "com/", "allow"), "http://" + "a." * 50_000 + "com/": ("a." * 50_000 + "com", "/", "com/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge(pages, urlfilter.RULES).collect()}
    assert got == dict(enumerate(urls.values()))
    assert urlfilter.judge(pages.where("1=0"), urlfilter.RULES).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, []).collect()} == {"allow"}


def test_url_digest_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda b: len(b))
    path = tmp_path / "list"
    path.write_bytes(urlfilter.pack([("ab/", "block"), ("cd/", "allow"), ("ab/", "allow"), ("efg/", "block")]))
    listed = urlfilter.DigestArray(str(path))
    found = listed.find([b"ab/", b"cd/", b"xy/", b"efg/", b"long one/"])
    assert [listed.rule(i) if i >= 0 else None for i in found] == [b"ab/", b"cd/", None, b"efg/", None]
    assert listed.block[found[0]] == 1


def test_neighbours_recall(spark):
    got = collision.query(spark, SF).toPandas()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, v = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        best = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and mine.score.is_monotonic_increasing
        assert np.allclose(mine.score, [d[ids == i][0] for i in mine.vec_id], rtol=1e-12)
        hits += len(set(mine.vec_id) & set(ids[best]))
    assert hits / len(got) >= 0.95


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [1.0, 0.1]), (8, [1.0, 0.1]), (8, [1.5, 0.0]), (9, [1.0, 0.0, 0.0])]
    rows += [(i, [0.0, 1.0]) for i in range(100, 150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in collision.search(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    assert [i for _, i in sorted(got[0])] == [1, 8, *range(100, 108)]
    assert [i for _, i in sorted(got[100])] == list(range(101, 111))
    assert collision.search(df.where("1=0"), F.col("id") % 100 == 0).count() == 0
    assert collision.search(df.where("vec_id < 1"), F.col("id") % 100 == 0).count() == 0
