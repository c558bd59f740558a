"""MinHash, line dedup, decontamination."""

import random

import brute
import corpus_pipeline
from conftest import LONG, SF
from pyspark.sql import functions as F

from lumenmesh.llm import common, decontam, minhash, templates
from lumenmesh.operators import graph


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_near_duplicates_match_brute(spark, docs):
    want = brute.near_duplicates(rows_of(docs))
    got = minhash.query(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(want)


def test_near_duplicates_in_a_family(spark):
    """A family around the threshold: many links, and members that only a few others link to."""
    rng = random.Random(5)
    seed = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(300):
        w = list(seed)
        for j in rng.sample(range(120), rng.randrange(0, 7)):
            w[j] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(30)) + " the same closing words of all these texts here") for i in range(50)]
    want = brute.near_duplicates(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) > 52


def test_near_duplicates_take_up_few_pairs_beside_links(spark):
    """Of a family that is alike by 0.6 to 0.8 hardly more pairs than the links leave the buckets, and every link does."""
    rng = random.Random(9)
    seed = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for i in range(150):
        w = list(seed)
        for j in rng.sample(range(150), rng.randrange(0, 9)):
            w[j] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    near = lambda p: {(i, j) for i in range(150) for j in range(i) if 100 * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j])}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    reps = minhash.signatures(rows).withColumn("node", F.col("doc_id")).localCheckpoint()
    members = reps.select("node", F.explode("bands").alias("key"))
    none = spark.createDataFrame([], "node long, root long")
    pairs = {(r.b, r.a) for r in minhash._across(members, none, reps, False).collect()}
    assert near(75) <= pairs <= near(68) and len(pairs) < 1.3 * len(near(75))
    assert len(near(60)) > 1.5 * len(near(75)) > 300


def test_near_duplicates_edges(odd_docs, no_docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd_docs).collect()), key=str)
    by = {r[0]: r[1:] for r in got}
    assert len(got) == odd_docs.count()
    assert [by[i] for i in (1, 2, 3)] == [(0, 1, True), (0, 2, True), (0, 3, True)]
    assert by[4] == (1, 4, True) and by[None] == (3, None, True)
    assert by[7][1:] == (6, False) and by[6][1:] == (6, True) and by[8] == (3, 8, True)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_near_duplicates_of_shared_ids(spark):
    """Each text of a doc_id is judged by itself; repeated rows, also very many, change nothing."""
    rng = random.Random(8)
    texts = [[f"{c}{rng.randrange(10**6)}" for _ in range(60)] for c in "ab"]
    a, b = " ".join(texts[0]), " ".join(texts[1])
    near = [" ".join([*t[:-2], "x", "y"]) for t in texts]
    rows = [(1, a), (5, near[0]), (5, b), (9, near[1]), (None, b), (None, None), (5, b)]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (9, 5, False)]


def test_near_duplicates_of_hot_groups(spark, monkeypatch):
    """Groups of copies that are dealt over many tasks give what they give whole."""
    monkeypatch.setattr(common, "HOT_ROWS", 7)
    rng = random.Random(6)
    seed = [f"w{rng.randrange(10_000)}" for _ in range(100)]
    rows = [(i, " ".join(seed)) for i in range(40)]
    for i in range(100, 220):
        w = list(seed)
        for j in rng.sample(range(100), rng.randrange(1, 6)):
            w[j] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    want = brute.near_duplicates(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_sets_of_long_texts_in_parts(monkeypatch):
    text = " ".join(f"word{i % 977} and{i % 31}" for i in range(20_000)).encode()
    odd = [text, b" " * 5000 + b"one two three" + b"\n" * 5000, b"z" * 200_000 + b" " + b"y" * 200_000, b" " * 9000, text[:5000] + b"z" * 100_000 + text[:5000]]
    whole = list(minhash.shingle_sets(odd))
    monkeypatch.setattr(minhash, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(minhash, "parts", lambda t: common.parts(t, 1000))
    cut = [next(minhash.shingle_sets([t])) for t in odd]
    assert [x.tolist() for x in cut] == [x.tolist() for x in whole]
    assert [len(x) for x in whole[1:4]] == [1, 1, 0]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


def dropped(docs, min_docs=None):
    return templates.recurring_lines(docs, min_docs).select("doc_id", "line").collect()


def test_line_templates_match_brute(docs, monkeypatch):
    for min_docs in (2, 5):
        got = {tuple(r) for r in dropped(docs, min_docs)}
        assert got == brute.template_drops(rows_of(docs), min_docs)
    monkeypatch.setattr(templates, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    assert {tuple(r) for r in dropped(docs, 2)} == brute.template_drops(rows_of(docs), 2)


def test_lines_belong_to_a_text_not_to_an_id(spark):
    shared = "shared line of all"
    rows = [(i, f"{shared}\nown words {'abcdefgh'[i]} alone") for i in range(1, 7)] + [(5, "precious unique first line\nanother unique one"), (None, shared), (None, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.text) for r in templates.drop_templates(df).collect())
    assert out == sorted([(1, rows[0][1]), (5, rows[6][1]), (0, shared), (0, shared)] + [(i, rows[i - 1][1].split("\n")[1]) for i in range(2, 7)])
    alone = spark.createDataFrame([(3, shared)] * 9, "doc_id long, text string")
    assert not dropped(alone)


def test_line_keys_of_long_texts_in_parts(monkeypatch):
    text = "\n".join(f"line {i % 50} of some words that go on {i % 7} and on until the end\n" for i in range(400)).encode()
    whole = templates.keys_of([b"one\ntwo", text, b"", b"x\n" * 3])
    monkeypatch.setattr(templates, "CHUNK_BYTES", 500)
    monkeypatch.setattr(templates, "parts", lambda t, ends: common.parts(t, 500, ends))
    monkeypatch.setattr(templates, "chunks", lambda t: common.chunks(t, 500))
    cut = templates.keys_of([b"one\ntwo", text, b"", b"x\n" * 3])
    assert all((whole[c] == cut[c]).all() for c in whole) and len(whole["text"]) == 2 + 400 + 3


def test_line_templates_generalise(spark):
    rows = [(i, f"Page {i} of 90\nown words number{chr(97 + i)} stand here {'abcdefgh'[i]}\nthe report was sent to the office of {name} in the same week") for i, name in enumerate(["ann", "bob", "cyd", "dee", "eve", "fay"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in templates.drop_templates(df).collect()}
    assert out[0].text == rows[0][1] and out[0].n_dropped == 0
    assert all(out[i].text == rows[i][1].split("\n")[1] and out[i].n_dropped == 2 and out[i].n_lines == 3 for i in range(1, 6))
    assert templates.recurring_lines(df.where("doc_id < 4")).count() == 0


def test_long_lines_recur_from_two_documents(spark):
    shared = " ".join(f"shared{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'xyz'[i // 26]}" for i in range(60))
    own = [" ".join(f"{w}{c}" for c in "abcdefghijklmnopqrstuvwxyz" for w in (f"own{d}", f"more{d}")).translate(str.maketrans("123", "xyz")) for d in (1, 2, 3)]
    rows = [(1, f"{own[0]}\n{shared}\na short line"), (2, f"{shared}\n{own[1]}\na short line"), (3, f"{own[2]}\na short line")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in dropped(df)} == {(2, 0)}
    assert not dropped(df, 5)
    out = {r.doc_id: r.text for r in corpus_pipeline.near_dedup_stage(spark, df, SF).collect()}
    assert out == {1: rows[0][1], 2: f"{own[1]}\na short line", 3: rows[2][1]}


def test_rows_of_numbers_are_compared_by_value(spark):
    rows = [(i, f"{i}2 {i}4\n| {i}1.5 | {i}7 |\nBerlin {i} 2{i} 3{i}\n€ {i} – {i}3\n" + " ".join(f"{i}{j}" for j in range(12)) + f"\n12 34\nPage {i} of 90") for i in range(1, 7)]
    got = {tuple(r) for r in dropped(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got == {(i, line) for i in range(2, 7) for line in (5, 6)}


def test_line_templates_edges(odd_docs, no_docs):
    out = templates.drop_templates(odd_docs, 2)
    assert out.columns == [*odd_docs.columns, "_n_lines", "_n_dropped"] and out.count() == odd_docs.count()
    by = {r.doc_id: r for r in out.collect()}
    assert by[1].text is None and by[1]._n_lines == 0 and by[3].text == " \t\n " and by[6].text == LONG and by[7].text == ""
    assert templates.drop_templates(no_docs).count() == 0


def test_overlaps_match_brute(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute.benchmark_overlaps(rows_of(docs), [tuple(r) for r in items.select("item_id", "text").collect()])
    assert want
    for bound in (200_000, 1):
        monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", bound)
        got = {(r.doc_id, r.item_id): (r.matched, r.compared) for r in decontam.overlaps(docs, items).collect()}
        assert got == want
    plan = decontam.overlaps(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_overlaps_tolerate_substitution(spark):
    rng = random.Random(2)
    item = [f"t{rng.randrange(10**6)}" for _ in range(40)]
    twisted = list(item)
    for j in range(3, 40, 6):
        twisted[j] = "other"
    rows = [(1, "some words before " + " ".join(twisted).upper()), (2, " ".join(reversed(item))), (3, "%%% ".join(item)), (4, " ".join(item[:9])), (5, " ".join(item[8:24]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item)), (9, "too short"), (None, None), (10, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, items).collect()}
    assert got == {(d, i) for d in (1, 3, 5) for i in (7, 8)}
    assert {r.doc_id for r in decontam.decontaminate(docs, items).collect()} == {2, 4}


def test_overlaps_of_shared_and_null_ids(spark, monkeypatch):
    """Quotes and signs around a passage change nothing; each text of a doc_id, null or not, is compared by itself."""
    item = " ".join(f"token{c}" for c in "abcdefghij")
    twisted = item.replace("tokene", "x").replace("tokeni", "y")
    rows = [(1, twisted), (2, f'"{twisted}."'), (5, "nothing of it"), (5, f"« {item} »"), (None, item), (None, "other words"), (None, item), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "( " + item + " )")], "item_id long, text string")
    want = {(d, i): n for d, n in ((1, (8, 10)), (2, (8, 10)), (5, (10, 10)), (None, (10, 10))) for i in (1, 2)}
    assert {k: v for k, v in brute.benchmark_overlaps(rows, [(1, item), (2, item)]).items()} == want
    for bound, hot in ((200_000, 2000), (1, 2000), (1, 1)):
        monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", bound)
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        got = decontam.overlaps(docs, items).collect()
        assert {(r.doc_id, r.item_id): (r.matched, r.compared) for r in got} == want and len(got) == len(want)


def test_pipeline_stage_of_shared_and_null_ids(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(40)) for x in "abc")
    rows = [(None, a, 1), (None, a, 1), (1, b, 2), (1, b, 1), (2, b, 5), (2, c, 5), (3, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int")
    got = sorted(map(tuple, corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[3], rows[5], rows[6]], key=str)


def test_overlaps_edges(odd_docs, no_docs):
    items = odd_docs.select(F.col("doc_id").alias("item_id"), "text")
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(odd_docs, items).collect()}
    assert got == {(6, 6), (6, 7), (7, 6), (7, 7)}
    assert decontam.overlaps(no_docs, items).count() == 0 and decontam.overlaps(odd_docs, items.where("1=0")).count() == 0
    kept = decontam.decontaminate(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2
