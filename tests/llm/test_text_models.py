"""Toxicity, language-model scores, SentencePiece, personal data, the pipeline."""

import hashlib
import itertools
import math
import random
import re
import tracemalloc
import weakref
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
import sentencepiece
from conftest import SF
from pyspark.sql import functions as F

from lumenmesh.llm import ctw, pieces, pii, toxicity
from lumenmesh.llm.common import sliced, written


# ---- toxicity

@pytest.fixture(scope="module")
def channel(docs):
    counts = toxicity.trigrams([r.text for r in docs.collect()] + ["you are a stupid moron and a pathetic loser trash clown idiot"] * 50)
    return toxicity.Channel(toxicity.char_costs(counts))


@pytest.mark.parametrize("seen, meant", [
    ("m0r0n", "moron"), ("s t u p i d", "stupid"), ("l-o-s-e-r", "loser"), ("stuuuupid", "stupid"), ("1d10t", "idiot"), ("p@thetic", "pathetic"), ("tr4sh", "trash"), ("cl()wn", "cl()wn"),
])
def test_channel_restores(channel, seen, meant):
    assert toxicity.restored([f"the {seen} here"], channel) == [f"the {meant} here"]


def test_readings_are_the_cheapest_of_all(channel):
    """Every reading of short stretches, tried one by one under the channel's and the character model's costs."""
    T = toxicity

    def readings(text):
        options = []
        for i, c in enumerate(text):
            own = 0.0 if c.isalpha() else T.COST_SEPARATOR if c in T.SEPARATORS else T.COST_ANY
            some = [(c, own), *((x, T.COST_LEET) for x in T.LEET.get(c, ""))]
            if c in T.SEPARATORS and 0 < i < len(text) - 1:
                some.append(("", T.COST_GAP))
            if i and c == text[i - 1] and c.isalpha():
                some.append(("", T.COST_REPEAT if i < 2 or c != text[i - 2] else 0.05))
            options.append(some)
        for path in itertools.product(*options):
            word, total = "".join(x for x, _ in path), sum(x for _, x in path)
            at = [0, 0, *(int(T._INDEX[ord(c)]) if c.isalpha() else 1 for c in word), 0]
            yield total + sum(channel.cost[(a * T.SIZE + b) * T.SIZE + c] for a, b, c in zip(at, at[1:], at[2:])), word

    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice("aaeosst01345$@!.- ") for _ in range(rng.randrange(1, 7)))
        every = sorted(readings(text))
        best = channel.restore(text)
        assert math.isclose(min(c for c, w in every if w == best), every[0][0], rel_tol=1e-9, abs_tol=1e-6)


def test_scores_equal_a_plain_sum():
    """The features and summaries of a text by loops over its words."""
    texts = ["Bad baad dog, BAD dogs", "", "nothing here", "bad"]
    words = {"bad": 2.0, "dog": 1.0, "not": 0.5}
    keys = {w: toxicity.features([w])[1][0] for w in ("bad", "dog")} | {"not": toxicity.features(["not"])[1][0]}
    order = sorted(words, key=lambda w: keys[w])
    out = toxicity.summaries(texts, np.array([keys[w] for w in order], np.uint64), np.array([[words[w]] for w in order]), np.zeros(4, int))
    assert out[:, 3].tolist() == [math.log1p(n) for n in (5, 0, 2, 1)]
    assert out[:, :3].tolist() == [[2.0, 1.0, 0.0], [0.0] * 3, [0.0] * 3, [2.0, 0.0, 0.0]]


def test_channel_leaves_the_rest(channel):
    texts = ["", "call 555 1234 on 2021-03-04!", "The plain words stay, all of them.", "thea*** of%%% wh$$$", "a\nb\n\nc", "日本 🙂 ñandú"]
    assert toxicity.restored(texts, channel) == texts


def test_trigram_costs_are_probabilities(channel):
    p = np.exp(-np.array(channel.cost).reshape(-1, toxicity.SIZE))
    assert np.allclose(p.sum(1), 1, atol=1e-4)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.query(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95


def test_toxicity_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, None), (6, 1), (6, 0), (8, 0), (9, 0), (None, 1)], "doc_id long, toxic int")
    for given in (labels, labels.where("toxic = 0"), labels.where("1=0")):
        model = toxicity.train(spark, odd_docs, given)
        assert toxicity.score(odd_docs, model).count() == odd_docs.count()
        assert toxicity.score(no_docs, model).count() == 0
        assert toxicity.screen(odd_docs, model).columns == odd_docs.columns


# ---- context-tree weighting

def test_tree_probabilities_sum_to_one():
    rng = random.Random(1)
    text = "".join(rng.choice("abc ") for _ in range(3000)).encode()
    packed, _ = ctw.grams([text])
    full, n = np.unique(packed, return_counts=True)
    levels = []
    for d in range(ctw.DEPTH + 1):
        key, at = np.unique(full & np.uint64((1 << (8 * d + 8)) - 1), return_inverse=True)
        total = np.bincount(at, n)
        context = key >> np.uint64(8)
        of = {c: total[context == c].sum() for c in np.unique(context)}
        kept = np.array([of[c] >= (20 if d > 1 else 0) for c in context])
        levels.append((key[kept], total[kept]))
    tree = ctw.Tree.of(levels)
    for context in (0, int(full[0]) >> 8, int.from_bytes(b"abca", "big"), int.from_bytes(b"zzza", "big"), int.from_bytes(b"\xff\xff\xffb", "big")):
        every = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert math.isclose((10 ** tree.log10(every)).sum(), 1, rel_tol=1e-9)


def test_tree_weights_by_hand():
    """One context byte deep: the root's mean of its own estimate and its children's product."""
    def kt(z, o):
        return math.exp(math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(z + o + 1))

    a, b = 0x00, 0x80  # differ in the first bit
    counts = {(a, a): 8, (a, b): 1, (b, a): 2, (b, b): 9}
    deep = np.array([(c << 8) | x for c, x in counts], np.uint64)
    tree = ctw.Tree.of([(np.array([a, b], np.uint64), np.array([10.0, 10.0])), (deep, np.array(list(counts.values()), float))])
    own, below = kt(10, 10), kt(8, 1) * kt(2, 9)
    stop = own / (own + below)
    first = stop * (10.5 / 21) + (1 - stop) * (1.5 / 10)
    rest = 1.0
    for _ in range(7):  # the other bits were always 0: 10 at the root, 1 below context a
        own, below = kt(10, 0), kt(1, 0) * kt(9, 0)
        s = own / (own + below)
        rest *= 1 - (s * (0.5 / 11) + (1 - s) * (0.5 / 2))
    assert math.isclose(10 ** tree.log10(np.array([(a << 8) | b], np.uint64))[0], first * rest, rel_tol=1e-9)


def test_scores_match_plain_version(spark, docs):
    got = {r.doc_id: r for r in ctw.query(spark, SF).collect()}
    words = {r.doc_id: brute.WORD.findall(brute.lower(r.text)) + [None] for r in docs.collect()}
    c = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in words.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(got[d].base_score, base, rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert all(r.score < 0 for r in held)
    assert np.mean([r.bits_per_byte for r in held]) < 3  # bytes of this text take 4.2 bits without any context


@pytest.mark.parametrize("depth, least", [(5, 1), (5, 4), (3, 2), (2, 3), (1, 1), (0, 1)])
def test_scores_equal_a_plain_tree(spark, docs, monkeypatch, depth, least):
    """Trained by tasks of a few grams each, and by the recursion of the definition."""
    texts = [r.text[:400] for r in docs.orderBy("doc_id").limit(14).collect()]
    plain = brute.context_tree(texts[:10], depth, least)
    rows = spark.createDataFrame(list(enumerate([*texts, "", None, "Zq\x00 日本"])), "doc_id long, text string")
    model = ctw.train(rows.where("doc_id < 10"), depth, least)
    got = {r.doc_id: (r.text, r.score) for r in ctw.score(rows, model).join(rows, "doc_id").collect()}
    for text, score in got.values():
        assert math.isclose(score, plain(text), rel_tol=1e-6)  # the files hold single precision


def test_long_texts_are_scored_in_parts(monkeypatch):
    text = b"some words that go on and on, " * 40
    whole = ctw.grams([text])[0]
    for most in (7, 100, len(text), len(text) - 1):
        assert (np.concatenate(list(ctw.cut_grams(text, ctw.DEPTH, most))) == whole).all()
    batch = type("B", (), {"num_rows": 10, "column": lambda self, c: {"key": self.key, "n": self.n}[c]})
    groups = []
    for i in range(9):
        b = batch()
        b.key, b.n = (ctw.pa.array(x) for x in (((np.arange(10) + 10 * i) // 16 << 8), np.ones(10, np.int64)))
        groups.append(b)
    found = [k >> np.uint64(8) for k, _ in ctw._whole_groups(groups, 2, 12)]
    assert sum(map(len, found)) == 90 and len(found) > 3
    assert all(not set(a) & set(b) for i, a in enumerate(found) for b in found[:i])


def test_scores_with_joined_words(spark, docs, monkeypatch):
    part = docs.limit(30).select("doc_id", "text")
    whole = {r.doc_id: r.base_score for r in ctw.score(part, ctw.train(part)).collect()}
    monkeypatch.setattr(ctw, "MOST_WORDS", 50)
    assert {r.doc_id: pytest.approx(r.base_score) for r in ctw.score(part, ctw.train(part)).collect()} == whole


def test_scores_edges(odd_docs, no_docs):
    model = ctw.train(odd_docs)
    got = ctw.score(odd_docs.select("doc_id", "text"), model).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1 and by[1].score == by[2].score
    assert ctw.score(no_docs.select("doc_id", "text"), model).count() == 0
    nothing = ctw.score(odd_docs.select("doc_id", "text"), ctw.train(no_docs)).collect()
    assert {round(r.bits_per_byte, 9) for r in nothing} == {8.0} and {r.n_known for r in nothing} == {0}


# ---- SentencePiece

@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Model(f.read())


def test_ids_equal_the_library(model, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(3)
    odd = ["", " ", "  a  ", "\n\t", "<s> </s> <unk> <0x41>", "a" * 5000, "ab" * 3000, " " * 500, "日本🙂\x00é", "▁▁x"]
    odd += ["".join(rng.choice("ab  cdeé日🙂.\n01the ing =-") for _ in range(rng.randrange(80))) for _ in range(500)]
    for text in odd + [r.text for r in docs.collect()]:
        ids = pieces.encode_texts(model, [text])[0]
        assert ids.tolist() == library.encode(text)
        assert pieces.decode_ids(model, ids).decode() == text.replace("▁", " ")


def test_stream_holds_a_bounded_window(model):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for text in ("a" * 4000, "the" * 2000, "=-" * 1500, "0123456789" * 300, " " * 3000 + "the", "a b\n" * 900 + "\n" * 99):
        search, out, held = pieces.Stream(model), [], 0
        marked = ("▁" + text).replace(" ", "▁")
        for i in range(0, len(marked), 5):
            out += search.feed(marked[i : i + 5])
            held = max(held, len(search.text) + len(search.ahead))
        out = np.frombuffer(b"".join(out + search.finish()), np.int32)
        assert out.tolist() == library.encode(text) and held <= 6 * model.longest and search.commits > len(text) // (6 * model.longest)


def test_every_document_is_streamed(model, docs):
    """Whole documents through one search each, in blocks of any size: same ids, a bounded window, many commits."""
    for r in docs.collect():
        ids, search = pieces.encode_text(model, r.text, 37)
        assert ids == pieces.encode_texts(model, [r.text])[0].tobytes()
        assert search.widest <= 6 * model.longest and search.commits >= len((r.text or "").split())
    assert model.widest <= 6 * model.longest


def test_forgetting_does_not_change_ids(model, docs, monkeypatch):
    texts = [r.text for r in docs.limit(40).collect()]
    want = [x.tolist() for x in pieces.encode_texts(model, texts)]
    for c in ("REMEMBERED", "FITS", "STRANGE"):
        monkeypatch.setattr(pieces, c, 0)
    assert [pieces.encode_texts(model, [t])[0].tolist() for t in texts] == want


def test_a_chunk_is_not_held_word_by_word(model):
    """Texts whose words recur take little more memory than they have: not all their stretches are held at once."""
    words = [f"w{i:04d}" for i in range(500)]
    texts = [" ".join(words[j % 500] for j in range(i, i + 10_000)) for i in range(30)]
    pieces.encode_texts(model, texts[:1])
    tracemalloc.start()
    try:
        found = pieces.encode_texts(model, texts)
        peak = tracemalloc.get_traced_memory()[1] - sum(x.nbytes for x in found)
    finally:
        tracemalloc.stop()
    assert len(found) == 30 and peak < 8 << 20


def test_workers_forget_models_of_other_operators():
    """A worker that goes on with another operator's task has the memory of the model again."""
    with open(pieces.MODEL, "rb") as f:
        data = f.read()
    held = weakref.ref(pieces._loaded("", data))
    assert not list(sliced(iter([]), keeps=pieces._loaded)) and held() is not None
    assert not list(sliced(iter([]))) and held() is None


def test_stretches_are_searched_together(monkeypatch):
    """Stretches that aren't remembered go through one search over all of them, whatever slots their pairs share."""
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    with open(pieces.MODEL, "rb") as f:
        data = f.read()
    rng = random.Random(7)
    syllables = ["an", "the", "tion", "ä", "ño", "Qu", "eau", "x", "00", "?!", "日", "🙂", "\x00", "ing"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 7))) for _ in range(3000)]
    texts = [" ".join(words[i : i + 300]) for i in range(0, len(words), 300)]
    for slots, together in ((19, 1 << 13), (3, 7)):
        monkeypatch.setattr(pieces, "SLOTS", slots, raising=False)
        monkeypatch.setattr(pieces, "TOGETHER", together, raising=False)
        m = pieces.Model(data)
        monkeypatch.setattr(pieces.Stream, "_merge", lambda *a: pytest.fail("a short stretch was searched alone"))
        assert [x.tolist() for x in pieces.encode_texts(m, texts)] == [library.encode(t) for t in texts]
        monkeypatch.undo()


def test_small_models_merge_as_by_hand():
    """Models with equal scores, with pieces that merging doesn't make and with characters that are no pieces."""
    from sentencepiece import sentencepiece_model_pb2

    rng = random.Random(8)
    for _ in range(60):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.trainer_spec.model_type = 2
        proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces = False, False, True
        table = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))): -float(rng.randrange(6)) for _ in range(rng.randrange(1, 25))}
        for t, s, k in [*((t, s, 1) for t, s in table.items()), ("<unk>", 0, 2)]:
            p = proto.pieces.add()
            p.piece, p.score, p.type = t, s, k
        m = pieces.Model(proto.SerializeToString())

        def by_hand(text):
            parts = list(text)
            while True:
                pairs = [(table[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in table]
                if not pairs:
                    return parts
                i = -max(pairs)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]

        names = [t for t in table] + [c for c in "abcx" if c not in table]
        place = {t: m.ids[t] if t in m.ids else m.place(t) for t in names}
        for a, b in itertools.product(names, names):
            assert m.allowed(place[a] << pieces.SHIFT | place[b]) == (by_hand(a + b) == [a, b])
        words = sorted({"".join(rng.choice("abcx") for _ in range(rng.randrange(1, 2 * m.longest + 1))) for _ in range(60)})
        found = pieces.merge_all(m, words)
        for w, ids in zip(words, found):
            search = pieces.Stream(m)
            search._advance(w)
            assert ids == search._path(len(w))
        if m.longest > 1 and all(by_hand(t) == [t] for t in table):
            assert [np.frombuffer(x, np.int32).tolist() for x in found] == [[place[t] if place[t] < len(m.pieces) else m.unknown for t in by_hand(w)] for w in words]


def test_unigram_search_matches_brute(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces = False, False, True
    table = {"a": -2.1, "b": -2.3, "ab": -3.0, "ba": -3.3, "aab": -4.05, "bb": -4.7, "abab": -5.9}
    for t, s, k in [("<unk>", 0, 2), *((t, s, 1) for t, s in table.items())]:
        p = proto.pieces.add()
        p.piece, p.score, p.type = t, s, k
    m = pieces.Model(proto.SerializeToString())
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("aabbx") for _ in range(rng.randrange(1, 60)))
        best = [(0.0, [])]
        for end in range(1, len(text) + 1):
            options = [(best[end - n][0] + table[text[end - n : end]], best[end - n][1] + [text[end - n : end]]) for n in range(1, 5) if n <= end and text[end - n : end] in table]
            if text[end - 1] not in table:
                options.append((best[end - 1][0] + m.lowest, best[end - 1][1] + ["x"]))
            best.append(max(options, key=lambda o: o[0]))
        ids = pieces.encode_texts(m, [text])[0]
        got = sum(m.pieces[i][1] if i else m.lowest for i in ids)
        assert math.isclose(got, best[-1][0], rel_tol=1e-6)  # the file holds single precision


def test_round_trip_edges(odd_docs, no_docs):
    got = pieces.round_trip(odd_docs).collect()
    assert all(r.round_trip for r in got) and len(got) == odd_docs.count()
    assert {r.doc_id: r.n_ids for r in got}[1] == 0
    texts = sorted((str(r.doc_id), r.text) for r in pieces.decode(pieces.encode(odd_docs)).collect())
    assert texts == sorted((str(r.doc_id), (r.text or "").replace("▁", " ")) for r in odd_docs.collect())
    assert pieces.encode(no_docs).count() == 0


# ---- personal data

def plain_spans(text):
    """The contract's patterns, as they are written."""
    def luhn(d):
        return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]


def test_base_spans_match_patterns(docs):
    rng = random.Random(6)
    texts = [r.text for r in docs.collect()]
    texts += ["".join(rng.choice("0123456789.@+-() abz%_") for _ in range(rng.randrange(60))) for _ in range(20_000)]
    texts += ["4111 1111 1111 1111", "4111-1111-1111-1111.1.2.3", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "x@y@z.w", "+1 (017) 555-7713", "999.1.1.1 007.0.0.255", "🙂 a@b.co", "１.２.３.４"]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


def test_long_runs_stay_linear():
    for unit in ("a", "1", "1.", "+1", "a.", "@", "1 ", "(", "-1", ":"):
        pii.candidates(unit * 50_000)


def test_query_digests(spark, docs):
    got = {r.doc_id: r for r in pii.query(spark, SF).collect()}
    for r in docs.collect():
        want = plain_spans(r.text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert set(listed.split(",")) <= set(g.spans.split(",")) or not listed


def test_loose_spans_are_added(spark):
    rows = [(i, f"please mail joe{i} [at] site{i} [dot] com or call (0{100 + i}) 555-{1000 + i} today") for i in range(40)]
    rows += [(100 + i, f"mail a{i}@b{i}.com, phone +1 555 {100 + i} {2000 + i}") for i in range(40)]
    rows += [(200, "look at the house. the dot was at home, order 12-34-56 of page 7")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.base) for s in r.spans] for r in pii.find(df, pii.learn(df)).collect()}
    assert got[5] == [("email", False), ("phone", False)] and got[105] == [("email", True), ("phone", True)] and got[200] == []


def test_added_kinds(spark):
    """Bank, identity and key spans are found whole; their digits aren't phones or cards; plain numbers and hashes stay out."""
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(i, f"my ssn 078-05-{1120 + i} and iban DE89 3704 0044 0532 0130 00 here") for i in range(30)]
    rows += [(100 + i, f'token = "{key[i:]}{key[:i]}" or password: hunter2x{i}') for i in range(30)]
    rows += [(200, "chapter 123 of 45 and 6789, invoice hash of nothing; internationalisation and counterrevolutionaries"), (201, None), (202, "GB82 WEST 1234 5698 7654 33")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(df, pii.learn(df)).collect()}
    for i, text in rows[:30]:
        assert got[i] == [("iban", text.index("DE89"), text.index(" here")), ("id", text.index("078"), text.index(" and"))]
    for i, text in rows[30:60]:
        assert got[i] == [("secret", 9, 49), ("secret", text.index("hunter"), len(text))]
    assert got[200] == got[201] == [] and not any(k == "iban" for k, _, _ in got[202])
    assert pii.iban_valid("GB82 WEST 1234 5698 7654 32") and not pii.iban_valid("GB82 WEST 1234 5698 7654 33")


def test_estimation_finds_the_unreliable_labeler():
    rng = random.Random(8)
    counts = Counter()
    for _ in range(4000):
        y = rng.random() < 0.6
        vote = [(1 if y else -1) * (1 if rng.random() < right else -1) for right in (0.95, 0.9, 0.6)]
        counts["email", *vote, 0] += 1
    _, reliability = pii.estimate(counts)
    assert np.allclose(reliability["email"], (0.95, 0.9, 0.6), atol=0.04)


def test_pii_edges(odd_docs, no_docs):
    model = pii.learn(no_docs)
    assert all(r.spans == [] for r in pii.find(odd_docs, model).collect())
    assert pii.find(odd_docs, model).count() == odd_docs.count() and pii.find(no_docs, model).count() == 0


# ---- the pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = docs.columns, docs
    for name, stage in p.STAGES[:-1]:
        before = [tuple(r) for r in now.select("doc_id", "text").collect()]
        now = written(stage(spark, now, SF), name)
        assert now.columns == columns
        after = {r.doc_id: r.text for r in now.collect()}
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
            assert set(after) == {d for d, _ in before if scores[d] < 0.5}
        if name == "line_dedup":
            gone = brute.template_drops(before)
            want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in before}
            assert after == {d: t for d, t in want.items() if t.strip(" \t\n\v\f\r") or (d, 0) not in gone}
            assert all(r.n_chars == len(r.text) for r in now.collect())
        if name == "near_dedup":
            want = brute.near_duplicates(before)
            assert set(after) == {d for d, (_, c) in want.items() if d == c}
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(after) == {d for d, _ in before} - {d for d, _ in brute.benchmark_overlaps(before, items)}
    ids = {r.doc_id: len(r.ids) for r in p.run(spark, SF).collect()}
    assert set(ids) == set(after) and all(ids.values())


def test_pipeline_edges(spark, odd_docs, no_docs):
    import corpus_pipeline as p

    for given in (odd_docs, no_docs):
        now = given
        for _, stage in p.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == given.columns
        out = p.STAGES[-1][1](spark, now, SF).collect()
        assert len({r.doc_id for r in out}) == len(out)
        if given is odd_docs:
            assert {r.doc_id for r in out} >= {1, 2, 3, 4, 6, 8, None}
