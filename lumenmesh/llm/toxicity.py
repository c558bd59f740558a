"""Toxicity behind a noisy channel.

A text's suspicious stretches (letters mixed with leetspeak symbols, letters repeated three times or more, single letters
with one separator between them) become character lattices: a symbol may stand for letters, a repeated letter or a
separator may be dropped, each at a cost. Viterbi search under a character trigram model, counted over all documents,
restores the stretch; the rest of a text restores to itself.

The restored text is scored by a classifier that is fitted on a bounded, hashed sample of labelled documents: words and
their beginnings that are much more common in toxic than in clean documents get log-odds weights, and a logistic model over
the largest weights of a document gives the score. When it is fitted, each document's own label is left out of the counts.

Defined cases: null and empty texts score like a text without any weighted word; null labels are ignored, of several labels
of one document the larger counts; without labels of both kinds every score is the share of toxic labels (0 without any);
a very long text is restored and read in parts, cut between words, and scored as a whole; a null doc_id is scored and not
held out; repeated rows score alike; ties between readings go to the first found; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BASE, _BASE_INV, CHUNK_BYTES, MODELS, _powers, chunks, crc_mod, mix64, sliced, small, table, written

#: Expected number of labelled documents that the classifier is fitted on, at most.
SAMPLE = 20_000
#: What a symbol may stand for (fixed values of the channel).
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "*": "aeiou", "#": "aeiou",
}
SEPARATORS = " .-_*"
COST_LEET, COST_REPEAT, COST_GAP, COST_ANY, COST_SEPARATOR = 0.5, 0.7, 0.1, 2.0, 6.0
#: Beginnings of words that are features, in letters.
STARTS = (3, 4, 5, 6, 7, 8)
#: A weighted feature is in at least so many toxic documents of the sample, with log-odds of at least LEAST_ODDS.
LEAST_TOXIC, LEAST_ODDS, PRIOR = 3, 1.2, 3.0

_CODES = 1 << 16
_LETTER = np.array([chr(i).isalpha() for i in range(_CODES)])
_LOWER = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 and not 0xD800 <= i < 0xE000 else i for i in range(_CODES)], np.uint32)
_ALNUM = np.array([chr(i).isalnum() and chr(i).isascii() or chr(i).isalpha() for i in range(_CODES)])
_SYMBOL = np.zeros(_CODES, bool)
_SYMBOL[[ord(c) for c in LEET]] = True
_GAP = np.zeros(_CODES, bool)
_GAP[[ord(c) for c in SEPARATORS]] = True
_BLANK = np.zeros(_CODES, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.Generator(np.random.PCG64(4)).integers(0, 1 << 64, _CODES, dtype=np.uint64)

#: Alphabet of the character model: 0 the edge of a word, 1 any other letter or symbol, then a-z and the Latin-1 letters.
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(i) for i in range(0xDF, 0x100) if i != 0xF7)
SIZE = 2 + len(_LETTERS)
_INDEX = np.ones(_CODES, np.int64)
for _i, _c in enumerate(_LETTERS):
    _INDEX[ord(_c)] = 2 + _i


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, a line feed after each, and where each text begins (and the last ends)."""
    flat = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    return np.where(flat < _CODES, flat, 0xFFFF), np.cumsum([0, *(len(t) + 1 for t in texts)])


_CUT = re.compile(r"\w\w\s(?=\w\w)")


def cut_text(text: str, most: int = CHUNK_BYTES) -> list[str]:
    """A long text in parts of at most `most` characters, cut between two words of two or more letters where there are such
    (so no spelled-out word is cut); together they are the text."""
    out, at = [], 0
    while len(text) - at > most:
        cut = max((m.end() for m in _CUT.finditer(text, at + most // 2, at + most)), default=at + most)
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def trigrams(texts: list[str]) -> np.ndarray:
    """Counts of (edge or letter, edge or letter, edge or letter) over the words of texts."""
    out = np.zeros(SIZE**3, np.int64)
    texts = [p for t in texts for p in cut_text(t)]
    for a, b in chunks(texts):
        flat, _ = codes(texts[a:b])
        x = np.where(_LETTER[flat], _INDEX[_LOWER[flat]], 0)
        x = x[np.concatenate([[True], (x[1:] > 0) | (x[:-1] > 0)])]
        x = np.concatenate([[0], np.repeat(x, 1 + (x == 0)), [0, 0]])  # an edge counts twice, so that a word starts anew
        out += np.bincount((x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:], minlength=SIZE**3)
    return out


def char_costs(counts: np.ndarray) -> np.ndarray:
    """-log p(c | a, b), with backing off to shorter contexts."""
    n = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    uni = n.sum((0, 1)) + 1
    uni /= uni.sum()
    bi = n.sum(0) + 5 * uni
    bi /= bi.sum(1, keepdims=True)
    tri = n + 5 * bi[None]
    return -np.log(tri / tri.sum(2, keepdims=True)).astype(np.float32)


class Channel:
    """Restores one stretch; remembers recent ones."""

    def __init__(self, costs: np.ndarray) -> None:
        self.cost = costs.reshape(-1).tolist()
        self.remembered = lru_cache(maxsize=20_000)(self._restore)

    def restore(self, text: str) -> str:
        return self.remembered(text) if len(text) <= 64 else self._restore(text)

    def _index(self, c: str) -> int:
        return int(_INDEX[ord(c)]) if ord(c) < _CODES and c.isalpha() else 1

    def _restore(self, text: str) -> str:
        """The cheapest reading of a stretch under channel and character model."""
        cost, lower = self.cost, text.lower()
        if len(lower) != len(text):
            lower = text
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for i, c in enumerate(lower):
            options = [(c, 0.0 if c.isalpha() else COST_SEPARATOR if c in SEPARATORS else COST_ANY)]
            options += [(x, COST_LEET) for x in LEET.get(c, "")]
            if c in SEPARATORS and 0 < i < len(lower) - 1:
                options.append(("", COST_GAP))
            if i and c == lower[i - 1] and c.isalpha():
                options.append(("", COST_REPEAT if i < 2 or c != lower[i - 2] else 0.05))
            fresh: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (sofar, path) in states.items():
                for out, extra in options:
                    if out:
                        k = self._index(out)
                        key, total = (b, k), sofar + extra + cost[(a * SIZE + b) * SIZE + k]
                    else:
                        key, total = (a, b), sofar + extra
                    if key not in fresh or total < fresh[key][0]:
                        fresh[key] = (total, (out, path) if out else path)
            states = fresh
        best = min(states.items(), key=lambda s: (s[1][0] + cost[(s[0][0] * SIZE + s[0][1]) * SIZE], s[0]))[1][1]
        out = []
        while best is not None:
            out.append(best[0])
            best = best[1]
        return "".join(reversed(out))


def stretches(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the suspicious stretches, in order and apart."""
    blank, alnum, letter = _BLANK[flat], _ALNUM[flat], _LETTER[flat]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    solid = alnum.copy()
    solid[1:] |= _SYMBOL[flat[1:]] & blank[:-1]
    solid[:-1] &= alnum[:-1] | letter[1:]
    at = np.flatnonzero(solid)
    lo, hi = np.searchsorted(at, start), np.searchsorted(at, end)
    some = hi > lo
    start, end, lo, hi = start[some], end[some], lo[some], hi[some]
    start, end = at[lo], at[hi - 1] + 1

    def total(mask):
        return np.concatenate([[0], np.cumsum(mask)])

    def has(mask):
        sums = total(mask)
        return sums[end] > sums[start]

    low = _LOWER[flat]
    thrice = np.zeros(len(flat), bool)
    thrice[2:] = letter[2:] & (low[2:] == low[1:-1]) & (low[2:] == low[:-2])
    odd = (has(_SYMBOL[flat]) & has(letter)) | has(thrice)
    spans = [np.stack([start[odd], end[odd]], 1)]
    # single letters (or symbols) with one equal separator between them, four at least
    single = (letter | _SYMBOL[flat]) & ~_GAP[flat]
    lone = single.copy()
    lone[1:] &= ~(alnum[:-1] | single[:-1])
    lone[:-1] &= ~(alnum[1:] | single[1:])
    pos = np.flatnonzero(lone)
    if len(pos) > 3:
        tied = (np.diff(pos) == 2) & _GAP[flat[pos[:-1] + 1]]
        sep = flat[np.minimum(pos + 1, len(flat) - 1)]
        tied[1:] &= ~tied[:-1] | (sep[1:-1] == sep[:-2])
        step = np.diff(np.concatenate([[False], tied, [False]]).astype(np.int8))
        a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        long = b - a >= 3
        spans.append(np.stack([pos[a[long]], pos[b[long]] + 1], 1))
    both = np.concatenate(spans)
    both = both[np.lexsort((-both[:, 1], both[:, 0]))]
    if len(both):
        keep = both[:, 0] >= np.concatenate([[0], np.maximum.accumulate(both[:, 1])[:-1]])
        both = both[keep]
    return both[:, 0], both[:, 1]


def restored(texts: list[str], channel: Channel) -> list[str]:
    """Every text with its suspicious stretches replaced by their cheapest readings."""
    if any(len(t) > CHUNK_BYTES for t in texts):
        whole = [cut_text(t) for t in texts]
        read = iter(restored([p for ps in whole for p in ps], channel))
        return ["".join([next(read) for _ in ps]) for ps in whole]
    out: list[str] = []
    for a, b in chunks(texts):
        flat, offsets = codes(texts[a:b])
        start, end = stretches(flat)
        owner = np.searchsorted(offsets, start, "right") - 1
        cuts = np.searchsorted(owner, np.arange(b - a + 1))
        for i in range(b - a):
            text = texts[a + i]
            if cuts[i] < cuts[i + 1]:
                parts, done = [], 0
                for s, e in zip((start[cuts[i] : cuts[i + 1]] - offsets[i]).tolist(), (end[cuts[i] : cuts[i + 1]] - offsets[i]).tolist()):
                    parts += [text[done:s], channel.restore(text[s:e])]
                    done = e
                text = "".join([*parts, text[done:]])
            out.append(text)
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of every feature (words and beginnings, letters doubled in the word counted once), and the
    number of words of each text."""
    flat, offsets = codes(texts)
    letter = _LETTER[flat]
    low = _LOWER[flat]
    before = np.concatenate([[False], letter[:-1]])
    same = np.zeros(len(flat), bool)
    same[1:] = letter[1:] & letter[:-1] & (low[1:] == low[:-1])
    place = np.concatenate([[0], np.cumsum(letter & ~same)])
    first = np.flatnonzero(letter & ~before)
    last = np.flatnonzero(before & ~letter)
    kept = low[letter & ~same]
    total = np.zeros(len(kept) + 1, np.uint64)
    np.cumsum(_RANDOM[kept] * _powers(_BASE, len(kept)), out=total[1:])
    back = _powers(_BASE_INV, len(kept) + 1)
    s, e = place[first], place[last]
    owner = np.searchsorted(offsets, first, "right") - 1
    texts_of, hashes = [owner], [mix64((total[e] - total[s]) * back[s])]
    for n in STARTS:
        long = e - s > n
        texts_of.append(owner[long])
        hashes.append(mix64((total[s[long] + n] - total[s[long]]) * back[s[long]] + np.uint64(n)))
    return np.concatenate(texts_of), np.concatenate(hashes), np.bincount(owner, minlength=len(texts))


def distinct_features(texts: list[str]):
    """For ranges of texts: the range, text number within it and hash of every distinct feature, and the numbers of words."""
    for a, b in chunks(texts):
        if b - a == 1:
            found = [features([p]) for p in cut_text(texts[a])]
            h = np.unique(np.concatenate([np.unique(f[1]) for f in found]))
            yield a, b, np.zeros(len(h), np.int64), h, np.array([sum(int(f[2].sum()) for f in found)])
        else:
            owner, h, n = features(texts[a:b])
            order = np.lexsort((h, owner))
            owner, h = owner[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
            yield a, b, owner[new], h[new], n


def log_odds(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    p = (toxic + PRIOR * share) / (toxic + clean + PRIOR)
    return np.log(p / (1 - p)) - math.log(share / (1 - share))


def summaries(texts: list[str], keys: np.ndarray, weights: np.ndarray, which: np.ndarray) -> np.ndarray:
    """For each text: its three largest weights (0 where fewer) over distinct features, and the log of its word count.
    weights has a column for each way of counting; which names the column for each text."""
    out = np.zeros((len(texts), 4))
    for a, b, who, h, n in distinct_features(texts):
        out[a:b, 3] = np.log1p(n)
        if not len(keys) or not len(h):
            continue
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        who, what = who[hit], at[hit]
        w = weights[what, which[a:b][who]]
        order = np.lexsort((-w, who))
        who, w = who[order], w[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        top = (rank < 3) & (w > 0)
        out[a + who[top], rank[top]] = w[top]
    return out


def _strings(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def fit(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> dict:
    """docs (text) gives the character model, labelled (doc_id, text, toxic) the classifier."""

    def count_chars(batches):
        counts = np.zeros(SIZE**3, np.int64)
        for batch in sliced(batches):
            counts += trigrams(_strings(batch.column("text")))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), "n": counts[at]})

    counts = np.zeros(SIZE**3)
    grams = docs.select("text").mapInArrow(count_chars, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    for r in grams.toLocalIterator():
        counts[r[0]] = r[1]
    costs = char_costs(counts)
    model = {"costs": costs, "keys": np.zeros(0, np.uint64), "weights": np.zeros((0, 3)), "line": np.zeros(5), "share": 0.0}

    labelled = labelled.where("toxic IS NOT NULL")
    size = labelled.count()
    chance = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    train = labelled.where(chance < sample / max(size, 1)).select("text", "toxic")

    def restore(batches):
        channel = Channel(costs)
        for batch in sliced(batches):
            texts = restored(_strings(batch.column("text")), channel)
            yield pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "toxic": batch.column("toxic").cast(pa.int32())})

    train = written(train.mapInArrow(restore, "text string, toxic int"), "toxicity-sample")
    sizes = {r[0]: r[1] for r in train.groupBy((F.col("toxic") > 0).alias("y")).count().collect()}
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    if not bad or not good:
        return model | {"share": bad / (bad + good) if bad + good else 0.0}
    share = bad / (bad + good)

    def toxic_features(batches):
        for batch in sliced(batches):
            texts = _strings(batch.column("text"))
            for _, _, _, h, _ in distinct_features(texts):
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "n": n.astype(np.int64)})

    common = train.where("toxic > 0").mapInArrow(toxic_features, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    common = common.where(F.col("n") >= LEAST_TOXIC).select("h")
    keys = np.sort(np.fromiter((r[0] for r in common.toLocalIterator()), np.int64).view(np.uint64))

    def count_features(batches):
        sums = np.zeros((2, len(keys)), np.int64)
        for batch in sliced(batches):
            texts, y = _strings(batch.column("text")), batch.column("toxic").to_numpy() > 0
            for a, b, owner, h, _ in distinct_features(texts):
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                hit = keys[at] == h
                np.add.at(sums, (y[a:b][owner[hit]].astype(int), at[hit]), 1)
        at = np.flatnonzero(sums.sum(0))
        yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), "bad": sums[1, at], "good": sums[0, at]})

    tables = np.zeros((2, len(keys)))
    if len(keys):
        for r in train.mapInArrow(count_features, "at int, bad long, good long").groupBy("at").agg(F.sum("bad"), F.sum("good")).toLocalIterator():
            tables[:, r[0]] = r[1], r[2]
    t, c = tables
    strong = log_odds(t, c, share) >= LEAST_ODDS
    keys, t, c = keys[strong], t[strong], c[strong]
    weights = np.stack([log_odds(t, c, share), log_odds(t, np.maximum(c - 1, 0), share), log_odds(np.maximum(t - 1, 0), c, share)], 1)

    def summarise(batches):
        for batch in sliced(batches):
            y = batch.column("toxic").to_numpy() > 0
            x = summaries(_strings(batch.column("text")), keys, weights, 1 + y.astype(int))
            yield pa.RecordBatch.from_pydict({**{f"x{i}": x[:, i] for i in range(4)}, "y": y.astype(float)})

    rows = train.mapInArrow(summarise, "x0 double, x1 double, x2 double, x3 double, y double")
    x = np.array([tuple(r) for r in rows.toLocalIterator()])
    return model | {"keys": keys, "weights": weights, "line": logistic(x[:, :4], x[:, 4]), "share": share}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients and intercept by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, eye = np.zeros(x.shape[1]), np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * eye, x.T @ (y - p) - ridge * w)
        w = w + move
        if np.abs(move).max() < 1e-9:
            break
    return w


@lru_cache(maxsize=1)
def _channel(data: bytes) -> Channel:
    return Channel(np.frombuffer(data, np.float32))


MODELS.append(_channel)


def _probabilities(texts: list[str], m: dict) -> np.ndarray:
    if not len(m["keys"]):
        return np.full(len(texts), m["share"])
    x = summaries(restored(texts, _channel(m["costs"])), m["keys"], m["weights"], np.zeros(len(texts), int))
    return 1 / (1 + np.exp(-np.clip(x @ m["line"][:4] + m["line"][4], -30, 30)))


def _sent(docs: DataFrame, model: dict):
    return docs.sparkSession.sparkContext.broadcast(model | {"costs": model["costs"].tobytes()})


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, predicted (1 from 0.5 on); one row per row of docs."""
    held = _sent(docs, model)

    def run(batches):
        for batch in sliced(batches, keeps=_channel):
            p = _probabilities(_strings(batch.column("text")), held.value)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": p, "predicted": (p >= 0.5).astype(np.int32)})

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, score double, predicted int")


def screen(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs with a score under 0.5."""
    held = _sent(docs, model)

    def run(batches):
        for batch in sliced(batches, keeps=_channel):
            yield batch.filter(pa.array(_probabilities(_strings(batch.column("text")), held.value) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def labelled_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of a hashed sample of labels of about twice the size that `fit` takes."""
    labels = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = labels.count()
    chance = F.pmod(F.xxhash64("doc_id", F.lit("labels")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    picked = labels.where(chance < 2 * sample / max(size, 1))
    return docs.select("doc_id", "text").join(small(picked), "doc_id")


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> dict:
    """The model as op4 and the pipeline fit it: labels only of rows whose crc32(doc_id) mod 5 is not 0."""
    return fit(docs, labelled_documents(docs, labels.where(crc_mod("doc_id", 5) != 0)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, train(spark, docs, labels))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
