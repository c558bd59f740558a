"""Language identification by error-correcting output codes.

Every learned language gets a codeword of bits; each bit has a binary classifier over byte n-grams (log-odds
between the languages whose bit is 1 and those whose bit is 0); decoding picks the codeword with the least weighted
logistic loss, where the weight of a bit for a language is how often the bit's classifier was right on it.

Defined cases: null text, or text without a letter, is ``und`` with score 0; without any learnable row every text
is ``und``; ties go to the alphabetically first language; a null doc_id counts as not held out; repeated rows are
predicted alike; a very long text is read in parts that overlap by an n-gram; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, byte_texts, chunks, crc_mod, sliced, table, written

ORDERS, BUCKETS = 4, 1 << 13
#: Expected number of documents per language that the classifiers are fitted on.
SAMPLE_PER_LANGUAGE = 1500
#: How much of a summed log-odds counts: neighbouring n-grams repeat each other's evidence.
TEMPER = 0.1
#: A decoding whose two best languages are nearer than this in probability is ambiguous.
AMBIGUOUS = 0.5


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1/-1: all distinct splits for up to 6 languages, else the best of many random codes."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= 6:
        splits = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(splits, float).T
    rng, bits, best = np.random.default_rng(seed), 10 * math.ceil(math.log2(n)), None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        gap = min((bits - np.max((code @ code.T)[i, :i])) for i in range(1, n))
        if best is None or gap > best[0]:
            best = (gap, code)
    return best[1]


def ngrams(texts: list[bytes]):
    """For each order, the bucket of the n-gram at each byte; and the start and length of each text. A window
    that starts in a text never reaches the next one."""
    pad = b" " * (ORDERS - 1)
    flat = np.frombuffer(pad.join([t.lower() for t in texts]) + pad, np.uint8).astype(np.uint32)
    lengths = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths + ORDERS - 1)[:-1]])
    h, out = np.zeros(len(flat), np.uint32), []
    for k in range(ORDERS):
        shifted = flat if k == 0 else np.concatenate([flat[k:], np.full(k, 32, np.uint32)])
        h = (h + shifted + np.uint32(1)) * np.uint32(0x9E3779B1)
        out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(19))
    return out, starts, lengths


def bit_scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Tempered log-odds of every bit for every text."""
    out = np.zeros((len(texts), weights.shape[1]))
    for a, b in chunks(texts):
        if b - a == 1:
            out[a] = sum(_bit_sums([texts[a][i : i + CHUNK_BYTES + ORDERS - 1]], weights, CHUNK_BYTES)[0] for i in range(0, len(texts[a]), CHUNK_BYTES))
        else:
            out[a:b] = _bit_sums(texts[a:b], weights)
    return out * TEMPER


def _bit_sums(texts: list[bytes], weights: np.ndarray, most: int | None = None) -> np.ndarray:
    """Sums over the n-grams that begin at the bytes of each text, of the first `most` bytes where that is given."""
    out = np.zeros((len(texts), weights.shape[1]))
    grams, starts, lengths = ngrams(texts)
    inside = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(inside)) + inside * (ORDERS - 1)
    full = np.flatnonzero(lengths)
    if len(full):
        first = (starts - np.arange(len(texts)) * (ORDERS - 1))[full]
        for g in grams:
            out[full] += np.add.reduceat(weights[g[at[:most]]], first, axis=0)
    return out


def decode(scores: np.ndarray, code: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """Probability of every language from the weighted logistic losses to its codeword."""
    z = np.clip(scores[:, None, :] * code[None, :, :], -500, 500)
    loss = (trust[None] * np.logaddexp(0, -z)).sum(2)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    return p / p.sum(1, keepdims=True)


def fit(train: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> dict:
    """Learns from (doc_id, text, lang); rows with null text or lang are ignored. A language with more rows is
    sampled by a hash of doc_id down to `sample_per_language` rows in expectation."""
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    code = codebook(len(langs))
    model = {"langs": langs, "code": code, "weights": None, "trust": None}
    if len(langs) < 2:
        return model
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample_per_language / sizes[k]))])
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    place = F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, i)])
    sample = written(train.where(chance < share[F.col("lang")]).select(place[F.col("lang")].alias("cls"), "text"), "langid-sample")
    n = len(langs)

    def count(batches):
        sums = np.zeros((n, BUCKETS), np.int64)
        for batch in sliced(batches):
            texts, cls = byte_texts(batch.column("text")), batch.column("cls").to_numpy()
            for a, b in chunks(texts):
                step = CHUNK_BYTES if b - a == 1 else max(1, max(map(len, texts[a:b])))
                for i in range(0, max(1, len(texts[a])) if b - a == 1 else 1, step):  # a long text is counted in parts
                    grams, starts, lengths = ngrams([t[i : i + step + ORDERS - 1] for t in texts[a:b]])
                    inside = np.repeat(np.arange(b - a), lengths)
                    at = np.arange(len(inside)) + inside * (ORDERS - 1)
                    if b - a == 1:
                        inside, at = inside[:step], at[:step]
                    for g in grams:
                        sums += np.bincount(cls[a:b][inside] * BUCKETS + g[at], minlength=n * BUCKETS).reshape(n, BUCKETS)
        c, f = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"cls": c.astype(np.int32), "feature": f.astype(np.int32), "n": sums[c, f]})

    counts = np.zeros((n, BUCKETS))
    for r in sample.mapInArrow(count, "cls int, feature int, n long").groupBy("cls", "feature").agg(F.sum("n")).collect():
        counts[r[0], r[1]] = r[2]
    share_of = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    up, down = (code > 0).astype(float), (code < 0).astype(float)
    weights = (np.log((up / up.sum(0)).T @ share_of) - np.log((down / down.sum(0)).T @ share_of)).T.astype(np.float32)

    def judge(batches):
        right = np.zeros((n, code.shape[1] + 1))
        for batch in sliced(batches):
            cls = batch.column("cls").to_numpy()
            ok = bit_scores(byte_texts(batch.column("text")), weights) * code[cls] > 0
            np.add.at(right, cls, np.column_stack([ok, np.ones(len(cls))]))
        c, k = np.nonzero(right)
        yield pa.RecordBatch.from_pydict({"cls": c.astype(np.int32), "bit": k.astype(np.int32), "n": right[c, k]})

    right = np.zeros((n, code.shape[1] + 1))
    for r in sample.mapInArrow(judge, "cls int, bit int, n double").groupBy("cls", "bit").agg(F.sum("n")).collect():
        right[r[0], r[1]] = r[2]
    trust = (right[:, :-1] + 1) / (right[:, -1:] + 2)
    return model | {"weights": weights, "trust": trust / trust.mean(1, keepdims=True)}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, margin (best minus second probability), ambiguous; one row per row of docs."""
    langs, code, weights, trust = (model[k] for k in ("langs", "code", "weights", "trust"))

    def run(batches):
        for batch in sliced(batches):
            texts, letter = byte_texts(batch.column("text")), np.array(batch.column("letter").to_pylist(), bool)
            size = len(texts)
            if not langs:
                p = np.zeros((size, 1))
            elif weights is None:
                p = np.ones((size, 1))
            else:
                p = decode(bit_scores(texts, weights), code, trust)
            best = p.argmax(1) if size else np.zeros(0, int)
            top = np.sort(p, 1)
            margin = top[:, -1] - (top[:, -2] if top.shape[1] > 1 else 0)
            known = letter & bool(langs)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "lang_pred": pa.array([langs[b] if k else "und" for b, k in zip(best, known)], pa.string()),
                "score": np.where(known, top[:, -1], 0.0),
                "margin": np.where(known, margin, 0.0),
                "ambiguous": ~known | (margin < AMBIGUOUS),
            })

    key = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letter"))
    return rows.mapInArrow(run, f"doc_id {key}, lang_pred string, score double, margin double, ambiguous boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(crc_mod("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    out = predict(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "ambiguous")
