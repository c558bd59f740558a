"""Near-duplicates by b-bit MinHash.

A text's set holds its distinct five-word shingles (64-bit hashes of them). Texts with equal sets collapse to one
representative first. Each set keeps 256 minima: 48 bands of 5 minima make the candidate buckets, and the two lowest
bits of all minima, packed as two bit planes, give a collision-corrected estimate of similarity by bit counts. What the
estimate lets through (five standard deviations below the threshold) is confirmed on the full sets.

A bucket is never expanded into all its pairs. Its members are compared with one pivot, the member that shares buckets with
most others; the links found are closed into components; in buckets that still hold several components the members outside
the largest one are compared with the members of other components, by their packed bits and by maps of 2,048 bits in which
each set marks its hashes: where more bits differ than elements may, there is no link. Pairs within one component change nothing and aren't compared. Only pairs
that the estimate lets through leave a bucket; each full set is made once for them. Buckets, pivots, components and groups of
copies that hold very many rows are dealt over several tasks. A pair at exactly the threshold shares no band with a chance
of 2e-6.

Defined cases: empty and null texts have no set, are linked with nothing and kept; texts of fewer than five words are one
shingle; a very long text is worked through in parts of bounded size (its set is as large as the text asks for); of rows that
share a doc_id each is judged by its own text; a null doc_id is linked with nothing and kept; repeated rows are copies; other
columns of the input are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import CHUNK_BYTES, byte_texts, chunks, dealt, mix64, parts, sliced, small, table, text_print, word_bounds, word_hashes, written

SHINGLE = 5
#: Bytes from which on a word stands as its digest.
LONG_WORD = 1 << 16
_LONG_WORDS = re.compile(rb"[^\x20\x09-\x0D]{%d,}" % LONG_WORD)
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
HASHES, BANDS, ROWS = 256, 48, 5
#: Bits of the map that a set's hashes are marked in.
MARKS = 2048
#: Five standard deviations of a 256-minima, 2-bit estimate below 0.75.
LEAST_ESTIMATE = 0.585
_GEN = np.random.Generator(np.random.PCG64(3))
_MUL = _GEN.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _GEN.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shortened(text: bytes) -> bytes:
    """Lower-cased; words beyond LONG_WORD bytes stand as their 128-bit digest, so that any long text can be cut between words."""
    text = text.lower()
    return _LONG_WORDS.sub(lambda m: xxhash.xxh3_128_hexdigest(m[0]).encode(), text) if len(text) > LONG_WORD else text


def shingle_sets(texts: list[bytes], size: int = SHINGLE):
    """The sorted distinct shingle hashes of each text; a long text is worked through in parts."""
    texts = [shortened(t) for t in texts]
    for a, b in chunks(texts):
        if b - a > 1 or len(texts[a]) <= 2 * CHUNK_BYTES:
            yield from _sets(texts[a:b], size)
            continue
        found, before = [], []
        for part in parts(texts[a]):
            found.append(next(_sets([b" ".join([*before, part])], size)) if len(before) + len(part.split(None, size)) >= size else np.zeros(0, np.uint64))
            before = [*before, *part.split()][1 - size :]
        if before and not any(map(len, found)):
            found = list(_sets([b" ".join(before)], size))
        yield np.unique(np.concatenate(found))


def _sets(texts: list[bytes], size: int):
    flat = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts, ends = word_bounds(flat)
    h = word_hashes(flat, starts, ends)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(starts, offsets)
    x = h[: max(0, len(h) - size + 1)].copy()
    for k in range(1, size):
        x = (x ^ (x >> np.uint64(29))) * _STEP + h[k : k + len(x)]
    x = mix64(x)
    for lo, hi in zip(first[:-1], first[1:]):
        if hi - lo >= size:
            yield np.unique(x[lo : hi - size + 1])
        elif hi > lo:
            y = np.uint64(hi - lo)
            for w in h[lo:hi]:
                y = np.uint64((int(y ^ (y >> np.uint64(29))) * int(_STEP) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            yield mix64(np.array([y]))
        else:
            yield np.zeros(0, np.uint64)


def minima(s: np.ndarray) -> np.ndarray:
    """The 256 minima of one set."""
    x, out = (s ^ (s >> np.uint64(32))).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(out, (x[i : i + 512, None] * _MUL + _ADD).min(0), out=out)
    return out


def _lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(np.arange(0, n * k + 1, k, dtype=np.int32), values.reshape(-1).view(np.int64))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, two prints of the text (`_p`, `_q`), text: what tells the texts of one doc_id apart."""
    return docs.select("doc_id", *text_print(F.col("text")), "text")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, the prints of the text, n (size of the set), a 128-bit print of the set, the packed bits, the band keys and the
    map of the set."""

    def run(batches):
        for batch in sliced(batches):
            texts = byte_texts(batch.column("text"))
            n, prints, low = np.zeros(len(texts), np.int64), np.zeros((2, len(texts)), np.uint64), np.zeros((len(texts), HASHES), np.uint32)
            marks = np.zeros((len(texts), MARKS), bool)
            for i, s in enumerate(shingle_sets(texts)):
                n[i] = len(s)
                if len(s):
                    prints[0, i], prints[1, i] = mix64(s ^ _STEP).sum(dtype=np.uint64), mix64(s + _STEP).sum(dtype=np.uint64)
                    low[i] = minima(s)
                    marks[i, s & np.uint64(MARKS - 1)] = True
            low ^= low >> np.uint32(16)
            low *= np.uint32(0x7FEB352D)
            low ^= low >> np.uint32(15)
            planes = np.concatenate([np.packbits((low >> np.uint32(k) & np.uint32(1)).astype(bool), axis=1) for k in (0, 1)], axis=1)
            band = low[:, : BANDS * ROWS].reshape(len(texts), BANDS, ROWS).astype(np.uint64)
            keys = np.broadcast_to(mix64(np.arange(BANDS, dtype=np.uint64)), band.shape[:2]).copy()
            for k in range(ROWS):
                keys = mix64(keys * _STEP + band[:, :, k])
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in ("doc_id", "_p", "_q")}, "n": n, "p1": prints[0].view(np.int64), "p2": prints[1].view(np.int64),
                "bits": _lists(np.ascontiguousarray(planes).view(np.uint64)), "bands": _lists(np.ascontiguousarray(keys)), "marks": _lists(np.packbits(marks, axis=1).view(np.uint64)),
            })

    key = docs.schema["doc_id"].dataType.simpleString()
    return identified(docs).mapInArrow(run, f"doc_id {key}, _p long, _q long, n long, p1 long, p2 long, bits array<long>, bands array<long>, marks array<long>")


def full_sets(texts: DataFrame) -> DataFrame:
    """node and the whole set of its text."""

    def run(batches):
        for batch in sliced(batches):
            nodes, sets = batch.column("node"), list(shingle_sets(byte_texts(batch.column("text"))))
            for a, b in chunks(sets, 1 << 18):
                ends = np.cumsum([0, *map(len, sets[a:b])]).astype(np.int32)
                flat = np.concatenate(sets[a:b]).view(np.int64)
                yield pa.RecordBatch.from_pydict({"node": nodes.slice(a, b - a), "members": pa.ListArray.from_arrays(ends, flat)})

    return texts.select("node", "text").mapInArrow(run, "node long, members array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity from two packed signatures: the share of equal 2-bit minima, less what equals by chance."""
    words = HASHES // 64
    off = sum(
        F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]).bitwiseOR(F.col(a)[i + words].bitwiseXOR(F.col(b)[i + words])))
        for i in range(words)
    )
    return ((HASHES - off) / F.lit(float(HASHES)) - 0.25) / 0.75


def may_link() -> Column:
    """For rows with n, bits of both sides: sizes and estimate allow a link."""
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT
    return sizes & (estimate("bits_a", "bits_b") >= LEAST_ESTIMATE)


def marks_allow() -> Column:
    """For rows with n, marks of both sides: no more bits differ than elements may. Each bit that one map alone has stands for
    an element that one set alone has, so this drops no link."""
    differ = F.aggregate(F.zip_with("marks_a", "marks_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return differ * (100 + PERCENT) <= (F.col("n_a") + F.col("n_b")) * (100 - PERCENT)


def _counted(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("rows"))


def likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those (a, b), a being the side that may recur very often, whose sizes and estimate allow a link; and the estimate."""
    side = {x: reps.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab"}
    both = dealt(pairs, side["a"], ["a"], _counted(pairs, "a"), "b").join(side["b"], "b")
    return both.where(may_link()).select("a", "b")


def confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those (a, b) of a written table whose full sets are similar enough, as (u, v). Each set is made once."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = written(reps.select("node", "doc_id", "_p", "_q").join(nodes, "node", "left_semi"), "candidates")
    texts = identified(docs).join(small(wanted), ["doc_id", "_p", "_q"])
    if wanted.count() < texts.count():  # repeated rows
        texts = texts.groupBy("node").agg(F.any_value("text").alias("text"))
    sets = written(full_sets(texts), "sets")
    a = sets.select(F.col("node").alias("a"), F.col("members").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("members").alias("set_b"))
    both = dealt(pairs, a, ["a"], _counted(pairs, "a"), "b").join(b, "b")
    return both.where(similar("set_a", "set_b")).select(F.col("a").alias("u"), F.col("b").alias("v"))


def similar(a: str, b: str) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return 100 * shared >= PERCENT * (F.size(a) + F.size(b) - shared)


def links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, root) over representatives: reps has one row per distinct set; nodes linked with nothing are absent."""
    bands = reps.select("node", F.explode("bands").alias("key"))
    buckets = written(bands.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "buckets")
    members = written(dealt(bands, buckets.select("key", F.col("rows").alias("size")), ["key"], buckets, "node"), "members")
    # the pivot of a bucket is the member that meets most others: of copies with changes, one that was changed least
    met = members.groupBy("node").agg(F.sum("size").alias("met"))
    pivots = members.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("pivot")).select("key", F.col("pivot.node").alias("a"))
    star = dealt(members.select("key", "node"), pivots, ["key"], buckets, "node")
    star = written(star.where("node <> a").select("a", F.col("node").alias("b")).distinct(), "pairs")
    roots = components(confirm(written(likely(star, reps), "pairs"), docs, reps))
    # what is left: buckets that still hold several components. First the likeliest partner of a member in each other
    # component is confirmed, then all likely partners in those that are still others
    for likeliest in (True, False):
        pairs = written(_across(members, roots, reps, likeliest), "pairs")
        if pairs.isEmpty():
            break
        more = confirm(pairs, docs, reps)
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    return roots


def _across(members: DataFrame, roots: DataFrame, reps: DataFrame, likeliest: bool) -> DataFrame:
    """(a, b) of different components that share a bucket and may link. In a bucket the component with most members is
    compared with the others only, so one large component costs as many comparisons as there are others' members."""
    known = members.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = known.groupBy("key", "root").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("rows"), F.count("*").alias("roots"))
    open_ = written(open_.where("roots > 1").select("key", F.col("main.root").alias("main"), "rows"), "open-buckets")
    live = dealt(known, open_.select("key", "main"), ["key"], open_, "node")
    live = written(live.join(reps.select("node", "n", "bits", "marks"), "node"), "live")
    others = live.where("root <> main").drop("main")
    left, right = (rows.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "n", "bits", "marks"))) for rows, side in ((live, "a"), (others, "b")))
    found = dealt(left, right, ["key"], open_, "node_a").where(F.expr("root_a <> root_b") & may_link() & marks_allow())
    if not likeliest:
        return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    best = found.groupBy("node_b", "root_a").agg(F.max(F.struct(estimate("bits_a", "bits_b").alias("e"), "node_a")).alias("best"))
    return best.select(F.least("best.node_a", "node_b").alias("a"), F.greatest("best.node_a", "node_b").alias("b")).distinct()


def judged(docs: DataFrame) -> DataFrame:
    """For each row its doc_id, the prints of its text, n_shingles and component_id."""
    signed = written(signatures(docs), "signatures")
    real = signed.where("n > 0 AND doc_id IS NOT NULL")
    # one representative for each distinct set, and how many rows have it
    firsts = real.groupBy("p1", "p2", "n").agg(
        F.min(F.struct("doc_id", "_p", "_q")).alias("first"), F.any_value("bits").alias("bits"), F.any_value("bands").alias("bands"), F.any_value("marks").alias("marks"), F.count("*").alias("rows")
    )
    reps = written(firsts.select(F.monotonically_increasing_id().alias("node"), "first.*", "p1", "p2", "n", "bits", "bands", "marks", "rows"), "representatives")
    roots = written(links(docs, reps), "components")
    placed = written(reps.select("node", "doc_id", "p1", "p2", "n", "rows").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    least = written(placed.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")), "least")
    place = dealt(placed.drop("doc_id"), least.drop("rows"), ["root"], least, "node").select("p1", "p2", "n", "component_id")
    mine = signed.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "_p", "_q", "n", "p1", "p2")
    grouped = dealt(mine, place, ["p1", "p2", "n"], reps.select("p1", "p2", "n", "rows"), "doc_id")
    alone = signed.where("NOT (n > 0 AND doc_id IS NOT NULL)").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "_p", "_q", F.col("n").alias("n_shingles"), "component_id"]
    return grouped.select(*columns).unionByName(alone.select(*columns))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included), kept; one row per row."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return judged(docs).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
