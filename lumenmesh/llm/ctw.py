"""Language-model scoring by context-tree weighting over bytes.

Every byte is eight binary decisions; each decision of the byte tree has its own tree of contexts, the last 0 to 5 bytes.
A context's zeros and ones give a Krichevsky-Trofimov estimate; from the leaves up, a node's weighted probability is the
mean of its own estimate and the product of its children's, which fixes how much of a prediction each depth gives. After
training the tree is frozen, so a byte's code length depends on its context only: distinct 6-grams are looked up once.

Counts are taken over all training texts and the tree grows with them: it keeps every context that occurs LEAST times,
however large the corpus is. The rest of a node's counts form one further child, which predicts for contexts that aren't
kept, so that all probabilities still sum to one. Subtrees are weighted by the executors; the finished tree lies in files,
which executors fetch and map, so that no process holds it whole.

Beside it stands a unigram base over words: word counts are summed in a shuffle; words that make up at least 1/MOST_WORDS
of all tokens are sent to the executors, all others are joined.

Defined cases: null is the empty text, which has the end token only; without training texts a byte has the probability
1/256 and base counts are zero; rows that share a doc_id are scored each, repeated rows alike; a very long text is read in
parts, with the bytes before as context; a null doc_id is scored and counts as training; other columns are ignored.
"""

from __future__ import annotations

import fcntl
import hashlib
import os
import shutil
from functools import lru_cache
from math import lgamma

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, chunks, crc_mod, forget, parts, sliced, table, word_bounds, word_hashes, written

DEPTH = 5
#: Occurrences from which on a context is kept.
LEAST = 16
MOST_WORDS = 1 << 21
ROWS_OF_A_FILE = 4_000_000
#: Ends a text and fills the context before it; never a byte of UTF-8.
END = 0xFF
#: Stands for the end token among word hashes.
END_WORD = np.uint64(0x454E44)
_CHUNK = 1 << 19


def grams(texts: list[bytes], depth: int = DEPTH, before: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The depth + 1 bytes up to every position, packed with the predicted byte lowest, and the number of positions of each
    text (its bytes and its end). before: what the first text follows, where it isn't the beginning."""
    fill = bytes([END]) * max(depth, 1)
    flat = np.frombuffer((fill[:depth] if before is None else before) + b"".join(t + fill for t in texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    packed = np.zeros(len(flat) - depth, np.uint64)
    for k in range(depth + 1):
        packed |= flat[depth - k : len(flat) - k].astype(np.uint64) << np.uint64(8 * k)
    if depth > 1:  # of the fill after a text only the first byte is predicted
        inside = np.ones(len(packed), bool)
        ends = np.cumsum(lengths + len(fill)) - len(fill)
        for k in range(1, depth):
            inside[ends + k] = False
        packed = packed[inside]
    return packed, lengths + 1


def coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and for each value its place among them."""
    d = pa.array(values).dictionary_encode()
    return d.dictionary.to_numpy(zero_copy_only=False), d.indices.to_numpy(zero_copy_only=False)


def cut_grams(text: bytes, depth: int, most: int):
    """The grams of a long text in parts of so many positions."""
    fill = bytes([END]) * depth
    for i in range(0, len(text) + 1, most):
        before = text[max(0, i - depth) : i]
        packed, _ = grams([text[i : i + most]], depth, (fill + before)[len(before) :])
        yield packed if i + most > len(text) else packed[:-1]


def text_logs(texts: list[bytes], tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each text with its end, and its positions."""
    if len(texts) == 1 and len(texts[0]) > 2 * _CHUNK:
        sums = [tree.log10(d)[at].sum() for d, at in map(coded, cut_grams(texts[0], tree.depth, _CHUNK))]
        return np.array([sum(sums)]), np.array([len(texts[0]) + 1])
    packed, n = grams(texts, tree.depth)
    d, at = coded(packed)
    return np.add.reduceat(tree.log10(d)[at], np.concatenate([[0], np.cumsum(n)[:-1]])), n


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and how many each has."""
    flat = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts, ends = word_bounds(flat)
    cuts = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    return word_hashes(flat, starts, ends), np.diff(cuts)


def gathered(train: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, key, n): kind 0 counts byte grams of depth + 1, kind 1 words."""

    def summed(parts):
        keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        d, at = coded(keys)
        return d, np.bincount(at, n, len(d)).astype(np.int64)

    def run(batches):
        held: dict[int, list] = {0: [], 1: []}

        def flush():
            for kind, parts in held.items():
                if parts:
                    d, n = summed(parts)
                    for i in range(0, len(d), 200_000):
                        m = len(d[i : i + 200_000])
                        yield pa.RecordBatch.from_pydict({"kind": np.full(m, kind, np.int32), "key": d[i : i + m].view(np.int64), "n": n[i : i + m]})
                    parts.clear()

        for batch in sliced(batches):
            texts = [t.lower() for t in byte_texts(batch.column("text"))]
            for a, b in chunks(texts, _CHUNK):
                long = b - a == 1 and len(texts[a]) > 2 * _CHUNK
                packed = cut_grams(texts[a], depth, _CHUNK) if long else [grams(texts[a:b], depth)[0]]
                words = (words_of([p])[0] for p in parts(texts[a], _CHUNK)) if long else [words_of(texts[a:b])[0]]
                for kind, keys in (*((0, k) for k in packed), *((1, k) for k in words)):
                    d, at = coded(keys)
                    held[kind].append((d, np.bincount(at, minlength=len(d))))
                held[1].append((np.array([END_WORD]), np.array([b - a])))
                if sum(len(d) for found in held.values() for d, _ in found) > 1_200_000:
                    yield from flush()
        yield from flush()

    rows = train.select("text").mapInArrow(run, "kind int, key long, n long")
    return written(rows.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ngram-counts")


def _log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    distinct = np.unique(np.concatenate([zeros, ones, zeros + ones]))
    half = np.array([lgamma(x + 0.5) for x in distinct]) - lgamma(0.5)
    full = np.array([lgamma(x + 1.0) for x in distinct])
    return half[np.searchsorted(distinct, zeros)] + half[np.searchsorted(distinct, ones)] - full[np.searchsorted(distinct, zeros + ones)]


def _next_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


def _find(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted value among sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(want), int), np.zeros(len(want), bool)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return at, keys[at] == want


def _parent(key: np.ndarray, d: int) -> np.ndarray:
    """The key of the node with the d latest bytes of context."""
    return key & np.uint64((1 << (8 * d + 8)) - 1)


def node_counts(packed: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (context, then the bits of the byte so far, led by a 1) of the binary nodes, with their zeros and ones."""
    context, byte = packed >> np.uint64(8), packed & np.uint64(255)
    keys, zeros, ones = [], [], []
    for k in range(8):
        head = (np.uint64(1) << np.uint64(k)) | (byte >> np.uint64(8 - k))
        bit = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
        d, at = np.unique((context << np.uint64(8)) | head, return_inverse=True)
        keys.append(d)
        zeros.append(np.bincount(at, n * ~bit, len(d)))
        ones.append(np.bincount(at, n * bit, len(d)))
    key = np.concatenate(keys)
    order = np.argsort(key)
    return key[order], np.concatenate(zeros)[order], np.concatenate(ones)[order]


def kept_levels(packed: np.ndarray, n: np.ndarray, first: int, last: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth the packed (context, byte) and counts of the contexts that occur `least` times; the empty one always."""
    out = []
    for d in range(first, last + 1):
        g, at = np.unique(_parent(packed, d), return_inverse=True)
        count = np.bincount(at, n, len(g))
        _, of = np.unique(g >> np.uint64(8), return_inverse=True)
        keep = (np.bincount(of, count)[of] >= least) if d and len(g) else np.ones(len(g), bool)
        out.append((g[keep], count[keep]))
    return out


def bottom_up(nodes: list, first: int, up: np.ndarray | None = None) -> tuple[np.ndarray, list]:
    """nodes: by depth from `first` on. The log weighted probabilities of the first level, and for each level the share of
    its own estimate and what the counts that no kept context below has predict. The last level is that of leaves, unless
    `up` has its weighted probabilities."""
    shares: list = [None] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        key, zeros, ones = nodes[i]
        if i == len(nodes) - 1:
            if up is None:
                up, shares[i] = _log_estimate(zeros, ones), (np.zeros(len(key)), _next_one(zeros, ones))
            continue
        below, size = nodes[i + 1], len(key)
        parent = np.searchsorted(key, _parent(below[0], first + i))
        rest0, rest1 = zeros - np.bincount(parent, below[1], size), ones - np.bincount(parent, below[2], size)
        own = _log_estimate(zeros, ones)
        both = np.logaddexp(own, np.bincount(parent, up, size) + _log_estimate(rest0, rest1))
        up, shares[i] = both - np.log(2), (np.exp(own - both), _next_one(rest0, rest1))
    return up, shares


def top_down(nodes: list, first: int, shares: list, sofar: np.ndarray, left: np.ndarray, leaf: bool) -> tuple[list, np.ndarray, np.ndarray]:
    """The probability of a one where no deeper node applies, by level; and what is so far and left after the last level.
    sofar, left: for the nodes of the first level, from the levels above."""
    out = []
    for i, (key, zeros, ones) in enumerate(nodes):
        if i:
            parent = np.searchsorted(nodes[i - 1][0], _parent(key, first + i - 1))
            sofar, left = sofar[parent], left[parent]
        stop, rest = shares[i]
        if not leaf or i < len(nodes) - 1:
            sofar, left = sofar + left * stop * _next_one(zeros, ones), left * (1 - stop)
        out.append(sofar + left * rest)
    return out, sofar, left


def logit(p: np.ndarray) -> np.ndarray:
    """Log odds: they keep the precision of probabilities near 0 and near 1."""
    return np.log(p) - np.log1p(-p)


def seen_logs(packed: np.ndarray, key: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log10 probability of each packed byte in its context, all of whose nodes are among the keys."""
    out = np.zeros(len(packed))
    context, byte = packed >> np.uint64(8), packed & np.uint64(255)
    for k in range(8):
        p = one[np.searchsorted(key, (context << np.uint64(8)) | (np.uint64(1) << np.uint64(k)) | (byte >> np.uint64(8 - k)))]
        out += np.log10(np.where((byte >> np.uint64(7 - k)) & np.uint64(1) == 1, p, 1 - p))
    return out


class Tree:
    """The frozen, weighted tree. By depth: sorted node keys with the log odds of a one there where no deeper node applies;
    and the sorted bytes seen in the kept contexts with their log10 probability where no deeper context is kept. The arrays
    may be mapped from files."""

    def __init__(self, keys: list, odds: list, seen: list, logs: list) -> None:
        self.depth, self.keys, self.odds, self.seen, self.logs = len(keys) - 1, keys, odds, seen, logs

    @classmethod
    def of(cls, levels: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
        """levels: for each depth, packed (context, byte) and counts of the kept contexts; the whole tree at once."""
        nodes = [node_counts(g, n) for g, n in levels]
        _, shares = bottom_up(nodes, 0)
        size = len(nodes[0][0])
        ones, _, _ = top_down(nodes, 0, shares, np.zeros(size), np.ones(size), True)
        seen = [np.sort(g) for g, _ in levels]
        return cls([x[0] for x in nodes], [logit(o) for o in ones], seen, [seen_logs(g, x[0], o) for g, x, o in zip(seen, nodes, ones)])

    def _by_bits(self, packed: np.ndarray, deepest: int) -> np.ndarray:
        """log10 probability of each packed byte given its context, bit by bit from the deepest node there is."""
        out = np.zeros(len(packed))
        context, byte = packed >> np.uint64(8), packed & np.uint64(255)
        for k in range(8):
            key = (context << np.uint64(8)) | (np.uint64(1) << np.uint64(k)) | (byte >> np.uint64(8 - k))
            odds, open_ = np.zeros(len(packed)), np.arange(len(packed))
            for d in range(deepest, -1, -1):
                if not len(open_):
                    break
                at, found = _find(self.keys[d], _parent(key[open_], d))
                odds[open_[found]] = self.odds[d][at[found]]
                open_ = open_[~found]
            bit = (byte >> np.uint64(7 - k)) & np.uint64(1)
            out -= np.logaddexp(0, np.where(bit == 1, -odds, odds)) / np.log(10)
        return out

    def log10(self, packed: np.ndarray) -> np.ndarray:
        """log10 probability of packed bytes: from the deepest kept context of each, bit by bit for bytes never seen there."""
        order = np.argsort(packed)  # neighbours in the arrays are looked up together
        packed = packed[order]
        found_all, open_ = np.zeros(len(packed)), np.arange(len(packed))
        for d in range(self.depth, -1, -1):
            if not len(open_):
                break
            whole = _parent(packed[open_], d)
            at, found = _find(self.seen[d], whole)
            found_all[open_[found]] = self.logs[d][at[found]]
            open_, whole = open_[~found], whole[~found]
            # never seen there, though the context is kept: its first node is there
            _, here = _find(self.keys[d], (whole >> np.uint64(8)) << np.uint64(8) | np.uint64(1))
            if here.any():
                found_all[open_[here]] = self._by_bits(packed[open_[here]], d)
            open_ = open_[~here]
        if len(open_):
            found_all[open_] = self._by_bits(packed[open_], 0)
        out = np.empty(len(packed))
        out[order] = found_all
        return out


def _whole_groups(batches, base: int, most: int = 200_000):
    """Keys and counts of grams, in parts that hold all grams of the same `base` latest bytes of context together."""
    keys, n, held, limit = [], [], 0, most
    for batch in batches:
        keys.append(batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64))
        n.append(batch.column("n").to_numpy(zero_copy_only=False).astype(float))
        held += batch.num_rows
        if held < limit:
            continue
        k, c = np.concatenate(keys), np.concatenate(n)
        group = _parent(k, base) >> np.uint64(8)
        other = np.flatnonzero(group != group[-1])
        cut = other[-1] + 1 if len(other) else 0
        if cut:
            yield k[:cut], c[:cut]
        keys, n, held = [k[cut:]], [c[cut:]], len(k) - cut
        limit = max(most, 2 * held)
    if held:
        yield np.concatenate(keys), np.concatenate(n)


def _rows(level: int, key: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"level": np.full(len(key), level, np.int32), "key": key.view(np.int64), "value": value.astype(np.float32)})


def grow(counts: DataFrame, depth: int = DEPTH, least: int = LEAST) -> tuple[str, ...]:
    """The tree from gathered counts, as files that every executor gets; returns their names, in order.

    The subtrees of contexts that share their two latest bytes are weighted apart, each by one task; only the nodes of these
    two bytes (at most 2^24 whatever the corpus, as there are 2^16 such contexts) go to the driver, which weights the levels
    above and hands down to each subtree what is left for it."""
    spark, base = counts.sparkSession, min(2, depth)
    deep = counts.where("kind = 0").select("key", "n")
    group = (F.shiftright("key", 8)).bitwiseAND((1 << (8 * base)) - 1).alias("g")
    together = deep.select("key", "n", group).repartition("g").sortWithinPartitions("g").select("key", "n")

    def subtree(key, n):
        levels = kept_levels(key, n, base, depth, least)
        nodes = [node_counts(g, c) for g, c in levels]
        return levels, nodes, *bottom_up(nodes, base)

    def weigh(batches):
        for key, n in _whole_groups(batches, base):
            _, nodes, up, _ = subtree(key, n)
            yield pa.RecordBatch.from_pydict({"key": nodes[0][0].view(np.int64), "zeros": nodes[0][1], "ones": nodes[0][2], "up": up})

    found = together.mapInArrow(weigh, "key long, zeros double, ones double, up double").toArrow()
    key = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    key, zeros, ones, up = key[order], *(found.column(c).to_numpy()[order] for c in ("zeros", "ones", "up"))
    sofar, left, above = np.zeros(len(key)), np.ones(len(key)), []
    if base:
        short = deep.groupBy(F.col("key").bitwiseAND((1 << (8 * base)) - 1).alias("key")).agg(F.sum("n").alias("n")).toArrow()
        levels = kept_levels(short.column("key").to_numpy().view(np.uint64), short.column("n").to_numpy().astype(float), 0, base - 1, least)
        nodes = [*(node_counts(g, c) for g, c in levels), (key, zeros, ones)]
        _, shares = bottom_up(nodes, 0, up)
        size = len(nodes[0][0])
        one, sofar, left = top_down(nodes[:-1], 0, shares[:-1], np.zeros(size), np.ones(size), False)
        parent = np.searchsorted(nodes[-2][0], _parent(key, base - 1))
        sofar, left = sofar[parent], left[parent]
        for d, ((g, _), x, o) in enumerate(zip(levels, nodes, one)):
            above += [_rows(2 * d, x[0], logit(o)), _rows(2 * d + 1, g, seen_logs(g, x[0], o))]
    held = spark.sparkContext.broadcast((key, sofar, left))

    def finish(batches):
        key, sofar, left = held.value
        for gram, n in _whole_groups(batches, base):
            levels, nodes, _, shares = subtree(gram, n)
            at = np.searchsorted(key, nodes[0][0])
            one, _, _ = top_down(nodes, base, shares, sofar[at], left[at], True)
            for d, ((g, _), x, o) in enumerate(zip(levels, nodes, one), base):
                yield _rows(2 * d, x[0], logit(o))
                yield _rows(2 * d + 1, g, seen_logs(g, x[0], o))

    schema = "level int, key long, value float"
    rows = together.mapInArrow(finish, schema)
    if above:
        rows = rows.unionByName(spark.createDataFrame(pa.Table.from_batches(above), schema))
    rows = written(rows, "tree-rows")
    files = -(-rows.count() // ROWS_OF_A_FILE) or 1
    ordered = written(rows.repartitionByRange(files, "level", "key").sortWithinPartitions("level", "key"), "tree")
    forget(rows)
    paths = sorted(ordered.inputFiles())
    for path in paths:
        spark.sparkContext.addFile(path)
    return tuple(path.rsplit("/", 1)[-1] for path in paths)


@lru_cache(maxsize=1)
def opened(names: tuple[str, ...], depth: int) -> Tree:
    """The tree of these files, mapped from arrays that the first task on a machine makes of them."""
    root = SparkFiles.getRootDirectory()
    home = os.path.join(root, "tree-" + hashlib.md5(repr((names, depth)).encode()).hexdigest())
    with open(home + ".lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)  # one task makes the arrays, the others wait; the lock ends with its process
        if not os.path.isdir(home):
            made = home + ".new"
            shutil.rmtree(made, ignore_errors=True)
            os.mkdir(made)
            files = {(level, part): open(f"{made}/{level}.{part}", "wb") for level in range(2 * depth + 2) for part in ("key", "value")}
            for name in names:
                for batch in pq.ParquetFile(os.path.join(root, name)).iter_batches(1 << 18):
                    level, key, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("level", "key", "value"))
                    for x in np.unique(level).tolist():
                        here = slice(np.searchsorted(level, x), np.searchsorted(level, x, "right"))
                        files[x, "key"].write(key[here].tobytes())
                        files[x, "value"].write(value[here].tobytes())
            for f in files.values():
                f.close()
            os.rename(made, home)

    def mapped(level, part, kind):
        path = f"{home}/{level}.{part}"
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)

    def each(x, part, kind):
        return [mapped(2 * d + x, part, kind) for d in range(depth + 1)]

    return Tree(each(0, "key", np.uint64), each(0, "value", np.float32), each(1, "key", np.uint64), each(1, "value", np.float32))


def train(docs: DataFrame, depth: int = DEPTH, least: int = LEAST) -> dict:
    """Model of the texts of docs: the files of the tree, and the base's counts."""
    counts = gathered(docs, depth)
    words = counts.where("kind = 1").select(F.col("key").alias("word"), F.col("n").alias("c"))
    tokens, distinct = words.agg(F.sum("c"), F.count("*")).first()
    tokens = tokens or 0
    often = words.where(F.col("c") * MOST_WORDS >= tokens).toArrow()
    key, c = often.column("word").to_numpy(), often.column("c").to_numpy()
    order = np.argsort(key)
    return {"tree": grow(counts, depth, least), "depth": depth, "words": words, "tokens": tokens, "distinct": distinct, "key": key[order], "c": c[order]}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """For every row of docs: its columns but text, then n_tokens, n_known, train_tokens, base_score, score,
    and bits_per_byte (the code length of the text and its end)."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c != "text"]
    held = spark.sparkContext.broadcast({c: model[c] for c in ("tree", "depth", "key", "c")})

    def run(batches):
        m = held.value
        tree, key, c = opened(m["tree"], m["depth"]), m["key"], m["c"]
        for batch in sliced(batches):
            texts = [t.lower() for t in byte_texts(batch.column("text"))]
            for a, b in chunks(texts, _CHUNK):
                part = texts[a:b]
                logs, n = text_logs(part, tree)
                h, size = words_of(part)
                h, size = np.insert(h, np.cumsum(size), END_WORD).view(np.int64), size + 1
                first = np.concatenate([[0], np.cumsum(size)[:-1]])
                d, at = coded(h)
                place = np.minimum(np.searchsorted(key, d), max(len(key) - 1, 0))
                often = (key[place] == d) if len(key) else np.zeros(len(d), bool)
                lg = np.where(often, np.log10(np.where(often, c[place] if len(key) else 1, 0) + 1.0), 0.0)
                known = np.add.reduceat(often[at].astype(np.int64), first)
                rare = np.flatnonzero(~often[at])
                owner = np.repeat(np.arange(b - a), size)[rare]
                ends = np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row").slice(a, b - a), *(batch.column(f"_k{i}").slice(a, b - a) for i in range(len(keep))),
                     pa.array(size), pa.array(known), pa.array(np.add.reduceat(lg[at], first)), pa.array(logs), pa.array(n),
                     pa.ListArray.from_arrays(ends, h[rare])],
                    ["_row", *(f"_k{i}" for i in range(len(keep))), "_size", "_known", "_base", "_score", "_bytes", "_rare"],
                )

    fields = ", ".join(f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)), "text")
    schema = f"_row long, {fields}, _size long, _known long, _base double, _score double, _bytes long, _rare array<long>"
    scored = written(rows.mapInArrow(run, schema), "scored")
    rare = scored.select("_row", F.explode("_rare").alias("word")).groupBy("_row", "word").agg(F.count("*").alias("tf"))
    found = rare.join(model["words"], "word").select("_row", (F.col("tf") * F.log10(F.col("c") + 1.0)).alias("lg"), "tf")
    more = found.groupBy("_row").agg(F.sum("lg").alias("_lg"), F.sum("tf").alias("_tf"))
    whole = F.log10(F.lit(float(model["tokens"] + model["distinct"] + 1)))
    out = scored.drop("_rare").join(more, "_row", "left")
    return out.select(
        *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)),
        F.col("_size").alias("n_tokens"),
        (F.col("_known") + F.coalesce("_tf", F.lit(0))).alias("n_known"),
        F.lit(model["tokens"]).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_lg", F.lit(0.0)) - F.col("_size") * whole).alias("base_score"),
        F.col("_score").alias("score"),
        (-F.col("_score") * F.log2(F.lit(10.0)) / F.col("_bytes")).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 7) == 2).alias("held_out"))
    return score(docs, train(docs.where("NOT held_out")))
