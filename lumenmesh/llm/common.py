"""What the operators of this subpackage share: tables, shared folders, checked broadcasts, text batches."""

from __future__ import annotations

import ctypes
import gc
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LIBC = ctypes.CDLL(None)
if hasattr(_LIBC, "mallopt"):
    # arrays beyond those of a chunk go back to the system when freed (M_MMAP_THRESHOLD), up to 64 MB of smaller ones are kept
    # for the next chunk (M_TRIM_THRESHOLD), and threads share an arena (M_ARENA_MAX)
    _LIBC.mallopt(-3, 8 << 20)
    _LIBC.mallopt(-1, 64 << 20)
    _LIBC.mallopt(-8, 1)
#: White space that separates words: space and \x09-\x0D.
SPACE = "[\\x20\\x09-\\x0D]"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Rows whose keys may be broadcast; beyond it, the joins below are shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that one vectorised step works on; longer texts are worked on in parts.
CHUNK_BYTES = 1 << 18
#: Rows of one key in one task of a `dealt` join.
HOT_ROWS = 2000
#: Caches of what operators load in a Python worker; see `sliced`.
MODELS: list = []


def put(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a file to the shared folder and has Spark send it to every executor; returns its path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        for i in range(0, len(data), 1 << 20):
            stream.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        stream.close()
    return path.toString()


_equipped: set[str] = set()


def equip(spark: SparkSession) -> None:
    """Once a context: sends this package to Python workers, which may not find it on their own path, and keeps Arrow batches
    small."""
    context = spark.sparkContext
    if context.applicationId in _equipped:
        return
    _equipped.add(context.applicationId)
    # texts may be long: batches between the JVM and Python are kept small where the session has no wish of its own
    for key, ours in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "8388608")):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, ours)
    root, held = Path(__file__).parents[1], io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    context.addPyFile(put(spark, f"{root.name}-{uuid.uuid4().hex}.zip", held.getvalue()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    equip(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a session on one machine gets one of its own; on a
    cluster that is an error, as a local folder isn't shared."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df, cut from its lineage by a table in the shared folder, which is deleted when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a `written` table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (of fixed-width columns), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dealt(many: DataFrame, one: DataFrame, keys: list[str], counts: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """many joined with one, which has few rows of a key, where a key may hold a large part of many.

    counts: (keys, `rows`) of many, at least for the keys with most rows. Keys of more than HOT_ROWS rows (or of so many that
    there are half a million such keys at most) are dealt, by the column `by`, over as many tasks as they need; one's rows
    are copied for these. Only the list of such keys is broadcast."""
    hot = counts.where(F.col("rows") > HOT_ROWS).select(*keys, F.col("rows").alias("_rows"))
    n, rows = hot.agg(F.count("*"), F.sum("_rows")).first()
    if not n:
        return many.join(one, keys, how)
    most = HOT_ROWS if n <= 500_000 else rows // 500_000 + 1
    hot = hot.where(F.col("_rows") > most).select(*keys, F.ceil(F.col("_rows") / most).cast("int").alias("_deals"))
    hot = F.broadcast(hot)
    deals = F.coalesce("_deals", F.lit(1))
    left = many.join(hot, keys, "left").withColumn("_deal", F.pmod(F.xxhash64(by), deals).cast("int")).drop("_deals")
    right = one.join(hot, keys, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("_deals")
    return left.join(right, [*keys, "_deal"], how).drop("_deal")


def text_print(c: Column) -> list[Column]:
    """Two 64-bit prints of a text, which tell rows of one doc_id apart."""
    return [F.xxhash64(c).alias("_p"), F.xxhash64(F.lit(1), c).alias("_q")]


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % n, F.lit(-1))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(c: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; none for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def chunks(texts: list, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` characters each; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t)
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def parts(text: bytes, most: int = CHUNK_BYTES, ends: bytes = b" \t\n\v\f\r") -> list[bytes]:
    """A long text in parts of about `most` bytes that end after one of `ends` (where there is one), so that no word is cut;
    together they are the text."""
    out, at = [], 0
    while len(text) - at > 2 * most:
        cut = max(text.rfind(bytes([c]), at + 1, at + most) for c in ends) + 1
        if not cut:
            later = [x for x in (text.find(bytes([c]), at + most) for c in ends) if x >= 0]
            cut = min(later) + 1 if later else len(text)
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]] if at < len(text) or not out else out


def _trim() -> None:
    """Gives free memory back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def sliced(batches, rows: int = 1000, keeps=None):
    """Batches of so many rows at most, so that few texts are copied at a time; at the end the worker gives free memory back,
    as it lives on for other tasks. What tasks of other operators have loaded in this worker goes first: all of MODELS but
    `keeps`."""
    left = [m for m in MODELS if m is not keeps and m.cache_info().currsize]
    for m in left:
        m.cache_clear()
    if left:
        gc.collect()
        _trim()
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    _trim()


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_GEN = np.random.Generator(np.random.PCG64(20))
_BYTE = _GEN.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = int(_GEN.integers(0, 1 << 62, dtype=np.uint64)) * 8 + 5
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
KEPT_POWERS = CHUNK_BYTES + (CHUNK_BYTES >> 2)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; those for texts of usual chunks are kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1) if n > KEPT_POWERS else KEPT_POWERS
        have = np.ones(1, np.uint64)
        while len(have) < size:
            more = have[: size - len(have)]
            have = np.concatenate([have, more * np.uint64(pow(base, len(have), 1 << 64))])
        if size == KEPT_POWERS:
            _POWERS[base] = have
    return have[:n]


def word_bounds(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words in bytes."""
    word = np.concatenate([[False], ~IS_SPACE[flat], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, from one running polynomial over all bytes."""
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE[flat] * _powers(_BASE, len(flat)), out=total[1:])
    return mix64((total[ends] - total[starts]) * _powers(_BASE_INV, len(flat) + 1)[starts] + (ends - starts).astype(np.uint64))
