"""Systematic, even and strided samples of ordered rows, and keyed thinning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def systematic_sample(frames: DataFrame, interval: int, most: int) -> DataFrame:
    """frames: idx (dense from 0). Rows with idx % interval = 0, the first `most` of them, numbered from 0. The number follows
    from idx, so nothing is sorted."""
    kept = F.floor(F.col("idx") / interval).cast("long")
    return frames.where((F.col("idx") % interval == 0) & (kept < most)).withColumn("saved_index", kept)


def default_interval(fps: float) -> int:
    """Half a second of frames, rounded half to even, at least 1."""
    return max(1, round(fps / 2))


def default_most(total: int, interval: int) -> int:
    return math.ceil(total / interval)


def even_positions(n: int, most: int) -> list[int]:
    """At most `most` of n positions, evenly spread: the middle one for a single one, else rounded half to even."""
    if most <= 0 or n <= 0:
        return []
    if n <= most:
        return list(range(n))
    if most == 1:
        return [n // 2]
    return sorted({round(i * (n - 1) / (most - 1)) for i in range(most)})


def even_sample(values: DataFrame, column: str, most: int) -> DataFrame:
    """The even sample of the distinct values of a column in ascending order. Ranks come from counts by value, summed in a
    prefix; the list of values is that of a catalogue (frames of a clip), so one window holds it."""
    ordered = values.select(column).distinct().withColumn("pos", F.row_number().over(W.orderBy(column)) - 1)
    n = ordered.agg(F.count("*").alias("n"))
    at = ordered.crossJoin(F.broadcast(n))
    if most <= 0:
        return at.where("1 = 0").select(column)
    if most == 1:
        return at.where("n = 1 OR pos = floor(n / 2)").select(column)
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.rint(i * (F.col("n") - 1) / (most - 1)).cast("int"))
    return at.where((F.col("n") <= most) | F.array_contains(picked, F.col("pos"))).select(column)


def linspace_positions(n: int, most: int) -> list[int]:
    """min(n, most) positions from 0 to n - 1, truncated, in integer arithmetic."""
    m = min(n, most)
    return [0] if m == 1 else [i * (n - 1) // (m - 1) for i in range(m)]


def strided(rows: DataFrame, position: str, k: int, n: int | None = None) -> DataFrame:
    """Every max(1, n // k)-th position, k of them; n is the number of rows unless it is given."""
    step = max(1, (rows.count() if n is None else n) // k)
    return rows.where((F.col(position) % step == 0) & (F.col(position) < step * k))


def hashed_sample(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """The k rows with the smallest seeded hash of the key: the same for any partitioning."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(k)


def first_faces(faces: DataFrame, most: int) -> DataFrame:
    """The faces with the `most` smallest ids, their vertices numbered densely from 1 in order of the old ids."""
    kept = faces.orderBy("fid").limit(most)
    corner = kept.select("fid", F.posexplode(F.array("v0", "v1", "v2")).alias("pos", "vid"))
    ids = corner.select("vid").distinct().withColumn("new", F.row_number().over(W.orderBy("vid")).cast("long"))
    return corner.join(ids, "vid").groupBy("fid").agg(*(F.max(F.when(F.col("pos") == i, F.col("new"))).alias(f"v{i}") for i in range(3)))
