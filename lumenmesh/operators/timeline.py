"""As-of joins with interpolation over keyframes, and logs as state folded over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def bracket(keys: DataFrame, targets: DataFrame, by: str, at: str, values: list[str]) -> DataFrame:
    """by, at and, for each target, the last key at or before it and the first at or after it: lo, hi and their values with
    _lo and _hi. Keys and targets are merged and swept once a track; there is no range join."""
    ks = keys.select(by, at, F.struct(F.col(at).alias("k"), *values).alias("key"))
    both = ks.withColumn("target", F.lit(False)).unionByName(targets.select(by, at, F.lit(True).alias("target")), allowMissingColumns=True)
    w = W.partitionBy(by).orderBy(at).rangeBetween
    near = both.select(by, at, "target", F.last("key", True).over(w(W.unboundedPreceding, 0)).alias("a"), F.first("key", True).over(w(0, W.unboundedFollowing)).alias("b"))
    return near.where("target").select(by, at, F.col("a.k").alias("lo"), F.col("b.k").alias("hi"), *(F.col(f"{s}.{v}").alias(f"{v}_{n}") for v in values for s, n in (("a", "lo"), ("b", "hi"))))


def share(at: Column, lo: Column, hi: Column) -> Column:
    """Where `at` lies between lo and hi; 0 on an exact key."""
    return F.when(hi > lo, (at - lo) / (hi - lo)).otherwise(0.0)


def interpolate(keys: DataFrame, targets: DataFrame, by: str, at: str, values: list[str]) -> DataFrame:
    """Linear between the keys around each target; the exact key where there is one; null outside the keys."""
    b = bracket(keys, targets, by, at, values)
    t = share(F.col(at), F.col("lo"), F.col("hi"))
    inside = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    return b.select(by, at, *(F.when(inside, F.col(f"{v}_lo") + t * (F.col(f"{v}_hi") - F.col(f"{v}_lo"))).alias(v) for v in values))


def slerp(a: list[Column], b: list[Column], t: Column) -> list[Column]:
    """Unit quaternions on the shorter arc; near-parallel ones linearly, renormalised."""
    dot = sum(x * y for x, y in zip(a, b))
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.lit(1.0), F.abs(dot)))
    small = angle < 1e-6
    s = F.when(small, 1.0).otherwise(F.sin(angle))
    wa, wb = F.when(small, 1 - t).otherwise(F.sin((1 - t) * angle) / s), F.when(small, t).otherwise(F.sin(t * angle) / s)
    mixed = [wa * x + wb * sign * y for x, y in zip(a, b)]
    length = F.sqrt(sum(m * m for m in mixed))
    return [m / length for m in mixed]


def missing_frames(saved: DataFrame) -> DataFrame:
    """idx: every index between the first and last saved one that isn't saved."""
    span = saved.agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).where("lo IS NOT NULL")
    return span.select(F.explode(F.sequence("lo", "hi")).alias("idx")).join(saved, "idx", "left_anti")


def click_stack(clicks: DataFrame) -> DataFrame:
    """clicks: session, mode, seq, action (add, undo, clear), point. The points left: undo takes the last one of the mode,
    clear all of them. An add survives if no clear follows and the adds and undos after it never go below its own level."""
    w = W.partitionBy("session", "mode").orderBy("seq")
    last_clear = F.coalesce(F.max(F.when(F.col("action") == "clear", F.col("seq"))).over(W.partitionBy("session", "mode")), F.lit(-1))
    live = clicks.withColumn("last_clear", last_clear).where("seq > last_clear AND action <> 'clear'")
    step = F.when(F.col("action") == "add", 1).otherwise(-1)
    raw = live.withColumn("raw", F.sum(step).over(w))
    # undo on an empty stack does nothing: lift the running sum by how far it has ever been below zero
    level = F.col("raw") - F.least(F.lit(0), F.min("raw").over(w))
    lifted = raw.withColumn("level", level)
    later = F.min("level").over(w.rowsBetween(1, W.unboundedFollowing))
    return lifted.withColumn("later", later).where("action = 'add' AND coalesce(later, level) >= level").select("session", "mode", "seq", "point")


def compact_log(lines: DataFrame, keep: int = 2000) -> DataFrame:
    """lines: stage, stream, seq, text. ANSI codes stripped, blank lines dropped; consecutive progress updates (a line with a
    percentage) of one channel become one entry, placed at the first, with the last text and their number; the newest
    `keep` entries of each stage stay."""
    clean = lines.withColumn("text", F.regexp_replace("text", "\\x1b\\[[0-9;]*[A-Za-z]", "")).where(F.trim("text") != "")
    clean = clean.withColumn("progress", F.col("text").rlike("[0-9]+%"))
    entry = F.when(F.col("progress"), F.lit(-1)).otherwise(F.col("seq"))
    g = clean.groupBy("stage", "stream", entry.alias("entry")).agg(F.min("seq").alias("seq"), F.max_by("text", "seq").alias("text"), F.count("*").alias("updates"))
    w = W.partitionBy("stage").orderBy(F.col("seq").desc())
    return g.withColumn("age", F.row_number().over(w)).where(F.col("age") <= keep).select("stage", "stream", "seq", "text", "updates")
