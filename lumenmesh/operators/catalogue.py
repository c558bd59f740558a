"""Object catalogue: listing, upsert, migration, prerequisites, layered settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(objects: DataFrame) -> DataFrame:
    """Newest first, objects without a time last, equal ones by name."""
    return objects.orderBy(F.coalesce(F.col("updated_at").cast("string"), F.lit("")).desc(), "name")


def upsert(old: DataFrame, new: DataFrame, key: str, created: str, now: Column) -> DataFrame:
    """Rows of new over those of old by key; the time of creation of an old row stays, a new row gets `now`."""
    keep = old.join(new.select(key), key, "left_anti")
    was = old.select(key, F.col(created).alias("_was"))
    fresh = new.join(was, key, "left").withColumn(created, F.coalesce("_was", now)).drop("_was")
    return keep.unionByName(fresh.select(*old.columns))


def migration_plan(entries: DataFrame, branch: str) -> DataFrame:
    """name, target: entries without a branch prefix whose target name is free."""
    bare = entries.where(~F.contains("name", F.lit("/"))).select("name", F.concat(F.lit(f"{branch}/"), "name").alias("target"))
    return bare.join(entries.select(F.col("name").alias("target")), "target", "left_anti").select("name", "target")


def missing_requirements(requirements: DataFrame, present: DataFrame, stage: int) -> DataFrame:
    """requirements: stage, path; present: path. What the stage needs and isn't there."""
    return requirements.where(F.col("stage") == stage).join(present, "path", "left_anti").select("stage", "path")


def safe_path(path: Column) -> Column:
    """Relative, without a step up, not empty."""
    return F.coalesce((path != "") & ~path.startswith("/") & ~path.rlike("(^|/)\\.\\.(/|$)"), F.lit(False))


def settings(layers: list[DataFrame]) -> DataFrame:
    """layers of (key, value), strongest first: each key's first non-null value and the number of the layer it is from."""
    all_ = None
    for i, layer in enumerate(layers):
        part = layer.where("value IS NOT NULL").select("key", "value", F.lit(i).alias("layer"))
        all_ = part if all_ is None else all_.unionByName(part)
    best = all_.groupBy("key").agg(F.min(F.struct("layer", "value")).alias("b"))
    return best.select("key", "b.value", "b.layer")


def colour_transfer(patch: DataFrame, reference: DataFrame, columns: tuple[str, ...] = ("r", "g", "b"), eps: float = 1e-6) -> DataFrame:
    """The patch's colours moved to the mean and spread (population) of the reference's."""
    stat = lambda df, s: df.agg(*(f(c).alias(f"{s}{n}_{c}") for c in columns for n, f in (("m", F.avg), ("d", F.stddev_pop))))
    both = patch.crossJoin(F.broadcast(stat(patch, "p"))).crossJoin(F.broadcast(stat(reference, "r")))
    new = {c: (F.col(c) - F.col(f"pm_{c}")) * F.col(f"rd_{c}") / F.greatest(F.col(f"pd_{c}"), F.lit(eps)) + F.col(f"rm_{c}") for c in columns}
    return both.select(*(new[c].alias(c) if c in new else F.col(c) for c in patch.columns))


def grouping_summary(rows: DataFrame, *keys: str, measure: str) -> DataFrame:
    """Counts, distinct values and sums over the cube of keys, with the grouping number."""
    return rows.cube(*keys).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_distinct(measure).alias("distinct_values"), F.sum(measure).alias("total"))


def by_support(stats: DataFrame) -> DataFrame:
    """fid, stats: the views of each face as (support, view) structs, the best supported first, of equals the lower."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("support")).alias("s"), "view", "support")))
    return stats.groupBy("fid").agg(F.transform(order, lambda s: F.struct(s["view"].alias("view"), s["support"].alias("support"))).alias("stats"))


def hydrated(stages: DataFrame, artefacts: DataFrame) -> DataFrame:
    """stages: object, stage, path (what the stage leaves). object, stage, state: complete where the artefact exists, else
    pending; current: the first pending stage of the object, null if there is none."""
    there = artefacts.select("object", "path").distinct().withColumn("_there", F.lit(True))
    of = stages.join(there, ["object", "path"], "left").groupBy("object", "stage").agg(F.bool_and(F.coalesce("_there", F.lit(False))).alias("done"))
    first = of.groupBy("object").agg(F.min(F.when(~F.col("done"), F.col("stage"))).alias("current"))
    return of.join(first, "object").select("object", "stage", F.when(F.col("done"), "complete").otherwise("pending").alias("state"), "current")
