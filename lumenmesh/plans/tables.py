"""Meshes, cameras and scores derived deterministically from the driver's tables, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _three_smallest(pairs: DataFrame) -> DataFrame:
    """pairs (fid, v) -> fid, v0, v1, v2: the three smallest distinct v of each fid that has so many."""
    v = F.array_sort(F.collect_set("v"))
    return pairs.groupBy("fid").agg(v.alias("v")).where("size(v) >= 3").select("fid", *(F.col("v")[i].alias(f"v{i}") for i in range(3)))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One face an order: its three smallest parts."""
    return _three_smallest(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fid"), F.col("l_partkey").alias("v")))


def dense_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over 97 vertices, so that edges are shared by many faces."""
    return _three_smallest(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fid"), (F.col("l_partkey") % 97).alias("v")))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("vid"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"), (F.col("p_partkey") % 31).cast("double").alias("z")
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *(e[i].cast("double").alias(a) for i, a in enumerate("xyz")))


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera centres: every 25th vector, dimensions 3 to 5 times 3. One row in 25 of a bounded catalogue table."""
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").where("vec_id % 25 = 0").select(F.col("vec_id").alias("cam"), *((e[i + 3].cast("double") * 3).alias(f"c{a}") for i, a in enumerate("xyz")))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texel, view, score: the best discounted price share of an order line per (order, supplier mod 16)."""
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("texel"), (F.col("l_suppkey") % 16).alias("view"))
        .agg(F.max(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("score"))
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px, py, value on a 64 by 64 grid: mean event value of the cell."""
    cell = F.col("event_id") % 4096
    e = read(spark, sf_dir, "events").groupBy(cell.alias("cell")).agg(F.avg("value").alias("value"))
    return e.select((F.col("cell") % 64).alias("px"), F.floor(F.col("cell") / 64).cast("long").alias("py"), "value")


FACES = """d AS (SELECT DISTINCT l_orderkey AS fid, l_partkey AS v FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY v) AS k FROM d),
faces AS (SELECT fid, max(CASE WHEN k=1 THEN v END) AS v0, max(CASE WHEN k=2 THEN v END) AS v1, max(CASE WHEN k=3 THEN v END) AS v2
  FROM r WHERE k <= 3 GROUP BY fid HAVING count(*) = 3)"""
DENSE_FACES = FACES.replace("l_partkey AS v", "l_partkey % 97 AS v")
EDGES = """sides AS (SELECT fid, least(v0,v1) AS u, greatest(v0,v1) AS v FROM faces UNION ALL
  SELECT fid, least(v1,v2), greatest(v1,v2) FROM faces UNION ALL SELECT fid, least(v2,v0), greatest(v2,v0) FROM faces),
edges AS (SELECT u, v, count(*) AS n FROM sides GROUP BY u, v)"""
VERTICES = "vertices AS (SELECT p_partkey AS vid, CAST(p_size AS DOUBLE) AS x, p_retailprice/100 AS y, CAST(p_partkey % 31 AS DOUBLE) AS z FROM part)"
CORNERS = """corner AS (SELECT f.*, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2
  FROM faces f JOIN vertices a ON a.vid=f.v0 JOIN vertices b ON b.vid=f.v1 JOIN vertices c ON c.vid=f.v2),
geo AS (SELECT fid, v0, v1, v2, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS nx, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS ny, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS nz,
  (x0+x1+x2)/3 AS cx, (y0+y1+y2)/3 AS cy, (z0+z1+z2)/3 AS cz FROM corner)"""
POINTS = "points AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
CAMERAS = """cameras AS (SELECT vec_id AS cam, CAST(embedding[4] AS DOUBLE)*3 AS cx, CAST(embedding[5] AS DOUBLE)*3 AS cy, CAST(embedding[6] AS DOUBLE)*3 AS cz
  FROM embeddings WHERE vec_id % 25 = 0)"""
SCORES = """scores AS (SELECT l_orderkey AS texel, l_suppkey % 16 AS view, max(l_extendedprice*(1-l_discount)) AS score FROM lineitem GROUP BY 1, 2)"""
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY texel ORDER BY score DESC, view) - 1 AS rank FROM scores)"
GRID = """grid AS (SELECT cell % 64 AS px, cell // 64 AS py, value FROM (SELECT event_id % 4096 AS cell, avg(value) AS value FROM events GROUP BY 1))"""
