"""Wavefront OBJ text as relations, and back."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), text. The text source keeps no line numbers; each file is read whole, one row a file, as OBJ
    files are bounded artefacts of one object, and many files spread over many tasks."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\\r?\\n")).alias("pos", "text")).select("file", (F.col("pos") + 1).alias("line"), F.trim("text").alias("text"))


def parse_lines(lines: DataFrame) -> dict[str, DataFrame]:
    """lines: file, line, text. vertices (file, vid from 1, x, y, z), texcoords (file, vtid from 1, u, v) and faces (file,
    fid from 1, v, vt, material): polygons are cut into fans; usemtl holds for the faces that follow it in its file. A face
    corner without a texture index is an error, as are short records."""
    rows = lines.where("text <> '' AND NOT startswith(text, '#')").select("file", "line", F.split("text", "\\s+").alias("t"))
    head = F.get("t", F.lit(0))
    number = lambda i: F.get("t", F.lit(i)).cast("double")

    def numbered(kind: str, least: int, id_name: str, **columns) -> DataFrame:
        bad = F.raise_error(F.lit(f"a {kind} record is too short"))
        some = rows.where(head == kind).withColumn("_ok", F.when(F.size("t") < least, bad.cast("int")).otherwise(1)).where("_ok = 1")
        w = W.partitionBy("file").orderBy("line")
        return some.select("file", F.row_number().over(w).cast("long").alias(id_name), *(c.alias(k) for k, c in columns.items()))

    w = W.partitionBy("file").orderBy("line")
    marked = rows.where(head.isin("usemtl", "f")).withColumn("material", F.last(F.when(head == "usemtl", F.get("t", F.lit(1))), True).over(w)).where(head == "f")
    corner = F.transform(F.slice("t", 2, F.size("t") - 1), lambda c: F.split(c, "/"))
    bad = F.raise_error(F.lit("a face corner needs vertex and texture index")).cast("array<array<string>>")
    marked = marked.withColumn("c", F.when(F.forall(corner, lambda p: (F.size(p) >= 2) & (F.get(p, F.lit(1)) != "")), corner).otherwise(bad)).where("size(c) >= 3")
    fans = marked.select("file", "line", "material", "c", F.posexplode(F.sequence(F.lit(1), F.size("c") - 2)).alias("k", "i"))
    at = lambda i, part: F.get(F.get("c", i), F.lit(part)).cast("long")
    tri = lambda part: F.array(at(F.lit(0), part), at(F.col("i"), part), at(F.col("i") + 1, part))
    order = W.partitionBy("file").orderBy("line", "k")
    return {
        "vertices": numbered("v", 4, "vid", x=number(1), y=number(2), z=number(3)),
        "texcoords": numbered("vt", 3, "vtid", u=number(1), v=number(2)),
        "faces": fans.select("file", F.row_number().over(order).cast("long").alias("fid"), tri(0).alias("v"), tri(1).alias("vt"), "material"),
    }


def read_obj(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return parse_lines(numbered_lines(spark, path))


def obj_lines(vertices: DataFrame, texcoords: DataFrame, faces: DataFrame) -> DataFrame:
    """part, id, text: the records of one mesh, to be written in order of part and id. Ids are densely numbered from 1."""
    v = vertices.select(F.lit(0).alias("part"), F.col("vid").alias("id"), F.format_string("v %.6f %.6f %.6f", "x", "y", "z").alias("text"))
    t = texcoords.select(F.lit(1).alias("part"), F.col("vtid").alias("id"), F.format_string("vt %.6f %.6f", "u", "v").alias("text"))
    corner = lambda i: F.concat_ws("/", F.get("v", F.lit(i)), F.get("vt", F.lit(i)))
    f = faces.select(F.lit(2).alias("part"), F.col("fid").alias("id"), F.concat_ws(" ", F.lit("f"), *(corner(i) for i in range(3))).alias("text"))
    return v.unionByName(t).unionByName(f)


def write_obj(lines: DataFrame, path: str) -> None:
    """One text file in a folder; its records are sorted in a single task, as the format has one order."""
    lines.repartitionByRange(1, "part", "id").sortWithinPartitions("part", "id").select("text").write.mode("overwrite").text(os.fspath(path))
