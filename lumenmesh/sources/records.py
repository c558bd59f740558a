"""JSON, CSV and binary records: poses, intrinsics, manifests, clicks, reconstructions, listings."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MATRIX = "array<array<double>>"
VIEW = "struct<frame_name:string, frame_index:int, transform_matrix:array<array<double>>>"


def tolerant_json(text: Column, schema: str) -> Column:
    """The record, with nulls for what doesn't fit; an empty record for no or broken text."""
    return F.from_json(F.coalesce(text, F.lit("{}")), schema, {"mode": "PERMISSIVE"})


def poses(texts: DataFrame) -> DataFrame:
    """texts: file, text. file, pos, frame, pose of either form: a record of `poses` with `frame_indices`, or a list of views
    with `transform_matrix`, whose frame is `frame_index`, else the trailing digits of the name, else the position. If
    the numbers of poses and indices differ, positions count."""
    listed = F.ltrim("text").startswith("[")
    record = texts.where(~listed).select("file", tolerant_json(F.col("text"), f"poses array<{MATRIX}>, frame_indices array<int>").alias("j"))
    fits = F.size("j.poses") == F.size("j.frame_indices")
    a = record.select("file", F.posexplode("j.poses").alias("pos", "pose"), F.when(fits, F.col("j.frame_indices")).alias("i"))
    a = a.select("file", "pos", F.coalesce(F.get("i", F.col("pos")), F.col("pos")).alias("frame"), "pose")
    views = texts.where(listed).select("file", F.posexplode(F.from_json("text", f"array<{VIEW}>")).alias("pos", "v"))
    digits = F.regexp_extract(F.regexp_replace(F.coalesce("v.frame_name", F.lit("")), "\\.[^.]*$", ""), "([0-9]+)$", 1)
    b = views.select("file", "pos", F.coalesce("v.frame_index", F.nullif(digits, F.lit("")).cast("int"), "pos").alias("frame"), F.col("v.transform_matrix").alias("pose"))
    return a.unionByName(b)


def intrinsics(texts: DataFrame, width: int, height: int) -> DataFrame:
    """file, fx, fy, cx, cy of records that hold all four and whose size, if given, is that of the image."""
    j = texts.select("file", tolerant_json(F.col("text"), "fx double, fy double, cx double, cy double, image_width int, image_height int").alias("j")).select("file", "j.*")
    size = (F.coalesce("image_width", F.lit(width)) == width) & (F.coalesce("image_height", F.lit(height)) == height)
    return j.where(F.col("fx").isNotNull() & F.col("fy").isNotNull() & F.col("cx").isNotNull() & F.col("cy").isNotNull() & size).select("file", "fx", "fy", "cx", "cy")


def saved_frames(texts: DataFrame) -> DataFrame:
    """file, saved_index, source_frame_index of a frame manifest; incomplete rows go, of equal saved indices the last stays."""
    j = texts.select("file", tolerant_json(F.col("text"), "saved_frames array<struct<saved_index:int, saved_name:string, source_frame_index:int>>").alias("j"))
    rows = j.select("file", F.posexplode("j.saved_frames").alias("pos", "r")).where("r.saved_index IS NOT NULL AND r.source_frame_index IS NOT NULL")
    return rows.groupBy("file", F.col("r.saved_index").alias("saved_index")).agg(F.max_by("r.source_frame_index", "pos").alias("source_frame_index"))


def hull_views(texts: DataFrame) -> DataFrame:
    """file, pos and the camera of every complete view, from a record of `views` or a bare list; relative mask paths are
    resolved against the manifest's folder."""
    view = "struct<mask_path:string, camera:struct<fx:double, fy:double, cx:double, cy:double, extrinsic:array<array<double>>>>"
    bare = F.from_json(F.when(F.ltrim("text").startswith("["), F.col("text")), f"array<{view}>")
    held = tolerant_json(F.when(~F.ltrim("text").startswith("["), F.col("text")), f"views array<{view}>")["views"]
    rows = texts.select("file", F.posexplode(F.coalesce(bare, held)).alias("pos", "v")).select("file", "pos", "v.mask_path", "v.camera.*")
    whole = F.col("mask_path").isNotNull()
    for c in ("fx", "fy", "cx", "cy", "extrinsic"):
        whole = whole & F.col(c).isNotNull()
    folder = F.regexp_replace("file", "[^/]*$", "")
    return rows.where(whole).withColumn("mask_path", F.when(F.col("mask_path").startswith("/"), F.col("mask_path")).otherwise(F.concat(folder, "mask_path")))


def saved_clicks(texts: DataFrame) -> DataFrame:
    """file, mode, pos, x, y, label of a click manifest."""
    points = "struct<click_points:array<array<double>>, click_labels:array<int>>"
    j = texts.select("file", tolerant_json(F.col("text"), f"object {points}, ground {points}").alias("j"))
    parts = [j.select("file", F.lit(m).alias("mode"), F.posexplode(F.arrays_zip(f"j.{m}.click_points", f"j.{m}.click_labels")).alias("pos", "p")) for m in ("object", "ground")]
    both = parts[0].unionByName(parts[1])
    return both.select("file", "mode", "pos", F.get("p.click_points", F.lit(0)).alias("x"), F.get("p.click_points", F.lit(1)).alias("y"), F.coalesce("p.click_labels", F.lit(1)).alias("label"))


def gpu_rows(lines: DataFrame) -> DataFrame:
    """value: CSV lines of index, name, total and free MB; what isn't a number is null."""
    t = F.split("value", "\\s*,\\s*")
    return lines.select(F.get(t, F.lit(0)).try_cast("int").alias("gpu"), F.get(t, F.lit(1)).alias("name"), F.get(t, F.lit(2)).try_cast("double").alias("total_mb"), F.get(t, F.lit(3)).try_cast("double").alias("free_mb"))


def freest_gpu(rows: DataFrame) -> DataFrame:
    best = rows.agg(F.max(F.struct(F.coalesce("free_mb", F.lit(-1.0)).alias("free"), (-F.col("gpu")).alias("g"))).alias("m"))
    return best.where("m IS NOT NULL").select((-F.col("m.g")).alias("gpu"), F.col("m.free").alias("free_mb"))


def artefacts(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """path, modified, mb (one digit) of files with the given extensions; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    last = F.lower(F.regexp_extract("path", "(\\.[^./]+)$", 1))
    return files.where(last.isin(*extensions)).select("path", F.col("modificationTime").alias("modified"), F.bround(F.col("length") / 1048576, 1).alias("mb"))


def resolve_frames(wanted: DataFrame, listing: DataFrame, extension: str = ".png") -> DataFrame:
    """wanted: idx; listing: path. The file of that number in five digits, else that of this position in sorted order."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    by_name = listing.select(name.alias("name"), F.col("path").alias("exact"))
    by_place = listing.select((F.row_number().over(W.orderBy("path")) - 1).cast("long").alias("idx"), F.col("path").alias("place"))
    at = wanted.withColumn("name", F.format_string(f"%05d{extension}", "idx")).join(by_name, "name", "left").join(by_place, "idx", "left")
    return at.select("idx", F.coalesce("exact", "place").alias("path"))


def _records(kind: str):
    """Reads the binary reconstruction files; each is one bounded artefact and one row of input."""

    def images(data: bytes):
        (n,), at = struct.unpack_from("<Q", data), 8
        for _ in range(n):
            v = struct.unpack_from("<I7dI", data, at)
            end = data.index(b"\0", at + 64)
            (points,) = struct.unpack_from("<Q", data, end + 1)
            yield v[0], list(v[1:5]), list(v[5:8]), v[8], data[at + 64 : end].decode(), points
            at = end + 9 + 24 * points

    def cameras(data: bytes):
        (n,), at = struct.unpack_from("<Q", data), 8
        for _ in range(n):
            cam, model, w, h = struct.unpack_from("<IiQQ", data, at)
            count = PARAMETERS[model]
            yield cam, model, w, h, list(struct.unpack_from(f"<{count}d", data, at + 24))
            at += 24 + 8 * count

    return images if kind == "images" else cameras


#: Parameters of the camera models by number (fixed values of the format).
PARAMETERS = {0: 3, 1: 4, 2: 4, 3: 5, 4: 8, 5: 8, 6: 12, 7: 5, 8: 4, 9: 5, 10: 12}
_SCHEMAS = {
    "images": "file string, image_id long, q array<double>, t array<double>, camera_id long, name string, points long",
    "cameras": "file string, camera_id long, model long, width long, height long, params array<double>",
}


def reconstruction(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """`images` or `cameras` of binary reconstruction files."""
    read, names = _records(kind), [c.split()[0] for c in _SCHEMAS[kind].split(", ")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = [dict(zip(names, (file, *r))) for r in read(data)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _SCHEMAS[kind])


def image_poses(images: DataFrame) -> DataFrame:
    """view (by name), name, camera_id and the camera-to-world rotation r and centre c of world-to-camera quaternions."""
    w, x, y, z = (F.get("q", F.lit(i)) for i in range(4))
    t = [F.get("t", F.lit(i)) for i in range(3)]
    r = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    back = F.array(*(F.array(*(r[i][j] for i in range(3))) for j in range(3)))
    centre = F.array(*(-sum(r[i][j] * t[i] for i in range(3)) for j in range(3)))
    return images.select((F.row_number().over(W.orderBy("name")) - 1).alias("view"), "name", "camera_id", back.alias("r"), centre.alias("c"))


def dominant_camera(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """The camera of most images (of equal ones the first seen) with fx, fy, cx, cy: simple models share one focal length."""
    n = images.groupBy("camera_id").agg(F.count("*").alias("n"), F.min("image_id").alias("first"))
    best = n.agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "camera_id")).alias("m")).select("m.camera_id", "m.n")
    p = lambda i: F.get("params", F.lit(i))
    shared = F.col("model").isin(0, 2, 3, 8, 9)
    return cameras.join(F.broadcast(best), "camera_id").select("camera_id", "n", "width", "height", p(0).alias("fx"), F.when(shared, p(0)).otherwise(p(1)).alias("fy"), F.when(shared, p(1)).otherwise(p(2)).alias("cx"), F.when(shared, p(2)).otherwise(p(3)).alias("cy"))
