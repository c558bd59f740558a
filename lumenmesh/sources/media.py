"""Images and masks as pixel rows, and listings of videos, reconstructions and meshes by their rules."""

from __future__ import annotations

import io
import struct
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lumenmesh.functions import rules

#: Endings of videos (fixed values).
VIDEOS = ("mp4", "mov", "avi", "mkv", "webm", "m4v")


def png_pixels(data: bytes):
    """height x width x channels of an 8-bit PNG without interlacing (grey, grey with alpha, colour, colour with alpha)."""
    import numpy as np

    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, shape = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
            if depth != 8 or channels is None or interlaced:
                raise ValueError("only 8-bit PNG files without palette and interlacing are read")
            shape = height, width, channels
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    height, width, n = shape
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width * n + 1)
    out = np.zeros((height + 1, width + 1, n), np.uint8)  # a row and a pixel of zeros before the image
    for y in range(height):
        line, above = raw[y, 1:].reshape(width, n), out[y]
        row = out[y + 1]
        if raw[y, 0] == 0:
            row[1:] = line
        elif raw[y, 0] == 1:
            row[1:] = np.cumsum(line, 0, dtype=np.uint8)
        elif raw[y, 0] == 2:
            row[1:] = line + above[1:]
        else:
            for x in range(width):
                a, b, c = row[x].astype(int), above[x + 1].astype(int), above[x].astype(int)
                if raw[y, 0] == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
                row[x + 1] = (line[x] + guess) & 255
    return out[1:, 1:]


def _decoded(path: str, data: bytes):
    import numpy as np

    return np.load(io.BytesIO(data), allow_pickle=False) if path.endswith(".npy") else png_pixels(data)


def _pixel_rows(spark: SparkSession, folder: str, ending: str, schema: str, rows) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ending}").load(folder).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                found = rows(_decoded(path, data))
                n = len(found["px"])
                yield pa.RecordBatch.from_pydict({"frame": pa.array([path.rsplit("/", 1)[-1].rsplit(".", 1)[0]] * n, pa.string()), **found})

    return files.mapInArrow(run, schema)


def read_frames(spark: SparkSession, folder: str, ending: str = "png") -> DataFrame:
    """frame (the file's name), px, py, r, g, b in 0 to 1 of every pixel of PNG or NPY images; a grey one has it thrice."""

    def rows(image):
        import numpy as np

        image = image[..., None] if image.ndim == 2 else image
        c = (image[..., :3] if image.shape[2] >= 3 else np.repeat(image[..., :1], 3, 2)).astype(np.float32) / np.float32(255)
        py, px = np.mgrid[: c.shape[0], : c.shape[1]]
        return {"px": px.ravel().astype(np.int64), "py": py.ravel().astype(np.int64), **{n: c[..., i].ravel() for i, n in enumerate("rgb")}}

    return _pixel_rows(spark, folder, ending, "frame string, px long, py long, r float, g float, b float", rows)


def read_masks(spark: SparkSession, folder: str, ending: str = "png") -> DataFrame:
    """frame, px, py of the set pixels: above 127 in a PNG file, true or not 0 in an NPY file."""

    def rows(image):
        import numpy as np

        grey = image[..., 0] if image.ndim == 3 else image
        py, px = np.nonzero(grey > 127 if ending == "png" else grey != 0)
        return {"px": px.astype(np.int64), "py": py.astype(np.int64)}

    return _pixel_rows(spark, folder, ending, "frame string, px long, py long", rows)


def videos(files: DataFrame) -> DataFrame:
    """files: path, length (bytes). name, path, megabytes (one digit, half to even) and a suggested object name of the
    videos, by path."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, "(?<=.)\\.[^.]+$", "")
    found = files.where(F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1)).isin(*VIDEOS))
    return found.select(name.alias("name"), "path", F.bround(F.col("length") / 1048576, 1).alias("megabytes"), rules.sanitize_name(stem).alias("suggested")).orderBy("path")


def video_facts(meta: DataFrame) -> DataFrame:
    """meta: name, raw_fps, fps, frames, width, height, auto_oriented, container_rotation, tag_rotation. What is derived:
    duration (two digits), interval (half a second of frames, half to even, at least 1), most (frames at that interval),
    rotation (0 if the reader turns frames itself; else the first of container and tag that is 90, 180 or 270; else 0), and
    the sides as they look after turning."""
    usable = lambda c: F.when(F.col(c).isin(90, 180, 270), F.col(c))
    rotation = F.when(F.coalesce("auto_oriented", F.lit(False)), 0).otherwise(F.coalesce(usable("container_rotation"), usable("tag_rotation"), F.lit(0)))
    at = meta.withColumns({"rotation": rotation, "interval": F.greatest(F.lit(1), F.rint(F.col("fps") / 2).cast("long"))})
    turned = F.col("rotation").isin(90, 270)
    return at.select(
        "name", "fps", "frames", F.when(turned, F.col("height")).otherwise(F.col("width")).alias("width"), F.when(turned, F.col("width")).otherwise(F.col("height")).alias("height"),
        F.when(F.col("raw_fps") > 0, F.bround(F.col("frames") / F.col("raw_fps"), 2)).otherwise(0.0).alias("duration"), "rotation", "interval",
        F.when(F.col("frames") > 0, F.ceil(F.col("frames") / F.col("interval"))).otherwise(0).cast("long").alias("most"),
    )


def first_folder(files: DataFrame, name: str = "images.bin") -> DataFrame:
    """files: path. One row: the first folder, by name, that holds the named file; null for none."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return files.where(F.col("path").endswith(f"/{name}")).agg(F.min(folder).alias("folder"))


def preferred_file(files: DataFrame, patterns: list[str], *keys: str) -> DataFrame:
    """files: keys, path, length. For each key the largest file (of equals the first) of the first pattern (a regular
    expression) that any of its files matches."""
    order: Column = F.lit(None)
    for i, p in reversed(list(enumerate(patterns))):
        order = F.when(F.col("path").rlike(p), i).otherwise(order)
    w = W.partitionBy(*keys).orderBy("_order", F.col("length").desc(), "path") if keys else W.partitionBy(F.lit(0)).orderBy("_order", F.col("length").desc(), "path")
    found = files.withColumn("_order", order).where("_order IS NOT NULL")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*keys, "path", "length")


def first_source(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """(name, rows) in order of preference, all of one schema: the rows of the first that has any, with its name; an error
    if none has."""
    for name, rows in sources:
        if not rows.isEmpty():
            return rows.withColumn("source", F.lit(name))
    raise ValueError("none of the sources has rows: " + ", ".join(n for n, _ in sources))
