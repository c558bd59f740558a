"""Loops, chains, fillings; images, listings and other operators that SQL can't express."""

import io
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenmesh.functions import rules
from lumenmesh.operators import bake, holes, mesh, raster, sampling
from lumenmesh.sources import media


def got(df):
    return sorted(map(tuple, df.collect()))


def loops(spark, *rings):
    return spark.createDataFrame([(i, k, v) for i, ring in enumerate(rings) for k, v in enumerate(ring)], "loop_id long, pos int, vid long")


def peeled(ring):
    """Plain version: cut out the ring between the first vertex that comes again and its first place, until none does."""
    out = []
    while True:
        at = next(((ring.index(v), i) for i, v in enumerate(ring) if ring.index(v) < i), None)
        if at is None:
            return out + [ring] * (len(ring) >= 3)
        out += [ring[at[0] : at[1]]] * (at[1] - at[0] >= 3)
        ring = ring[: at[0] + 1] + ring[at[1] + 1 :]


def test_split_loops(spark):
    rng = np.random.default_rng(1)
    rings = [[1, 2, 3], [1, 2, 3, 4, 2, 5, 6], [1, 2, 1, 2], [7, 8, 9, 7, 10, 11], *(rng.integers(0, 12, n).tolist() for n in range(3, 40))]
    parts = {}
    for loop, part, pos, vid in got(holes.split_loops(loops(spark, *rings))):
        parts.setdefault(loop, {}).setdefault(part, []).append(vid)
    assert {k: list(v.values()) for k, v in parts.items()} == {i: p for i, p in enumerate(map(peeled, rings)) if p}


def test_chain_paths(spark):
    paths = [(0, 0, (1, 2, 3)), (0, 1, (5, 4, 3)), (0, 2, (5, 6, 1)), (1, 0, (10, 11, 12)), (1, 1, (12, 13, 14)), (2, 0, (20, 21, 22)), (2, 1, (23, 24, 22))]
    rows = [(loop, p, i, v) for loop, p, vs in paths for i, v in enumerate(vs)]
    vertices = spark.createDataFrame([(v, float(v), 0.0, 0.0) for v in range(30)], "vid long, x double, y double, z double")
    df = spark.createDataFrame(rows, "loop_id long, path long, pos int, vid long")
    chains = lambda gap: {k: [r[3] for r in got(holes.chain_paths(df, vertices, gap)) if r[0] == k] for k in range(3)}
    assert chains(3.5) == {0: [1, 2, 3, 4, 5, 6], 1: [], 2: [20, 21, 22, 24, 23]}
    assert chains(0.0) == {0: [1, 2, 3, 4, 5, 6], 1: [], 2: []}


def test_fill_closes_a_box(spark):
    """A cube without its top: the four corners of the hole become two triangles that look outward."""
    v = spark.createDataFrame([(i, float(i & 1), float(i >> 1 & 1), float(i >> 2)) for i in range(8)], "vid long, x double, y double, z double")
    sides = [(0, 2, 3), (0, 3, 1), (0, 1, 5), (0, 5, 4), (1, 3, 7), (1, 7, 5), (3, 2, 6), (3, 6, 7), (2, 0, 4), (2, 4, 6)]
    faces = spark.createDataFrame([(i, *f) for i, f in enumerate(sides)], "fid long, v0 long, v1 long, v2 long")
    walked = mesh.boundary_paths(faces).where("closed").select("loop_id", "pos", "vid")
    ring = walked.join(walked.groupBy("loop_id").agg(F.max("pos").alias("end")), "loop_id").where("pos < end")
    new = holes.fill(ring, faces, v)
    whole = faces.unionByName(new.select((F.col("fid") + 100).alias("fid"), "v0", "v1", "v2"))
    assert new.count() == 2 and mesh.boundary_edges(whole).count() == 0
    assert got(mesh.outward_ratio(whole, v))[0][0] == 1.0
    again = new.select("loop_id", "fid", "v0", "v1", "v2")
    assert holes.fill(ring, faces.unionByName(again.select((F.col("fid") + 100).alias("fid"), "v0", "v1", "v2")), v).count() == 0


def test_fill_region_until_full(spark):
    values = spark.createDataFrame([(0, 0, 1.0), (9, 0, 5.0)], "px long, py long, value double")
    region = spark.range(1, 9).select(F.col("id").alias("px"), F.lit(0).cast("long").alias("py"))
    out = dict((r[0], r[2]) for r in got(raster.fill_region(values, region)))
    assert len(out) == 10 and out[4] == 1.0 and out[5] == 5.0
    assert raster.fill_region(values, region.where("px > 3 AND px < 6")).count() == 2


def png(image, filters):
    h, w, n = image.shape
    lines, above = [], np.zeros((w, n), int)
    for y in range(h):
        row = image[y].astype(int)
        left = np.vstack([np.zeros((1, n), int), row[:-1]])
        corner = np.vstack([np.zeros((1, n), int), above[:-1]])
        p = left + above - corner
        pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
        guess = [0, left, above, (left + above) // 2, np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))][filters[y % len(filters)]]
        lines.append(bytes([filters[y % len(filters)]]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        above = row
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_frames_and_masks(spark, tmp_path):
    rng = np.random.default_rng(2)
    for n in (1, 3, 4):
        image = rng.integers(0, 256, (11, 7, n)).astype(np.uint8)
        assert (media.png_pixels(png(image, range(5))) == image).all()
    colour = rng.integers(0, 256, (5, 4, 3)).astype(np.uint8)
    (tmp_path / "00012.png").write_bytes(png(colour, [4, 1, 3]))
    held = io.BytesIO()
    np.save(held, colour[..., 0] > 99)
    (tmp_path / "00013.npy").write_bytes(held.getvalue())
    out = {(r.px, r.py): (r.r, r.g, r.b) for r in media.read_frames(spark, str(tmp_path)).collect()}
    assert len(out) == 20 and np.allclose(out[3, 4], colour[4, 3] / 255, atol=1e-6)
    assert got(media.read_masks(spark, str(tmp_path))) == sorted(("00012", x, y) for y in range(5) for x in range(4) if colour[y, x, 0] > 127)
    assert got(media.read_masks(spark, str(tmp_path), "npy")) == sorted(("00013", x, y) for y in range(5) for x in range(4) if colour[y, x, 0] > 99)
    with pytest.raises(ValueError):
        media.png_pixels(b"GIF89a")


def test_first_source(spark):
    none, some = spark.range(0), spark.range(2)
    assert got(media.first_source([("denoised", none), ("object", some), ("mesh", spark.range(9))])) == [(0, "object"), (1, "object")]
    with pytest.raises(ValueError, match="denoised, object"):
        media.first_source([("denoised", none), ("object", none)])


def test_clusters_meet_the_budget(spark):
    n = 24
    v = spark.range(n * n).select(F.col("id").alias("vid"), (F.col("id") % n).cast("double").alias("x"), F.floor(F.col("id") / n).cast("double").alias("y"), F.lit(0.0).alias("z"))
    at = v.where(f"x < {n - 1} AND y < {n - 1}").select(F.col("vid").alias("a"))
    faces = at.select(F.col("a").alias("fid"), F.col("a").alias("v0"), (F.col("a") + 1).alias("v1"), (F.col("a") + n).alias("v2"))
    out, size = mesh.cluster_to_budget(faces, v, 120)
    assert size > 0 and out.count() < faces.count()
    assert mesh.cluster_to_budget(faces, v, 10_000)[1] == 0.0


def test_documents_and_samples(spark):
    row = spark.range(1).select(rules.loop_document(F.lit(3), F.array(F.lit(1), F.lit(2)), F.lit(0.5), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.lit(-1.0), F.array(F.array(F.lit(0.0)))).alias("j")).first()
    assert json.loads(row.j) == {"loop_id": 3, "vertex_count": 2, "diameter": 0.5, "centroid": [1.0, 2.0, 3.0], "normal_y": -1.0, "points": [[0.0]]}
    rows = spark.range(500).withColumnRenamed("id", "k")
    sample = {r.k for r in sampling.hashed_sample(rows, "k", 20).collect()}
    order = sorted((r.h, r.k) for r in rows.select("k", F.xxhash64("k", F.lit(42)).alias("h")).collect())
    assert sample == {k for _, k in order[:20]} == {r.k for r in sampling.hashed_sample(rows.repartition(7), "k", 20).collect()}
    fields = dict(bake.field_candidates(100))
    assert len(fields) == 33 and abs(fields[89] - 50.88) < 0.01
