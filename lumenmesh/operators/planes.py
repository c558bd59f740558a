"""Planes, boxes, loops in their planes, and scalar camera geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lumenmesh.operators.mesh import cross, norm

XYZ = ("x", "y", "z")


def bounding_box(vertices: DataFrame) -> DataFrame:
    """One row: lo and hi of each axis, and the length of the diagonal."""
    box = vertices.agg(*(f(a).alias(f"{n}_{a}") for a in XYZ for n, f in (("lo", F.min), ("hi", F.max))))
    return box.withColumn("diagonal", norm(tuple(F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in XYZ)))


def normalised_plane(normal: tuple[float, float, float], d: float) -> tuple[float, float, float, float]:
    """Unit normal and offset of n.x + d = 0; a normal of no length is an error."""
    length = math.sqrt(sum(c * c for c in normal))
    if length < 1e-12:
        raise ValueError("the plane has no normal")
    return (*(c / length for c in normal), d / length)


def signed_distance(plane: tuple[float, float, float, float]) -> Column:
    return sum(F.lit(float(k)) * F.col(a) for k, a in zip(plane, XYZ)) + F.lit(float(plane[3]))


def orient_to_mesh(vertices: DataFrame, plane: tuple[float, float, float, float], tol: float = 1e-9) -> DataFrame:
    """One row: nx, ny, nz, d of the plane turned so that the mesh lies on its positive side: turned if the mean distance
    is negative, or about 0 with fewer vertices above than below."""
    s = signed_distance(plane)
    g = vertices.agg(F.avg(s).alias("mean"), F.count_if(s > 0).alias("above"), F.count_if(s < 0).alias("below"))
    turn = (F.col("mean") < -tol) | ((F.abs("mean") <= tol) & (F.col("above") < F.col("below")))
    sign = F.when(F.coalesce(turn, F.lit(False)), -1.0).otherwise(1.0)
    return g.select(*((sign * float(k)).alias(n) for k, n in zip(plane, ("nx", "ny", "nz", "d"))))


def default_plane(vertices: DataFrame) -> DataFrame:
    """The horizontal plane through the lowest vertex."""
    return vertices.agg((-F.min("y")).alias("d")).select(F.lit(0.0).alias("nx"), F.lit(1.0).alias("ny"), F.lit(0.0).alias("nz"), "d")


def onto_plane(vertices: DataFrame, plane: tuple[float, float, float, float], chosen: Column) -> DataFrame:
    s = signed_distance(plane)
    return vertices.select("vid", *(F.when(chosen, F.col(a) - s * float(k)).otherwise(F.col(a)).alias(a) for a, k in zip(XYZ, plane)))


def tangent_axes(normal: tuple[float, float, float], limit: float = 0.92) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Two unit axes across a unit normal, seeded by X unless that is nearly the normal, then by Z."""
    seed = (0.0, 0.0, 1.0) if abs(normal[0]) > limit else (1.0, 0.0, 0.0)
    dot = sum(a * b for a, b in zip(seed, normal))
    u = tuple(s - dot * n for s, n in zip(seed, normal))
    length = math.sqrt(sum(c * c for c in u))
    u = tuple(c / length for c in u)
    return u, cross(normal, u)


def loop_plane_coordinates(loops: DataFrame, normal: tuple[float, float, float]) -> DataFrame:
    """loops: loop_id, pos, vid, x, y, z -> the same with x, y in the plane, centred on each loop's mean."""
    mean = loops.groupBy("loop_id").agg(*(F.avg(a).alias(f"m{a}") for a in XYZ))
    u, v = tangent_axes(normal)
    at = loops.join(mean, "loop_id")
    along = lambda axis: sum(F.lit(float(k)) * (F.col(a) - F.col(f"m{a}")) for k, a in zip(axis, XYZ))
    return at.select("loop_id", "pos", "vid", along(u).alias("x"), along(v).alias("y"))


def footprint_axes(normal: tuple[float, float, float]) -> tuple[tuple[float, ...], tuple[float, ...]] | None:
    """Two unit axes across a normal of any length, seeded by X unless that is nearly the normal, then by Y; none for no
    normal."""
    size = math.sqrt(sum(float(c) * float(c) for c in normal))
    if size < 1e-12:
        return None
    n = tuple(float(c) / size for c in normal)
    seed = (1.0, 0.0, 0.0) if abs(n[0]) < 0.9 else (0.0, 1.0, 0.0)
    dot = sum(a * b for a, b in zip(seed, n))
    across = tuple(s - dot * c for s, c in zip(seed, n))
    size = math.sqrt(sum(c * c for c in across))
    u = tuple(c / size for c in across)
    return u, cross(n, u)


def planar_uvs(points: DataFrame, normal: tuple[float, float, float], pad: float = 0.02) -> DataFrame:
    """points: vid, x, y, z -> vid, u, v within [pad, 1 - pad], the aspect kept, the shorter side in the middle; no rows
    without a normal, for fewer than three points or a shape that is thinner than 1e-4 of its length."""
    axes = footprint_axes(normal)
    if axes is None:
        return points.where("1 = 0").select("vid", F.col("x").alias("u"), F.col("y").alias("v"))
    at = points.select("vid", *(sum(F.lit(float(k)) * F.col(c) for k, c in zip(axis, XYZ)).alias(n) for axis, n in zip(axes, "pq")))
    box = at.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}{c}") for c in "pq" for k, f in (("lo", F.min), ("hi", F.max))))
    box = box.withColumns({"wp": F.col("hip") - F.col("lop"), "wq": F.col("hiq") - F.col("loq")}).withColumn("side", F.greatest("wp", "wq"))
    box = box.where((F.col("n") >= 3) & (F.col("side") >= 1e-9)).where(F.least("wp", "wq") >= 1e-4 * F.col("side"))
    scale = (1 - 2 * pad) / F.col("side")
    middle = {c: (F.col(f"lo{c}") + F.col(f"hi{c}")) / 2 for c in "pq"}
    inside = lambda x: F.greatest(F.lit(pad), F.least(F.lit(1 - pad), x))
    return at.join(F.broadcast(box)).select("vid", *(inside((F.col(c) - middle[c]) * scale + 0.5).alias(n) for c, n in (("p", "u"), ("q", "v"))))


def barycentric(px: Column, py: Column, x: list[Column], y: list[Column]) -> tuple[Column, Column, Column]:
    """Weights of the three corners; a denominator smaller than 1e-10 in size counts as 1e-10, whatever its sign."""
    d = (y[1] - y[2]) * (x[0] - x[2]) + (x[2] - x[1]) * (y[0] - y[2])
    d = F.when(F.abs(d) < 1e-10, 1e-10).otherwise(d)
    a = ((y[1] - y[2]) * (px - x[2]) + (x[2] - x[1]) * (py - y[2])) / d
    b = ((y[2] - y[0]) * (px - x[2]) + (x[0] - x[2]) * (py - y[2])) / d
    return a, b, 1 - a - b


def in_triangle(px: Column, py: Column, x: list[Column], y: list[Column], eps: float = 1e-9) -> Column:
    return F.least(*barycentric(px, py, x, y)) >= -eps


def scale_intrinsics(cameras: DataFrame, width: int, height: int) -> DataFrame:
    """fx, fy, cx, cy, w, h brought to another image size."""
    sx, sy = F.lit(float(width)) / F.col("w"), F.lit(float(height)) / F.col("h")
    return cameras.withColumns({"fx": F.col("fx") * sx, "cx": F.col("cx") * sx, "fy": F.col("fy") * sy, "cy": F.col("cy") * sy, "w": F.lit(width), "h": F.lit(height)})


def clip_matrix(near: float = 0.01, far: float = 100.0) -> Column:
    """Rows of the projection to clip space for camera columns fx, fy, cx, cy, w, h."""
    z, row = F.lit(0.0), lambda *c: F.array(*c)
    return F.array(
        row(2 * F.col("fx") / F.col("w"), z, 1 - 2 * F.col("cx") / F.col("w"), z),
        row(z, 2 * F.col("fy") / F.col("h"), 2 * F.col("cy") / F.col("h") - 1, z),
        row(z, z, F.lit(-(far + near) / (far - near)), F.lit(-2 * far * near / (far - near))),
        row(z, z, F.lit(-1.0), z),
    )


def texture_size(requested: Column, width: Column, height: Column, most: int = 2048) -> Column:
    """The requested size if positive, else the rounded geometric mean of the image's sides, capped."""
    return F.least(F.lit(most), F.when(requested > 0, requested).otherwise(F.bround(F.sqrt(width * height)).cast("int")))


def sane_click(x: Column) -> Column:
    """Non-finite becomes 0, all others are kept within [0, 1)."""
    fine = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    return F.greatest(F.lit(0.0), F.least(F.lit(math.nextafter(1.0, 0.0)), fine))


def principal_axes(points: DataFrame, key: str) -> DataFrame:
    """key, n, centre and the three unit axes of each group's covariance, the least spread first. The sums are built in
    Spark; only six numbers a group go to the eigenvalue routine."""
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    g = points.groupBy(key).agg(F.count("*").alias("n"), *(F.avg(a).alias(f"m{a}") for a in XYZ), *(F.covar_pop(a, b).alias(a + b) for a, b in pairs))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names if n != key}
            m = np.empty((batch.num_rows, 3, 3))
            for i, a in enumerate(XYZ):
                for j, b in enumerate(XYZ):
                    m[:, i, j] = c[a + b] if a + b in c else c[b + a]
            _, axes = np.linalg.eigh(m)
            axes = axes.transpose(0, 2, 1)
            lead = np.take_along_axis(axes, np.abs(axes).argmax(2)[..., None], 2)
            axes = axes * np.where(lead < 0, -1.0, 1.0)  # one of the two directions: the largest component is positive
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("n"), pa.array(np.stack([c[f"m{a}"] for a in XYZ], 1).tolist(), pa.list_(pa.float64())), pa.array(axes.tolist(), pa.list_(pa.list_(pa.float64())))], [key, "n", "centre", "axes"])

    return g.mapInArrow(run, f"{key} {points.schema[key].dataType.simpleString()}, n long, centre array<double>, axes array<array<double>>")


def oriented_boxes(points: DataFrame, key: str) -> DataFrame:
    """key and the extent along each principal axis."""
    axes = principal_axes(points, key).select(key, "axes")
    along = lambda i: sum(F.get(F.get("axes", F.lit(i)), F.lit(j)) * F.col(a) for j, a in enumerate(XYZ))
    at = points.join(axes, key).select(key, *(along(i).alias(f"e{i}") for i in range(3)))
    return at.groupBy(key).agg(*((F.max(f"e{i}") - F.min(f"e{i}")).alias(f"extent{i}") for i in range(3)))


def ransac_plane(points: DataFrame, trials: int = 200, threshold: float = 0.01, seed: int = 42) -> DataFrame:
    """One row: the plane through three hashed points with most inliers (of equals the first trial). The trials are drawn from
    a bounded hashed sample; inliers are counted over all points."""
    few = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(3 * trials)
    ranked = few.select((F.row_number().over(W.orderBy(F.xxhash64("id", F.lit(seed)), "id")) - 1).alias("i"), *XYZ)
    trial = ranked.groupBy(F.floor(F.col("i") / 3).cast("int").alias("trial")).agg(F.array_sort(F.collect_list(F.struct("i", *XYZ))).alias("p")).where("size(p) = 3")
    at = lambda i, a: F.get("p", F.lit(i))[a]
    n = cross(*(tuple(at(i, a) - at(0, a) for a in XYZ) for i in (1, 2)))
    trial = trial.select("trial", *(c.alias(f"n{a}") for c, a in zip(n, XYZ)), *(at(0, a).alias(f"o{a}") for a in XYZ))
    length = norm(tuple(F.col(f"n{a}") for a in XYZ))
    trial = trial.withColumn("length", length).where("length > 1e-12").select("trial", *((F.col(f"n{a}") / F.col("length")).alias(f"n{a}") for a in XYZ), *(f"o{a}" for a in XYZ))
    off = sum(F.col(f"n{a}") * (F.col(a) - F.col(f"o{a}")) for a in XYZ)
    hits = points.crossJoin(F.broadcast(trial)).groupBy("trial").agg(F.count_if(F.abs(off) <= threshold).alias("inliers"))
    best = hits.agg(F.max(F.struct("inliers", (-F.col("trial")).alias("t"))).alias("m")).select((-F.col("m.t")).alias("trial"), F.col("m.inliers").alias("inliers"))
    return trial.join(F.broadcast(best), "trial").select("nx", "ny", "nz", (-sum(F.col(f"n{a}") * F.col(f"o{a}") for a in XYZ)).alias("d"), "inliers")
