"""Baking: points of a surface looked up in the pixels of every view, scored, and blended into a colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmesh.operators import cleanup, views

#: Colour of the faces that close the model (fixed values), and how near a vertex must come to it.
CAP_COLOUR, CAP_NEAR = (1.0, 0.55, 0.0), 0.05


def packet(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """points: texel, x, y, z, nx, ny, nz (unit normal). Rows of `views.project` with dist (to the camera) and cos (of the
    angle between the normal and the direction to the camera)."""
    d = [F.col(f"t{a}") - F.col(a) for a in "xyz"]
    dist = F.sqrt(sum(c * c for c in d))
    cos = sum(F.col(f"n{a}") * c for a, c in zip("xyz", d)) / F.greatest(dist, F.lit(1e-10))
    return views.project(points, cameras).withColumns({"dist": dist, "cos": cos})


def looked_up(packets: DataFrame, masks: DataFrame, depths: DataFrame) -> DataFrame:
    """packets with px, py (the nearest pixel, half to even, clipped to the image) and visible: joined with masks (cam, px, py
    of set pixels) and depths (cam, px, py, depth; a missing pixel hides nothing) on view and pixel."""
    clip = lambda c, n: F.greatest(F.lit(0), F.least(F.col(n) - 1, F.rint(c))).cast("long")
    at = packets.withColumns({"px": clip(F.col("u"), "w"), "py": clip(F.col("v"), "h")})
    at = at.join(masks.select("cam", "px", "py", F.lit(True).alias("_mask")), ["cam", "px", "py"], "left")
    at = at.join(depths.select("cam", "px", "py", F.col("depth").alias("_reference")), ["cam", "px", "py"], "left")
    seen = cleanup.sample_visible(F.col("depth"), F.col("_reference"), F.col("cos"), F.col("u"), F.col("v"), F.col("w"), F.col("h"), F.col("_mask"))
    return at.withColumn("visible", seen).drop("_mask", "_reference")


def scored(seen: DataFrame, least_cos: float = 0.1, angle_exp: float = 2.0, dist_pow: float = 1.0) -> DataFrame:
    """texel, view, score, u, v of the visible samples that are seen steeply enough."""
    good = seen.where(F.col("visible") & (F.col("cos") > least_cos))
    return good.select("texel", F.col("cam").alias("view"), views.view_score(F.col("cos"), F.col("dist"), angle_exp, dist_pow).alias("score"), "u", "v")


def colours(samples: DataFrame, images: DataFrame) -> DataFrame:
    """samples: texel, view, u, v and others. With r, g, b of the view's image (cam, px, py, r, g, b) between the four pixels
    around; pixels that the image lacks leave their weight to the others."""
    x0, y0 = F.floor("u").cast("long"), F.floor("v").cast("long")
    fx, fy = F.col("u") - F.floor("u"), F.col("v") - F.floor("v")
    corner = lambda i, j: F.struct((x0 + i).alias("px"), (y0 + j).alias("py"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("part"))
    rest = samples.columns
    parts = samples.select("*", F.inline(F.array(*(corner(i, j) for i in (0, 1) for j in (0, 1)))))
    at = parts.join(images.withColumnRenamed("cam", "view"), ["view", "px", "py"]).where("part > 0")
    return at.groupBy(*rest).agg(*((F.sum(F.col("part") * F.col(c)) / F.sum("part")).alias(c) for c in "rgb"))


def bake(points: DataFrame, cameras: DataFrame, masks: DataFrame, depths: DataFrame, images: DataFrame, locked: DataFrame | None = None, k: int = 3, hard_ratio: float = 2.0) -> DataFrame:
    """texel, r, g, b, n (views that it is blended from). The k best visible views of a texel, or the best alone where it is
    clearly better, are blended by score. locked: texel, view; such a texel takes its colour from that view alone, with
    weight 1, if it is visible there. Texels that no view shows are left out."""
    found = scored(looked_up(packet(points, cameras), masks, depths))
    top = views.harden(views.top_views(found.select("texel", "view", "score"), k), hard_ratio)
    chosen = found.join(top.select("texel", "view"), ["texel", "view"])
    if locked is not None:
        free = chosen.join(locked.select("texel"), "texel", "left_anti").select("texel", "view", "u", "v", "score")
        fixed = found.join(locked.select("texel", "view"), ["texel", "view"]).select("texel", "view", "u", "v", F.lit(1.0).alias("score"))
        chosen = free.unionByName(fixed)
    coloured = colours(chosen.select("texel", "view", "u", "v", F.col("score").alias("weight")), images)
    w = F.nullif(F.sum("weight"), F.lit(0.0))
    out = coloured.groupBy("texel").agg(*((F.sum(F.col("weight") * F.col(c)) / w).alias(c) for c in "rgb"), F.count("*").alias("n"))
    return out.where("r IS NOT NULL")


def mask_pixels(points: DataFrame, cameras: DataFrame, scale: float, nearest: float, farthest: float) -> DataFrame:
    """points x cameras, the cameras' translations scaled: px, py (nearest pixel, half to even, clipped), depth, and valid:
    the depth strictly between the two bounds and the unrounded place inside the image."""
    scaled = cameras.withColumns({f"t{a}": F.col(f"t{a}") * scale for a in "xyz"})
    cx, cy, depth = views.camera_point()
    at = views.with_all(points, scaled).withColumns({"_x": cx, "_y": cy, "depth": depth})
    z = F.when(F.abs("depth") > 1e-8, F.col("depth")).otherwise(1.0)
    at = at.withColumns({"u": F.col("fx") * F.col("_x") / z + F.col("cx"), "v": F.col("fy") * F.col("_y") / z + F.col("cy")})
    inside = (F.col("depth") > nearest) & (F.col("depth") < farthest) & (F.col("u") >= 0) & (F.col("u") < F.col("w")) & (F.col("v") >= 0) & (F.col("v") < F.col("h"))
    clip = lambda c, n: F.greatest(F.lit(0), F.least(F.greatest(F.col(n) - 1, F.lit(0)), F.rint(c))).cast("long")
    return at.select(*points.columns, "cam", clip("u", "w").alias("px"), clip("v", "h").alias("py"), "depth", inside.alias("valid"))


def colour_error(samples: DataFrame, images: DataFrame) -> DataFrame:
    """samples: candidate, cam, px, py, r, g, b (what the points look like). For each candidate camera the mean squared
    difference from the images' pixels, pooled over all views, and n; the least is the best."""
    there = images.select("cam", "px", "py", *(F.col(c).alias(f"_{c}") for c in "rgb"))
    off: Column = sum((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in "rgb") / 3
    return samples.join(there, ["cam", "px", "py"]).groupBy("candidate").agg(F.avg(off).alias("error"), F.count("*").alias("n"))


def field_candidates(width: int, first: int = 25, last: int = 89, step: int = 2) -> list[tuple[int, float]]:
    """Fields of view in degrees and their focal lengths in pixels for an image width."""
    from math import radians, tan

    return [(d, width / (2 * tan(radians(d) / 2))) for d in range(first, last + 1, step)]


def cap_faces(faces: DataFrame, vertex_colours: DataFrame) -> DataFrame:
    """fid of the faces all of whose corners (vertex_colours: vid, r, g, b) have the colour of caps."""
    off = F.sqrt(sum((F.col(c) - v) * (F.col(c) - v) for c, v in zip("rgb", CAP_COLOUR)))
    orange = vertex_colours.where(off < CAP_NEAR).select("vid")
    corner = faces.select("fid", F.posexplode(F.array("v0", "v1", "v2")).alias("pos", "vid")).join(orange, "vid")
    return corner.groupBy("fid").agg(F.count("*").alias("n")).where("n = 3").select("fid")


def cap_texels(texels: DataFrame, coloured: DataFrame, faces: DataFrame, vertex_colours: DataFrame) -> DataFrame:
    """texels: px, py, fid. Those of cap faces that have no colour yet (coloured: px, py)."""
    return texels.join(cap_faces(faces, vertex_colours), "fid").join(coloured, ["px", "py"], "left_anti").select("px", "py", "fid")


def corner_index(faces: DataFrame, merged: DataFrame) -> DataFrame:
    """faces: fid, v, vt (arrays, by corner); merged: vid (of the original), merged. merged, vid, fid, corner, vt: where each
    merged vertex's originals are used."""
    corner = faces.select("fid", "vt", F.posexplode("v").alias("corner", "vid"))
    return corner.select("fid", "corner", "vid", F.get("vt", F.col("corner")).alias("vt")).join(merged, "vid").select("merged", "vid", "fid", "corner", "vt")
