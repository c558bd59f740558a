"""Contact clean-up: keep flags of faces through ordered passes, loop selection, the proposal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lumenmesh.operators import mesh


def sample_visible(depth: Column, reference: Column, cos: Column, u: Column, v: Column, w: Column, h: Column, mask: Column) -> Column:
    """In front, inside, on the mask and not behind what the depth buffer has there (no depth there hides nothing). The
    tolerance grows with the depth and with how slanting the surface is seen (cos: of its angle to the view)."""
    tolerance = F.greatest(F.lit(1e-4), 0.003 * reference / F.greatest(F.abs(cos), F.lit(0.1)))
    hidden = F.coalesce(depth > reference + tolerance, F.lit(False))
    return (depth > 0.01) & (u >= 0) & (u < w - 1) & (v >= 0) & (v < h - 1) & F.coalesce(mask, F.lit(False)) & ~hidden


def clip_pass(keep: Column, distances: list[Column]) -> Column:
    return keep & (F.least(*distances) > 0)


def mask_pass(keep: Column, band: Column, outside: Column, ground: Column) -> Column:
    """Within the band near the plane: a kept face far outside goes, a removed one well inside comes back."""
    score = F.greatest(outside, ground)
    return F.when(band & keep & (score > 0.5), False).when(band & ~keep & (score < 0.2), True).otherwise(keep)


def noise_pass(keep: Column, band: Column, distance: Column, outside: Column) -> Column:
    return keep & ~(~band & (distance > 0) & (outside > 0.7))


def lower_half_pass(keep: Column, height: Column, half: Column, outside: Column) -> Column:
    return keep & ~((height >= 0) & (height <= half) & (outside > 0.2))


def flipped_pass(keep: Column, distance: Column, diagonal: Column, facing: Column) -> Column:
    return keep & ~((distance < 0.01 * diagonal) & (facing < 0))


def islands(faces: DataFrame, vertices: DataFrame, share: float = 0.1, gap: float = 0.02) -> DataFrame:
    """Faces of the largest component, and of those that are neither small against it nor farther from its box than `gap`
    times the box's diagonal."""
    of = mesh.face_components(faces)
    sizes = of.groupBy("component").agg(F.count("*").alias("size"))
    main = sizes.agg(F.max(F.struct("size", (-F.col("component")).alias("c"))).alias("m")).select((-F.col("m.c")).alias("main"), F.col("m.size").alias("largest"))
    corner = faces.join(of, "fid").select("component", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct().join(vertices, "vid").crossJoin(F.broadcast(main))
    box = corner.where("component = main").agg(*(f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    whole = box.select(mesh.norm(tuple(F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in "xyz")).alias("diagonal"))
    off = mesh.norm(tuple(F.greatest(F.col(f"lo_{a}") - F.col(a), F.lit(0.0), F.col(a) - F.col(f"hi_{a}")) for a in "xyz"))
    far = corner.crossJoin(F.broadcast(box)).groupBy("component").agg(F.min(off).alias("off"))
    judged = sizes.join(far, "component").crossJoin(F.broadcast(main)).crossJoin(F.broadcast(whole))
    good = (F.col("component") == F.col("main")) | ((F.col("size") >= F.greatest(F.lit(1), F.floor(share * F.col("largest")))) & (F.col("off") <= gap * F.col("diagonal")))
    return faces.join(of.join(judged.where(good).select("component"), "component", "left_semi"), "fid", "left_semi")


def split_faces(clipped: DataFrame, merged: DataFrame, keep: DataFrame) -> DataFrame:
    """clipped: fid, source, v0..v2. Faces that clipping made, i.e. whose corners are no merged face's, of kept sources."""
    key = lambda: F.array_sort(F.array("v0", "v1", "v2")).alias("key")
    fresh = clipped.select("*", key()).join(merged.select(key()), "key", "left_anti").drop("key")
    return fresh.join(keep.where("keep").select(F.col("fid").alias("source")), "source", "left_semi").select("fid", "source", "v0", "v1", "v2")


def scatter_keep(faces: DataFrame, face_map: DataFrame, keep: DataFrame) -> DataFrame:
    """fid, keep of the original faces; those without a merged face are kept."""
    back = face_map.join(keep.select(F.col("fid").alias("merged"), "keep"), "merged").groupBy("fid").agg(F.bool_and("keep").alias("keep"))
    return faces.select("fid").join(back, "fid", "left").select("fid", F.coalesce("keep", F.lit(True)).alias("keep"))


def loop_reasons(loops: DataFrame, band: float, most_diameter: float, least_down: float) -> DataFrame:
    """loops: loop_id, height, diameter, facing (normal . up). The first reason in order that a loop is no candidate."""
    reason = F.when(F.col("height") > band, "outside_contact_band").when(F.col("diameter") > most_diameter, "diameter_too_large").when(F.col("facing") > -least_down, "not_downward_facing").otherwise("candidate")
    return loops.select("loop_id", reason.alias("reason"))


def best_loop(loops: DataFrame, target: tuple[float, float, float, float] | None = None, diagonal: float = 1.0) -> DataFrame:
    """loops: loop_id, area, cx, cy, cz. The largest, of equals the first; or, with a target (area and centre), that with the
    least mismatch of area and of centre (a quarter as much, in diagonals), unless its own area is off by more than 15 % or
    its centre by more than 8 %: then none."""
    if target is None:
        m = loops.agg(F.max(F.struct("area", (-F.col("loop_id")).alias("l"))).alias("m"))
        return m.where("m IS NOT NULL").select((-F.col("m.l")).alias("loop_id"))
    area, *centre = map(float, target)
    err = F.abs(F.col("area") - area) / max(area, 1e-9)
    off = mesh.norm(tuple(F.col(f"c{a}") - c for a, c in zip("xyz", centre))) / max(float(diagonal), 1e-6)
    m = loops.agg(F.min(F.struct((err + 0.25 * off).alias("e"), "loop_id", err.alias("err"), off.alias("off"))).alias("m"))
    return m.where("m.err <= 0.15 AND m.off <= 0.08").select("m.loop_id")


def cap_groups(loops: DataFrame, diagonal: float) -> DataFrame:
    """loops: loop_id, n_vertices, n_faces, distance. Running face offset by loop, and which one is the ground cap: of loops of
    four vertices or more near the plane the one with most vertices, of equals the first."""
    near = loops.where((F.col("n_vertices") >= 4) & (F.abs("distance") < 0.02 * diagonal))
    best = near.agg(F.max(F.struct("n_vertices", (-F.col("loop_id")).alias("l"))).alias("m")).select((-F.col("m.l")).alias("ground"))
    w = W.orderBy("loop_id").rowsBetween(W.unboundedPreceding, -1)  # one row a loop
    return loops.select("loop_id", F.coalesce(F.sum("n_faces").over(w), F.lit(0)).alias("offset")).crossJoin(F.broadcast(best)).select("loop_id", "offset", (F.coalesce(F.col("loop_id") == F.col("ground"), F.lit(False))).alias("is_ground"))


def proposal(passes: DataFrame, n_cleanup_faces: int, has_section: bool) -> DataFrame:
    """passes: name, removed_faces, removed_components, largest. One JSON document and whether to apply it."""
    g = passes.agg(F.sum("removed_faces").alias("faces"), F.sum("removed_components").alias("components"), F.max("largest").alias("largest"), F.sort_array(F.collect_list(F.struct("name", "removed_faces"))).alias("passes"))
    doc = F.to_json(F.struct("passes", F.struct("faces", "components", "largest").alias("removed"), F.lit(n_cleanup_faces).alias("cleanup_faces")))
    return g.select(doc.alias("document"), (F.coalesce(F.col("faces") > 0, F.lit(False)) & F.lit(n_cleanup_faces > 0) & F.lit(has_section)).alias("apply"))


def orientation(camera_facing: Column, camera_away: Column, outward: Column, least: float = 0.6, margin: float = 0.15) -> Column:
    """keep or flip by what the cameras see; if that is unclear, by the outward ratio; null if nothing is known."""
    by_camera = F.when((camera_facing >= least) & (camera_facing - camera_away >= margin), "keep").when((camera_away >= least) & (camera_away - camera_facing >= margin), "flip")
    return F.coalesce(by_camera, F.when(outward >= 0.5, "keep").when(outward < 0.5, "flip"))


def mask_consistency(samples: DataFrame) -> DataFrame:
    """samples: outside, ground (booleans of sampled points in sampled views). One row: shares and score, four digits; nulls
    without samples."""
    g = samples.agg(F.count("*").alias("n"), F.avg(F.col("outside").cast("double")).alias("outside"), F.avg(F.col("ground").cast("double")).alias("ground"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("outside") + F.col("ground")) / 2))
    return g.select("n", F.bround("outside", 4).alias("outside"), F.bround("ground", 4).alias("ground"), F.bround(score, 4).alias("score"))


def loop_flags(loops: DataFrame, least: int = 3) -> DataFrame:
    """loops: loop_id, pos, vid of paths whose last vertex repeats the first where closed. loop_id, n, and why it can't be
    filled: small, open or self_touching, else fillable."""
    ends = loops.groupBy("loop_id").agg(F.count("*").alias("rows"), F.count_distinct("vid").alias("distinct"), F.min_by("vid", "pos").alias("first"), F.max_by("vid", "pos").alias("last"))
    closed = F.col("first") == F.col("last")
    n = F.col("rows") - closed.cast("int")
    flag = F.when(~closed, "open").when(n < least, "small").when(F.col("distinct") < n, "self_touching").otherwise("fillable")
    return ends.select("loop_id", n.alias("n"), flag.alias("flag"))


def clip_offset(loops: DataFrame, lowest: float, height: float, share: float = 0.20, epsilon: float = 0.002) -> DataFrame:
    """loops: loop_id, vid, distance (above the plane) of closed boundary loops, the closing vertex not repeated. One row: how
    far to raise the cut so that it clears all loops of three vertices or more near the lowest point, at most 30 % of the
    height deep; without such loops just above the lowest point; never less than epsilon."""
    of = loops.groupBy("loop_id").agg(F.avg("distance").alias("mean"), F.max("distance").alias("top"), F.count_distinct("vid").alias("n"))
    low = of.where((F.col("n") >= 3) & (F.col("mean") - lowest <= share * height))
    clear = F.least(F.max("top") + epsilon, F.lit(lowest + 0.3 * height))
    return low.agg(F.greatest(F.coalesce(clear, F.lit(lowest + epsilon)), F.lit(epsilon)).alias("offset"))
