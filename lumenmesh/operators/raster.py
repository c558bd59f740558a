"""Images and masks as sparse pixel relations: frame (or any key), px, py and values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _offsets(cells: list[tuple[int, int]]) -> Column:
    return F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in cells))


def square(radius: int) -> list[tuple[int, int]]:
    return [(x, y) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1)]


CROSS = [(1, 0), (-1, 0), (0, 1), (0, -1)]


def spread(pixels: DataFrame, cells: list[tuple[int, int]], *keys: str) -> DataFrame:
    """Every row once for each offset, moved by it; other columns are carried along."""
    rest = [c for c in pixels.columns if c not in ("px", "py")]
    moved = pixels.select("*", F.inline(_offsets(cells)))
    return moved.select(*rest, (F.col("px") + F.col("dx")).alias("px"), (F.col("py") + F.col("dy")).alias("py"), "dx", "dy")


def dilate(mask: DataFrame, radius: int, *keys: str) -> DataFrame:
    return spread(mask.select(*keys, "px", "py"), square(radius)).select(*keys, "px", "py").distinct()


def erode(mask: DataFrame, radius: int, *keys: str) -> DataFrame:
    """Pixels all of whose square neighbourhood is set."""
    n = spread(mask.select(*keys, "px", "py"), square(radius)).groupBy(*keys, "px", "py").agg(F.count("*").alias("n"))
    return n.where(F.col("n") == (2 * radius + 1) ** 2).drop("n")


def close(mask: DataFrame, radius: int, *keys: str) -> DataFrame:
    return erode(dilate(mask, radius, *keys), radius, *keys)


def final_mask(objects: DataFrame, ground: DataFrame, *keys: str) -> DataFrame:
    return objects.join(ground, [*keys, "px", "py"], "left_anti")


def mask_iou(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """keys, both, either, iou; 0 where nothing is set."""
    both = a.select(*keys, "px", "py", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*keys, "px", "py", F.lit(0).alias("a"), F.lit(1).alias("b")))
    cell = both.groupBy(*keys, "px", "py").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    g = cell.groupBy(*keys).agg(F.sum(F.col("a") * F.col("b")).alias("both"), F.count("*").alias("either"))
    return g.withColumn("iou", F.col("both") / F.col("either"))


def fill_depth(depth: DataFrame, mask: DataFrame, hull: DataFrame, mode: str = "fill") -> DataFrame:
    """px, py, depth, changed. `fill` takes the hull's depth where the mask is set and the depth invalid (null or <= 0);
    `replace` takes the hull's for the whole mask, 0 where it has none."""
    m = mask.select("px", "py", F.lit(True).alias("in_mask"))
    h = hull.select("px", "py", F.when(F.col("depth") < F.lit(float("inf")), F.col("depth")).alias("hull"))
    at = depth.join(m, ["px", "py"], "left").join(h, ["px", "py"], "left")
    bad = F.coalesce(F.col("depth") <= 0, F.lit(True)) | F.isnan("depth")
    hull_ok = F.coalesce(F.col("hull") > 0, F.lit(False))
    inside = F.coalesce("in_mask", F.lit(False))
    if mode == "fill":
        new = F.when(inside & bad & hull_ok, F.col("hull")).otherwise(F.col("depth"))
    else:
        new = F.when(inside, F.when(hull_ok, F.col("hull")).otherwise(0.0)).otherwise(F.col("depth"))
    return at.select("px", "py", new.alias("depth"), (~new.eqNullSafe(F.col("depth"))).alias("changed"))


def label_boundary(labels: DataFrame, *keys: str) -> DataFrame:
    """Pixels with a right or lower neighbour, or a left or upper one, of another label."""
    here = labels.select(*keys, "px", "py", "label")
    there = spread(labels.select(*keys, "px", "py", F.col("label").alias("other")), CROSS).drop("dx", "dy")
    return here.join(there, [*keys, "px", "py"]).where("label <> other").select(*keys, "px", "py").distinct()


def gaussian(values: DataFrame, sigma: float, radius: int, *keys: str) -> DataFrame:
    """Normalised convolution over the pixels that exist, in two passes of one axis each (weighted sums and weights)."""
    now = values.select(*keys, "px", "py", F.col("value").alias("s"), F.lit(1.0).alias("w"))
    for axis in ((1, 0), (0, 1)):
        kernel = F.array(*(F.struct(F.lit(axis[0] * i).alias("dx"), F.lit(axis[1] * i).alias("dy"), F.lit(math.exp(-i * i / (2 * sigma * sigma))).alias("k")) for i in range(-radius, radius + 1)))
        now = now.select("*", F.inline(kernel)).groupBy(*keys, (F.col("px") + F.col("dx")).alias("px"), (F.col("py") + F.col("dy")).alias("py")).agg(F.sum(F.col("s") * F.col("k")).alias("s"), F.sum(F.col("w") * F.col("k")).alias("w"))
    out = now.join(values.select(*keys, "px", "py"), [*keys, "px", "py"], "left_semi")
    return out.select(*keys, "px", "py", (F.col("s") / F.col("w")).alias("value"))


def grow(values: DataFrame, width: int, height: int, rounds: int) -> DataFrame:
    """In each round every empty cell of the grid with set 4-neighbours takes their mean."""
    now = values.select("px", "py", "value")
    for _ in range(rounds):
        near = spread(now, CROSS).where((F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") < width) & (F.col("py") < height))
        fresh = near.join(now.select("px", "py"), ["px", "py"], "left_anti").groupBy("px", "py").agg(F.avg("value").alias("value"))
        now = now.unionByName(fresh)
    return now


def downsample(values: DataFrame, factor: int, *keys: str) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / factor).cast("long").alias(c)
    return values.groupBy(*keys, cell("px"), cell("py")).agg(F.avg("value").alias("value"))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def bilinear(samples: DataFrame, image: DataFrame, width: int, height: int) -> DataFrame:
    """samples: id, u, v. The image's value between the four pixels around, which are clipped to the image."""
    x0, y0 = F.floor("u").cast("long"), F.floor("v").cast("long")
    clip = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("long")
    fx, fy = F.col("u") - x0, F.col("v") - y0
    part = lambda dx, dy: F.struct(clip(x0 + dx, width).alias("px"), clip(y0 + dy, height).alias("py"), ((fx if dx else 1 - fx) * (fy if dy else 1 - fy)).alias("w"))
    parts = samples.select("id", F.inline(F.array(part(0, 0), part(1, 0), part(0, 1), part(1, 1))))
    return parts.join(image, ["px", "py"]).groupBy("id").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def composite(base: DataFrame, layers: list[tuple[DataFrame, tuple[float, float, float], float]]) -> DataFrame:
    """base: px, py, r, g, b; each mask is laid over the result so far with its colour and alpha."""
    now = base
    for i, (mask, colour, alpha) in enumerate(layers):
        now = now.join(mask.select("px", "py", F.lit(True).alias(f"_m{i}")), ["px", "py"], "left")
        now = now.withColumns({c: F.when(F.col(f"_m{i}"), F.col(c) * (1 - alpha) + alpha * v).otherwise(F.col(c)) for c, v in zip("rgb", colour)}).drop(f"_m{i}")
    return now


def mean_difference(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Mean absolute difference over the pixels that both have."""
    there = b.select(*keys, "px", "py", F.col("value").alias("other"))
    return a.join(there, [*keys, "px", "py"]).groupBy(*keys).agg(F.avg(F.abs(F.col("value") - F.col("other"))).alias("difference"), F.count("*").alias("n"))


def median_colour(wedges: DataFrame, image: DataFrame, width: int, height: int, fallback: float = 176.0) -> DataFrame:
    """wedges: u, v. One row: the median of each channel at the nearest pixels (v upwards, half to even, clipped); a grey
    where nothing is found."""
    px = F.greatest(F.lit(0), F.least(F.lit(width - 1), F.rint(F.col("u") * (width - 1)))).cast("long")
    py = F.greatest(F.lit(0), F.least(F.lit(height - 1), F.rint((1 - F.col("v")) * (height - 1)))).cast("long")
    at = wedges.select(px.alias("px"), py.alias("py")).join(image, ["px", "py"])
    return at.agg(*(F.coalesce(F.median(c), F.lit(fallback)).alias(c) for c in "rgb"))


def sobel(values: DataFrame, *keys: str) -> DataFrame:
    """Gradient magnitude of pixels all of whose eight neighbours exist."""
    weights = [((x, y), x * (2 if y == 0 else 1), y * (2 if x == 0 else 1)) for y in (-1, 0, 1) for x in (-1, 0, 1) if (x, y) != (0, 0)]
    kernel = F.array(*(F.struct(F.lit(-x).alias("dx"), F.lit(-y).alias("dy"), F.lit(float(gx)).alias("gx"), F.lit(float(gy)).alias("gy")) for (x, y), gx, gy in weights))
    moved = values.select(*keys, "px", "py", "value", F.inline(kernel))
    g = moved.groupBy(*keys, (F.col("px") + F.col("dx")).alias("px"), (F.col("py") + F.col("dy")).alias("py")).agg(F.count("*").alias("n"), F.sum(F.col("value") * F.col("gx")).alias("sx"), F.sum(F.col("value") * F.col("gy")).alias("sy"))
    whole = g.where("n = 8").join(values.select(*keys, "px", "py"), [*keys, "px", "py"], "left_semi")
    return whole.select(*keys, "px", "py", F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")).alias("gradient"))


def unsharp(values: DataFrame, amount: float, sigma: float = 1.0, radius: int = 3, *keys: str) -> DataFrame:
    """What the Gaussian takes away is added `amount` times, kept within 0 to 1."""
    low = gaussian(values, sigma, radius, *keys).withColumnRenamed("value", "_low")
    sharp = F.col("value") + amount * (F.col("value") - F.col("_low"))
    return values.join(low, [*keys, "px", "py"]).select(*keys, "px", "py", F.greatest(F.lit(0.0), F.least(F.lit(1.0), sharp)).alias("value"))


def pixel_components(mask: DataFrame, width: int) -> DataFrame:
    """px, py, component (number of its first pixel, row by row) of set pixels of an image so wide; 8 neighbours touch."""
    from lumenmesh.operators.graph import components

    number = lambda dx, dy: (F.col("py") + dy) * width + F.col("px") + dx
    here = mask.select("px", "py", number(0, 0).cast("long").alias("u")).distinct()
    ahead = [(1, 0), (-1, 1), (0, 1), (1, 1)]
    pairs = here.select("u", F.explode(F.array(*(F.when(F.col("px").between(-dx, width - 1 - dx) & (F.col("px") + dx >= 0), number(dx, dy).cast("long")) for dx, dy in ahead))).alias("v"))
    edges = pairs.join(here.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v")
    roots = components(edges).withColumnRenamed("node", "u")
    return here.join(roots, "u", "left").select("px", "py", F.coalesce("root", "u").alias("component"))


def detail_advantage(reference: DataFrame, candidate: DataFrame, sigma: float = 1.0, radius: int = 3) -> DataFrame:
    """One row, 0 to 1.5: by how much the fine structure (a grey value less its Gaussian) of the candidate exceeds the
    reference's in the mean over the pixels that both have, in shares of the reference's; 0 without such pixels."""

    def fine(values, name):
        low = gaussian(values, sigma, radius).withColumnRenamed("value", "_low")
        return values.join(low, ["px", "py"]).select("px", "py", F.abs(F.col("value") - F.col("_low")).alias(name))

    shared = reference.select("px", "py").join(candidate.select("px", "py"), ["px", "py"], "left_semi")
    both = fine(reference.join(shared, ["px", "py"], "left_semi"), "a").join(fine(candidate.join(shared, ["px", "py"], "left_semi"), "b"), ["px", "py"])
    gain = F.avg(F.greatest(F.col("b") - F.col("a"), F.lit(0.0))) / F.greatest(F.avg("a"), F.lit(1e-4))
    return both.agg(F.coalesce(F.least(gain, F.lit(1.5)), F.lit(0.0)).alias("advantage"), F.count("*").alias("n"))


def fill_region(values: DataFrame, region: DataFrame, rounds: int = 300, *channels: str) -> DataFrame:
    """values: px, py and channels; region: px, py. In each round every empty pixel of the region with set 4-neighbours takes
    their mean, until nothing is empty or can be filled; all other pixels stay. Lineage is cut every round."""
    from lumenmesh.operators.graph import cut

    channels = channels or ("value",)
    now = values.select("px", "py", *channels)
    empty = cut(region.select("px", "py").distinct().join(now, ["px", "py"], "left_anti"))
    for _ in range(rounds):
        fresh = cut(spread(now, CROSS).join(empty, ["px", "py"], "left_semi").groupBy("px", "py").agg(*(F.avg(c).alias(c) for c in channels)))
        if fresh.isEmpty():
            break
        empty = cut(empty.join(fresh.select("px", "py"), ["px", "py"], "left_anti"))
        now = cut(now.unionByName(fresh))
    return now


def level_seams(values: DataFrame, labels: DataFrame, reach: int = 2, sigma: float = 2.0, share: float = 0.7) -> DataFrame:
    """Values within `reach` steps of a border between labels move towards their Gaussian, the nearer the more: by
    share * (1 - d / (reach + 1)), d being the least number of steps (of 8 neighbours) to the border."""
    border = label_boundary(labels).select("px", "py")
    off = F.greatest(F.abs("dx"), F.abs("dy"))
    near = spread(border, square(reach)).groupBy("px", "py").agg(F.min(off).alias("d"))
    low = gaussian(values, sigma, math.ceil(3 * sigma)).withColumnRenamed("value", "_low")
    w = F.coalesce(share * (1 - F.col("d") / (reach + 1)), F.lit(0.0))
    at = values.join(low, ["px", "py"]).join(near, ["px", "py"], "left")
    return at.select("px", "py", (F.col("value") + w * (F.col("_low") - F.col("value"))).alias("value"))
