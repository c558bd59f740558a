"""Names, tolerant casts, tiers, ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize_name(name: Column, longest: int = 80) -> Column:
    """Slashes and white space become dashes, as does all but letters, digits, underscore, dot and dash; dashes are
    collapsed, dashes and dots trimmed; null where nothing is left."""
    s = F.regexp_replace(name, "[/\\\\]+", "-")
    s = F.regexp_replace(s, "(?U)\\s+", "-")
    s = F.regexp_replace(s, "(?U)[^\\w.-]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, "-{2,}", "-"), "^[-.]+|[-.]+$", "")
    return F.nullif(F.substring(s, 1, longest), F.lit(""))


def branch_slug(name: Column, longest: int = 80) -> Column:
    """Like a name, but white space is an ordinary stranger; nothing left is `main`."""
    s = F.regexp_replace(F.regexp_replace(name, "[/\\\\]+", "-"), "(?U)[^\\w.-]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, "-{2,}", "-"), "^[-.]+|[-.]+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, longest), F.lit("")), F.lit("main"))


_GROUPED = "[0-9]+(_[0-9]+)*"


def _bare(text: Column) -> Column:
    """Without white space around it."""
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def cast_int(text: Column, default: int) -> Column:
    """Whole numbers only, with a sign and underscores between digits allowed; a fraction or an exponent gives the default."""
    s = _bare(text)
    whole = F.when(s.rlike(f"^[+-]?{_GROUPED}$"), F.replace(s, F.lit("_"), F.lit("")).try_cast("bigint"))
    return F.coalesce(whole, F.lit(default).cast("bigint"))


def cast_float(text: Column, default: float) -> Column:
    """Decimal numbers, exponents, inf and nan; underscores between digits allowed."""
    s = F.lower(_bare(text))
    fine = s.rlike(f"^[+-]?(({_GROUPED}\\.?|({_GROUPED})?\\.{_GROUPED})(e[+-]?{_GROUPED})?|inf|infinity|nan)$")
    return F.coalesce(F.when(fine, F.replace(F.regexp_replace(s, "^[+-]nan$", "nan"), F.lit("_"), F.lit("")).try_cast("double")), F.lit(default))


def cast_bool(text: Column, default: bool) -> Column:
    s = F.lower(_bare(text))
    return F.when(s.isin("1", "true", "yes", "on", "y"), True).when(s.isin("0", "false", "no", "off", "n"), False).otherwise(F.lit(default))


def cast_choice(text: Column, choices: list[str], default: str) -> Column:
    """A choice as it is written, white space around it aside."""
    s = _bare(text)
    return F.when(s.isin(*choices), s).otherwise(F.lit(default))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def first_of(*layers: Column) -> Column:
    """Configuration precedence: the first layer that says something."""
    return F.coalesce(*layers)


#: Least memory in MB of each tier and its name, which is output, largest first (fixed values).
TIERS = [(17000, "t18"), (14000, "t16"), (10000, "t12"), (7000, "t8")]


def memory_tier(mb: Column) -> Column:
    out = F.lit("t_other")
    for least, name in reversed(TIERS):
        out = F.when(mb >= least, name).otherwise(out)
    return out


def first_rule(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The class of the first rule whose phrase the lower-cased text contains."""
    out = F.lit(default)
    for phrase, name in reversed(rules):
        out = F.when(F.contains(F.lower(text), F.lit(phrase)), name).otherwise(out)
    return out


def resolve_checkpoint(text: Column, current: Column, spec: list[tuple[str, str]]) -> Column:
    """Where a progress text stands. Nothing said keeps the current checkpoint; a text about starting is the first, one that
    waits for the confirmation of the next stage the last; else the first whose pattern (case aside) is found, even if it is
    the current one; else the last for the word complete; else the current one. Without checkpoints null."""
    if not spec:
        return F.lit(None).cast("string")
    t = _bare(F.coalesce(text, F.lit("")))
    out = F.when(t.rlike("(?i)\\bcomplete\\b"), spec[-1][0]).otherwise(current)
    for name, pattern in reversed(spec):
        out = F.when(t.rlike(f"(?i){pattern}"), name).otherwise(out)
    waiting = t.rlike("(?i)waiting for next-stage confirmation")
    return F.when(t == "", current).when(F.contains(F.lower(t), F.lit("starting")), spec[0][0]).when(waiting, spec[-1][0]).otherwise(out)


def frame_number(text: Column) -> Column:
    """The run of exactly five digits in the stem of a path's last part, else in that part, else in the whole text: the first
    of these that has one such run, not more; null for none."""
    part = F.regexp_extract(F.regexp_replace(text, "(?<=.)(/+\\.?)+$", ""), "[^/]*$", 0)
    stem = F.regexp_replace(part, "(?<=.)\\.[^.]+$", "")

    def only(where):
        runs = F.regexp_extract_all(where, F.lit("(?<![0-9])([0-9]{5})(?![0-9])"), F.lit(1))
        return F.when(F.size(runs) == 1, F.get(runs, F.lit(0)).cast("int"))

    return F.coalesce(only(stem), only(part), only(text))


def progress_of(line: Column, total: int) -> Column:
    """Percent that a training or stereo line (case aside) stands for: 5 + 45 i / total, or 55 + 0.25 p; null for other
    lines."""
    i = F.nullif(F.regexp_extract(line, "(?i)\\[ITER\\s+([0-9]+)\\]", 1), F.lit("")).cast("double")
    p = F.nullif(F.regexp_extract(line, "([0-9]+)%", 1), F.lit("")).cast("double")
    return F.when(i.isNotNull(), 5 + i / total * 45).when(F.lower(line).rlike("stereo|disparity") & p.isNotNull(), 55 + 0.25 * p)


def face_budget(n: Column, ram_limit: Column) -> Column:
    return F.greatest(F.lit(50_000), F.least(n, ram_limit, F.lit(300_000)))


def parameter_ladder(voxel: Column, trunc: Column, baselines: Column, dilate: Column, blocks: Column) -> Column:
    """Requested, reduced and safe parameters, rungs equal to the one before left out."""
    rung = lambda name, v, t, b, d, k: F.struct(F.lit(name).alias("rung"), F.struct(v.alias("voxel"), t.alias("trunc"), b.alias("baselines"), d.alias("dilate"), k.alias("blocks")).alias("p"))
    lo, hi = lambda c, x: F.greatest(c, F.lit(x)), lambda c, x: F.least(c, F.lit(x))
    a = rung("requested", voxel, trunc, baselines, dilate, blocks)
    b = rung("reduced", lo(voxel, 0.005), lo(trunc, 0.04), hi(baselines, 20), lo(dilate, 2), hi(blocks, 100_000))
    c = rung("safe", lo(voxel, 0.005), lo(trunc, 0.04), hi(baselines, 16), lo(dilate, 3), hi(blocks, 75_000))
    steps = F.array(a, b, c)
    return F.filter(steps, lambda s, i: (i == 0) | (s["p"] != F.get(steps, i - 1)["p"]))


def utc_iso(ts: Column) -> Column:
    """A zone-less UTC timestamp as text, to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def alias_of(text: Column, aliases: dict[str, str], default: str) -> Column:
    """The canonical name of a trimmed, lower-cased alias."""
    s = F.lower(F.trim(text))
    out = F.lit(default)
    for name, canonical in aliases.items():
        out = F.when(s == name, canonical).otherwise(out)
    return out


def env_int(text: Column, default: int, least: int) -> Column:
    """A setting as text: the default if it is blank or no whole number, else at least `least`."""
    s = _bare(F.coalesce(text, F.lit("")))
    whole = F.when(s.rlike(f"^[+-]?{_GROUPED}$"), F.replace(s, F.lit("_"), F.lit("")).try_cast("bigint"))
    return F.coalesce(F.greatest(whole, F.when(whole.isNotNull(), F.lit(least).cast("bigint"))), F.lit(default).cast("bigint"))


def env_float(text: Column, default: float, lo: float, hi: float) -> Column:
    """A setting as text: the default if it is blank or no number, else kept between the bounds."""
    x = F.nullif(cast_float(text, float("nan")), F.lit(float("nan")))
    return F.coalesce(F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi))), F.lit(default))


def env_bool(text: Column, default: bool) -> Column:
    s = F.lower(_bare(F.coalesce(text, F.lit(""))))
    return F.when(s.isin("1", "true", "yes", "on"), True).when(s.isin("0", "false", "no", "off"), False).otherwise(F.lit(default))


#: Classes of failures and what a lower-cased text says for each, in order: any of the groups, all of a group's phrases
#: (fixed values).
FAILURES = [
    ("cuda_illegal_memory_access", [["illegal memory access"]]),
    ("cuda_rasterizer_failure", [["diff_gaussian_rasterization", "cuda error"]]),
    ("renderer_signature_mismatch", [["unexpected keyword argument"], ["camera.__init__"], ["train_test_exp"], ["antialiasing"], ["depths"], ["not enough values to unpack"]]),
    ("missing_rasterizer_extension", [["no module named 'diff_gaussian_rasterization'"]]),
    ("missing_output_artifacts", [["missing stereo outputs"], ["camera_data.json"]]),
]


def failure_class(text: Column) -> Column:
    """The first class of failure that the text speaks of, else unclassified."""
    t, out = F.lower(text), F.lit("unclassified")
    for name, groups in reversed(FAILURES):
        said = F.lit(False)
        for phrases in groups:
            every = F.lit(True)
            for p in phrases:
                every = every & F.contains(t, F.lit(p))
            said = said | every
        out = F.when(said, name).otherwise(out)
    return out


def out_of_memory(text: Column) -> Column:
    t = F.lower(text)
    return F.contains(t, F.lit("out of memory")) & (F.contains(t, F.lit("cuda")) | F.contains(t, F.lit("open3d")))


def preset_of(fields: dict[str, Column], presets: dict[str, dict[str, object]], custom: str = "custom") -> Column:
    """The first preset all of whose values the fields have, else custom. fields: the public ones, by name."""
    out = F.lit(custom)
    for name, values in reversed(presets.items()):
        same = F.lit(True)
        for field, column in fields.items():
            same = same & F.coalesce(column == F.lit(values[field]), F.lit(False))
        out = F.when(same, name).otherwise(out)
    return out


def normal_preset(text: Column, names: list[str], default: str) -> Column:
    s = F.lower(_bare(F.coalesce(text, F.lit(""))))
    return F.when(s.isin(*names), s).otherwise(F.lit(default))


def loop_document(loop_id: Column, vertices: Column, diameter: Column, centroid: Column, normal_y: Column, points: Column) -> Column:
    """One loop as JSON; centroid: an array of three, points: an array of such."""
    return F.to_json(F.struct(loop_id.alias("loop_id"), F.size(vertices).alias("vertex_count"), diameter.alias("diameter"), centroid.alias("centroid"), normal_y.alias("normal_y"), points.alias("points")))
