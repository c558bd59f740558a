"""Holes: simple loops from walked paths, their triangles, and which of them may be added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenmesh.operators import mesh


def split_loops(loops: DataFrame) -> DataFrame:
    """loops: loop_id, pos, vid of closed loops, the closing vertex not repeated. loop_id, part, pos, vid: a loop that visits
    a vertex again is cut there, the inner part first, until no part has a vertex twice; parts of fewer than three vertices
    are left out. A loop is one group, cut in one walk."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("pos")
        walked, place, found = [], {}, []
        for v in pdf["vid"].tolist():
            if v in place:
                found.append(walked[place[v] :])
                for gone in walked[place[v] + 1 :]:
                    del place[gone]
                del walked[place[v] + 1 :]
            else:
                place[v] = len(walked)
                walked.append(v)
        found.append(walked)
        simple = [p for p in found if len(p) >= 3]
        rows = [(int(pdf["loop_id"].iloc[0]), k, i, v) for k, p in enumerate(simple) for i, v in enumerate(p)]
        return pd.DataFrame(rows, columns=["loop_id", "part", "pos", "vid"])

    return loops.groupBy("loop_id").applyInPandas(run, "loop_id long, part long, pos long, vid long")


def chain_paths(paths: DataFrame, vertices: DataFrame, gap: float) -> DataFrame:
    """paths: loop_id (a boundary component), path, pos, vid of open paths. loop_id, chain, pos, vid: paths that share an end
    vertex are chained, each time the first unused one; chains that come back to their beginning are closed, and so are those
    whose ends are at most `gap` apart; others are left out. The closing vertex isn't repeated. A component is one group."""
    at = paths.join(vertices.select("vid", "x", "y", "z"), "vid")

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["path", "pos"])
        where = {v: (x, y, z) for v, x, y, z in zip(pdf["vid"], pdf["x"], pdf["y"], pdf["z"])}
        open_ = [g["vid"].tolist() for _, g in pdf.groupby("path", sort=True)]
        ends: dict[int, list[int]] = {}
        for i in reversed(range(len(open_))):
            for v in {open_[i][0], open_[i][-1]}:
                ends.setdefault(v, []).append(i)
        used, rows, number = set(), [], 0

        def next_at(v):
            """The first unused path that ends there."""
            near = ends.get(v, [])
            while near and near[-1] in used:
                near.pop()
            return near[-1] if near else None

        for seed, path in enumerate(open_):
            if seed in used:
                continue
            used.add(seed)
            chain = list(path)
            while chain[0] != chain[-1]:
                options = [i for i in (next_at(chain[-1]), next_at(chain[0])) if i is not None]
                if not options:
                    break
                i = min(options)
                used.add(i)
                p = open_[i]
                if chain[-1] in (p[0], p[-1]):
                    chain += (p if chain[-1] == p[0] else p[::-1])[1:]
                else:
                    chain = (p if chain[0] == p[-1] else p[::-1])[:-1] + chain
            a, b = where[chain[0]], where[chain[-1]]
            if chain[0] == chain[-1]:
                chain.pop()
            elif not 0 < gap or sum((s - t) ** 2 for s, t in zip(a, b)) ** 0.5 > gap:
                continue
            rows += [(int(pdf["loop_id"].iloc[0]), number, i, v) for i, v in enumerate(chain)]
            number += 1
        return pd.DataFrame(rows, columns=["loop_id", "chain", "pos", "vid"])

    return at.groupBy("loop_id").applyInPandas(run, "loop_id long, chain long, pos long, vid long")


def in_own_plane(loops: DataFrame, vertices: DataFrame) -> DataFrame:
    """loops: loop_id, pos, vid. With x, y in the plane of the loop's area vector, so that the loop turns to the left."""
    at = loops.join(vertices.select("vid", *(F.col(a).alias(f"w{a}") for a in "xyz")), "vid")
    ring = F.array_sort(F.collect_list(F.struct("pos", "wx", "wy", "wz")))
    of = at.groupBy("loop_id").agg(ring.alias("ring"), *(F.avg(f"w{a}").alias(f"m{a}") for a in "xyz"))

    def area(a, b):
        turn = lambda i, n: F.get("ring", i)[f"w{a}"] * n[f"w{b}"] - F.get("ring", i)[f"w{b}"] * n[f"w{a}"]
        return F.aggregate(F.transform("ring", lambda n, i: turn(F.when(i > 0, i - 1).otherwise(F.size("ring") - 1), n)), F.lit(0.0), lambda s, x: s + x)

    of = of.select("loop_id", "mx", "my", "mz", area("y", "z").alias("nx"), area("z", "x").alias("ny"), area("x", "y").alias("nz"))
    size = mesh.norm(tuple(F.col(f"n{a}") for a in "xyz"))
    of = of.where(size > 1e-12).withColumns({f"n{a}": F.col(f"n{a}") / size for a in "xyz"})
    # an axis across the normal: the X axis less what is along it, or the Y axis where the normal is near X
    first = F.abs("nx") < 0.9
    along = F.when(first, F.col("nx")).otherwise(F.col("ny"))
    u = [F.when(first, 1.0).otherwise(0.0) - along * F.col("nx"), F.when(first, 0.0).otherwise(1.0) - along * F.col("ny"), -along * F.col("nz")]
    of = of.withColumns({f"u{a}": c for a, c in zip("xyz", u)})
    of = of.withColumns({f"u{a}": F.col(f"u{a}") / mesh.norm(tuple(F.col(f"u{b}") for b in "xyz")) for a in "xyz"})
    v = mesh.cross(tuple(F.col(f"n{a}") for a in "xyz"), tuple(F.col(f"u{a}") for a in "xyz"))
    both = at.join(of.withColumns({f"v{a}": c for a, c in zip("xyz", v)}), "loop_id")
    on = lambda p: sum(F.col(f"{p}{a}") * (F.col(f"w{a}") - F.col(f"m{a}")) for a in "xyz")
    return both.select("loop_id", "pos", "vid", on("u").alias("x"), on("v").alias("y"))


def fill(loops: DataFrame, faces: DataFrame, vertices: DataFrame, least_area: float = 1e-10) -> DataFrame:
    """loops: loop_id, pos, vid of simple closed loops. loop_id, fid, v0..v2: the triangles of those loops that can be closed
    without an edge of more than two faces, degenerate ones left out. They run against the faces at the loop, so that both
    look to the same side. Loops that claim the same edge beyond two faces go all but the first."""
    cut = mesh.ear_clip(in_own_plane(loops, vertices))
    geometry = mesh.face_geometry(cut.select((F.col("loop_id") * F.lit(1 << 31) + F.col("fid")).alias("fid"), "v0", "v1", "v2"), vertices)
    fine = geometry.where(F.col("area") > least_area).select("fid", "v0", "v1", "v2").withColumn("loop_id", F.floor(F.col("fid") / F.lit(1 << 31)).cast("long"))
    # a loop edge that a face runs along in the same direction: the loop's triangles are turned
    arrow = lambda df: df.select("*", F.inline(F.array(*(F.struct(F.col(f"v{i}").alias("a"), F.col(f"v{(i + 1) % 3}").alias("b")) for i in range(3)))))
    own = arrow(fine).join(arrow(faces.select("v0", "v1", "v2")).select("a", "b", F.lit(1).alias("along")), ["a", "b"], "left")
    turn = own.groupBy("loop_id").agg((F.count("along") > 0).alias("turn"))
    fine = fine.join(turn, "loop_id").select("loop_id", "fid", "v0", *(F.when(F.col("turn"), F.col(f"v{3 - i}")).otherwise(F.col(f"v{i}")).alias(f"v{i}") for i in (1, 2)))
    side = lambda df, *keep: arrow(df).select(*keep, F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    there = side(faces).groupBy("u", "v").agg(F.count("*").alias("n"))
    new = side(fine, "loop_id").groupBy("u", "v", "loop_id").agg(F.count("*").alias("own"))
    before = F.sum("own").over(mesh.W.partitionBy("u", "v").orderBy("loop_id").rowsBetween(mesh.W.unboundedPreceding, 0))
    over = new.withColumn("all", before).join(there, ["u", "v"], "left").where(F.col("all") + F.coalesce("n", F.lit(0)) > 2).select("loop_id").distinct()
    return fine.join(over, "loop_id", "left_anti").select("loop_id", F.pmod("fid", F.lit(1 << 31)).alias("fid"), "v0", "v1", "v2")


def plane_loops(loops: DataFrame, diagonal: float, most: float = 0.01, snap: float = 0.0001, first_new: int | None = None) -> DataFrame:
    """loops: loop_id, vid, distance (from the plane). loop_id of those that lie on the plane: no vertex farther than `most`
    diagonals, and, where clipping made the vertices from `first_new` on, at least one such vertex or all within `snap`
    diagonals."""
    far = F.max(F.abs("distance"))
    fresh = F.max(F.col("vid") >= first_new) if first_new is not None else F.lit(True)
    of = loops.groupBy("loop_id").agg(far.alias("far"), fresh.alias("fresh"))
    return of.where((F.col("far") <= most * diagonal) & (F.col("fresh") | (F.col("far") <= snap * diagonal))).select("loop_id")


def best_shift(sections: DataFrame, least_area: float, share: float = 0.1) -> DataFrame:
    """sections: shift, area of the largest closed section there (0 for none). One row: the first shift whose section is at
    least `least_area` and `share` of the largest, its area, how many were probed, and the first shift with any section."""
    top = sections.agg(F.greatest(F.lit(least_area), share * F.max("area")).alias("need"))
    at = sections.crossJoin(F.broadcast(top))
    good = F.min(F.when(F.col("area") >= F.col("need"), F.struct("shift", "area")))
    return at.agg(good.alias("g"), F.count("*").alias("probed"), F.min(F.when(F.col("area") > 0, F.col("shift"))).alias("first_valid")).select(
        F.col("g.shift").alias("shift"), F.coalesce("g.area", F.lit(0.0)).alias("area"), "probed", "first_valid"
    )
