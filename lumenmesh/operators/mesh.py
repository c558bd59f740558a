"""Mesh operators on relational tables.

faces: fid, v0, v1, v2. vertices: vid, x, y, z. Ids are explicit, results carry no order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lumenmesh.operators.graph import components, cut

CORNERS = ("v0", "v1", "v2")


def face_edges(faces: DataFrame) -> DataFrame:
    """fid, u, v with u < v: the three undirected edges of each face."""
    edge = lambda a, b: F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    return faces.select("fid", F.inline(F.array(edge("v0", "v1"), edge("v1", "v2"), edge("v2", "v0"))))


def edge_degree(faces: DataFrame) -> DataFrame:
    """u, v, n: how many face sides lie on each edge."""
    return face_edges(faces).groupBy("u", "v").agg(F.count("*").alias("n"))


def boundary_edges(faces: DataFrame) -> DataFrame:
    return edge_degree(faces).where("n = 1")


def nonmanifold_edges(faces: DataFrame) -> DataFrame:
    return edge_degree(faces).where("n > 2")


def has_nonmanifold_edges(faces: DataFrame) -> DataFrame:
    return edge_degree(faces).agg(F.coalesce(F.max("n") > 2, F.lit(False)).alias("non_manifold"))


def cap_exceeds_edges(faces: DataFrame, cap: DataFrame) -> DataFrame:
    """Edges of `cap` that would be shared by more than two faces once it is added."""
    have, add = edge_degree(faces), edge_degree(cap).withColumnRenamed("n", "added")
    both = add.join(have, ["u", "v"], "left").select("u", "v", "added", F.coalesce("n", F.lit(0)).alias("present"))
    return both.where("added + present > 2")


def face_adjacency(faces: DataFrame) -> DataFrame:
    """fid, nbr: faces joined over shared edges. On an edge with more than two faces all later faces join the first one
    only (a star). The first face of an edge is a group minimum, so a hot edge is never gathered."""
    edges = face_edges(faces).distinct()
    first = edges.groupBy("u", "v").agg(F.min("fid").alias("hub"), F.max("fid").alias("other")).where("hub < other").drop("other")
    spokes = edges.join(first, ["u", "v"]).where("fid <> hub").select("fid", F.col("hub").alias("nbr"))
    return spokes.unionByName(spokes.select(F.col("nbr").alias("fid"), F.col("fid").alias("nbr"))).distinct()


def clean_mesh(faces: DataFrame) -> DataFrame:
    """Degenerate faces go, then faces with the vertices of an earlier one."""
    proper = faces.where("v0 <> v1 AND v1 <> v2 AND v0 <> v2")
    key = F.array_sort(F.array(*CORNERS))
    first = proper.groupBy(key.alias("key")).agg(F.min(F.struct("fid", *CORNERS)).alias("f"))
    return first.select("f.*")


def referenced_vertices(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    used = faces.select(F.explode(F.array(*CORNERS)).alias("vid")).distinct()
    return vertices.join(used, "vid", "left_semi")


def submesh(faces: DataFrame, part: str = "part") -> DataFrame:
    """part, fid, v0..v2 with vertices numbered densely from 0 within the part, in order of their ids."""
    corner = faces.select(part, "fid", F.posexplode(F.array(*CORNERS)).alias("pos", "vid"))
    ids = corner.select(part, "vid").distinct()
    ids = ids.select(part, "vid", (F.row_number().over(W.partitionBy(part).orderBy("vid")) - 1).cast("long").alias("new"))
    return corner.join(ids, [part, "vid"]).groupBy(part, "fid").agg(*(F.max(F.when(F.col("pos") == i, F.col("new"))).alias(c) for i, c in enumerate(CORNERS)))


def tile_offsets(parts: DataFrame) -> DataFrame:
    """parts: part, n_vertices. Adds the tile (row, col) of a ceil(sqrt(n)) grid and the running vertex offset."""
    n = parts.agg(F.ceil(F.sqrt(F.count("*"))).alias("side"))
    order = W.orderBy("part")  # one row per part
    return parts.crossJoin(F.broadcast(n)).select(
        "part",
        F.floor((F.row_number().over(order) - 1) / F.col("side")).cast("long").alias("tile_row"),
        ((F.row_number().over(order) - 1) % F.col("side")).cast("long").alias("tile_col"),
        F.coalesce(F.sum("n_vertices").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("vertex_offset"),
    )


def weld_vertices(vertices: DataFrame, tol: float) -> DataFrame:
    """vid, new_vid: vertices on the same half-even rounded cell become the one with the smallest id."""
    cell = [F.rint(F.col(c) / tol).alias(f"c{c}") for c in "xyz"]
    firsts = vertices.groupBy(*cell).agg(F.min("vid").alias("new_vid"))
    return vertices.select("vid", *cell).join(firsts, ["cx", "cy", "cz"]).select("vid", "new_vid")


def weld_faces(faces: DataFrame, welded: DataFrame) -> DataFrame:
    """Faces over welded vertices; those with fewer than three distinct ones go."""
    out = faces
    for c in CORNERS:
        to = welded.select(F.col("vid").alias(c), F.col("new_vid").alias(f"n_{c}"))
        out = out.join(to, c)
    return out.select("fid", *(F.col(f"n_{c}").alias(c) for c in CORNERS)).where("v0 <> v1 AND v1 <> v2 AND v0 <> v2")


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """fid, v0..v2 and the coordinates x0..z2 of the three corners."""
    out = faces
    for i, c in enumerate(CORNERS):
        out = out.join(vertices.select(F.col("vid").alias(c), *(F.col(a).alias(f"{a}{i}") for a in "xyz")), c)
    return out


def cross(a: tuple, b: tuple) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(v: tuple) -> Column:
    return F.sqrt(sum(c * c for c in v))


def face_geometry(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """fid, v0..v2, unnormalised normal (nx, ny, nz), area, centroid (cx, cy, cz), degenerate (normal of length <= 1e-12)."""
    at = corners(faces, vertices)
    side = lambda i: tuple(F.col(f"{a}{i}") - F.col(f"{a}0") for a in "xyz")
    n = cross(side(1), side(2))
    at = at.select("fid", *CORNERS, *(c.alias(f"n{a}") for a, c in zip("xyz", n)), *(((F.col(f"{a}0") + F.col(f"{a}1") + F.col(f"{a}2")) / 3).alias(f"c{a}") for a in "xyz"))
    length = norm(tuple(F.col(f"n{a}") for a in "xyz"))
    return at.withColumns({"area": length / 2, "degenerate": length <= 1e-12})


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """vid, nx, ny, nz: area-weighted sums of face normals, of unit length (length floored at 1e-10)."""
    g = face_geometry(faces, vertices).select(F.explode(F.array(*CORNERS)).alias("vid"), "nx", "ny", "nz")
    s = g.groupBy("vid").agg(*(F.sum(f"n{a}").alias(f"n{a}") for a in "xyz"))
    length = F.greatest(norm(tuple(F.col(f"n{a}") for a in "xyz")), F.lit(1e-10))
    return s.select("vid", *((F.col(f"n{a}") / length).alias(f"n{a}") for a in "xyz"))


def outward_ratio(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: the share of proper faces that look away from the vertices' mean; null without any."""
    middle = vertices.agg(*(F.avg(a).alias(f"m{a}") for a in "xyz"))
    g = face_geometry(faces, vertices).where("NOT degenerate").crossJoin(F.broadcast(middle))
    dot = sum(F.col(f"n{a}") * (F.col(f"c{a}") - F.col(f"m{a}")) for a in "xyz")
    return g.agg(F.avg((dot > 0).cast("double")).alias("ratio"), F.count("*").alias("n"))


def bbox_vote(faces: DataFrame, vertices: DataFrame, share: float = 0.05, least: int = 2) -> DataFrame:
    """One row: of the six ends of the three axes, at how many the faces whose centres lie within `share` of the centres'
    range look outward or inward in the mean; an axis without a range has no say."""
    every = face_geometry(faces, vertices)
    box = every.agg(*(f(f"c{a}").alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    g = every.where("NOT degenerate").crossJoin(F.broadcast(box))
    sides = F.array(*(
        F.struct(F.lit(f"{sign}{a}").alias("side"), (F.lit(s) * F.col(f"n{a}") / norm(tuple(F.col(f"n{b}") for b in "xyz"))).alias("out"),
                 ((F.col(f"hi{a}") - F.col(f"c{a}") if s > 0 else F.col(f"c{a}") - F.col(f"lo{a}")) <= share * (F.col(f"hi{a}") - F.col(f"lo{a}"))).alias("near"),
                 (F.col(f"hi{a}") - F.col(f"lo{a}") >= 1e-12).alias("wide"))
        for a in "xyz" for sign, s in (("+", 1.0), ("-", -1.0))
    ))
    near = g.select(F.inline(sides)).where("near AND wide").groupBy("side").agg(F.round(F.avg("out"), 9).alias("out"), F.count("*").alias("n")).where(F.col("n") >= least)
    return near.agg(F.count_if(F.col("out") > 0).alias("outward"), F.count_if(F.col("out") <= 0).alias("inward")).withColumn(
        "looks_outward", F.when(F.col("outward") + F.col("inward") > 0, F.col("outward") >= F.col("inward"))
    )


def flip(faces: DataFrame, when: Column) -> DataFrame:
    """Swaps v1 and v2 where the condition holds."""
    return faces.select("fid", "v0", F.when(when, F.col("v2")).otherwise(F.col("v1")).alias("v1"), F.when(when, F.col("v1")).otherwise(F.col("v2")).alias("v2"))


def face_components(faces: DataFrame) -> DataFrame:
    """fid, component (smallest fid of the connected faces)."""
    found = components(face_adjacency(faces).where("fid < nbr").select(F.col("fid").alias("u"), F.col("nbr").alias("v")))
    return faces.select("fid").join(found.withColumnRenamed("node", "fid"), "fid", "left").select("fid", F.coalesce("root", "fid").alias("component"))


def drop_small_components(faces: DataFrame, share: float = 0.02) -> DataFrame:
    """Faces of components with at least max(1, int(share * faces)) members."""
    of = face_components(faces)
    sizes = of.groupBy("component").agg(F.count("*").alias("size"))
    least = sizes.agg(F.greatest(F.lit(1), F.floor(F.sum("size") * share)).alias("least"))
    keep = sizes.crossJoin(F.broadcast(least)).where("size >= least").select("component")
    return faces.join(of.join(keep, "component", "left_semi"), "fid", "left_semi")


def largest_component(faces: DataFrame) -> DataFrame:
    """Faces of the component with most members; of equal ones that with the smallest fid."""
    of = face_components(faces)
    best = of.groupBy("component").agg(F.count("*").alias("size")).agg(F.max(F.struct("size", (-F.col("component")).alias("c"))).alias("m"))
    return faces.join(of.join(F.broadcast(best.select((-F.col("m.c")).alias("component"))), "component", "left_semi"), "fid", "left_semi")


def erode(adjacency: DataFrame, keep: DataFrame, share: float = 0.6, rounds: int = 3) -> DataFrame:
    """keep: fid, keep. In each round every kept face goes whose removed neighbours are more than `share` of its
    neighbours, all judged by the state before the round; faces without neighbours stay as they are."""
    now = keep
    for _ in range(rounds):
        state = now.select(F.col("fid").alias("nbr"), F.col("keep").alias("nbr_keep"))
        gone = adjacency.join(state, "nbr").groupBy("fid").agg(F.avg((~F.col("nbr_keep")).cast("double")).alias("gone"))
        now = now.join(gone, "fid", "left").select("fid", (F.col("keep") & (F.coalesce("gone", F.lit(0.0)) <= share)).alias("keep"))
    return now


def vertex_adjacency(faces: DataFrame) -> DataFrame:
    e = face_edges(faces).select("u", "v").distinct()
    return e.select(F.col("u").alias("vid"), F.col("v").alias("nbr")).unionByName(e.select(F.col("v").alias("vid"), F.col("u").alias("nbr")))


def smooth(vertices: DataFrame, faces: DataFrame, factors: list[float]) -> DataFrame:
    """One uniform Laplacian step for each factor; alternating signs give Taubin smoothing."""
    adjacency, now = vertex_adjacency(faces), vertices.select("vid", "x", "y", "z")
    for f in factors:
        at = now.select(F.col("vid").alias("nbr"), *(F.col(a).alias(f"n{a}") for a in "xyz"))
        mean = adjacency.join(at, "nbr").groupBy("vid").agg(*(F.avg(f"n{a}").alias(f"n{a}") for a in "xyz"))
        now = now.join(mean, "vid", "left").select("vid", *((F.col(a) + f * (F.coalesce(f"n{a}", a) - F.col(a))).alias(a) for a in "xyz"))
    return now


def kd_partition(points: DataFrame, rounds: int) -> DataFrame:
    """points: id, x, y, z. id, part: in each round every part is cut at the median of its longest axis (ties x, y, z)."""
    now = points.select("id", "x", "y", "z", F.lit(0).cast("long").alias("part"))
    for _ in range(rounds):
        ext = now.groupBy("part").agg(*((F.max(a) - F.min(a)).alias(f"e{a}") for a in "xyz"), *(F.median(a).alias(f"m{a}") for a in "xyz"))
        pick = F.when((F.col("ex") >= F.col("ey")) & (F.col("ex") >= F.col("ez")), 0).when(F.col("ey") >= F.col("ez"), 1).otherwise(2)
        cut = ext.select("part", pick.alias("axis"), F.element_at(F.array("mx", "my", "mz"), pick + 1).alias("cut"))
        now = now.join(cut, "part").select("id", "x", "y", "z", (F.col("part") * 2 + (F.element_at(F.array("x", "y", "z"), F.col("axis") + 1) > F.col("cut")).cast("long")).alias("part"))
    return now.select("id", "part")


def clip_cases(faces: DataFrame, vertices: DataFrame, normal: tuple[float, float, float], offset: float) -> DataFrame:
    """fid, above (corners strictly above the plane), pieces (faces that clipping leaves: 1 for one or three corners
    above, 2 for two)."""
    at = corners(faces, vertices)
    above = sum((sum(F.lit(k) * F.col(f"{a}{i}") for k, a in zip(normal, "xyz")) > offset).cast("int") for i in range(3))
    return at.select("fid", above.alias("above")).withColumn("pieces", F.element_at(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(1)), F.col("above") + 1))


def plane_crossings(faces: DataFrame, vertices: DataFrame, normal: tuple[float, float, float], offset: float) -> DataFrame:
    """u, v, x, y, z: one shared point for every edge whose ends lie strictly on different sides of the plane."""
    e = face_edges(faces).select("u", "v").distinct()
    for c in ("u", "v"):
        d = sum(F.lit(k) * F.col(a) for k, a in zip(normal, "xyz")) - offset
        e = e.join(vertices.select(F.col("vid").alias(c), *(F.col(a).alias(f"{a}{c}") for a in "xyz"), d.alias(f"d{c}")), c)
    e = e.where(F.col("du") * F.col("dv") < 0).withColumn("t", F.col("du") / (F.col("du") - F.col("dv")))
    return e.select("u", "v", *((F.col(f"{a}u") + F.col("t") * (F.col(f"{a}v") - F.col(f"{a}u"))).alias(a) for a in "xyz"))


def section_segments(faces: DataFrame, vertices: DataFrame, normal: tuple[float, float, float], offset: float) -> DataFrame:
    """fid and the two crossed edges of every face that the plane cuts through two of its sides."""
    cut = plane_crossings(faces, vertices, normal, offset).select("u", "v")
    hit = face_edges(faces).join(cut, ["u", "v"])
    ends = hit.groupBy("fid").agg(F.count("*").alias("n"), F.min(F.struct("u", "v")).alias("a"), F.max(F.struct("u", "v")).alias("b"))
    return ends.where("n = 2").select("fid", F.col("a.u").alias("u0"), F.col("a.v").alias("w0"), F.col("b.u").alias("u1"), F.col("b.v").alias("w1"))


def loop_area(loops: DataFrame) -> DataFrame:
    """loops: loop_id, pos, x, y. loop_id, area: signed, by the shoelace formula around each closed loop."""
    w = W.partitionBy("loop_id").orderBy("pos")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w))
    at = loops.select("loop_id", (F.col("x") * nxt("y") - nxt("x") * F.col("y")).alias("cross"))
    return at.groupBy("loop_id").agg((F.sum("cross") / 2).alias("area"))


PATH = "loop_id long, path long, pos long, vid long, closed boolean"
#: Sides that are walked at a time, if they end with a component; rows of a batch of vertices of paths.
WALKED_SIDES, PATH_ROWS = 1 << 18, 1 << 16


def boundary_paths(faces: DataFrame) -> DataFrame:
    """loop_id (smallest vertex of its boundary component), path (number within the component), pos, vid, closed: boundary
    edges walked into paths. The least unused edge begins a path, from its smaller end; each step goes to the smallest
    neighbour over an unused edge; the path ends where it began or where no edge is left. Paths of fewer than three vertices
    are left out. A component of the boundary is walked by one task, as each step depends on those before, in linear time; it
    is read in order, held as flat arrays (some ten bytes for either end of an edge), and paths leave as they end."""
    edges = cut(boundary_edges(faces).select("u", "v"))
    roots = components(edges).withColumnRenamed("node", "u")
    edges = edges.join(roots, "u", "left").select(F.coalesce("root", "u").alias("root"), "u", "v")
    ends = lambda a, b: F.struct(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    both = F.when(F.col("u") == F.col("v"), F.array(ends("u", "v"))).otherwise(F.array(ends("u", "v"), ends("v", "u")))
    sides = edges.select(F.col("root").cast("long").alias("root"), F.inline(both))
    return sides.repartition("root").sortWithinPartitions("root", "u", "v").mapInArrow(_walked, PATH)


def _walked(batches):
    """Arrow batches of sides root, u, v, each edge from both ends, in that order -> batches of PATH."""
    import numpy as np

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        root, u, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        new = np.flatnonzero(root[1:] != root[:-1]) + 1
        if held and held[-1][0][-1] != root[0]:
            new = np.concatenate([[0], new])
        if len(new) and rows + new[-1] >= WALKED_SIDES:
            if last := int(new[-1]):
                held.append(_runs(root[:last], u[:last], v[:last]))
            yield from _paths(held)
            rows, root, u, v = 0, root[last:], u[last:], v[last:]
        held.append(_runs(root, u, v))
        rows += len(u)
    yield from _paths(held)


def _runs(root, u, v):
    """Of sorted sides: root, u and number of each run of one u; all v, in 32 bits where they fit."""
    import numpy as np

    at = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    small = -(1 << 31) <= v.min() and v.max() < 1 << 31
    return root[at], u[at], np.diff(at, append=len(u)), v.astype(np.int32 if small else np.int64)


def _paths(held: list):
    """Batches of the paths of whole components; `held` is emptied."""
    from array import array
    from bisect import bisect_left

    import numpy as np
    import pyarrow as pa

    if not held:
        return
    root, node, count = (np.concatenate([h[i] for h in held]) for i in range(3))
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))  # a run may go on in the next batch
    root, node, count = root[first], node[first], np.add.reduceat(count, first)
    start = np.concatenate([[0], np.cumsum(count)])
    order = np.argsort(node, kind="stable")
    known, to, at = node[order], np.empty(start[-1], np.int32 if len(node) < 1 << 31 else np.int64), 0
    for i, h in enumerate(held):
        to[at : at + len(h[3])] = order[np.searchsorted(known, h[3])]
        at += len(h[3])
        held[i] = None
    held.clear()
    del known, order, count
    # sides of a node before `past` are used; of those behind it, the ones marked in `used` are
    past, begin, near, used = memoryview(start[:-1].copy()), memoryview(start), memoryview(to), bytearray(len(to))

    def onward(x):
        """The smallest neighbour over an unused edge, which is used up; -1 without one."""
        i, end = past[x], begin[x + 1]
        while i < end and used[i]:
            i += 1
        if i == end:
            past[x] = i
            return -1
        past[x], y = i + 1, near[i]
        used[bisect_left(near, x, begin[y], begin[y + 1])] = 1
        return y

    def batch(paths):
        """paths: component's first node, number, position of the first vertex, vertices, closed."""
        long = np.array([len(p[3]) for p in paths])
        flat = np.concatenate([np.frombuffer(p[3], np.int64) for p in paths])
        one = lambda i, kind: np.repeat(np.array([p[i] for p in paths], kind), long)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(long) - long, long) + one(2, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (root[one(0, np.int64)], one(1, np.int64), pos, node[flat], one(4, bool))], ["loop_id", "path", "pos", "vid", "closed"])

    ready, rows, number, of = [], 0, 0, None
    for s in range(len(node)):
        if past[s] == begin[s + 1]:
            continue
        while (x := onward(s)) >= 0:
            path = array("q", (s, x))
            while x != s and (x := onward(x)) >= 0:
                path.append(x)
            if len(path) < 3:
                continue
            if root[s] != of:
                number, of = 0, root[s]
            closed = path[-1] == s
            for i in range(0, len(path), PATH_ROWS):
                ready.append((s, number, i, path[i : i + PATH_ROWS], closed))
                rows += len(ready[-1][3])
                if rows >= PATH_ROWS:
                    yield batch(ready)
                    ready, rows = [], 0
            number += 1
    if ready:
        yield batch(ready)


def ear_clip(loops: DataFrame) -> DataFrame:
    """loops: loop_id, pos, vid, x, y (simple polygons). loop_id, fid, v0..v2: each polygon as triangles, ears cut in order
    of position; nothing of a polygon that can't be cut to the end. A loop is one group; its cost grows with the square of its
    length."""

    def clip(pdf):
        import pandas as pd

        pdf = pdf.sort_values("pos")
        pts, ids = list(zip(pdf["x"], pdf["y"])), list(pdf["vid"])
        turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        ring = list(range(len(pts)))
        if sum(pts[i - 1][0] * pts[i][1] - pts[i][0] * pts[i - 1][1] for i in ring) < 0:
            ring.reverse()
        out = []
        while len(ring) > 2:
            for k in range(len(ring)):
                a, b, c = ring[k - 1], ring[k], ring[(k + 1) % len(ring)]
                inside = (p for p in ring if p not in (a, b, c))
                if turn(pts[a], pts[b], pts[c]) > 0 and not any(min(turn(pts[a], pts[b], pts[p]), turn(pts[b], pts[c], pts[p]), turn(pts[c], pts[a], pts[p])) >= 0 for p in inside):
                    break
            else:
                out = []  # no ear is left: the polygon isn't simple
                break
            out.append((int(pdf["loop_id"].iloc[0]), len(out), ids[a], ids[b], ids[c]))
            ring.pop(k)
        return pd.DataFrame(out, columns=["loop_id", "fid", "v0", "v1", "v2"])

    return loops.groupBy("loop_id").applyInPandas(clip, "loop_id long, fid long, v0 long, v1 long, v2 long")


def clip_mesh(faces: DataFrame, vertices: DataFrame, normal: tuple[float, float, float], offset: float) -> tuple[DataFrame, DataFrame]:
    """The part of the mesh strictly above a plane: vertices with the crossing points added, and faces (source, piece, v0..v2)
    with winding kept. A crossing point's id is a negative hash of its edge, so both faces of an edge share it and no global
    numbering is needed."""
    height = sum(F.lit(float(k)) * F.col(a) for k, a in zip(normal, "xyz")) - float(offset)
    at = faces
    for c in CORNERS:
        at = at.join(vertices.select(F.col("vid").alias(c), (height > 0).alias(f"up_{c}")), c)
    n = sum(F.col(f"up_{c}").cast("int") for c in CORNERS)
    odd = F.when(n == 1, F.when(F.col("up_v0"), 0).when(F.col("up_v1"), 1).otherwise(2)).when(n == 2, F.when(~F.col("up_v0"), 0).when(~F.col("up_v1"), 1).otherwise(2)).otherwise(0)
    ring = F.array(*CORNERS, "v0", "v1")
    turned = at.select("fid", n.alias("n"), odd.alias("odd"), ring.alias("ring")).select("fid", "n", *(F.get("ring", F.col("odd") + i).alias(x) for i, x in enumerate("ijk")))
    point = lambda a, b: _crossing_id(F.least(a, b), F.greatest(a, b))
    tri = lambda *v: F.struct(*(c.alias(x) if isinstance(c, Column) else F.col(c).alias(x) for c, x in zip(v, CORNERS)))
    pieces = (
        F.when(F.col("n") == 3, F.array(tri("i", "j", "k")))
        .when(F.col("n") == 1, F.array(tri("i", point("i", "j"), point("k", "i"))))
        .when(F.col("n") == 2, F.array(tri(point("i", "j"), "j", "k"), tri(point("i", "j"), "k", point("k", "i"))))
    )
    out = turned.where("n > 0").select(F.col("fid").alias("source"), F.posexplode(pieces).alias("piece", "t")).select("source", "piece", "t.*")
    edges = face_edges(faces).select("u", "v").distinct()
    for c in ("u", "v"):
        edges = edges.join(vertices.select(F.col("vid").alias(c), *(F.col(a).alias(f"{a}{c}") for a in "xyz"), height.alias(f"h{c}")), c)
    edges = edges.where((F.col("hu") > 0) != (F.col("hv") > 0)).withColumn("t", F.col("hu") / (F.col("hu") - F.col("hv")))
    made = edges.select(_crossing_id("u", "v").alias("vid"), *((F.col(f"{a}u") + F.col("t") * (F.col(f"{a}v") - F.col(f"{a}u"))).alias(a) for a in "xyz"))
    return vertices.where(height > 0).select("vid", "x", "y", "z").unionByName(made), out


def _crossing_id(u, v) -> Column:
    return -F.shiftrightunsigned(F.xxhash64(u, v), 1) - 1


def section_loops(segments: DataFrame, positions: DataFrame, least_area: float = 1e-12) -> DataFrame:
    """segments: a, b (ids of crossing points); positions: vid, x, y in the plane. loop_id, pos, vid of the closed loops:
    components in which every point has two segments, walked from the smallest id, with an area."""
    e = segments.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct()
    found = components(e)
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    of = both.join(found.withColumnRenamed("node", "u"), "u", "left").withColumn("root", F.coalesce("root", "u"))
    degree = of.groupBy("root", "u").agg(F.count("*").alias("n")).groupBy("root").agg(F.bool_and(F.col("n") == 2).alias("closed")).where("closed")
    at = of.join(degree, "root", "left_semi").join(positions.select(F.col("vid").alias("u"), "x", "y"), "u")

    def walk(pdf):
        import pandas as pd

        nbrs, xy = {}, {}
        for u, v, x, y in zip(pdf["u"], pdf["v"], pdf["x"], pdf["y"]):
            nbrs.setdefault(u, []).append(v)
            xy[u] = (x, y)
        start = min(nbrs)
        path, before = [start], None
        while True:
            step = min(n for n in nbrs[path[-1]] if n != before) if before is not None else min(nbrs[start])
            if step == start:
                break
            before = path[-1]
            path.append(step)
        area = sum(xy[a][0] * xy[b][1] - xy[b][0] * xy[a][1] for a, b in zip(path, path[1:] + path[:1])) / 2
        return pd.DataFrame({"loop_id": start, "pos": range(len(path)), "vid": path, "area": abs(area)})

    loops = at.groupBy("root").applyInPandas(walk, "loop_id long, pos int, vid long, area double")
    return loops.where(F.col("area") > least_area)


def cluster_to_budget(faces: DataFrame, vertices: DataFrame, target: int, tolerance: float = 0.15, steps: int = 30) -> tuple[DataFrame, float]:
    """Faces after welding vertices in cells, and the size of the cells: a binary search over it until the number of faces is
    within `tolerance` of the target (or `steps` are taken; then the nearest so far). Few enough faces stay as they are. One
    count is all that comes to the driver in a step."""
    total = faces.count()
    if total <= target:
        return faces, 0.0
    box = vertices.agg(*((F.max(a) - F.min(a)).alias(a) for a in "xyz")).first()
    lo, hi, best = 0.0, max(box) or 1.0, None
    for _ in range(steps):
        size = (lo + hi) / 2
        found = weld_faces(faces, weld_vertices(vertices, size))
        n = found.count()
        if best is None or abs(n - target) < best[0]:
            best = abs(n - target), found, size
        if abs(n - target) <= tolerance * target:
            break
        lo, hi = (size, hi) if n > target else (lo, size)
    return best[1], best[2]
