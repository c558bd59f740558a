"""Operators on small hand-made inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumenmesh.functions import rules
from lumenmesh.operators import graph, mesh, raster, sampling, timeline, views

NO_FACES = "fid long, v0 long, v1 long, v2 long"


def faces(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], NO_FACES)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_top_views_ties_and_strictness(spark):
    s = spark.createDataFrame([(0, 0, 0.8), (0, 1, 0.5), (0, 2, 0.2), (0, 3, 0.6), (1, 5, 0.5), (1, 2, 0.5), (2, 1, 0.0)], "texel long, view long, score double")
    assert [(t, r, v) for t, r, v, _ in got(views.top_views(s))] == [(0, 0, 0), (0, 1, 3), (0, 2, 1), (1, 0, 2), (1, 1, 5)]
    assert [(t, v) for t, v, _ in got(views.best_view(s))] == [(0, 0), (1, 2), (2, 1)]


def test_hardening(spark):
    top = spark.createDataFrame([(0, 0, 2, 0.9), (0, 1, 5, 0.3), (0, 2, 7, 0.1), (1, 0, 1, 0.5), (1, 1, 2, 0.4)], "texel long, rank int, view long, score double")
    assert [(t, v) for t, _, v, _ in got(views.harden(top))] == [(0, 2), (1, 1), (1, 2)]


def test_conflicts_need_an_angle(spark):
    cams = spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, 0.0, 0.0, 1.0), (2, 0.98, 0.0, 0.17)], "cam long, cx double, cy double, cz double")
    top = spark.createDataFrame([(0, 0, 0, 0.52), (0, 1, 1, 0.47), (1, 0, 0, 0.8), (1, 1, 1, 0.2), (2, 0, 0, 0.51), (2, 1, 2, 0.49)], "texel long, rank int, view long, score double")
    texels = spark.createDataFrame([(i, 0.0, 0.0, 0.0) for i in range(3)], "texel long, x double, y double, z double")
    assert got(views.conflicts(top, texels, cams)) == [(0, 0, 1)]


def by_all_pairs(left, right, near=1e-3, far=5e-2):
    """id -> (rid, d) of the tolerant match, from all pairs of rows."""
    out = {}
    for i, *p in left:
        ds = sorted((math.sqrt((p[0] - x) * (p[0] - x) + (p[1] - y) * (p[1] - y) + (p[2] - z) * (p[2] - z)), rid) for rid, x, y, z in right)
        if ds and (ds[0][0] <= near or ds[0][0] <= far and (len(ds) == 1 or ds[0][0] * 10 < ds[1][0])):
            out[i] = ds[0][::-1]
    return out


@pytest.mark.parametrize("spread", [0.01, 0.3, 3.0])
def test_tolerant_matches_equal_all_pairs(spark, monkeypatch, spread):
    monkeypatch.setattr(views, "CROWDED", 10)
    rng = random.Random(int(spread * 100))
    near_by = lambda p, r: [c + rng.uniform(-r, r) for c in p]
    right = [(i, *near_by((0, 0, 0), spread)) for i in range(150)]
    right += [(200 + i, *near_by((9, 9, 9), 1e-4)) for i in range(40)] + [(300 + i, 5.0, 5.0, -0.0 if i else 0.0) for i in range(3)]
    right += [(400, 20.0, 0.0, 0.0), (401, 20.5, 0.0, 0.0), (402, 30.0, 0.0, 0.0), (403, 30.4, 0.0, 0.0), (404, -1e12, 0.0, 0.0)]
    left = [(i, *near_by(rng.choice(right)[1:], rng.choice((1e-5, 5e-4, 2e-3, 1e-2, 4e-2, 0.3)))) for i in range(300)]
    left += [(500 + i, x, 0.0, 0.0) for i, x in enumerate((20.0, 20.001, 20.04, 20.05, 30.03, 30.04, 29.95, -1e12))]
    left += [(600 + i, 5.0, 5.0, z) for i, z in enumerate((0.0, 0.0, 0.002, 0.001))]
    odd = [(1000, None, 0.0, 0.0), (1001, float("nan"), 0.0, 0.0), (1002, float("inf"), 0.0, 0.0)]
    l, r = (spark.createDataFrame(rows + odd, f"{k} long, x double, y double, z double") for rows, k in ((left, "id"), (right, "rid")))
    want = by_all_pairs(left, right)
    assert {i: (rid, d) for i, rid, d in got(views.match_tolerant(l, r))} == want and len(want) > 20
    assert got(views.match_tolerant(l, r.where("1 = 0"))) == []


def test_tolerant_matching_writes_no_pairs(spark):
    """Several thousand points of one cell aren't shuffled as millions of pairs."""
    rng = random.Random(7)
    rows = [(i, *(rng.uniform(0, 0.4) for _ in range(3))) for i in range(3000)]
    l, r = (spark.createDataFrame(rows, f"{k} long, x double, y double, z double") for k in ("id", "rid"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = written()
    assert [(i, rid, d) for i, rid, d in got(views.match_tolerant(l, r))] == [(i, i, 0.0) for i in range(3000)]
    assert written() - before < 20e6


def test_blend_and_spread(spark):
    c = spark.createDataFrame([(0, 0.5, 1.0, 0.0, 0.0), (0, 0.5, 0.0, 0.0, 1.0), (1, 0.8, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 1.0, 1.0)], "texel long, weight double, r double, g double, b double")
    assert got(views.blend(c)) == [(0, 0.5, 0.0, 0.5), (1, 1.0, 0.0, 0.0)]
    spread = {t: s for t, _, s in got(views.colour_spread(c))}
    assert math.isclose(spread[0], math.sqrt(0.5)) and spread[1] == 0


def test_star_adjacency_and_empty_mesh(spark):
    f = faces(spark, (0, 1, 2), (1, 0, 3), (0, 1, 4), (7, 8, 9))
    assert got(mesh.face_adjacency(f)) == [(0, 1), (0, 2), (1, 0), (2, 0)]
    assert got(mesh.nonmanifold_edges(f)) == [(0, 1, 3)]
    assert got(mesh.face_components(f)) == [(0, 0), (1, 0), (2, 0), (3, 3)]
    none = f.where("1=0")
    assert got(mesh.face_components(none)) == [] and got(mesh.has_nonmanifold_edges(none)) == [(False,)] and got(mesh.boundary_paths(none)) == []


def test_small_components(spark):
    f = faces(spark, (0, 2, 1), (1, 2, 3), (1, 3, 4), (4, 3, 5), (6, 7, 8))
    assert [r[0] for r in got(mesh.drop_small_components(f, 0.5))] == [0, 1, 2, 3]
    assert [r[0] for r in got(mesh.largest_component(f))] == [0, 1, 2, 3]


def test_orientation(spark):
    v = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (1, -1.0, -1.0, 1.0), (2, -1.0, 1.0, -1.0), (3, 1.0, -1.0, -1.0)], "vid long, x double, y double, z double")
    inward = faces(spark, (0, 1, 2), (0, 3, 1), (0, 2, 3), (1, 3, 2))
    assert got(mesh.outward_ratio(inward, v))[0][0] < 0.1
    assert got(mesh.outward_ratio(mesh.flip(inward, F.lit(True)), v))[0][0] > 0.9


def test_boundary_paths_and_ear_clip(spark):
    square = faces(spark, (0, 1, 2), (0, 2, 3))
    assert got(mesh.boundary_paths(square)) == [(0, 0, i, v, True) for i, v in enumerate((0, 1, 2, 3, 0))]
    loop = spark.createDataFrame([(1, i, 10 + i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (1.0, 0.5), (0.0, 2.0)])], "loop_id long, pos int, vid long, x double, y double")
    tris = got(mesh.ear_clip(loop))
    assert len(tris) == 3 and {v for t in tris for v in t[2:]} == set(range(10, 15))
    assert got(mesh.loop_area(loop)) == [(1, 2.5)]


def roots_of(edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    return root


def paths_of(edges):
    """(loop_id, path, pos, vid, closed) of boundary edges, walked over sets."""
    root, left, out, number = roots_of(edges), {tuple(e) for e in edges}, [], {}
    while left:
        path = list(min(left, key=lambda e: (root[e[0]], e)))
        left.remove(tuple(path))
        while path[-1] != path[0] and (near := [e for e in left if path[-1] in e]):
            to, side = min((e[0] + e[1] - path[-1], e) for e in near)
            left.remove(side)
            path.append(to)
        if len(path) >= 3:
            k = number[root[path[0]]] = number.get(root[path[0]], -1) + 1
            out += [(root[path[0]], k, i, v, path[-1] == path[0]) for i, v in enumerate(path)]
    return sorted(out)


@pytest.mark.parametrize("sides, rows", [(1, 1), (40, 7), (1 << 18, 1 << 16)])
def test_boundary_paths_equal_walks_over_sets(spark, monkeypatch, sides, rows):
    import pyarrow as pa

    rng = random.Random(sides)
    edges = set()
    for k in range(12):  # components whose ids are mixed
        some = [12 * i + k - 50 for i in range(rng.choice((2, 3, 6, 20)))]
        edges |= {tuple(sorted(rng.sample(some, 2))) for _ in range(3 * len(some))}
    edges = sorted(edges | {(2**40 + i, 2**40 + i + 1) for i in range(5)})
    triangles = faces(spark, *((u, v, 2**50 + i) for i, (u, v) in enumerate(edges)))
    want = paths_of([e for u, v, w in ((r.v0, r.v1, r.v2) for r in triangles.collect()) for e in ((u, v), (u, w), (v, w))])
    assert got(mesh.boundary_paths(triangles)) == want
    monkeypatch.setattr(mesh, "WALKED_SIDES", sides)
    monkeypatch.setattr(mesh, "PATH_ROWS", rows)
    plain, root = paths_of(edges), roots_of(edges)
    ends = sorted((root[a], a, b) for u, v in edges for a, b in ((u, v), (v, u)))
    batches = [pa.RecordBatch.from_pylist([dict(zip("ruv", e)) for e in ends[i : i + 9]]) for i in range(0, len(ends), 9)]
    made = [tuple(r.values()) for b in mesh._walked(iter(batches)) for r in b.to_pylist()]
    assert made == plain


def test_boundary_walk_of_a_large_component_stays_small():
    """A component of 100,000 edges in one group: the walk holds few bytes a side."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    gen = np.random.default_rng(1)
    e = np.unique(np.sort(gen.integers(0, 5000, (105_000, 2)), axis=1), axis=0)
    e = e[e[:, 0] < e[:, 1]]
    u, v = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
    by = np.lexsort((v, u))
    batches = [pa.RecordBatch.from_arrays([pa.array(np.zeros(len(c), np.int64)), pa.array(u[c]), pa.array(v[c])], ["root", "u", "v"]) for c in np.array_split(by, 30)]
    tracemalloc.start()
    steps = sum(int(np.count_nonzero(b.column(2).to_numpy())) for b in mesh._walked(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0.95 * len(e) < steps <= len(e)  # of edges; a path of one edge is left out
    assert peak < 40 * len(u)


def test_even_sample_rounds_half_to_even():
    assert sampling.even_positions(10, 4) == [0, 3, 6, 9] and sampling.even_positions(3, 10) == [0, 1, 2]
    assert sampling.even_positions(5, 0) == [] and sampling.even_positions(5, 1) == [2]
    assert sampling.linspace_positions(10, 4) == [0, 3, 6, 9] and sampling.default_interval(5) == 2


def test_interpolation_at_and_outside_keys(spark):
    keys = spark.createDataFrame([(1, 0, 0.0), (1, 10, 20.0)], "k long, t long, v double")
    targets = spark.createDataFrame([(1, t) for t in (-1, 0, 5, 10, 11)] + [(2, 5)], "k long, t long")
    assert {(k, t): v for k, t, v in timeline.interpolate(keys, targets, "k", "t", ["v"]).collect()} == {(1, -1): None, (1, 0): 0.0, (1, 5): 10.0, (1, 10): 20.0, (1, 11): None, (2, 5): None}


def test_slerp_takes_the_shorter_arc(spark):
    q = timeline.slerp([F.lit(1.0), F.lit(0.0)], [F.lit(-math.cos(0.2)), F.lit(-math.sin(0.2))], F.lit(0.5))
    w, x = spark.range(1).select(*q).first()
    assert math.isclose(w, math.cos(0.1)) and math.isclose(x, math.sin(0.1))


def test_depth_fill(spark):
    inf = float("inf")
    depth = spark.createDataFrame([(0, 0, 0.0), (1, 0, 0.7), (2, 0, 0.0), (0, 1, 1.2), (1, 1, 0.0), (2, 1, 0.0)], "px long, py long, depth double")
    mask = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (2, 1)], "px long, py long")
    hull = spark.createDataFrame([(0, 0, 0.5), (1, 0, 0.6), (2, 0, 0.55), (0, 1, 0.8), (1, 1, 0.9), (2, 1, inf)], "px long, py long, depth double")
    assert {(x, y): v for x, y, v, c in raster.fill_depth(depth, mask, hull).collect() if c} == {(0, 0): 0.5}


def test_components_of_nothing_and_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    assert got(graph.components(e)) == [(i, 0) for i in range(1, 61)]
    assert got(graph.components(e.where("1=0"))) == []


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_components_match_a_plain_union(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "BROADCAST_NODES", most)
    rng = random.Random(4)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(200, 201), (201, 200), (300, 300)] + [(400, i) for i in range(401, 440)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    found = graph.components(spark.createDataFrame(edges, "u long, v long"))
    assert got(found) == sorted((x, r) for x, r in root.items() if x != r)


def test_rules(spark):
    r = spark.createDataFrame([(" a/b  c!!",), ("...",), ("ünï-code.",)], "s string")
    assert [tuple(x) for x in r.select(rules.sanitize_name(F.col("s")), rules.branch_slug(F.col("s"))).collect()] == [("a-b-c", "a-b-c"), (None, "main"), ("ünï-code", "ünï-code")]
    t = spark.createDataFrame([("frame_00012.jpg",), ("00012_00013",), ("123456",), (None,)], "s string")
    assert [x[0] for x in t.select(rules.frame_number(F.col("s"))).collect()] == [12, None, None, None]


def test_label_smoothing_in_place(spark):
    from lumenmesh.operators import labels

    view = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (9, 4)], "fid long, view long")
    adjacency = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1)], "fid long, nbr long")
    support = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5), (1, 1, 0.4), (2, 1, 0.5), (9, 4, 1.0)], "fid long, view long, support double")
    assert got(labels.smooth_labels(view, adjacency, support)) == [(0, 1), (1, 1), (2, 1), (9, 4)]


def test_region_labelling(spark):
    from lumenmesh.operators import labels

    f = spark.createDataFrame([(0, 0, 1, {0: 0.45, 1: 0.4}), (1, 0, 0, {0: 0.40, 1: 0.42}), (2, 0, 1, {0: 0.45, 1: 0.4}), (5, 5, 3, {3: 0.1, 4: 0.0})], "fid long, region long, base long, costs map<long,double>")
    links = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)], "fid long, nbr long, weight double")
    assert got(labels.label_regions(f, links)) == [(0, 0, 1), (1, 0, 1), (2, 0, 1), (5, 5, 3)]


def test_proposal_and_orientation(spark):
    from lumenmesh.operators import cleanup

    p = spark.createDataFrame([("a", 3, 1, 5), ("b", 0, 0, 9)], "name string, removed_faces long, removed_components long, largest long")
    doc, apply = cleanup.proposal(p, 4, True).first()
    assert apply and '"largest":9' in doc and '"faces":3' in doc
    assert cleanup.proposal(p.where("1=0"), 4, True).first()["apply"] is False
    ask = spark.range(1).select(*(cleanup.orientation(F.lit(a), F.lit(b), F.lit(c)) for a, b, c in ((0.7, 0.2, 0.1), (0.2, 0.7, 0.9), (0.5, 0.5, 0.9), (0.5, 0.5, 0.1))))
    assert tuple(ask.first()) == ("keep", "flip", "keep", "flip")


def test_principal_axes(spark):
    from lumenmesh.operators import planes

    pts = spark.createDataFrame([(1, float(x), float(y), 0.1 * (x - y)) for x in range(5) for y in range(3)], "k long, x double, y double, z double")
    row = planes.principal_axes(pts, "k").first()
    assert row.n == 15 and all(math.isclose(sum(c * c for c in a), 1) for a in row.axes)
    assert abs(row.axes[2][0]) > 0.9 and abs(row.axes[0][2]) > 0.9


def test_ransac_finds_the_plane(spark):
    from lumenmesh.operators import planes

    pts = spark.range(400).selectExpr("id", "id % 20 / 20.0D AS x", "floor(id / 20) / 20.0D AS y", "IF(id % 10 = 0, id / 100.0D, 0.5D) AS z")
    nx, ny, nz, d, n = planes.ransac_plane(pts, 60).first()
    assert math.isclose(abs(nz), 1, abs_tol=1e-9) and math.isclose(abs(d), 0.5, abs_tol=1e-9) and n >= 360


def test_clip_shares_crossing_points(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0, 2.0, 0.0), (3, 0.0, 2.0, 0.0)], "vid long, x double, y double, z double")
    f = faces(spark, (0, 1, 2), (0, 2, 3))
    pts, out = mesh.clip_mesh(f, v, (0.0, 1.0, 0.0), 1.0)
    where = {r.vid: (r.x, r.y) for r in pts.collect()}
    assert sorted(where.values()) == [(0.0, 1.0), (0.0, 2.0), (0.5, 1.0), (1.0, 1.0), (1.0, 2.0)]
    tris = [tuple(where[i] for i in (r.v0, r.v1, r.v2)) for r in out.collect()]
    areas = [((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2 for a, b, c in tris]
    assert len(tris) == 3 and math.isclose(sum(areas), 1.0) and min(areas) > 0


def test_section_loops(spark):
    seg = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1), (7, 8), (8, 9)], "a long, b long")
    pos = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in ((1, 0, 0), (2, 2, 0), (3, 2, 1), (4, 0, 1), (7, 0, 0), (8, 1, 0), (9, 2, 5))], "vid long, x double, y double")
    assert got(mesh.section_loops(seg, pos)) == [(1, i, v, 2.0) for i, v in enumerate((1, 2, 3, 4))]


def test_entry_imports_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
