"""Mesh and view operators bound to the derived tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenmesh.operators import mesh as M
from lumenmesh.operators import views as V
from lumenmesh.plans import tables as T

R = 6  # digits that doubles are rounded to before they are compared


def rounded(df, *columns, digits=R):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def _q(sql: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + sql if ctes else sql


#: Directed adjacency without duplicates, by the star rule.
ADJACENCY = """one AS (SELECT DISTINCT fid, u, v FROM sides),
hub AS (SELECT u, v, min(fid) AS hub FROM one GROUP BY u, v HAVING count(*) > 1),
half AS (SELECT o.fid, h.hub AS nbr FROM one o JOIN hub h ON o.u=h.u AND o.v=h.v WHERE o.fid <> h.hub),
adjacency AS (SELECT fid, nbr FROM half UNION SELECT nbr, fid FROM half)"""
REACH = "reach(fid, c) AS (SELECT fid, fid FROM faces UNION SELECT a.nbr, r.c FROM reach r JOIN adjacency a ON a.fid = r.fid WHERE r.c < a.nbr), comp AS (SELECT fid, min(c) AS component FROM reach GROUP BY fid)"
TOP = "top AS (SELECT texel, rank, view, score FROM ranked WHERE score > 0 AND rank < 3)"
TWO = """two AS (SELECT texel, max(CASE WHEN rank=0 THEN score END) AS score0, max(CASE WHEN rank=1 THEN score END) AS score1,
  max(CASE WHEN rank=0 THEN view END) AS view0, max(CASE WHEN rank=1 THEN view END) AS view1 FROM top GROUP BY texel)"""
KEEP = "keep0 AS (SELECT fid, fid % 3 <> 0 AS keep FROM faces)"


def _erosion_step(i: int) -> str:
    return f"""keep{i + 1} AS (SELECT k.fid, k.keep AND coalesce(g.gone, 0) <= 0.6 AS keep FROM keep{i} k LEFT JOIN
  (SELECT a.fid, avg(CASE WHEN n.keep THEN 0.0 ELSE 1.0 END) AS gone FROM adjacency a JOIN keep{i} n ON n.fid = a.nbr GROUP BY a.fid) g ON g.fid = k.fid)"""


def _smooth_step(i: int, f: float) -> str:
    mean = ", ".join(f"avg(p.{a}) AS {a}" for a in "xyz")
    new = ", ".join(f"s.{a} + ({f}) * (coalesce(m.{a}, s.{a}) - s.{a}) AS {a}" for a in "xyz")
    return f"s{i + 1} AS (SELECT s.vid, {new} FROM s{i} s LEFT JOIN (SELECT n.vid, {mean} FROM vadj n JOIN s{i} p ON p.vid = n.nbr GROUP BY n.vid) m ON m.vid = s.vid)"


def _kd_step(i: int) -> str:
    return f"""e{i} AS (SELECT part, max(x)-min(x) AS ex, max(y)-min(y) AS ey, max(z)-min(z) AS ez, median(x) AS mx, median(y) AS my, median(z) AS mz FROM k{i} GROUP BY part),
k{i + 1} AS (SELECT k.id, x, y, z, 2*k.part + CASE WHEN ex >= ey AND ex >= ez THEN CAST(x > mx AS INT) WHEN ey >= ez THEN CAST(y > my AS INT) ELSE CAST(z > mz AS INT) END AS part FROM k{i} k JOIN e{i} e ON e.part = k.part)"""


def _pairs(spark, d):
    return V.top_views(T.scores(spark, d))


def _texel_face(top):
    return top.select("texel").distinct().select("texel", F.floor(F.col("texel") / 16).cast("long").alias("fid"))


def _texels(top):
    t = F.col("texel")
    return top.select("texel").distinct().select("texel", (t % 7 / 7.0).alias("x"), (t % 11 / 11.0).alias("y"), (t % 13 / 13.0).alias("z"))


def _views(spark):
    return spark.range(16).selectExpr("id AS cam", "cos(id) * 3 AS cx", "sin(id) * 3 AS cy", "CAST(id % 5 AS DOUBLE) AS cz")


def _candidates(top):
    v = F.col("view")
    return top.select("texel", (F.col("score") / 100000).alias("weight"), *((v * k % 17 / 17.0).alias(c) for c, k in zip("rgb", (3, 5, 7))))


CANDIDATES = "cand AS (SELECT texel, score/100000 AS weight, view*3%17/17.0::DOUBLE AS r, view*5%17/17.0::DOUBLE AS g, view*7%17/17.0::DOUBLE AS b FROM top)"
TEXELS = "tex AS (SELECT DISTINCT texel, texel%7/7.0::DOUBLE AS x, texel%11/11.0::DOUBLE AS y, texel%13/13.0::DOUBLE AS z FROM top)"
VIEWS = "vw AS (SELECT range AS cam, cos(range)*3 AS cx, sin(range)*3 AS cy, CAST(range%5 AS DOUBLE) AS cz FROM range(16))"
CONFLICT = """dirs AS (SELECT t.texel, view0, view1, a.cx-x AS ax, a.cy-y AS ay, a.cz-z AS az, b.cx-x AS bx, b.cy-y AS by_, b.cz-z AS bz
  FROM two t JOIN tex USING (texel) JOIN vw a ON a.cam=view0 JOIN vw b ON b.cam=view1 WHERE score1 > 0 AND score0 < 1.35*score1 AND view0 <> view1),
conflict AS (SELECT texel, view0, view1 FROM dirs WHERE degrees(acos(greatest(-1, least(1, (ax*bx+ay*by_+az*bz)/
  (greatest(sqrt(ax*ax+ay*ay+az*az),1e-10)*greatest(sqrt(bx*bx+by_*by_+bz*bz),1e-10)))))) >= 20)"""
PLANE = (1.0, 0.0, 0.0)


def _mesh(f):
    return lambda s, d: f(T.faces(s, d), T.vertices(s, d))


def _summary(s, d):
    e = T.read(s, d, "events")
    out = V.summary(e, "value", "event_type")
    return rounded(out, "mean", "p50", "p90", "p95", "p99", "max", digits=4)


def _ground(s, d):
    e = T.read(s, d, "events")
    return rounded(V.vote_ratio(e, "user_id", F.col("event_type").isin("click", "purchase"), F.col("value") > 10, 3), "ratio")


def _carve(s, d):
    li = T.read(s, d, "lineitem").select(F.col("l_partkey").alias("voxel"), (F.col("l_tax") > 0.01).alias("valid"), (F.col("l_discount") < 0.09).alias("inside"))
    return V.carve(li, 16)


def _zbuffer(s, d):
    li = T.read(s, d, "lineitem")
    return V.z_buffer(li.select((F.col("l_suppkey") % 8).alias("view"), (F.col("l_partkey") % 64).alias("px"), (F.col("l_orderkey") % 64).alias("py"), (F.col("l_extendedprice") / 1000).alias("depth")))


def _rasterise(s, d):
    t = T.dense_faces(s, d)
    at = t.select(F.lit(0).cast("long").alias("view"), "fid", *(e.alias(f"{a}{i}") for i in range(3) for a, e in (("x", F.col(f"v{i}") % 10 * 1.5), ("y", F.floor(F.col(f"v{i}") / 10) * 1.5), ("z", 1 + F.col(f"v{i}") % 7 * 1.0))))
    return rounded(V.rasterise(at), "depth")


def _project(s, d):
    cams = s.range(4).selectExpr("id AS cam", "50.0D AS fx", "60.0D AS fy", "32.0D AS cx", "24.0D AS cy", "64 AS w", "48 AS h", "cos(id) AS r00", "0.0D AS r01", "sin(id) AS r02", "0.0D AS r10", "1.0D AS r11", "0.0D AS r12", "-sin(id) AS r20", "0.0D AS r21", "cos(id) AS r22", "0.1D * id AS tx", "0.0D AS ty", "-2.0D AS tz")
    out = V.project(T.points(s, d), cams).where(V.visible())
    return rounded(out.select("id", "cam", "u", "v", "depth"), "u", "v", "depth", digits=5)


PROJECT = """WITH """ + T.POINTS + """,
k AS (SELECT range AS cam, cos(range) AS c, sin(range) AS s, 0.1*range AS tx FROM range(4)),
q AS (SELECT id, cam, c*(x-tx) - s*(z+2) AS qx, y AS qy, s*(x-tx) + c*(z+2) AS depth FROM points, k),
p AS (SELECT id, cam, 50*qx/greatest(depth,1e-10)+32 AS u, 60*qy/greatest(depth,1e-10)+24 AS v, depth FROM q)
SELECT id, cam, round(u,5) AS u, round(v,5) AS v, round(depth,5) AS depth FROM p WHERE depth > 0.01 AND u >= 0 AND u < 63 AND v >= 0 AND v < 47"""


def _nearest(s, d):
    p = T.points(s, d).select(F.col("id").alias("fid"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"))
    return rounded(V.nearest_camera(p, T.cameras(s, d)), "d2")


def _match(s, d):
    p = T.points(s, d)
    left = p.where("id % 3 = 0").select("id", (F.col("x") + 0.0004).alias("x"), "y", "z")
    return rounded(V.match_tolerant(left, p.where("id % 4 <> 1").withColumnRenamed("id", "rid")), "d")


def _dominant(s, d):
    top = _pairs(s, d)
    return V.dominant_view(top, _texel_face(top), V.conflicts(top, _texels(top), _views(s)), least=2)


def _submesh(s, d):
    return M.submesh(T.faces(s, d).withColumn("part", F.col("fid") % 8))


def _tiles(s, d):
    return M.tile_offsets(T.read(s, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("part")).agg(F.count("*").alias("n_vertices")))


def _erosion(s, d):
    f = T.dense_faces(s, d)
    return M.erode(M.face_adjacency(f), f.select("fid", (F.col("fid") % 3 != 0).alias("keep")))


def _loop_area(s, d):
    c = T.read(s, d, "customer")
    loops = c.select(F.col("c_nationkey").cast("long").alias("loop_id"), F.col("c_custkey").alias("pos"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 37).cast("double").alias("y"))
    return rounded(M.loop_area(loops), "area", digits=4)


def queries() -> dict:
    xyz, nxyz = ("x", "y", "z"), ("nx", "ny", "nz")
    return {
        "boundary_edges": lambda s, d: M.boundary_edges(T.faces(s, d)),
        "nonmanifold_edges": lambda s, d: M.nonmanifold_edges(T.faces(s, d)),
        "has_nonmanifold": lambda s, d: M.has_nonmanifold_edges(T.faces(s, d)),
        "edge_degree": lambda s, d: M.edge_degree(T.dense_faces(s, d)),
        "cap_exceeds_edges": lambda s, d: M.cap_exceeds_edges(T.faces(s, d).where("fid % 5 > 0"), T.faces(s, d).where("fid % 5 = 0")),
        "face_adjacency_star": lambda s, d: M.face_adjacency(T.faces(s, d)),
        "clean_mesh": lambda s, d: M.clean_mesh(T.dense_faces(s, d)),
        "referenced_vertices": lambda s, d: M.referenced_vertices(T.vertices(s, d), T.faces(s, d)),
        "submesh_remap": _submesh,
        "tile_offsets": _tiles,
        "weld_vertices": lambda s, d: M.weld_vertices(T.vertices(s, d), 4.0),
        "weld_faces": lambda s, d: M.weld_faces(T.faces(s, d), M.weld_vertices(T.vertices(s, d), 4.0)),
        "face_normals_area": _mesh(lambda f, v: rounded(M.face_geometry(f, v).select("fid", *nxyz, "area", "cx", "cy", "cz", "degenerate"), *nxyz, "area", "cx", "cy", "cz", digits=4)),
        "vertex_normals": _mesh(lambda f, v: rounded(M.vertex_normals(f, v), *nxyz)),
        "outward_ratio": _mesh(lambda f, v: rounded(M.outward_ratio(f, v), "ratio")),
        "bbox_vote": _mesh(M.bbox_vote),
        "face_components": lambda s, d: M.face_components(T.faces(s, d)),
        "small_components": lambda s, d: M.drop_small_components(T.faces(s, d), 0.0003),
        "largest_component": lambda s, d: M.largest_component(T.faces(s, d)),
        "erosion3": _erosion,
        "laplacian2": _mesh(lambda f, v: rounded(M.smooth(v, f, [0.5, 0.5]), *xyz, digits=10)),
        "taubin4": _mesh(lambda f, v: rounded(M.smooth(v, f, [0.5, -0.53] * 2), *xyz, digits=10)),
        "kd_partition8": lambda s, d: M.kd_partition(T.points(s, d), 3),
        "plane_clip_cases": _mesh(lambda f, v: M.clip_cases(f, v, PLANE, 25.5)),
        "plane_crossings": _mesh(lambda f, v: rounded(M.plane_crossings(f, v, PLANE, 25.5), *xyz, digits=10)),
        "section_segments": _mesh(lambda f, v: M.section_segments(f, v, PLANE, 25.5)),
        "loop_area": _loop_area,
        "topk_views": lambda s, d: rounded(_pairs(s, d), "score", digits=4),
        "best_view": lambda s, d: rounded(V.best_view(T.scores(s, d)), "score", digits=4),
        "companion_views": lambda s, d: V.companion_views(_pairs(s, d), 2),
        "view_hardening": lambda s, d: rounded(V.harden(_pairs(s, d)), "score", digits=4),
        "conflict_texels": lambda s, d: V.conflicts(_pairs(s, d), _texels(_pairs(s, d)), _views(s)),
        "face_view_support": lambda s, d: rounded(V.face_view_support(_pairs(s, d), _texel_face(_pairs(s, d))), "support", digits=5),
        "dominant_view": _dominant,
        "weighted_blend": lambda s, d: rounded(V.blend(_candidates(_pairs(s, d))), "r", "g", "b"),
        "colour_spread": lambda s, d: rounded(V.colour_spread(_candidates(_pairs(s, d))), "spread"),
        "unstable_hardening": lambda s, d: V.harden_unstable(_pairs(s, d), V.colour_spread(_candidates(_pairs(s, d))), _pairs(s, d).where("texel % 9 = 0").select("texel")).select("texel", "rank", "view"),
        "array_summary": _summary,
        "ground_votes": _ground,
        "hull_carve": _carve,
        "zbuffer_min": _zbuffer,
        "rasterise_depth": _rasterise,
        "project_visible": _project,
        "nearest_camera": _nearest,
        "camera_match_tolerant": _match,
        "boundary_paths": lambda s, d: M.boundary_paths(T.faces(s, d)),
    }


def oracle_sql() -> dict:
    F_, D_, E_, V_, C_ = T.FACES, T.DENSE_FACES, T.EDGES, T.VERTICES, T.CORNERS
    S = (T.SCORES, T.RANKED, TOP)
    length = "sqrt(nx*nx+ny*ny+nz*nz)"
    cross = "cut AS (SELECT u, v, du, dv, a.x+du/(du-dv)*(b.x-a.x) AS x, a.y+du/(du-dv)*(b.y-a.y) AS y, a.z+du/(du-dv)*(b.z-a.z) AS z FROM (SELECT DISTINCT s.u, s.v, a.x-25.5 AS du, b.x-25.5 AS dv FROM sides s JOIN vertices a ON a.vid=u JOIN vertices b ON b.vid=v) JOIN vertices a ON a.vid=u JOIN vertices b ON b.vid=v WHERE du*dv < 0)"
    xyz = "round(x,6)+0.0 AS x, round(y,6)+0.0 AS y, round(z,6)+0.0 AS z"
    vadj = "vadj AS (SELECT DISTINCT u AS vid, v AS nbr FROM sides UNION SELECT DISTINCT v, u FROM sides), s0 AS (SELECT * FROM vertices)"
    weld = "weld AS (SELECT vid, min(vid) OVER (PARTITION BY round_even(x/4,0), round_even(y/4,0), round_even(z/4,0)) AS new_vid FROM vertices)"
    sides6 = " UNION ALL ".join(f"SELECT '{s}{a}' AS side, {k}*n{a}/{length} AS o FROM geo, box WHERE {length} > 1e-12 AND hi{a}-lo{a} >= 1e-12 AND {near} <= 0.05*(hi{a}-lo{a})" for a in "xyz" for s, k, near in (("+", 1, f"hi{a}-c{a}"), ("-", -1, f"c{a}-lo{a}")))
    return {
        "boundary_edges": _q("SELECT u, v, n FROM edges WHERE n = 1", F_, E_),
        "nonmanifold_edges": _q("SELECT u, v, n FROM edges WHERE n > 2", F_, E_),
        "has_nonmanifold": _q("SELECT coalesce(max(n) > 2, false) AS non_manifold FROM edges", F_, E_),
        "edge_degree": _q("SELECT u, v, n FROM edges", D_, E_),
        "cap_exceeds_edges": _q("SELECT u, v, count(*) FILTER (fid%5=0) AS added, count(*) FILTER (fid%5>0) AS present FROM sides GROUP BY u, v HAVING count(*) > 2 AND count(*) FILTER (fid%5=0) > 0", F_, E_),
        "face_adjacency_star": _q("SELECT fid, nbr FROM adjacency", F_, E_, ADJACENCY),
        "clean_mesh": _q("SELECT min(fid) AS fid, v0, v1, v2 FROM faces WHERE v0<>v1 AND v1<>v2 AND v0<>v2 GROUP BY v0, v1, v2", D_),
        "referenced_vertices": _q("SELECT * FROM vertices WHERE vid IN (SELECT v0 FROM faces UNION SELECT v1 FROM faces UNION SELECT v2 FROM faces)", F_, V_),
        "submesh_remap": _q("""SELECT f.fid % 8 AS part, f.fid, a.new AS v0, b.new AS v1, c.new AS v2 FROM faces f JOIN ids a ON a.part=f.fid%8 AND a.vid=v0 JOIN ids b ON b.part=f.fid%8 AND b.vid=v1 JOIN ids c ON c.part=f.fid%8 AND c.vid=v2""", F_,
                            "ids AS (SELECT part, vid, row_number() OVER (PARTITION BY part ORDER BY vid) - 1 AS new FROM (SELECT fid%8 AS part, v0 AS vid FROM faces UNION SELECT fid%8, v1 FROM faces UNION SELECT fid%8, v2 FROM faces))"),
        "tile_offsets": "WITH p AS (SELECT CAST(s_nationkey AS BIGINT) AS part, count(*) AS n FROM supplier GROUP BY 1), q AS (SELECT part, n, row_number() OVER (ORDER BY part)-1 AS k, CAST(ceil(sqrt((SELECT count(*) FROM p))) AS BIGINT) AS side FROM p) SELECT part, k//side AS tile_row, k%side AS tile_col, CAST(coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS vertex_offset FROM q",
        "weld_vertices": _q("SELECT vid, new_vid FROM weld", V_, weld),
        "weld_faces": _q("SELECT fid, a.new_vid AS v0, b.new_vid AS v1, c.new_vid AS v2 FROM faces JOIN weld a ON a.vid=v0 JOIN weld b ON b.vid=v1 JOIN weld c ON c.vid=v2 WHERE a.new_vid<>b.new_vid AND b.new_vid<>c.new_vid AND a.new_vid<>c.new_vid", F_, V_, weld),
        "face_normals_area": _q("SELECT fid, " + ", ".join(f"round({c},4)+0.0 AS {c}" for c in ("nx", "ny", "nz", "cx", "cy", "cz")) + f", round({length}/2,4)+0.0 AS area, {length} <= 1e-12 AS degenerate FROM geo", F_, V_, C_),
        "vertex_normals": _q("SELECT vid, " + ", ".join(f"round(n{a}/greatest({length},1e-10),6)+0.0 AS n{a}" for a in "xyz") + " FROM (SELECT vid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM (SELECT v0 AS vid, nx, ny, nz FROM geo UNION ALL SELECT v1, nx, ny, nz FROM geo UNION ALL SELECT v2, nx, ny, nz FROM geo) GROUP BY vid)", F_, V_, C_),
        "outward_ratio": _q(f"SELECT round(avg(CASE WHEN nx*(cx-mx)+ny*(cy-my)+nz*(cz-mz) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6)+0.0 AS ratio, count(*) AS n FROM geo, (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM vertices) WHERE {length} > 1e-12", F_, V_, C_),
        "bbox_vote": _q("SELECT count(*) FILTER (o > 0) AS outward, count(*) FILTER (o <= 0) AS inward, CASE WHEN count(*) > 0 THEN count(*) FILTER (o > 0) >= count(*) FILTER (o <= 0) END AS looks_outward FROM (SELECT side, round(avg(o),9) AS o FROM six GROUP BY side HAVING count(*) >= 2)", F_, V_, C_,
                        "box AS (SELECT " + ", ".join(f"min(c{a}) AS lo{a}, max(c{a}) AS hi{a}" for a in "xyz") + " FROM geo)", f"six AS ({sides6})"),
        "face_components": _q("SELECT fid, component FROM comp", F_, E_, ADJACENCY, REACH),
        "small_components": _q("SELECT f.* FROM faces f JOIN comp c USING (fid) WHERE c.component IN (SELECT component FROM comp GROUP BY 1 HAVING count(*) >= greatest(1, floor(0.0003*(SELECT count(*) FROM faces))))", F_, E_, ADJACENCY, REACH),
        "largest_component": _q("SELECT f.* FROM faces f JOIN comp c USING (fid) WHERE c.component = (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)", F_, E_, ADJACENCY, REACH),
        "erosion3": _q("SELECT fid, keep FROM keep3", D_, E_, ADJACENCY, KEEP, *(_erosion_step(i) for i in range(3))),
        "laplacian2": _q("SELECT vid, " + xyz.replace(",6)", ",10)") + " FROM s2", F_, E_, V_, vadj, _smooth_step(0, 0.5), _smooth_step(1, 0.5)),
        "taubin4": _q("SELECT vid, " + xyz.replace(",6)", ",10)") + " FROM s4", F_, E_, V_, vadj, *(_smooth_step(i, f) for i, f in enumerate([0.5, -0.53] * 2))),
        "kd_partition8": _q("SELECT id, part FROM k3", T.POINTS, "k0 AS (SELECT id, x, y, z, CAST(0 AS BIGINT) AS part FROM points)", *(_kd_step(i) for i in range(3))),
        "plane_clip_cases": _q("SELECT fid, above, CASE above WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS pieces FROM (SELECT fid, CAST(x0>25.5 AS INT)+CAST(x1>25.5 AS INT)+CAST(x2>25.5 AS INT) AS above FROM corner)", F_, V_, C_),
        "plane_crossings": _q("SELECT u, v, " + xyz.replace(",6)", ",10)") + " FROM cut", F_, E_, V_, cross),
        "section_segments": _q("SELECT fid, min((u,v))[1] AS u0, min((u,v))[2] AS w0, max((u,v))[1] AS u1, max((u,v))[2] AS w1 FROM sides JOIN cut USING (u, v) GROUP BY fid HAVING count(*) = 2", F_, E_, V_, cross),
        "loop_area": """WITH p AS (SELECT CAST(c_nationkey AS BIGINT) AS loop_id, c_custkey AS pos, c_acctbal/100 AS x, CAST(c_custkey % 37 AS DOUBLE) AS y FROM customer),
q AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM p WINDOW w AS (PARTITION BY loop_id ORDER BY pos))
SELECT loop_id, round(sum(x*y2-x2*y)/2,4)+0.0 AS area FROM q GROUP BY loop_id""",
        "topk_views": _q("SELECT texel, rank, view, round(score,4)+0.0 AS score FROM top", *S),
        "best_view": _q("SELECT texel, view, round(score,4)+0.0 AS score FROM ranked WHERE rank = 0", T.SCORES, T.RANKED),
        "companion_views": _q("SELECT texel, rank-1 AS place, view FROM top WHERE rank > 0", *S),
        "view_hardening": _q("SELECT texel, rank, view, round(score,4)+0.0 AS score FROM top JOIN two USING (texel) WHERE rank = 0 OR NOT coalesce(score1 > 0 AND score0 > 2*score1, false)", *S, TWO),
        "conflict_texels": _q("SELECT * FROM conflict", *S, TWO, TEXELS, VIEWS, CONFLICT),
        "face_view_support": _q("SELECT texel//16 AS fid, view, round(sum(score),5)+0.0 AS support, count(*) AS coverage FROM top GROUP BY 1, 2", *S),
        "dominant_view": _q("""SELECT n.fid, b.view FROM (SELECT texel//16 AS fid, count(DISTINCT texel) AS n, count(DISTINCT texel) FILTER (texel IN (SELECT texel FROM conflict)) AS bad FROM top GROUP BY 1) n
JOIN (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY support DESC, view) AS k FROM (SELECT texel//16 AS fid, view, sum(score) AS support, count(*) AS coverage FROM top WHERE texel IN (SELECT texel FROM conflict) GROUP BY 1, 2)) b
ON b.fid=n.fid AND b.k=1 WHERE bad >= 2 AND bad >= 0.2*n AND coverage >= 0.7*bad""", *S, TWO, TEXELS, VIEWS, CONFLICT),
        "weighted_blend": _q("SELECT texel, round(sum(weight*r)/sum(weight),6)+0.0 AS r, round(sum(weight*g)/sum(weight),6)+0.0 AS g, round(sum(weight*b)/sum(weight),6)+0.0 AS b FROM cand GROUP BY texel HAVING sum(weight) <> 0", *S, CANDIDATES),
        "colour_spread": _q("SELECT texel, n, round(CASE WHEN n >= 2 THEN spread ELSE 0 END,6)+0.0 AS spread FROM spread", *S, CANDIDATES, *_SPREAD),
        "unstable_hardening": _q("SELECT texel, rank, view FROM top JOIN spread USING (texel) WHERE rank = 0 OR NOT (n >= 2 AND spread > 0.18 AND texel % 9 <> 0)", *S, CANDIDATES, *_SPREAD),
        "array_summary": "SELECT event_type, count(value) AS n, round(avg(value),4)+0.0 AS mean, " + ", ".join(f"round(quantile_cont(value,{q}),4)+0.0 AS p{int(q*100)}" for q in (0.5, 0.9, 0.95, 0.99)) + ", round(max(value),4)+0.0 AS max FROM events GROUP BY event_type",
        "ground_votes": "SELECT user_id, n, round(CASE WHEN n >= 3 THEN yes/n ELSE 0 END,6)+0.0 AS ratio FROM (SELECT user_id, count(*) FILTER (value > 10) AS n, count(*) FILTER (value > 10 AND event_type IN ('click','purchase')) AS yes FROM events GROUP BY user_id)",
        "hull_carve": "SELECT l_partkey AS voxel, count(*) FILTER (l_tax > 0.01) AS views, count(*) FILTER (l_tax > 0.01 AND l_discount < 0.09) AS hits FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_tax > 0.01) >= 3 AND count(*) FILTER (l_tax > 0.01 AND l_discount < 0.09) >= 0.85*count(*) FILTER (l_tax > 0.01)",
        "zbuffer_min": "SELECT l_suppkey%8 AS view, l_partkey%64 AS px, l_orderkey%64 AS py, min(l_extendedprice/1000) AS depth FROM lineitem WHERE l_extendedprice/1000 > 0.01 GROUP BY 1, 2, 3",
        "rasterise_depth": _q("""SELECT CAST(0 AS BIGINT) AS view, fid, px, py, round(a*z0+b*z1+(1-a-b)*z2,6)+0.0 AS depth FROM (SELECT *, ((y1-y2)*(px+0.5-x2)+(x2-x1)*(py+0.5-y2))/det AS a, ((y2-y0)*(px+0.5-x2)+(x0-x2)*(py+0.5-y2))/det AS b
FROM (SELECT *, (y1-y2)*(x0-x2)+(x2-x1)*(y0-y2) AS det FROM tri) t, (SELECT range AS px FROM range(20)), (SELECT range AS py FROM range(20)) WHERE abs(det) > 1e-12) WHERE least(a, b, 1-a-b) >= -1e-5""", D_,
                              "tri AS (SELECT fid, " + ", ".join(f"v{i}%10*1.5::DOUBLE AS x{i}, v{i}//10*1.5::DOUBLE AS y{i}, 1+v{i}%7*1.0::DOUBLE AS z{i}" for i in range(3)) + " FROM faces)"),
        "project_visible": PROJECT,
        "nearest_camera": _q("SELECT id AS fid, cam, round(d2,6)+0.0 AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, cam) AS k FROM (SELECT id, cam, (x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz) AS d2 FROM points, cameras)) WHERE k = 1", T.POINTS, T.CAMERAS),
        "camera_match_tolerant": _q("""SELECT id, rid, round(d,6)+0.0 AS d FROM (SELECT *, lead(d) OVER (PARTITION BY id ORDER BY d, rid) AS second, row_number() OVER (PARTITION BY id ORDER BY d, rid) AS k FROM
(SELECT a.id, b.id AS rid, sqrt((a.x+0.0004-b.x)*(a.x+0.0004-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM points a, points b WHERE a.id%3=0 AND b.id%4<>1)) WHERE k = 1 AND (d <= 1e-3 OR (d <= 5e-2 AND (second IS NULL OR d*10 < second)))""", T.POINTS),
    }


_SPREAD = (
    "mean AS (SELECT texel, sum(weight) AS w, count(*) AS n, sum(weight*r)/sum(weight) AS mr, sum(weight*g)/sum(weight) AS mg, sum(weight*b)/sum(weight) AS mb FROM cand WHERE weight > 0 GROUP BY texel)",
    "spread AS (SELECT texel, any_value(n) AS n, CASE WHEN any_value(n) >= 2 THEN sqrt(sum(weight*((r-mr)*(r-mr)+(g-mg)*(g-mg)+(b-mb)*(b-mb)))/any_value(w)) ELSE 0 END AS spread FROM cand JOIN mean USING (texel) WHERE weight > 0 GROUP BY texel)",
)
