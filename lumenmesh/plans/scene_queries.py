"""Plane, clean-up, label and catalogue operators bound to the test tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenmesh.operators import catalogue as C
from lumenmesh.operators import cleanup as U
from lumenmesh.operators import labels as B
from lumenmesh.operators import mesh as M
from lumenmesh.operators import planes as P
from lumenmesh.operators import sampling as S
from lumenmesh.operators import timeline as L
from lumenmesh.plans import tables as T
from lumenmesh.plans.mesh_queries import ADJACENCY, REACH, _q, rounded

PLANE = P.normalised_plane((0.0, 3.0, 4.0), -60.0)  # 0.6 y + 0.8 z - 12
DIST = "0.6*y+0.8*z-12"


def _loops(s, d):
    """A loop a nation, from the customers that live there."""
    c = T.read(s, d, "customer")
    return c.select(F.col("c_nationkey").cast("long").alias("loop_id"), F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("vid"), (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_custkey") % 37).cast("double").alias("y"), (F.col("c_custkey") % 11).cast("double").alias("z"))


def _passes(s, d):
    li = T.read(s, d, "lineitem")
    keep, band = F.col("l_quantity") > 10, F.col("l_linenumber") <= 3
    outside, ground = F.col("l_discount") * 9, F.col("l_tax") * 9
    k1 = U.clip_pass(keep, [F.col("l_quantity") - 5, F.col("l_extendedprice") - 1000, F.col("l_discount") - 0.005])
    k2 = U.mask_pass(k1, band, outside, ground)
    k3 = U.noise_pass(k2, band, F.col("l_quantity") - 20, outside)
    k4 = U.lower_half_pass(k3, F.col("l_quantity") - 5, F.lit(20.0), outside)
    k5 = U.flipped_pass(k4, F.col("l_quantity"), F.lit(2000.0), F.col("l_tax") - 0.04)
    return li.select("l_returnflag", *(k.cast("int").alias(f"k{i}") for i, k in enumerate((k1, k2, k3, k4, k5), 1))).groupBy("l_returnflag").agg(*(F.sum(f"k{i}").alias(f"k{i}") for i in range(1, 6)))


PASSES = """WITH a AS (SELECT *, l_discount*9 AS o, greatest(l_discount*9, l_tax*9) AS sc, l_linenumber <= 3 AS band FROM lineitem),
b AS (SELECT *, l_quantity > 10 AND least(l_quantity-5, l_extendedprice-1000, l_discount-0.005) > 0 AS k1 FROM a),
c AS (SELECT *, CASE WHEN band AND k1 AND sc > 0.5 THEN false WHEN band AND NOT k1 AND sc < 0.2 THEN true ELSE k1 END AS k2 FROM b),
e AS (SELECT *, k2 AND NOT (NOT band AND l_quantity-20 > 0 AND o > 0.7) AS k3 FROM c),
f AS (SELECT *, k3 AND NOT (l_quantity-5 >= 0 AND l_quantity-5 <= 20 AND o > 0.2) AS k4 FROM e),
g AS (SELECT *, k4 AND NOT (l_quantity < 0.01*2000 AND l_tax-0.04 < 0) AS k5 FROM f)
SELECT l_returnflag, count(*) FILTER (k1) AS k1, count(*) FILTER (k2) AS k2, count(*) FILTER (k3) AS k3, count(*) FILTER (k4) AS k4, count(*) FILTER (k5) AS k5 FROM g GROUP BY 1"""


def _visible(s, d):
    li = T.read(s, d, "lineitem")
    ref = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_extendedprice") / 30000)
    ok = U.sample_visible(F.col("l_quantity") / 25, ref, F.col("l_discount") * 10 - 0.4, F.col("l_orderkey") % 70 * 1.0, F.col("l_partkey") % 50 * 1.0, F.lit(64), F.lit(48), F.when(F.col("l_tax") < 0.07, F.lit(True)))
    return li.groupBy("l_suppkey").agg(F.count_if(ok).alias("visible"), F.count("*").alias("n"))


def _split(s, d):
    f = T.faces(s, d)
    merged = f.where("fid % 4 = 1")
    clipped = f.select("fid", F.floor(F.col("fid") / 2).cast("long").alias("source"), "v2", "v0", "v1")
    return U.split_faces(clipped, merged, f.select("fid", (F.col("fid") % 3 > 0).alias("keep")))


def _scatter(s, d):
    f = T.faces(s, d)
    return U.scatter_keep(f, f.where("fid % 5 > 0").select("fid", F.floor(F.col("fid") / 3).cast("long").alias("merged")), f.select("fid", (F.col("fid") % 7 > 0).alias("keep")))


def _reasons(s, d):
    p = T.read(s, d, "part")
    loops = p.select(F.col("p_partkey").alias("loop_id"), (F.col("p_size") / 10).alias("height"), (F.col("p_retailprice") / 500).alias("diameter"), (F.col("p_partkey") % 5 / 5.0 - 0.6).alias("facing"))
    return U.loop_reasons(loops, 3.5, 3.0, 0.3)


def _caps(s, d):
    loops = T.read(s, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("loop_id")).agg(F.count("*").alias("n_vertices"), (F.count("*") - 2).alias("n_faces"), (F.min("s_suppkey") / 10.0 - 1).alias("distance"))
    return U.cap_groups(loops, 50.0)


def _regions(s, d):
    f = T.faces(s, d)
    normals = f.select("fid", F.lit(0.0).alias("nx"), F.when(F.col("fid") % 7 == 0, 0.0).otherwise(1.0).alias("ny"), F.when(F.col("fid") % 7 == 0, 1.0).otherwise(0.0).alias("nz"))
    sets = f.select("fid", F.array(F.col("v0") % 3, F.col("v1") % 4 + 1).alias("views"))
    return B.regions(f.where("fid % 4 = 0").select("fid"), M.face_adjacency(f), normals, sets)


REGIONS = """ok AS (SELECT a.fid, a.nbr FROM adjacency a JOIN faces f ON f.fid=a.fid JOIN faces g ON g.fid=a.nbr WHERE (a.fid%7=0) = (a.nbr%7=0)
  AND (f.v0%3 = g.v0%3 OR f.v0%3 = g.v1%4+1 OR f.v1%4+1 = g.v0%3 OR f.v1%4+1 = g.v1%4+1)),
reach(fid, c) AS (SELECT fid, fid FROM faces UNION SELECT a.nbr, r.c FROM reach r JOIN ok a ON a.fid = r.fid WHERE r.c < a.nbr),
comp AS (SELECT fid, min(c) AS region FROM reach GROUP BY fid)"""


def _boxes(s, d):
    p = T.points(s, d)
    return rounded(P.oriented_boxes(p.withColumn("k", F.col("id") % 5), "k"), "extent0", "extent1", "extent2", digits=4)


def _upsert(s, d):
    o = T.read(s, d, "orders")
    row = lambda k: o.where(k).select(F.col("o_orderkey").alias("name"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("string").alias("created_at"))
    new = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("name"), F.lit("X").alias("status"))
    return C.upsert(row("o_orderkey % 2 = 0"), new, "name", "created_at", F.lit("now"))


def _settings(s, d):
    p = T.read(s, d, "part")
    layer = lambda k, e: p.where(k).select(F.col("p_partkey").cast("string").alias("key"), F.expr(e).alias("value"))
    return C.settings([layer("p_partkey % 5 = 0", "if(p_partkey % 10 = 0, NULL, 'explicit')"), layer("p_partkey % 3 = 0", "'preset'"), layer("true", "'default'")])


def _migration(s, d):
    names = T.read(s, d, "nation").select(F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("main/N"), F.col("n_nationkey") + 1)).otherwise(F.concat(F.lit("N"), F.col("n_nationkey"))).alias("name"))
    return C.migration_plan(names, "main")


def _transfer(s, d):
    g = T.grid(s, d).select("px", "py", F.col("value").alias("r"), (F.col("value") / 2).alias("g"), (F.col("value") + F.col("px")).alias("b"))
    return rounded(C.colour_transfer(g.where("px < 20"), g.where("px >= 20")), "r", "g", "b", digits=4)


def _cube(s, d):
    li = T.read(s, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("q"))
    return C.grouping_summary(li, "l_returnflag", "l_linestatus", measure="q").withColumn("level", F.col("level").cast("long"))


def _sphere(s, d):
    """The slerp of one turn around an axis to another, by order."""
    o = T.read(s, d, "orders")
    half = lambda c: (F.col(c) % 300) / 100.0
    a, b = [F.cos(half("o_orderkey")), F.sin(half("o_orderkey"))], [F.cos(half("o_custkey")), F.sin(half("o_custkey"))]
    w, x = L.slerp(a, b, F.lit(0.25))
    return rounded(o.select("o_orderkey", w.alias("w"), x.alias("x")), "w", "x", digits=5)


def queries() -> dict:
    v, f = T.vertices, T.faces
    return {
        "bounding_box": lambda s, d: rounded(P.bounding_box(v(s, d)), "diagonal"),
        "signed_distances": lambda s, d: rounded(v(s, d).select("vid", P.signed_distance(PLANE).alias("distance")), "distance"),
        "plane_toward_mesh": lambda s, d: rounded(P.orient_to_mesh(v(s, d), PLANE), "nx", "ny", "nz", "d"),
        "default_plane": lambda s, d: rounded(P.default_plane(v(s, d)), "d"),
        "onto_plane": lambda s, d: rounded(P.onto_plane(v(s, d), PLANE, F.col("vid") % 2 == 0), "x", "y", "z"),
        "loop_plane_coordinates": lambda s, d: rounded(P.loop_plane_coordinates(_loops(s, d), (0.0, 1.0, 0.0)), "x", "y"),
        "planar_uvs": lambda s, d: rounded(P.planar_uvs(v(s, d), (0.0, 1.0, 0.0)), "u", "v"),
        "planar_uvs_across": lambda s, d: rounded(P.planar_uvs(v(s, d), (2.0, 0.0, 0.0)), "u", "v"),
        "barycentric_weights": lambda s, d: rounded(T.read(s, d, "orders").select("o_orderkey", *(c.alias(n) for c, n in zip(P.barycentric(F.col("o_orderkey") % 7 / 7.0, F.col("o_custkey") % 5 / 5.0, [F.lit(0.0), F.lit(1.0), F.lit(0.2)], [F.lit(0.0), F.lit(0.1), F.lit(1.0)]), "abc")), P.in_triangle(F.col("o_orderkey") % 7 / 7.0, F.col("o_custkey") % 5 / 5.0, [F.lit(0.0), F.lit(1.0), F.lit(0.2)], [F.lit(0.0), F.lit(0.1), F.lit(1.0)]).alias("inside")), "a", "b", "c"),
        "texture_size": lambda s, d: T.read(s, d, "part").select("p_partkey", P.texture_size(F.col("p_size") % 3 * 512, F.col("p_size") * 40, F.col("p_partkey") % 100 * 30).alias("size")),
        "clean_up_passes": _passes,
        "sample_visibility": _visible,
        "islands": lambda s, d: U.islands(f(s, d), v(s, d), 0.001, 0.2),
        "split_faces": _split,
        "scatter_keep": _scatter,
        "loop_reasons": _reasons,
        "cap_groups": _caps,
        "label_regions_grown": _regions,
        "oriented_boxes": _boxes,
        "plane_ransac": lambda s, d: P.ransac_plane(T.points(s, d), 50, 0.05),
        "hashed_sample": lambda s, d: S.hashed_sample(T.read(s, d, "part").select("p_partkey"), "p_partkey", 100),
        "metadata_upsert": _upsert,
        "layered_settings": _settings,
        "branch_migration": _migration,
        "colour_transfer": _transfer,
        "cube_summary": _cube,
        "slerp_turns": _sphere,
    }


def oracle_sql() -> dict:
    V, Fc, E = T.VERTICES, T.FACES, T.EDGES
    G = T.GRID
    r = lambda *cs, n=6: ", ".join(f"round({e},{n})+0.0 AS {a}" for a, e in (c.split("=", 1) for c in cs))
    return {
        "bounding_box": _q("SELECT " + ", ".join(f"min({a}) AS lo_{a}, max({a}) AS hi_{a}" for a in "xyz") + ", round(sqrt((max(x)-min(x))**2+(max(y)-min(y))**2+(max(z)-min(z))**2),6)+0.0 AS diagonal FROM vertices", V),
        "signed_distances": _q(f"SELECT vid, round({DIST},6)+0.0 AS distance FROM vertices", V),
        "plane_toward_mesh": _q(f"SELECT round(0*k,6)+0.0 AS nx, round(0.6*k,6)+0.0 AS ny, round(0.8*k,6)+0.0 AS nz, round(-12*k,6)+0.0 AS d FROM (SELECT CASE WHEN m < -1e-9 OR (abs(m) <= 1e-9 AND a < b) THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS k FROM (SELECT avg({DIST}) AS m, count(*) FILTER ({DIST} > 0) AS a, count(*) FILTER ({DIST} < 0) AS b FROM vertices))", V),
        "default_plane": _q("SELECT 0.0::DOUBLE AS nx, 1.0::DOUBLE AS ny, 0.0::DOUBLE AS nz, round(-min(y),6)+0.0 AS d FROM vertices", V),
        "onto_plane": _q("SELECT vid, " + r("x=x", f"y=CASE WHEN vid%2=0 THEN y-({DIST})*0.6 ELSE y END", f"z=CASE WHEN vid%2=0 THEN z-({DIST})*0.8 ELSE z END") + " FROM vertices", V),
        "loop_plane_coordinates": "WITH l AS (SELECT CAST(c_nationkey AS BIGINT) AS loop_id, c_custkey AS vid, c_acctbal/1000 AS x, CAST(c_custkey%11 AS DOUBLE) AS z FROM customer) SELECT loop_id, vid AS pos, vid, " + r("x=x-avg(x) OVER (PARTITION BY loop_id)", "y=avg(z) OVER (PARTITION BY loop_id)-z") + " FROM l",
        "planar_uvs": _q("SELECT vid, " + r("u=0.5+(x-mx)*0.96/s", "v=0.5-(z-mz)*0.96/s") + " FROM vertices, (SELECT (min(x)+max(x))/2 AS mx, (min(z)+max(z))/2 AS mz, greatest(max(x)-min(x), max(z)-min(z)) AS s FROM vertices)", V),
        "planar_uvs_across": _q("SELECT vid, " + r("u=0.5+(y-my)*0.96/s", "v=0.5+(z-mz)*0.96/s") + " FROM vertices, (SELECT (min(y)+max(y))/2 AS my, (min(z)+max(z))/2 AS mz, greatest(max(y)-min(y), max(z)-min(z)) AS s FROM vertices)", V),
        "barycentric_weights": "WITH p AS (SELECT o_orderkey, o_orderkey%7/7.0::DOUBLE AS x, o_custkey%5/5.0::DOUBLE AS y FROM orders), q AS (SELECT o_orderkey, ((0.1-1)*(x-0.2)+(0.2-1)*(y-1))/((0.1-1)*(0-0.2)+(0.2-1)*(0-1)) AS a, ((1-0)*(x-0.2)+(0-0.2)*(y-1))/((0.1-1)*(0-0.2)+(0.2-1)*(0-1)) AS b FROM p) SELECT o_orderkey, round(a,6)+0.0 AS a, round(b,6)+0.0 AS b, round(1-a-b,6)+0.0 AS c, least(a,b,1-a-b) >= -1e-9 AS inside FROM q",
        "texture_size": "SELECT p_partkey, least(2048, CASE WHEN p_size%3*512 > 0 THEN p_size%3*512 ELSE CAST(round_even(sqrt(p_size*40*(p_partkey%100*30)),0) AS BIGINT) END) AS size FROM part",
        "clean_up_passes": PASSES,
        "sample_visibility": "SELECT l_suppkey, count(*) FILTER (l_quantity/25 > 0.01 AND l_orderkey%70 < 63 AND l_partkey%50 < 47 AND l_tax < 0.07 AND (l_linenumber%3 = 0 OR l_quantity/25 <= l_extendedprice/30000+greatest(1e-4, 0.003*(l_extendedprice/30000)/greatest(abs(l_discount*10-0.4),0.1)))) AS visible, count(*) AS n FROM lineitem GROUP BY 1",
        "islands": _q("SELECT f.* FROM faces f JOIN comp c USING (fid) WHERE c.component IN (SELECT component FROM judged)", Fc, E, V, ADJACENCY, REACH,
                      "sizes AS (SELECT component, count(*) AS size FROM comp GROUP BY 1)", "main AS (SELECT component AS main, size AS largest FROM sizes ORDER BY size DESC, component LIMIT 1)",
                      "fv AS (SELECT fid, v0 AS vid FROM faces UNION ALL SELECT fid, v1 FROM faces UNION ALL SELECT fid, v2 FROM faces)", "cv AS (SELECT DISTINCT component, v.vid, v.x, v.y, v.z FROM comp JOIN fv USING (fid) JOIN vertices v ON v.vid = fv.vid)",
                      "box AS (SELECT " + ", ".join(f"min({a}) AS lo{a}, max({a}) AS hi{a}" for a in "xyz") + " FROM cv, main WHERE component = main)",
                      "diag AS (SELECT sqrt((hix-lox)**2+(hiy-loy)**2+(hiz-loz)**2) AS d FROM box)",
                      "far AS (SELECT component, min(sqrt(" + "+".join(f"greatest(lo{a}-{a},0,{a}-hi{a})**2" for a in "xyz") + ")) AS off FROM cv, box GROUP BY 1)",
                      "judged AS (SELECT component FROM sizes JOIN far USING (component), main, diag WHERE component = main OR (size >= greatest(1, floor(0.001*largest)) AND off <= 0.2*d))"),
        "split_faces": _q("SELECT fid, fid//2 AS source, v0, v1, v2 FROM (SELECT fid, v0, v1, v2 FROM faces) c WHERE fid//2 IN (SELECT fid FROM faces WHERE fid%3 > 0) AND NOT EXISTS (SELECT 1 FROM faces m WHERE m.fid%4=1 AND m.v0=c.v0 AND m.v1=c.v1 AND m.v2=c.v2)", Fc),
        "scatter_keep": _q("SELECT f.fid, coalesce(bool_and(k.fid%7 > 0), true) AS keep FROM faces f LEFT JOIN faces k ON f.fid%5 > 0 AND k.fid = f.fid//3 GROUP BY f.fid", Fc),
        "loop_reasons": "SELECT p_partkey AS loop_id, CASE WHEN p_size/10 > 3.5 THEN 'outside_contact_band' WHEN p_retailprice/500 > 3 THEN 'diameter_too_large' WHEN p_partkey%5/5.0::DOUBLE-0.6::DOUBLE > -0.3::DOUBLE THEN 'not_downward_facing' ELSE 'candidate' END AS reason FROM part",
        "cap_groups": "WITH l AS (SELECT CAST(s_nationkey AS BIGINT) AS loop_id, count(*) AS n, min(s_suppkey)/10.0::DOUBLE-1 AS dist FROM supplier GROUP BY 1), g AS (SELECT loop_id AS ground FROM l WHERE n >= 4 AND abs(dist) < 1 ORDER BY n DESC, loop_id LIMIT 1) SELECT loop_id, CAST(coalesce(sum(n-2) OVER (ORDER BY loop_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS \"offset\", coalesce(loop_id = (SELECT ground FROM g), false) AS is_ground FROM l",
        "label_regions_grown": _q("SELECT fid, region FROM comp WHERE region IN (SELECT region FROM comp WHERE fid%4=0)", Fc, E, ADJACENCY, REGIONS),
        "metadata_upsert": "SELECT o_orderkey AS name, CASE WHEN o_orderkey%3=0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey%2=0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE 'now' END AS created_at FROM orders WHERE o_orderkey%2=0 OR o_orderkey%3=0",
        "layered_settings": "SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_partkey%5=0 AND p_partkey%10<>0 THEN 'explicit' WHEN p_partkey%3=0 THEN 'preset' ELSE 'default' END AS value, CASE WHEN p_partkey%5=0 AND p_partkey%10<>0 THEN 0 WHEN p_partkey%3=0 THEN 1 ELSE 2 END AS layer FROM part",
        "branch_migration": "WITH n AS (SELECT CASE WHEN n_nationkey%3=0 THEN 'main/N' || (n_nationkey+1) ELSE 'N' || n_nationkey END AS name FROM nation) SELECT name, 'main/' || name AS target FROM n WHERE NOT contains(name, '/') AND 'main/' || name NOT IN (SELECT name FROM n)",
        "colour_transfer": f"WITH {G}, c AS (SELECT px, py, value AS r, value/2 AS g, value+px AS b FROM grid), s AS (SELECT px < 20 AS p, " + ", ".join(f"avg({k}) AS m{k}, stddev_pop({k}) AS d{k}" for k in "rgb") + " FROM c GROUP BY 1) SELECT px, py, " + ", ".join(f"round(({k}-a.m{k})*t.d{k}/greatest(a.d{k},1e-6)+t.m{k},4)+0.0 AS {k}" for k in "rgb") + " FROM c, s a, s t WHERE px < 20 AND a.p AND NOT t.p",
        "cube_summary": "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag)*2+grouping(l_linestatus) AS BIGINT) AS level, count(*) AS n, count(DISTINCT q) AS distinct_values, CAST(sum(q) AS BIGINT) AS total FROM (SELECT l_returnflag, l_linestatus, CAST(trunc(l_quantity) AS BIGINT) AS q FROM lineitem) GROUP BY CUBE (l_returnflag, l_linestatus)",
        "slerp_turns": """WITH a AS (SELECT o_orderkey, o_orderkey%300/100.0::DOUBLE AS p, o_custkey%300/100.0::DOUBLE AS q FROM orders), b AS (SELECT *, cos(p)*cos(q)+sin(p)*sin(q) AS dot FROM a), c AS (SELECT *, CASE WHEN dot < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sg, acos(least(1.0::DOUBLE, abs(dot))) AS ang FROM b),
e AS (SELECT *, CASE WHEN ang < 1e-6 THEN 0.75 ELSE sin(0.75*ang)/sin(ang) END AS wa, CASE WHEN ang < 1e-6 THEN 0.25 ELSE sin(0.25*ang)/sin(ang) END AS wb FROM c), f AS (SELECT o_orderkey, wa*cos(p)+wb*sg*cos(q) AS w, wa*sin(p)+wb*sg*sin(q) AS x FROM e) SELECT o_orderkey, round(w/sqrt(w*w+x*x),5)+0.0 AS w, round(x/sqrt(w*w+x*x),5)+0.0 AS x FROM f""",
    }


def _consistency(s, d):
    return U.mask_consistency(T.read(s, d, "lineitem").select((F.col("l_discount") > 0.05).alias("outside"), (F.col("l_tax") > 0.06).alias("ground")))


def _loop_rows(s, d):
    """A loop a customer: area and centre of their orders."""
    o = T.read(s, d, "orders").groupBy(F.col("o_custkey").alias("loop_id"))
    return o.agg(F.round(F.sum("o_totalprice") / 1000, 3).alias("area"), (F.max("o_orderkey") % 100 / 1.0).alias("cx"), (F.max("o_orderkey") % 37 / 1.0).alias("cy"), (F.count("*") / 1.0).alias("cz"))


def _best(s, d):
    """The best loop without a target, with one that fits, and with one whose best match is too far off."""
    loops = _loop_rows(s, d)
    named = lambda kind, df: df.select(F.lit(kind).alias("kind"), "loop_id")
    out = named("largest", U.best_loop(loops)).unionByName(named("near", U.best_loop(loops, (700.0, 50.0, 18.0, 6.0), 200.0)))
    return out.unionByName(named("far", U.best_loop(loops, (1e6, 50.0, 18.0, 6.0), 200.0)))


def _flags(s, d):
    o = T.read(s, d, "orders")
    pos = F.col("o_orderkey")
    return U.loop_flags(o.select(F.col("o_custkey").alias("loop_id"), pos.alias("pos"), (pos % 7).alias("vid")))


def _offset(s, d):
    li = T.read(s, d, "lineitem")
    return rounded(U.clip_offset(li.select(F.col("l_suppkey").alias("loop_id"), F.col("l_partkey").alias("vid"), (F.col("l_quantity") / 10).alias("distance")), 1.0, 10.0), "offset")


def _sobel(s, d):
    from lumenmesh.operators import raster

    return rounded(raster.sobel(T.grid(s, d)), "gradient", digits=4)


def _median(s, d):
    from lumenmesh.operators import raster

    g = T.grid(s, d)
    image = g.select("px", "py", F.col("value").alias("r"), (F.col("value") / 2).alias("g"), (F.col("value") + 1).alias("b"))
    wedges = s.range(300).select((F.col("id") * 7 % 100 / 100.0).alias("u"), (F.col("id") * 11 % 100 / 100.0).alias("v"))
    return rounded(raster.median_colour(wedges, image, 64, 64), "r", "g", "b", digits=5)


def _iso(s, d):
    from lumenmesh.functions import rules

    return T.read(s, d, "events").select("event_id", rules.utc_iso(F.col("ts")).alias("at"), rules.alias_of(F.col("event_type"), {"click": "press", "view": "look"}, "other").alias("kind"))


MORE = {"best_loop": _best, "mask_consistency": _consistency, "loop_flags": _flags, "clip_offset": _offset, "sobel_gradient": _sobel, "median_colour": _median, "utc_iso_alias": _iso}

_MISS = "abs(area-{0})/{0} AS err, sqrt((cx-50)**2+(cy-18)**2+(cz-6)**2)/200 AS far"
MORE_SQL = {
    "best_loop": "WITH l AS (SELECT o_custkey AS loop_id, round(sum(o_totalprice)/1000,3) AS area, max(o_orderkey)%100/1.0::DOUBLE AS cx, max(o_orderkey)%37/1.0::DOUBLE AS cy, count(*)/1.0::DOUBLE AS cz FROM orders GROUP BY 1), "
    + ", ".join(f"{n} AS (SELECT loop_id, err, far FROM (SELECT loop_id, {_MISS.format(t)} FROM l) ORDER BY err+0.25*far, loop_id LIMIT 1)" for n, t in (("near", "700.0::DOUBLE"), ("off_", "1e6")))
    + " SELECT 'largest' AS kind, loop_id FROM (SELECT loop_id FROM l ORDER BY area DESC, loop_id LIMIT 1) UNION ALL SELECT 'near', loop_id FROM near WHERE err <= 0.15 AND far <= 0.08 UNION ALL SELECT 'far', loop_id FROM off_ WHERE err <= 0.15 AND far <= 0.08",
    "mask_consistency": "SELECT count(*) AS n, round_even(avg(CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0 END),4) AS outside, round_even(avg(CASE WHEN l_tax > 0.06 THEN 1.0::DOUBLE ELSE 0 END),4) AS ground, round_even((avg(CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0 END)+avg(CASE WHEN l_tax > 0.06 THEN 1.0::DOUBLE ELSE 0 END))/2,4) AS score FROM lineitem",
    "loop_flags": "WITH e AS (SELECT o_custkey AS loop_id, count(*) AS k, count(DISTINCT o_orderkey%7) AS dv, arg_min(o_orderkey%7, o_orderkey) = arg_max(o_orderkey%7, o_orderkey) AS closed FROM orders GROUP BY 1) SELECT loop_id, k - CAST(closed AS INT) AS n, CASE WHEN NOT closed THEN 'open' WHEN k - CAST(closed AS INT) < 3 THEN 'small' WHEN dv < k - CAST(closed AS INT) THEN 'self_touching' ELSE 'fillable' END AS flag FROM e",
    "clip_offset": "SELECT round(greatest(0.002, coalesce(least(max(top)+0.002, 4.0), 1.002)),6)+0.0 AS \"offset\" FROM (SELECT avg(l_quantity/10) AS mean, max(l_quantity/10) AS top FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) >= 3) WHERE mean-1 <= 0.2*10",
    "sobel_gradient": f"WITH {T.GRID}, s AS (SELECT a.px, a.py, count(*) AS n, sum(b.value*(b.px-a.px)*(CASE WHEN b.py=a.py THEN 2 ELSE 1 END)) AS sx, sum(b.value*(b.py-a.py)*(CASE WHEN b.px=a.px THEN 2 ELSE 1 END)) AS sy FROM grid a JOIN grid b ON abs(a.px-b.px) <= 1 AND abs(a.py-b.py) <= 1 AND NOT (a.px=b.px AND a.py=b.py) GROUP BY 1, 2) SELECT px, py, round(sqrt(sx*sx+sy*sy),4)+0.0 AS gradient FROM s WHERE n = 8",
    "median_colour": f"WITH {T.GRID}, w AS (SELECT CAST(greatest(0, least(63, round_even(range*7%100/100.0::DOUBLE*63,0))) AS BIGINT) AS px, CAST(greatest(0, least(63, round_even((1-range*11%100/100.0::DOUBLE)*63,0))) AS BIGINT) AS py FROM range(300)) SELECT round(coalesce(median(value),176),5)+0.0 AS r, round(coalesce(median(value/2),176),5)+0.0 AS g, round(coalesce(median(value+1),176),5)+0.0 AS b FROM w JOIN grid USING (px, py)",
    "utc_iso_alias": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, CASE event_type WHEN 'click' THEN 'press' WHEN 'view' THEN 'look' ELSE 'other' END AS kind FROM events",
}
