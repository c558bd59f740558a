"""Baking, holes, caps, pixel regions, listings and rules bound to the derived tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenmesh.functions import rules as K
from lumenmesh.operators import bake as B
from lumenmesh.operators import catalogue as C
from lumenmesh.operators import cleanup as U
from lumenmesh.operators import holes as H
from lumenmesh.operators import mesh as M
from lumenmesh.operators import planes as P
from lumenmesh.operators import raster as R
from lumenmesh.operators import views as V
from lumenmesh.plans import tables as T
from lumenmesh.plans.mesh_queries import _q, rounded
from lumenmesh.sources import media

# ---- a small scene: the vectors' first dimensions as surface points, four cameras with masks, depths and images


def _surface(s, d):
    return T.points(s, d).select(F.col("id").alias("texel"), "x", "y", "z", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.when(F.col("id") % 5 > 0, -1.0).otherwise(1.0).alias("nz"))


def _cameras(s):
    return s.range(4).selectExpr("id AS cam", "50.0D AS fx", "60.0D AS fy", "32.0D AS cx", "24.0D AS cy", "64 AS w", "48 AS h", "cos(id) AS r00", "0.0D AS r01", "sin(id) AS r02", "0.0D AS r10", "1.0D AS r11", "0.0D AS r12", "-sin(id) AS r20", "0.0D AS r21", "cos(id) AS r22", "0.1D * id AS tx", "0.0D AS ty", "-2.0D AS tz")


def _pixels(s):
    return s.range(4 * 64 * 48).selectExpr("id DIV 3072 AS cam", "id % 64 AS px", "(id DIV 64) % 48 AS py")


def _masks(s):
    return _pixels(s).where("(px + py + cam) % 7 <> 0")


def _depths(s):
    return _pixels(s).where("px % 2 = 0").withColumn("depth", F.expr("1.5D + (px * py % 20) / 10.0D"))


def _images(s):
    return _pixels(s).selectExpr("*", "(px + cam) / 70.0D AS r", "py / 50.0D AS g", "(px * py % 31) / 31.0D AS b")


def _seen(s, d):
    return B.looked_up(B.packet(_surface(s, d), _cameras(s)), _masks(s), _depths(s))


def _bake(locked):
    def run(s, d):
        fixed = _surface(s, d).where("texel % 3 = 0").select("texel", (F.col("texel") % 4).alias("view")) if locked else None
        return rounded(B.bake(_surface(s, d), _cameras(s), _masks(s), _depths(s), _images(s), fixed), "r", "g", "b", digits=5)
    return run


SEEN = T.POINTS + """,
k AS (SELECT range AS cam, cos(range) AS c, sin(range) AS s, 0.1*range AS tx FROM range(4)),
q AS (SELECT id AS texel, cam, c*(x-tx) - s*(z+2) AS qx, y AS qy, s*(x-tx) + c*(z+2) AS depth, sqrt((tx-x)**2+y*y+(z+2)**2) AS dist, CASE WHEN id%5>0 THEN z+2 ELSE -z-2 END AS dot FROM points, k),
p AS (SELECT *, dot/greatest(dist,1e-10) AS cosine, 50*qx/greatest(depth,1e-10)+32 AS u, 60*qy/greatest(depth,1e-10)+24 AS v FROM q),
placed AS (SELECT *, CAST(greatest(0, least(63, round_even(u,0))) AS BIGINT) AS px, CAST(greatest(0, least(47, round_even(v,0))) AS BIGINT) AS py FROM p),
ref AS (SELECT *, CASE WHEN px%2=0 THEN 1.5+(px*py%20)/10.0::DOUBLE END AS reference FROM placed),
seen AS (SELECT *, depth > 0.01 AND u >= 0 AND u < 63 AND v >= 0 AND v < 47 AND (px+py+cam)%7 <> 0 AND (reference IS NULL OR depth <= reference+greatest(1e-4, 0.003*reference/greatest(abs(cosine),0.1))) AS visible FROM ref)"""
FOUND = SEEN + """,
found AS (SELECT texel, cam, u, v, greatest(cosine,0)**2/greatest(greatest(dist,1e-6),1e-10) AS score FROM seen WHERE visible AND cosine > 0.1),
rk AS (SELECT *, row_number() OVER (PARTITION BY texel ORDER BY score DESC, cam) - 1 AS rank FROM found),
hard AS (SELECT texel FROM rk GROUP BY texel HAVING max(CASE WHEN rank=1 THEN score END) > 0 AND max(CASE WHEN rank=0 THEN score END) > 2*max(CASE WHEN rank=1 THEN score END)),
best AS (SELECT texel, cam, u, v, score AS weight FROM rk WHERE rank = 0 OR (rank < 3 AND texel NOT IN (SELECT texel FROM hard)))"""
LOCKED = ", chosen AS (SELECT * FROM best WHERE texel%3 <> 0 UNION ALL SELECT texel, cam, u, v, 1.0::DOUBLE FROM found WHERE texel%3 = 0 AND cam = texel%4)"
BLEND = """, part AS (SELECT texel, cam, weight, CAST(floor(u) AS BIGINT)+i AS px, CAST(floor(v) AS BIGINT)+j AS py, (CASE i WHEN 1 THEN u-floor(u) ELSE 1-u+floor(u) END)*(CASE j WHEN 1 THEN v-floor(v) ELSE 1-v+floor(v) END) AS part FROM chosen, (VALUES (0,0),(1,0),(0,1),(1,1)) o(i,j)),
sampled AS (SELECT texel, cam, weight, sum(part*(px+cam)/70.0::DOUBLE)/sum(part) AS r, sum(part*py/50.0::DOUBLE)/sum(part) AS g, sum(part*(px*py%31)/31.0::DOUBLE)/sum(part) AS b FROM part WHERE part > 0 AND px BETWEEN 0 AND 63 AND py BETWEEN 0 AND 47 GROUP BY 1, 2, 3)
SELECT texel, round(sum(weight*r)/sum(weight),5)+0.0 AS r, round(sum(weight*g)/sum(weight),5)+0.0 AS g, round(sum(weight*b)/sum(weight),5)+0.0 AS b, count(*) AS n FROM sampled GROUP BY texel HAVING sum(weight) <> 0"""


def _pixel_join(s, d):
    return _seen(s, d).groupBy("cam").agg(F.count_if("visible").alias("visible"), F.count("*").alias("n"), F.sum(F.col("px") * F.when(F.col("visible"), 1).otherwise(0)).alias("places"))


def _mask_pixels(s, d):
    return B.mask_pixels(T.points(s, d), _cameras(s), 0.5, 0.2, 1.6).select("id", "cam", "px", "py", "valid")


def _colour_error(s, d):
    samples = _seen(s, d).where("visible").select((F.col("texel") % 6).alias("candidate"), "cam", "px", "py", *(F.expr(f"(texel % {m}) / {m}.0D").alias(c) for c, m in zip("rgb", (7, 11, 13))))
    return rounded(B.colour_error(samples, _images(s)), "error")


def _cap_colours(s, d):
    k = F.col("vid") % 9
    return T.vertices(s, d).select("vid", F.when(k < 6, 0.99).otherwise(0.5).alias("r"), F.when(k < 6, 0.55 + k / 200).otherwise(0.1).alias("g"), F.lit(0.01).alias("b"))


def _cap_texels(s, d):
    f = T.faces(s, d)
    texels = f.select((F.col("fid") % 500).alias("px"), F.floor(F.col("fid") / 500).cast("long").alias("py"), "fid")
    return B.cap_texels(texels, texels.where("px % 3 = 0").select("px", "py"), f, _cap_colours(s, d))


def _corner_index(s, d):
    f = T.faces(s, d)
    arrays = f.select("fid", F.array("v0", "v1", "v2").alias("v"), F.array(F.col("fid") * 3, F.col("fid") * 3 + 1, F.col("fid") * 3 + 2).alias("vt"))
    return B.corner_index(arrays, f.select("v0").distinct().select(F.col("v0").alias("vid"), (F.col("v0") % 50).alias("merged")))


def _plane_loops(s, d):
    li = T.read(s, d, "lineitem").where("l_linenumber <= 2")
    return H.plane_loops(li.select(F.col("l_orderkey").alias("loop_id"), F.col("l_partkey").alias("vid"), (F.col("l_discount") - F.lit(0.05)).alias("distance")), 5.0, 0.01, 0.006, 1000)


def _best_shift(s, d):
    o = T.read(s, d, "orders")
    return rounded(H.best_shift(o.groupBy((F.col("o_custkey") % 64).alias("shift")).agg((F.max("o_totalprice") - 350000).alias("gap")).select("shift", F.greatest(F.col("gap"), F.lit(0.0)).alias("area")), 40000.0), "area", digits=3)


def _plain(values):
    return values.select("px", "py", (F.col("value") / 500).alias("value"))


def _unsharp(s, d):
    return rounded(R.unsharp(_plain(T.grid(s, d)), 0.4), "value", digits=5)


def _components(s, d):
    return R.pixel_components(T.grid(s, d).where("(px * 7 + py * 13) % 5 < 2").select("px", "py"), 64)


def _advantage(s, d):
    g = _plain(T.grid(s, d))
    return rounded(R.detail_advantage(g.where("px < 50"), g.where("py < 40").select("px", "py", (F.col("value") * (1 + F.col("px") % 3 / 4)).alias("value"))), "advantage", digits=5)


def _fill(s, d):
    g = T.grid(s, d)
    # the region is the whole rectangle, also where no event gives the grid a pixel
    region = s.range(64 * 30).select((F.col("id") % 64).alias("px"), F.floor(F.col("id") / 64).cast("long").alias("py")).where("px > 20")
    return rounded(R.fill_region(g.where("(px + py) % 9 = 0"), region, 2), "value", digits=6)


def _level(s, d):
    g = T.grid(s, d)
    return rounded(R.level_seams(g, g.select("px", "py", F.floor(F.col("px") / 16).cast("long").alias("label")), 1, 1.0, 0.6), "value", digits=5)


BLUR = "sum(b.value*exp(-((a.px-b.px)**2+(a.py-b.py)**2)/2.0))/sum(exp(-((a.px-b.px)**2+(a.py-b.py)**2)/2.0))"


def _blurred(name: str, source: str) -> str:
    return f"{name} AS (SELECT a.px, a.py, any_value(a.value) AS value, {BLUR} AS low FROM {source} a JOIN {source} b ON abs(a.px-b.px) <= 3 AND abs(a.py-b.py) <= 3 GROUP BY 1, 2)"


def _geometry(s, d):
    """Distortion, back-projection, scaled intrinsics, a clip matrix entry and clicks, by point."""
    p = T.points(s, d)
    dx, dy = V.distort(F.col("x"), F.col("y"), (0.1, -0.05, 0.01, 0.02, 0.003))
    at = p.select("id", dx.alias("dx"), dy.alias("dy"), (F.col("x") * 50 + 32).alias("u"), (F.col("y") * 60 + 24).alias("v"), (F.col("z") + 2).alias("depth"), P.sane_click(F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("x") * 3)).alias("click"), V.view_score(F.col("x"), F.col("y"), 2.0, 1.5).alias("score"))
    cam = P.scale_intrinsics(_cameras(s).where("cam = 1").select("*", *(F.array(*(F.col(f"r{i}{j}") for j in range(3))).alias(f"row{i}") for i in range(3))).drop("row0", "row1", "row2"), 128, 72)
    clip = P.clip_matrix()
    cam = cam.select("*", clip[0][0].alias("m00"), clip[0][2].alias("m02"), clip[1][2].alias("m12"), clip[2][3].alias("m23"))
    both = V.back_project(at.crossJoin(F.broadcast(cam)))
    return rounded(both.select("id", "dx", "dy", "x", "y", "z", "click", "score", "fx", "cy", "m00", "m02", "m12", "m23"), "dx", "dy", "x", "y", "z", "click", "score", "fx", "cy", "m00", "m02", "m12", "m23", digits=5)


GEOMETRY = "WITH " + T.POINTS + """, a AS (SELECT *, x*x+y*y AS r2, x*50+32 AS u, y*60+24 AS v, z+2 AS depth FROM points),
b AS (SELECT *, 1+r2*(0.1+r2*(-0.05+r2*0.003)) AS radial, (u-64)/100*depth AS qx, (v-36)/90*depth AS qy FROM a)
SELECT id, round(x*radial+0.02*x*y+0.02*(r2+2*x*x),5)+0.0 AS dx, round(y*radial+0.01*(r2+2*y*y)+0.04*x*y,5)+0.0 AS dy,
round(cos(1)*qx+sin(1)*depth+0.1,5)+0.0 AS x, round(qy,5)+0.0 AS y, round(-sin(1)*qx+cos(1)*depth-2,5)+0.0 AS z,
round(CASE WHEN id%7=0 THEN 0 ELSE greatest(0, least(1, x*3)) END,5)+0.0 AS click, round(greatest(x,0)**2/greatest(greatest(y,1e-6)**1.5,1e-10),5)+0.0 AS score,
100.0::DOUBLE AS fx, 36.0::DOUBLE AS cy, 1.5625::DOUBLE AS m00, 0.0::DOUBLE AS m02, 0.0::DOUBLE AS m12, round(-2/99.99::DOUBLE,5)+0.0 AS m23 FROM b"""


def _texel_faces(s, d):
    f = T.dense_faces(s, d).where("v0 IS NOT NULL")
    return V.texel_faces(f.select((F.col("v0") % 40).alias("px"), (F.col("v1") % 40).alias("py"), "fid"))


def _orientation(s, d):
    li = T.read(s, d, "lineitem")
    c = lambda x: F.col(x) * 10
    what = U.orientation(c("l_discount"), c("l_tax"), F.when(F.col("l_linenumber") < 6, F.col("l_quantity") / 50))
    return li.groupBy(F.coalesce(what, F.lit("unknown")).alias("decision")).agg(F.count("*").alias("n"))


def _support(s, d):
    top = V.face_view_support(V.top_views(T.scores(s, d)), T.scores(s, d).select("texel").distinct().select("texel", F.floor(F.col("texel") / 64).cast("long").alias("fid")))
    at = C.by_support(top).select("fid", F.posexplode("stats").alias("place", "s"))
    return at.select("fid", "place", "s.view")


def _listed(s, d):
    o = T.read(s, d, "orders")
    rows = o.select(F.col("o_orderkey").cast("string").alias("name"), F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderdate").cast("string")).alias("updated_at"))
    return C.listed(rows).limit(50)


def _requirements(s, d):
    p = T.read(s, d, "part")
    needed = p.select((F.col("p_size") % 6).alias("stage"), F.concat(F.when(F.col("p_partkey") % 4 == 0, F.lit("/abs")).when(F.col("p_partkey") % 4 == 1, F.lit("a/../b")).otherwise(F.lit("a")), F.lit("/"), F.col("p_partkey")).alias("path"))
    missing = C.missing_requirements(needed, needed.where(F.length("path") % 3 == 0).select("path"), 3)
    return missing.select("stage", "path", C.safe_path(F.col("path")).alias("safe"))


def _hydrated(s, d):
    li = T.read(s, d, "lineitem").select(F.col("l_suppkey").alias("object"), F.col("l_linenumber").alias("stage"), F.concat(F.lit("p"), F.col("l_partkey")).alias("path"), "l_returnflag").where("object % 5 = object % 7 OR stage < 3")
    return C.hydrated(li.select("object", "stage", "path").distinct(), li.where("l_returnflag <> 'R' OR object < 20").select("object", "path"))


SETTINGS = ("", "  ", "7", " -3 ", "2.5", "x", "1e9", "On", "no", "1_0")
SAID = ("CUDA error: an Illegal Memory Access was met", "diff_gaussian_rasterization: CUDA error", "got an unexpected keyword argument", "No module named 'diff_gaussian_rasterization'", "see camera_data.json", "CUDA out of memory", "all is well", "diff_gaussian_rasterization only", "unknown depths")


def _env(s, d):
    t = F.element_at(F.array(*map(F.lit, SETTINGS)), (F.col("p_partkey") % len(SETTINGS) + 1).cast("int"))
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("p_partkey") % len(SAID) + 1).cast("int"))
    presets = {"fast": {"a": 1, "b": 2}, "fine": {"a": 2, "b": 2}}
    preset = K.preset_of({"a": F.col("p_partkey") % 4, "b": F.col("p_partkey") % 3}, presets)
    return T.read(s, d, "part").select("p_partkey", K.env_int(t, 5, 0).alias("i"), K.env_float(t, 0.5, 0.0, 3.0).alias("f"), K.env_bool(t, True).alias("b"), K.failure_class(said).alias("failure"), K.out_of_memory(said).alias("oom"), preset.alias("preset"), K.normal_preset(F.col("p_brand"), ["brand#11", "brand#12"], "other").alias("normal"))


ENV = "WITH t AS (SELECT p_partkey, p_brand, trim(([" + ", ".join(f"'{x}'" for x in SETTINGS) + f"])[p_partkey%{len(SETTINGS)}+1]) AS t, lower(([" + ", ".join("'" + x.replace("'", "''") + "'" for x in SAID) + f"])[p_partkey%{len(SAID)}+1]) AS s FROM part)" + """
SELECT p_partkey, CASE WHEN regexp_full_match(t, '[+-]?[0-9]+(_[0-9]+)*') THEN greatest(0, CAST(replace(t,'_','') AS BIGINT)) ELSE 5 END AS i,
CASE WHEN try_cast(replace(nullif(t,''),'_','') AS DOUBLE) IS NULL THEN 0.5 ELSE least(3.0, greatest(0.0, CAST(replace(t,'_','') AS DOUBLE))) END::DOUBLE AS f, CASE WHEN lower(t) IN ('0','false','no','off') THEN false ELSE true END AS b,
CASE WHEN contains(s,'illegal memory access') THEN 'cuda_illegal_memory_access' WHEN contains(s,'diff_gaussian_rasterization') AND contains(s,'cuda error') THEN 'cuda_rasterizer_failure'
WHEN contains(s,'unexpected keyword argument') OR contains(s,'depths') THEN 'renderer_signature_mismatch' WHEN contains(s,'no module named ''diff_gaussian_rasterization''') THEN 'missing_rasterizer_extension' WHEN contains(s,'camera_data.json') THEN 'missing_output_artifacts' ELSE 'unclassified' END AS failure,
contains(s,'out of memory') AND contains(s,'cuda') AS oom, CASE WHEN p_partkey%4=1 AND p_partkey%3=2 THEN 'fast' WHEN p_partkey%4=2 AND p_partkey%3=2 THEN 'fine' ELSE 'custom' END AS preset,
CASE WHEN lower(p_brand) IN ('brand#11','brand#12') THEN lower(p_brand) ELSE 'other' END AS normal FROM t"""


def _files(s, d):
    li = T.read(s, d, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ("x_cleaned_mesh.ply", "a.ply", "sub/b.ply", "c.obj", "images.bin", "Clip One.MP4", "d.txt"))), (F.col("l_partkey") % 7 + 1).cast("int"))
    return li.where("l_linenumber <= 2").select("l_suppkey", F.concat(F.lit("o"), F.col("l_suppkey"), F.lit("/"), F.col("l_orderkey"), F.lit("/"), kind).alias("path"), F.col("l_orderkey").alias("length")).distinct()


FILES = "files AS (SELECT DISTINCT l_suppkey, 'o' || l_suppkey || '/' || l_orderkey || '/' || (['x_cleaned_mesh.ply','a.ply','sub/b.ply','c.obj','images.bin','Clip One.MP4','d.txt'])[l_partkey%7+1] AS path, l_orderkey AS length FROM lineitem WHERE l_linenumber <= 2)"


def _video_facts(s, d):
    o = T.read(s, d, "orders")
    k = F.col("o_orderkey")
    meta = o.select(k.alias("name"), (k % 4 * 14.985).alias("raw_fps"), F.when(k % 4 > 0, k % 4 * 14.985).otherwise(30.0).alias("fps"), (F.col("o_custkey") % 900).alias("frames"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), (k % 5 == 0).alias("auto_oriented"), (k % 3 * 90).alias("container_rotation"), F.when(k % 2 == 0, 270).alias("tag_rotation"))
    return rounded(media.video_facts(meta), "fps", "duration", digits=3)


def queries() -> dict:
    f, v = T.faces, T.vertices
    return {
        "pixel_join": _pixel_join,
        "bake_texels": _bake(False),
        "bake_locked": _bake(True),
        "mask_pixels": _mask_pixels,
        "colour_error": _colour_error,
        "cap_texels": _cap_texels,
        "corner_index": _corner_index,
        "plane_loops": _plane_loops,
        "best_shift": _best_shift,
        "unsharp": _unsharp,
        "pixel_components": _components,
        "detail_advantage": _advantage,
        "fill_region2": _fill,
        "level_seams": _level,
        "camera_geometry": _geometry,
        "texel_faces": _texel_faces,
        "orientation": _orientation,
        "stats_by_support": _support,
        "listed_objects": _listed,
        "missing_requirements": _requirements,
        "hydrated_stages": _hydrated,
        "env_settings": _env,
        "preferred_files": lambda s, d: media.preferred_file(_files(s, d), ["_cleaned_mesh\\.ply$", "\\.ply$", "\\.obj$"], "l_suppkey"),
        "first_folder": lambda s, d: media.first_folder(_files(s, d)),
        "videos": lambda s, d: media.videos(_files(s, d).select("path", (F.col("length") * 3000).alias("length"))),
        "video_facts": _video_facts,
        "split_loops": lambda s, d: H.split_loops(T.read(s, d, "orders").select(F.col("o_custkey").alias("loop_id"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 7).alias("vid"))),
        "cluster_faces": lambda s, d: M.cluster_to_budget(f(s, d), v(s, d), f(s, d).count() // 3)[0],
    }


def oracle_sql() -> dict:
    G = T.GRID
    plain = G + ", plain AS (SELECT px, py, value/500 AS value FROM grid)"
    nb = "(VALUES (1,0),(-1,0),(0,1),(0,-1)) o(dx,dy)"
    fill = lambda i: f"f{i + 1} AS (SELECT * FROM f{i} UNION ALL SELECT n.px, n.py, avg(n.value) FROM (SELECT px+dx AS px, py+dy AS py, value FROM f{i}, {nb}) n WHERE n.px > 20 AND n.px <= 63 AND n.py < 30 AND n.py >= 0 AND NOT EXISTS (SELECT 1 FROM f{i} h WHERE h.px=n.px AND h.py=n.py) GROUP BY 1, 2)"
    k = "vid%9"
    orange = f"sqrt(((CASE WHEN {k}<6 THEN 0.99::DOUBLE ELSE 0.5 END)-1)**2 + ((CASE WHEN {k}<6 THEN 0.55::DOUBLE+{k}/200.0::DOUBLE ELSE 0.1 END)-0.55)**2 + 0.01::DOUBLE**2) < 0.05"
    return {
        "pixel_join": f"WITH {SEEN} SELECT cam, count(*) FILTER (visible) AS visible, count(*) AS n, CAST(sum(CASE WHEN visible THEN px ELSE 0 END) AS BIGINT) AS places FROM seen GROUP BY cam",
        "bake_texels": f"WITH {FOUND}, chosen AS (SELECT * FROM best){BLEND}",
        "bake_locked": f"WITH {FOUND}{LOCKED}{BLEND}",
        "mask_pixels": f"WITH {T.POINTS}, k AS (SELECT range AS cam, cos(range) AS c, sin(range) AS s, 0.05*range AS tx FROM range(4)), q AS (SELECT id, cam, c*(x-tx) - s*(z+1) AS qx, y AS qy, s*(x-tx) + c*(z+1) AS depth FROM points, k), "
        "p AS (SELECT *, 50*qx/CASE WHEN abs(depth) > 1e-8 THEN depth ELSE 1 END+32 AS u, 60*qy/CASE WHEN abs(depth) > 1e-8 THEN depth ELSE 1 END+24 AS v FROM q) "
        "SELECT id, cam, CAST(greatest(0, least(63, round_even(u,0))) AS BIGINT) AS px, CAST(greatest(0, least(47, round_even(v,0))) AS BIGINT) AS py, depth > 0.2 AND depth < 1.6 AND u >= 0 AND u < 64 AND v >= 0 AND v < 48 AS valid FROM p",
        "colour_error": f"WITH {SEEN} SELECT texel%6 AS candidate, round(avg(((texel%7/7.0::DOUBLE-(px+cam)/70.0::DOUBLE)**2+(texel%11/11.0::DOUBLE-py/50.0::DOUBLE)**2+(texel%13/13.0::DOUBLE-(px*py%31)/31.0::DOUBLE)**2)/3),6)+0.0 AS error, count(*) AS n FROM seen WHERE visible GROUP BY 1",
        "cap_texels": _q(f"SELECT fid%500 AS px, fid//500 AS py, fid FROM faces WHERE fid%500%3 <> 0 AND v0 IN (SELECT vid FROM orange) AND v1 IN (SELECT vid FROM orange) AND v2 IN (SELECT vid FROM orange)", T.FACES, T.VERTICES, f"orange AS (SELECT vid FROM vertices WHERE {orange})"),
        "corner_index": _q("SELECT c.vid%50 AS merged, c.vid, fid, corner, fid*3+corner AS vt FROM (SELECT fid, 0 AS corner, v0 AS vid FROM faces UNION ALL SELECT fid, 1, v1 FROM faces UNION ALL SELECT fid, 2, v2 FROM faces) c WHERE c.vid IN (SELECT v0 FROM faces)", T.FACES),
        "plane_loops": "SELECT l_orderkey AS loop_id FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1 HAVING max(abs(l_discount-0.05::DOUBLE)) <= 0.01::DOUBLE*5 AND (max(l_partkey) >= 1000 OR max(abs(l_discount-0.05::DOUBLE)) <= 0.006::DOUBLE*5)",
        "best_shift": "WITH a AS (SELECT o_custkey%64 AS shift, greatest(max(o_totalprice)-350000, 0) AS area FROM orders GROUP BY 1), n AS (SELECT greatest(40000, 0.1*max(area)) AS need FROM a), g AS (SELECT shift, area FROM a, n WHERE area >= need ORDER BY shift LIMIT 1) SELECT (SELECT shift FROM g) AS shift, round(coalesce((SELECT area FROM g), 0),3)+0.0 AS area, count(*) AS probed, min(CASE WHEN area > 0 THEN shift END) AS first_valid FROM a",
        "unsharp": f"WITH {plain}, {_blurred('bl', 'plain')} SELECT px, py, round(greatest(0, least(1, value+0.4*(value-low))),5)+0.0 AS value FROM bl",
        "pixel_components": f"WITH RECURSIVE {G}, m AS (SELECT px, py, py*64+px AS n FROM grid WHERE (px*7+py*13)%5 < 2), e AS (SELECT a.n AS a, b.n AS b FROM m a JOIN m b ON abs(a.px-b.px) <= 1 AND abs(a.py-b.py) <= 1), reach(n, c) AS (SELECT n, n FROM m UNION SELECT e.b, r.c FROM reach r JOIN e ON e.a = r.n WHERE r.c < e.b) SELECT m.px, m.py, min(c) AS component FROM reach JOIN m USING (n) GROUP BY 1, 2",
        "detail_advantage": f"WITH {plain}, ra AS (SELECT * FROM plain WHERE px < 50 AND py < 40), rb AS (SELECT px, py, value*(1+px%3/4.0::DOUBLE) AS value FROM plain WHERE px < 50 AND py < 40), {_blurred('ba', 'ra')}, {_blurred('bb', 'rb')} SELECT round(coalesce(least(1.5, avg(greatest(abs(bb.value-bb.low)-abs(ba.value-ba.low),0))/greatest(avg(abs(ba.value-ba.low)),1e-4)),0),5)+0.0 AS advantage, count(*) AS n FROM ba JOIN bb USING (px, py)",
        "fill_region2": f"WITH {G}, f0 AS (SELECT px, py, value FROM grid WHERE (px+py)%9=0), {fill(0)}, {fill(1)} SELECT px, py, round(value,6)+0.0 AS value FROM f2",
        "level_seams": f"WITH {G}, {_blurred('bl', 'grid')}, bo AS (SELECT px, py FROM grid WHERE (px%16=15 AND px < 63) OR (px%16=0 AND px > 0)), near AS (SELECT px+dx AS px, py+dy AS py, min(greatest(abs(dx), abs(dy))) AS d FROM bo, (SELECT a.range AS dx, b.range AS dy FROM range(-1,2) a, range(-1,2) b) GROUP BY 1, 2) SELECT px, py, round(value+coalesce(0.6*(1-d/2.0::DOUBLE),0)*(low-value),5)+0.0 AS value FROM bl LEFT JOIN near USING (px, py)",
        "camera_geometry": GEOMETRY,
        "texel_faces": _q("SELECT v0%40 AS px, v1%40 AS py, max(fid) AS fid FROM faces GROUP BY 1, 2", T.DENSE_FACES),
        "orientation": "SELECT coalesce(CASE WHEN l_discount*10 >= 0.6 AND l_discount*10-l_tax*10 >= 0.15 THEN 'keep' WHEN l_tax*10 >= 0.6 AND l_tax*10-l_discount*10 >= 0.15 THEN 'flip' WHEN l_linenumber < 6 THEN CASE WHEN l_quantity/50 >= 0.5 THEN 'keep' ELSE 'flip' END END, 'unknown') AS decision, count(*) AS n FROM lineitem GROUP BY 1",
        "stats_by_support": f"WITH {T.SCORES}, {T.RANKED}, t AS (SELECT texel//64 AS fid, view, sum(score) AS support FROM ranked WHERE score > 0 AND rank < 3 GROUP BY 1, 2) SELECT fid, CAST(row_number() OVER (PARTITION BY fid ORDER BY support DESC, view)-1 AS INTEGER) AS place, view FROM t",
        "listed_objects": "SELECT CAST(o_orderkey AS VARCHAR) AS name, CASE WHEN o_orderkey%11 > 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS updated_at FROM orders ORDER BY coalesce(CASE WHEN o_orderkey%11 > 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END, '') DESC, CAST(o_orderkey AS VARCHAR) LIMIT 50",
        "missing_requirements": "WITH n AS (SELECT p_size%6 AS stage, (CASE p_partkey%4 WHEN 0 THEN '/abs' WHEN 1 THEN 'a/../b' ELSE 'a' END) || '/' || p_partkey AS path FROM part) SELECT stage, path, NOT starts_with(path, '/') AND NOT contains(path, '/../') AS safe FROM n WHERE stage = 3 AND length(path)%3 <> 0",
        "hydrated_stages": "WITH l AS (SELECT l_suppkey AS object, l_linenumber AS stage, 'p' || l_partkey AS path, l_returnflag FROM lineitem WHERE l_suppkey%5 = l_suppkey%7 OR l_linenumber < 3), a AS (SELECT DISTINCT object, path FROM l WHERE l_returnflag <> 'R' OR object < 20), o AS (SELECT s.object, s.stage, bool_and(a.path IS NOT NULL) AS done FROM (SELECT DISTINCT object, stage, path FROM l) s LEFT JOIN a ON a.object=s.object AND a.path=s.path GROUP BY 1, 2) SELECT object, stage, CASE WHEN done THEN 'complete' ELSE 'pending' END AS state, min(CASE WHEN NOT done THEN stage END) OVER (PARTITION BY object) AS current FROM o",
        "env_settings": ENV,
        "preferred_files": f"WITH {FILES}, o AS (SELECT *, CASE WHEN path LIKE '%\\_cleaned\\_mesh.ply' ESCAPE '\\' THEN 0 WHEN path LIKE '%.ply' THEN 1 WHEN path LIKE '%.obj' THEN 2 END AS k FROM files) SELECT l_suppkey, path, length FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY k, length DESC, path) AS n FROM o WHERE k IS NOT NULL) WHERE n = 1",
        "first_folder": f"WITH {FILES} SELECT min(regexp_extract(path, '^(.*)/[^/]*$', 1)) AS folder FROM files WHERE path LIKE '%/images.bin'",
        "videos": f"WITH {FILES} SELECT 'Clip One.MP4' AS name, path, round_even(length*3000/1048576.0::DOUBLE,1) AS megabytes, 'Clip-One' AS suggested FROM files WHERE path LIKE '%.MP4'",
        "video_facts": """WITH m AS (SELECT o_orderkey AS name, o_orderkey%4*14.985::DOUBLE AS raw, CASE WHEN o_orderkey%4 > 0 THEN o_orderkey%4*14.985::DOUBLE ELSE 30 END AS fps, o_custkey%900 AS frames, CASE WHEN o_orderkey%5=0 THEN 0 WHEN o_orderkey%3 > 0 THEN o_orderkey%3*90 WHEN o_orderkey%2=0 THEN 270 ELSE 0 END AS rotation FROM orders),
i AS (SELECT *, greatest(1, CAST(round_even(fps/2,0) AS BIGINT)) AS interval_ FROM m) SELECT name, round(fps,3)+0.0 AS fps, frames, CASE WHEN rotation IN (90,270) THEN 1080 ELSE 1920 END AS width, CASE WHEN rotation IN (90,270) THEN 1920 ELSE 1080 END AS height,
CASE WHEN raw > 0 THEN round_even(frames/raw,2) ELSE 0 END AS duration, rotation, interval_ AS interval, CASE WHEN frames > 0 THEN CAST(ceil(frames/interval_) AS BIGINT) ELSE 0 END AS most FROM i""",
    }
