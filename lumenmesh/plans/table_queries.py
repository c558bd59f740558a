"""Sampling, time-line, raster and rule operators bound to the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenmesh.functions import rules as K
from lumenmesh.operators import raster as P
from lumenmesh.operators import sampling as S
from lumenmesh.operators import timeline as L
from lumenmesh.plans import tables as T
from lumenmesh.plans.mesh_queries import rounded


def _events(s, d):
    return T.read(s, d, "events")


def _seconds(c="ts"):
    """Whole seconds of a zone-less timestamp."""
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def _keys(s, d):
    """One key a user and second: the mean value."""
    return _events(s, d).groupBy("user_id", _seconds().alias("t")).agg(F.avg("value").alias("value"))


def _targets(s, d):
    span = _keys(s, d).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    hours = span.select(F.explode(F.sequence(F.floor(F.col("lo") / 86400) * 86400, F.col("hi"), F.lit(86400))).alias("t"))
    return _keys(s, d).select("user_id").distinct().crossJoin(F.broadcast(hours))


def _asof(s, d):
    return rounded(L.interpolate(_keys(s, d), _targets(s, d), "user_id", "t", ["value"]), "value", digits=5)


def _mask(s, d, k, r):
    e = _events(s, d).where(f"event_id % {k} = {r}")
    return e.select((F.col("user_id") % 8).alias("frame"), (F.col("event_id") % 61).alias("px"), (F.floor(F.col("value")).cast("long") % 47).alias("py")).distinct()


def _mask_sql(k, r):
    return f"SELECT DISTINCT user_id % 8 AS frame, event_id % 61 AS px, CAST(floor(value) AS BIGINT) % 47 AS py FROM events WHERE event_id % {k} = {r}"


def _closed(s, d):
    return P.close(_mask(s, d, 3, 0), 1, "frame")


def _depth_fill(mode):
    def run(s, d):
        g = T.grid(s, d)
        depth = g.select("px", "py", F.when(F.col("px") % 3 == 0, 0.0).otherwise(F.round("value", 4)).alias("depth"))
        hull = g.where("py % 2 = 0").select("px", "py", F.round(F.col("value") / 2, 4).alias("depth"))
        return P.fill_depth(depth, g.where("px < 40").select("px", "py"), hull, mode)
    return run


def _labels(s, d):
    return T.grid(s, d).select("px", "py", F.floor(F.col("value") / 40).cast("long").alias("label"))


def _composite(s, d):
    g = T.grid(s, d)
    base = g.select("px", "py", *((F.col("value") / k).alias(c) for c, k in zip("rgb", (255, 300, 400))))
    out = P.composite(base, [(g.where("px < 30").select("px", "py"), (0.0, 1.0, 0.0), 0.45), (g.where("py < 20").select("px", "py"), (1.0, 0.5, 0.0), 0.35)])
    return rounded(out, "r", "g", "b", digits=10)


def _bilinear(s, d):
    g = T.grid(s, d)
    samples = s.range(500).select("id", (F.col("id") * 7 % 640 / 10.0).alias("u"), (F.col("id") * 13 % 640 / 10.0).alias("v"))
    return rounded(P.bilinear(samples, g, 64, 64), "value", digits=5)


def _clicks(s, d):
    e = _events(s, d)
    action = F.when(F.col("event_id") % 29 == 0, "clear").when(F.col("event_id") % 3 == 0, "undo").otherwise("add")
    return L.click_stack(e.select(F.col("user_id").alias("session"), F.when(F.col("event_id") % 2 == 0, "object").otherwise("ground").alias("mode"), F.col("event_id").alias("seq"), action.alias("action"), F.round("value", 3).alias("point")))


def _log(s, d):
    c = T.read(s, d, "conversations")
    text = F.when(F.col("turn") % 3 == 0, F.concat((F.col("turn") * 7 % 100).cast("string"), F.lit("% done"))).when(F.col("turn") % 5 == 0, F.lit("  ")).otherwise(F.col("text"))
    return L.compact_log(c.select((F.col("conv_id") % 6).alias("stage"), "role", (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), text.alias("text")).withColumnRenamed("role", "stream"))


LADDER_IN = ("p_size / 10000.0D", "p_size / 1000.0D", "p_size", "p_size % 5", "p_size * 3000")
SAYINGS = ("Waiting for Next-Stage confirmation", " ", "now Starting up", "all COMPLETE.", "completely", "waiting for input", "complete purchase", *[None] * 10)
CHECKPOINTS = [("load", "click"), ("train", "purchase|signup"), ("bake", "view$")]
FAILURES = [("ing", "gerund"), ("or", "either"), ("the", "article")]


def _raw_name():
    return F.concat(F.lit(" /"), F.col("p_name"), F.lit("/"), F.col("p_type"), F.lit("..  x#"), F.col("p_size").cast("string"), F.lit("-"))


def _path():
    five = F.lpad(F.col("page_id").cast("string"), 5, "0")
    kinds = [F.concat(F.lit("a/frame_"), five, F.lit("_"), five, F.lit(".png")), F.concat(F.lit("dir_12345/img."), five), F.concat(F.lit("x/"), five, F.lit("/none.png/")), F.concat("url", F.lit("/0"), F.col("page_id").cast("string"))]
    out = kinds[3]
    for i in range(3):
        out = F.when(F.col("page_id") % 4 == i, kinds[i]).otherwise(out)
    return out


def _names(s, d):
    name = _raw_name()
    return T.read(s, d, "part").select("p_partkey", K.sanitize_name(name).alias("name"), K.branch_slug(name).alias("slug"))


WORDS = (" Yes", "off", "TRUE ", "no", "maybe", "3.7", "1e3", " 42 ", "1_000", "y", "N", "+7", "yes ", "12345678901234567890", "-.5e1")


def _casts(s, d):
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("x"), F.col("p_size"))).otherwise(F.element_at(F.array(*map(F.lit, WORDS)), (F.col("p_size") % len(WORDS) + 1).cast("int")))
    p = T.read(s, d, "part")
    return p.select("p_partkey", K.cast_int(text, -1).alias("i"), K.cast_float(text, -1.5).alias("f"), K.cast_bool(text, False).alias("b"), K.cast_choice(text, ["yes", "no"], "none").alias("c"))


def _ladder(s, d):
    p = T.read(s, d, "part")
    steps = K.parameter_ladder(*(F.expr(e) for e in LADDER_IN))
    at = p.select("p_partkey", F.posexplode(steps).alias("pos", "s"))
    return rounded(at.select("p_partkey", "pos", "s.rung", "s.p.voxel", "s.p.trunc", "s.p.baselines", "s.p.dilate", "s.p.blocks"), "voxel", "trunc")


def _resume(s, d):
    """First stage (by part of the order) that isn't complete, else 6."""
    o = T.read(s, d, "orders").select(F.col("o_custkey").alias("object"), (F.col("o_orderkey") % 6 + 1).alias("stage"), (F.col("o_orderstatus") == "F").alias("done"))
    return o.groupBy("object").agg(F.coalesce(F.min(F.when(~F.col("done"), F.col("stage"))), F.lit(6).cast("long")).alias("resume"))


def _objects(s, d):
    """Catalogue summary: files, bytes, complete stages, first artefact by path."""
    li = T.read(s, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("object")).agg(
        F.count("*").alias("files"), F.sum(F.col("l_quantity").cast("long")).alias("bytes"), F.count_distinct(F.when(F.col("l_linestatus") == "F", F.col("l_linenumber"))).alias("complete"),
        F.min(F.concat_ws("/", F.col("l_returnflag"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"))).alias("first_path"),
    ).orderBy("object")


def _progress(s, d):
    e = _events(s, d).groupBy("user_id", (F.col("event_id") % 6).alias("stage")).agg(F.max(F.least("value", F.lit(100.0))).alias("p"))
    # least first: a user's sum is the same however rows are dealt; tenths are rounded as doubles, half to even
    p = F.aggregate(F.array_sort(F.collect_list("p")), F.lit(0.0), lambda a, x: a + x)
    return e.groupBy("user_id").agg(p.alias("p")).select("user_id", (F.rint(F.col("p") / 6 * 10) / 10).alias("progress"))


def queries() -> dict:
    frames = lambda s, d: T.read(s, d, "customer").select((F.col("c_custkey") - 1).alias("idx"))
    g = T.grid
    return {
        "frame_sample": lambda s, d: S.systematic_sample(frames(s, d), 7, 100),
        "even_sample": lambda s, d: S.even_sample(T.read(s, d, "part").select("p_size"), "p_size", 9),
        "strided_sample": lambda s, d: S.strided(frames(s, d), "idx", 20),
        "reindex_subset": lambda s, d: S.first_faces(T.faces(s, d), 100),
        "asof_interpolate": _asof,
        "missing_frames": lambda s, d: L.missing_frames(T.read(s, d, "orders").select((F.col("o_orderkey") * 3 % 50021).alias("idx")).distinct()),
        "click_stack": _clicks,
        "log_compaction": _log,
        "mask_dilate": lambda s, d: P.dilate(_mask(s, d, 5, 0), 1, "frame"),
        "mask_close": _closed,
        "mask_compose": lambda s, d: P.final_mask(_mask(s, d, 2, 0), _mask(s, d, 3, 0), "frame"),
        "mask_iou": lambda s, d: rounded(P.mask_iou(_mask(s, d, 2, 0), _mask(s, d, 3, 0), "frame"), "iou"),
        "depth_fill": _depth_fill("fill"),
        "depth_replace": _depth_fill("replace"),
        "label_boundary": lambda s, d: P.label_boundary(_labels(s, d)),
        "masked_gaussian": lambda s, d: rounded(P.gaussian(g(s, d), 1.5, 3), "value", digits=4),
        "grid_fill2": lambda s, d: rounded(P.grow(g(s, d).where("(px + py) % 5 = 0"), 64, 64, 2), "value", digits=9),
        "grid_downsample": lambda s, d: rounded(P.downsample(g(s, d), 4), "value", digits=7),
        "bilinear_sample": _bilinear,
        "alpha_composite": _composite,
        "mean_difference": lambda s, d: rounded(P.mean_difference(g(s, d), g(s, d).select((F.col("px") + 1).alias("px"), "py", "value")), "difference", digits=4),
        "luma": lambda s, d: rounded(g(s, d).select("px", "py", P.luma(F.col("value"), F.col("value") / 2, F.col("value") / 3).alias("y")), "y", digits=7),
        "name_sanitize": _names,
        "tolerant_cast": _casts,
        "tier_bucket": lambda s, d: T.read(s, d, "part").select("p_partkey", K.memory_tier(F.col("p_retailprice") * 10).alias("tier")),
        "rule_classify": lambda s, d: T.read(s, d, "conversations").select("conv_id", "turn", K.first_rule(F.col("text"), FAILURES, "other").alias("rule")),
        "checkpoint_resolve": lambda s, d: _events(s, d).select("event_id", K.resolve_checkpoint(F.coalesce(F.element_at(F.array(*map(F.lit, SAYINGS)), (F.col("event_id") % 17 + 1).cast("int")), F.col("event_type")), F.lit("current"), CHECKPOINTS).alias("checkpoint")),
        "frame_key_extract": lambda s, d: T.read(s, d, "pages").select("page_id", K.frame_number(_path()).alias("frame")),
        "progress_lines": lambda s, d: rounded(_events(s, d).select("event_id", K.progress_of(F.when(F.col("event_id") % 2 == 0, F.concat(F.when(F.col("event_id") % 4 == 0, F.lit("[iter  ")).otherwise(F.lit("[ITER  ")), F.col("event_id").cast("string"), F.lit("] loss"))).otherwise(F.concat(F.lit("Stereo "), (F.col("event_id") % 100).cast("string"), F.lit("%"))), 5000).alias("progress")), "progress", digits=4),
        "face_budget": lambda s, d: T.read(s, d, "orders").select("o_orderkey", K.face_budget(F.col("o_orderkey") * 7, F.col("o_custkey") * 100).alias("budget")),
        "param_ladder": _ladder,
        "resume_stage": _resume,
        "object_summary": _objects,
        "progress_rollup": _progress,
    }


def oracle_sql() -> dict:
    G = T.GRID
    nb = "(VALUES (1,0),(-1,0),(0,1),(0,-1)) o(dx,dy)"
    sq = "(SELECT a.range AS dx, b.range AS dy FROM range(-1,2) a, range(-1,2) b) o"
    keys = "k AS (SELECT user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t, avg(value) AS value FROM events GROUP BY 1, 2)"
    clean = "regexp_replace(regexp_replace({}, '-{{2,}}', '-', 'g'), '^[-.]+|[-.]+$', '', 'g')"
    raw = "(' /' || p_name || '/' || p_type || '..  x#' || p_size || '-')"
    slashed = f"regexp_replace({raw}, '[/\\\\]+', '-', 'g')"
    name = clean.format(f"regexp_replace(regexp_replace({slashed}, '\\s+', '-', 'g'), '[^\\w.-]+', '-', 'g')")
    slug = clean.format(f"regexp_replace({slashed}, '[^\\w.-]+', '-', 'g')")
    text = f"CASE p_partkey%3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN 'x' || p_size ELSE ([{', '.join(repr(w) for w in WORDS)}])[p_size%{len(WORDS)}+1] END"
    grow = lambda i: f"g{i + 1} AS (SELECT * FROM g{i} UNION ALL SELECT n.px, n.py, avg(n.value) FROM (SELECT px+dx AS px, py+dy AS py, value FROM g{i}, {nb}) n WHERE n.px BETWEEN 0 AND 63 AND n.py BETWEEN 0 AND 63 AND NOT EXISTS (SELECT 1 FROM g{i} h WHERE h.px=n.px AND h.py=n.py) GROUP BY 1, 2)"
    fill = lambda new: f"WITH {G}, q AS (SELECT g.px, g.py, CASE WHEN g.px%3=0 THEN 0 ELSE round(value,4) END AS depth, g.px < 40 AS m, CASE WHEN g.py%2=0 THEN round(value/2,4) END AS hull FROM grid g), r AS (SELECT px, py, depth AS old, {new} AS depth FROM q) SELECT px, py, depth, depth IS DISTINCT FROM old AS changed FROM r"
    return {
        "frame_sample": "SELECT c_custkey-1 AS idx, (c_custkey-1)//7 AS saved_index FROM customer WHERE (c_custkey-1)%7=0 AND (c_custkey-1)//7 < 100",
        "even_sample": "WITH v AS (SELECT p_size, row_number() OVER (ORDER BY p_size)-1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT p_size FROM part)) SELECT p_size FROM v WHERE n <= 9 OR pos IN (SELECT CAST(round_even(range*(SELECT max(n)-1 FROM v)/8.0,0) AS BIGINT) FROM range(9))",
        "strided_sample": "SELECT c_custkey-1 AS idx FROM customer, (SELECT greatest(1, count(*)//20) AS step FROM customer) WHERE (c_custkey-1)%step=0 AND c_custkey-1 < step*20",
        "reindex_subset": f"WITH {T.FACES}, f AS (SELECT * FROM faces ORDER BY fid LIMIT 100), ids AS (SELECT vid, row_number() OVER (ORDER BY vid) AS new FROM (SELECT v0 AS vid FROM f UNION SELECT v1 FROM f UNION SELECT v2 FROM f)) SELECT fid, a.new AS v0, b.new AS v1, c.new AS v2 FROM f JOIN ids a ON a.vid=v0 JOIN ids b ON b.vid=v1 JOIN ids c ON c.vid=v2",
        "asof_interpolate": f"""WITH {keys}, span AS (SELECT min(t)//86400*86400 AS lo, max(t) AS hi FROM k), g AS (SELECT DISTINCT user_id, unnest(range(lo, hi+1, 86400)) AS t FROM (SELECT DISTINCT user_id FROM k), span),
a AS (SELECT g.user_id, g.t, k.t AS lo, k.value AS vlo FROM g ASOF LEFT JOIN k ON g.user_id=k.user_id AND g.t >= k.t), b AS (SELECT a.*, k.t AS hi, k.value AS vhi FROM a ASOF LEFT JOIN k ON a.user_id=k.user_id AND a.t <= k.t)
SELECT user_id, t, round(CASE WHEN lo IS NULL OR hi IS NULL THEN NULL WHEN hi > lo THEN vlo+(t-lo)/(hi-lo)*(vhi-vlo) ELSE vlo END,5)+0.0 AS value FROM b""",
        "missing_frames": "WITH s AS (SELECT DISTINCT o_orderkey*3%50021 AS idx FROM orders) SELECT range AS idx FROM range((SELECT min(idx) FROM s), (SELECT max(idx)+1 FROM s)) WHERE range NOT IN (SELECT idx FROM s)",
        "click_stack": """WITH RECURSIVE c AS (SELECT user_id AS session, CASE WHEN event_id%2=0 THEN 'object' ELSE 'ground' END AS mode, event_id AS seq, CASE WHEN event_id%29=0 THEN 'clear' WHEN event_id%3=0 THEN 'undo' ELSE 'add' END AS action, round(value,3) AS point FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY session, mode ORDER BY seq) AS k FROM c),
f(session, mode, k, stack) AS (SELECT session, mode, 0::BIGINT, CAST([] AS STRUCT(seq BIGINT, point DOUBLE)[]) FROM n WHERE k=1 UNION ALL
 SELECT n.session, n.mode, n.k, CASE n.action WHEN 'clear' THEN CAST([] AS STRUCT(seq BIGINT, point DOUBLE)[]) WHEN 'undo' THEN f.stack[:-2] ELSE list_append(f.stack, {'seq': n.seq, 'point': n.point}) END FROM f JOIN n ON n.session=f.session AND n.mode=f.mode AND n.k=f.k+1),
l AS (SELECT session, mode, unnest(stack) AS e FROM f WHERE (session, mode, k) IN (SELECT session, mode, max(k) FROM n GROUP BY 1, 2)) SELECT session, mode, e.seq AS seq, e.point AS point FROM l""",
        "log_compaction": """WITH c AS (SELECT conv_id%6 AS stage, role AS stream, conv_id*1000+turn AS seq, CASE WHEN turn%3=0 THEN (turn*7%100)||'% done' WHEN turn%5=0 THEN '  ' ELSE text END AS text FROM conversations),
d AS (SELECT * FROM c WHERE trim(text, ' ') <> ''), g AS (SELECT stage, stream, min(seq) AS seq, arg_max(text, seq) AS text, count(*) AS updates FROM d GROUP BY stage, stream, CASE WHEN regexp_matches(text, '[0-9]+%') THEN -1 ELSE seq END)
SELECT stage, stream, seq, text, updates FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY seq DESC) AS age FROM g) WHERE age <= 2000""",
        "mask_dilate": f"SELECT DISTINCT frame, px+dx AS px, py+dy AS py FROM ({_mask_sql(5, 0)}), {sq}",
        "mask_close": f"WITH m AS (SELECT DISTINCT frame, px+dx AS px, py+dy AS py FROM ({_mask_sql(3, 0)}), {sq}) SELECT frame, px+dx AS px, py+dy AS py FROM m, {sq} GROUP BY 1, 2, 3 HAVING count(*) = 9",
        "mask_compose": f"{_mask_sql(2, 0)} EXCEPT {_mask_sql(3, 0)}",
        "mask_iou": f"SELECT frame, sum(a*b)::BIGINT AS both, count(*) AS either, round(sum(a*b)/count(*),6)+0.0 AS iou FROM (SELECT frame, px, py, max(a) AS a, max(b) AS b FROM (SELECT *, 1 AS a, 0 AS b FROM ({_mask_sql(2, 0)}) UNION ALL SELECT *, 0, 1 FROM ({_mask_sql(3, 0)})) GROUP BY 1, 2, 3) GROUP BY frame",
        "depth_fill": fill("CASE WHEN m AND depth <= 0 AND coalesce(hull,0) > 0 THEN hull ELSE depth END"),
        "depth_replace": fill("CASE WHEN m THEN CASE WHEN coalesce(hull,0) > 0 THEN hull ELSE 0 END ELSE depth END"),
        "label_boundary": f"WITH {G}, l AS (SELECT px, py, CAST(floor(value/40) AS BIGINT) AS label FROM grid) SELECT DISTINCT a.px, a.py FROM l a, {nb} JOIN l b ON b.px=a.px+dx AND b.py=a.py+dy WHERE a.label <> b.label",
        "masked_gaussian": f"WITH {G} SELECT a.px, a.py, round(sum(b.value*exp(-((a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py))/4.5))/sum(exp(-((a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py))/4.5)),4)+0.0 AS value FROM grid a JOIN grid b ON abs(a.px-b.px) <= 3 AND abs(a.py-b.py) <= 3 GROUP BY 1, 2",
        "grid_fill2": f"WITH {G}, g0 AS (SELECT px, py, value FROM grid WHERE (px+py)%5=0), {grow(0)}, {grow(1)} SELECT px, py, round(value,9)+0.0 AS value FROM g2",
        "grid_downsample": f"WITH {G} SELECT px//4 AS px, py//4 AS py, round(avg(value),7)+0.0 AS value FROM grid GROUP BY 1, 2",
        "bilinear_sample": f"""WITH {G}, s AS (SELECT range AS id, range*7%640/10.0::DOUBLE AS u, range*13%640/10.0::DOUBLE AS v FROM range(500)),
q AS (SELECT id, CAST(greatest(0, least(63, floor(u)+dx)) AS BIGINT) AS px, CAST(greatest(0, least(63, floor(v)+dy)) AS BIGINT) AS py, (CASE dx WHEN 1 THEN u-floor(u) ELSE 1-u+floor(u) END)*(CASE dy WHEN 1 THEN v-floor(v) ELSE 1-v+floor(v) END) AS w FROM s, (VALUES (0,0),(1,0),(0,1),(1,1)) o(dx,dy))
SELECT id, round(sum(w*value),5)+0.0 AS value FROM q JOIN grid USING (px, py) GROUP BY id""",
        "alpha_composite": f"WITH {G}, a AS (SELECT px, py, value/255 AS r, value/300 AS g, value/400 AS b FROM grid), b1 AS (SELECT px, py, CASE WHEN px<30 THEN r*0.55 ELSE r END AS r, CASE WHEN px<30 THEN g*0.55+0.45 ELSE g END AS g, CASE WHEN px<30 THEN b*0.55 ELSE b END AS b FROM a) SELECT px, py, round(CASE WHEN py<20 THEN r*0.65+0.35 ELSE r END,10)+0.0 AS r, round(CASE WHEN py<20 THEN g*0.65+0.175 ELSE g END,10)+0.0 AS g, round(CASE WHEN py<20 THEN b*0.65 ELSE b END,10)+0.0 AS b FROM b1",
        "mean_difference": f"WITH {G} SELECT round(avg(abs(a.value-b.value)),4)+0.0 AS difference, count(*) AS n FROM grid a JOIN grid b ON a.px=b.px+1 AND a.py=b.py",
        "luma": f"WITH {G} SELECT px, py, round(0.299*value+0.587*value/2+0.114*value/3,7)+0.0 AS y FROM grid",
        "name_sanitize": f"SELECT p_partkey, nullif(substr({name},1,80),'') AS name, coalesce(nullif(substr({slug},1,80),''),'main') AS slug FROM part",
        "tolerant_cast": f"SELECT p_partkey, coalesce(CASE WHEN regexp_full_match(trim(t), '[+-]?[0-9]+(_[0-9]+)*') THEN try_cast(replace(replace(trim(t),'_',''),'+','') AS BIGINT) END,-1) AS i, coalesce(try_cast(replace(trim(t),'_','') AS DOUBLE),-1.5) AS f, lower(trim(t)) IN ('1','true','yes','on','y') AS b, CASE WHEN trim(t) IN ('yes','no') THEN trim(t) ELSE 'none' END AS c FROM (SELECT p_partkey, {text} AS t FROM part)",
        "tier_bucket": "SELECT p_partkey, CASE WHEN p_retailprice*10 >= 17000 THEN 't18' WHEN p_retailprice*10 >= 14000 THEN 't16' WHEN p_retailprice*10 >= 10000 THEN 't12' WHEN p_retailprice*10 >= 7000 THEN 't8' ELSE 't_other' END AS tier FROM part",
        "rule_classify": "SELECT conv_id, turn, CASE WHEN contains(lower(text),'ing') THEN 'gerund' WHEN contains(lower(text),'or') THEN 'either' WHEN contains(lower(text),'the') THEN 'article' ELSE 'other' END AS rule FROM conversations",
        "checkpoint_resolve": "SELECT event_id, CASE event_id%17 WHEN 0 THEN 'bake' WHEN 1 THEN 'current' WHEN 2 THEN 'load' WHEN 3 THEN 'bake' WHEN 4 THEN 'current' WHEN 5 THEN 'current' WHEN 6 THEN 'train' ELSE CASE WHEN regexp_matches(event_type,'click') THEN 'load' WHEN regexp_matches(event_type,'purchase|signup') THEN 'train' WHEN regexp_matches(event_type,'view$') THEN 'bake' ELSE 'current' END END AS checkpoint FROM events",
        "frame_key_extract": """WITH f AS (SELECT page_id, url, lpad(CAST(page_id AS VARCHAR),5,'0') AS five FROM pages), p AS (SELECT page_id, CASE page_id%4 WHEN 0 THEN 'a/frame_' || five || '_' || five || '.png' WHEN 1 THEN 'dir_12345/img.' || five WHEN 2 THEN 'x/' || five || '/none.png/' ELSE url || '/0' || page_id END AS path FROM f),
n AS (SELECT *, regexp_extract(rtrim(path, '/'), '[^/]*$') AS part FROM p), r AS (SELECT page_id, list_transform([regexp_replace(part, '(.)\\.[^.]+$', '\\1'), part, path], lambda t: list_filter(regexp_extract_all(t, '[0-9]+'), lambda x: length(x)=5)) AS runs FROM n)
SELECT page_id, CAST(list_filter(runs, lambda x: len(x)=1)[1][1] AS INTEGER) AS frame FROM r""",
        "progress_lines": "SELECT event_id, round(CASE WHEN event_id%2=0 THEN 5+event_id/5000*45 ELSE 55+0.25*(event_id%100) END::DOUBLE,4)+0.0 AS progress FROM events",
        "face_budget": "SELECT o_orderkey, greatest(50000, least(o_orderkey*7, o_custkey*100, 300000)) AS budget FROM orders",
        "param_ladder": """WITH p AS (SELECT p_partkey, CAST(p_size/10000.0 AS DOUBLE) AS v, CAST(p_size/1000.0 AS DOUBLE) AS t, p_size AS b, p_size%5 AS d, p_size*3000 AS k FROM part),
r AS (SELECT p_partkey, 0 AS o, 'requested' AS rung, v AS voxel, t AS trunc, b AS baselines, d AS dilate, k AS blocks FROM p UNION ALL SELECT p_partkey, 1, 'reduced', greatest(v,0.005), greatest(t,0.04), least(b,20), greatest(d,2), least(k,100000) FROM p UNION ALL SELECT p_partkey, 2, 'safe', greatest(v,0.005), greatest(t,0.04), least(b,16), greatest(d,3), least(k,75000) FROM p),
l AS (SELECT *, lag((voxel,trunc,baselines,dilate,blocks)) OVER (PARTITION BY p_partkey ORDER BY o) AS before FROM r)
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY o)-1 AS pos, rung, round(voxel,6)+0.0 AS voxel, round(trunc,6)+0.0 AS trunc, baselines, dilate, blocks FROM l WHERE before IS NULL OR before <> (voxel,trunc,baselines,dilate,blocks)""",
        "resume_stage": "SELECT o_custkey AS object, coalesce(min(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey%6+1 END), 6) AS resume FROM orders GROUP BY 1",
        "object_summary": "SELECT l_suppkey AS object, count(*) AS files, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS bytes, count(DISTINCT CASE WHEN l_linestatus='F' THEN l_linenumber END) AS complete, min(l_returnflag || '/' || lpad(CAST(l_orderkey AS VARCHAR),9,'0')) AS first_path FROM lineitem GROUP BY 1",
        "progress_rollup": "SELECT user_id, round_even(sum(p)/6,1) AS progress FROM (SELECT user_id, event_id%6 AS stage, max(least(value,100)) AS p FROM events GROUP BY 1, 2) GROUP BY 1",
    }
