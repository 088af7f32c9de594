"""Queries over masks, boxes, schedules, policies and planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import schedules as H
from ..operators import boxes as B
from ..operators import masks as K
from ..operators import planner as C
from ..operators import policy as R
from .registry import query, table

U = lambda key: f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
E = "(SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
CFG = K.MaskConfig(spatial=(0.15, 0.3), temporal=(0.4, 0.9), blocks=3)

#: Blocks of three per vector on a 4 x 8 x 8 grid, sizes by batch of 24 vectors, then hidden cells.
_MASKS = f"""
WITH b AS (SELECT vec_id, vec_id // 24 AS batch FROM embeddings),
size AS (SELECT batch, greatest(1, trunc(4 * (0.4 + (0.9 - 0.4) * {U("'1:' || batch || ':t'")}))::INT) AS t, trunc(64 * (0.15 + (0.3 - 0.15) * {U("'1:' || batch || ':s'")}))::INT AS n, 0.75 + 0.75 * {U("'1:' || batch || ':a'")} AS r FROM (SELECT DISTINCT batch FROM b)),
dims AS (SELECT batch, t, greatest(least(round_even(sqrt(n * r), 0)::INT, 8), 1) AS h, greatest(least(round_even(sqrt(n / r), 0)::INT, 8), 1) AS w FROM size),
blocks AS (SELECT vec_id, batch, t, h, w, floor({U("'1:' || batch || ':' || vec_id || ':' || i || ':d'")} * (4 - t + 1))::INT AS t0, floor({U("'1:' || batch || ':' || vec_id || ':' || i || ':y'")} * (8 - h + 1))::INT AS y0,
  floor({U("'1:' || batch || ':' || vec_id || ':' || i || ':x'")} * (8 - w + 1))::INT AS x0 FROM b JOIN dims USING (batch), range(3) k(i)),
cells AS (SELECT DISTINCT vec_id, batch, c FROM blocks, range(256) g(c) WHERE c // 64 BETWEEN t0 AND t0 + t - 1 AND (c % 64) // 8 BETWEEN y0 AND y0 + h - 1 AND c % 8 BETWEEN x0 AND x0 + w - 1),
hidden AS (SELECT vec_id, batch, list(c ORDER BY c) AS target, [x for x in range(256) if NOT list_contains(list(c), x)] AS context FROM cells GROUP BY 1, 2),
least_ AS (SELECT batch, min(len(context)) AS kc, min(len(target)) AS kt FROM hidden GROUP BY 1),
cut AS (SELECT vec_id, batch, context[1:kc] AS context, target[1:kt] AS target FROM hidden JOIN least_ USING (batch))
"""


def _samples(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 24).alias("batch"))


def _masks(spark, d, cfg=CFG):
    return K.make_masks(_samples(spark, d), "vec_id", "batch", 4, 8, 8, cfg, seed=1)


@query(_MASKS + "SELECT vec_id, len(target)::BIGINT AS n_target, list_sum(target)::BIGINT AS target_sum FROM hidden")
def block_mask(spark, d):
    made = K.blocks(_samples(spark, d), "vec_id", 4, 8, 8, CFG, 1, F.col("batch")).select("vec_id", K.hidden_cells(F.col("blocks"), 4, 8, 8).alias("t"))
    return made.select("vec_id", F.size("t").cast("long").alias("n_target"), F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x).alias("target_sum"))


@query(_MASKS + "SELECT vec_id, len(context)::BIGINT AS n_context, len(target)::BIGINT AS n_target, array_to_string(context[1:8], ',') AS first_context, list_sum(target)::BIGINT AS target_sum FROM cut")
def mask_truncate(spark, d):
    m = _masks(spark, d)
    return m.select("vec_id", F.size("context").cast("long").alias("n_context"), F.size("target").cast("long").alias("n_target"), F.array_join(F.slice("context", 1, 8), ",").alias("first_context"), F.aggregate("target", F.lit(0).cast("long"), lambda s, x: s + x).alias("target_sum"))


@query(_MASKS + "SELECT vec_id, len(context)::BIGINT AS n_context, (256 - len(context))::BIGINT AS n_target, (32640 - list_sum(context))::BIGINT AS target_sum FROM cut")
def mask_complement(spark, d):
    """The target is everything outside the context, taken after truncation."""
    m = _masks(spark, d, K.MaskConfig(spatial=(0.15, 0.3), temporal=(0.4, 0.9), blocks=3, full_complement=True))
    return m.select("vec_id", F.size("context").cast("long").alias("n_context"), F.size("target").cast("long").alias("n_target"), F.aggregate("target", F.lit(0).cast("long"), lambda s, x: s + x).alias("target_sum"))


@query(_MASKS + f"SELECT vec_id, round(list_sum([e[i + 1] for i in context if i < 64]), 6) AS total, len([i for i in context if i < 64])::BIGINT AS n FROM cut JOIN {E} USING (vec_id)")
def mask_gather(spark, d):
    tokens = table(spark, d, "embeddings").select("vec_id", A.dbl(F.col("embedding")).alias("e"))
    g = A.gather(F.col("e"), F.filter("context", lambda i: i < 64))
    return _masks(spark, d).join(tokens, "vec_id").select("vec_id", F.round(A.fold(g), 6).alias("total"), F.size(g).cast("long").alias("n"))


@query("SELECT 16 * (1 + l % 2) AS fpc, c AS cfg_id, count(*)::BIGINT AS n FROM (SELECT label AS l FROM embeddings WHERE label % 3 < 2), range(2) r(c) GROUP BY 1, 2")
def group_by_length_collate(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 24).alias("batch"), F.when(F.col("label") % 3 < 2, 16 * (1 + F.col("label") % 2)).otherwise(99).alias("length"))
    made = K.collate(rows, "length", [16, 32], [CFG, K.MaskConfig(blocks=1)], "vec_id", "batch", (4, 4, 4))
    return made.groupBy("fpc", "cfg_id").agg(F.count("*").alias("n"))


@query("SELECT a.i AS i, b.j AS j FROM range(48) a(i), range(48) b(j) WHERE b.j // 12 <= a.i // 12")
def causal_mask(spark, d):
    return K.causal_pairs(spark.range(48), 10, extra=2)


@query(f"""WITH s AS (SELECT k AS step, greatest(1, trunc(8 * (0.4 + (0.9 - 0.4) * {U("'1:' || k || ':t'")}))::INT) AS t, trunc(256 * (0.15 + (0.3 - 0.15) * {U("'1:' || k || ':s'")}))::INT AS n, 0.75 + 0.75 * {U("'1:' || k || ':a'")} AS r FROM range(200) q(k))
SELECT step, t, least(round_even(sqrt(n * r), 0)::INT, 16) AS h, least(round_even(sqrt(n / r), 0)::INT, 16) AS w FROM s""")
def block_size_draw(spark, d):
    t, h, w = K.block_size(8, 16, 16, CFG, 1, F.col("id"))
    return spark.range(200).select(F.col("id").alias("step"), t.alias("t"), h.alias("h"), w.alias("w"))


_BOX = "(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x1, l_discount * 500 AS y1, l_quantity * 3 AS x2, l_discount * 500 + l_tax * 1000 AS y2 FROM lineitem)"


def _boxes(spark, d):
    q, y = F.col("l_quantity"), F.col("l_discount") * 500
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", q.alias("x1"), y.alias("y1"), (q * 3).alias("x2"), (y + F.col("l_tax") * 1000).alias("y2"))


def _out(df, b):
    return df.select("l_orderkey", "l_linenumber", *((F.round(c, 4) + 0.0).alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)))


BOX = ("x1", "y1", "x2", "y2")


def _cols():
    return tuple(F.col(c) for c in BOX)


@query(f"SELECT l_orderkey, l_linenumber, round(x1 - 12, 4) + 0.0 AS x1, round(y1 - 7, 4) + 0.0 AS y1, round(x2 - 12, 4) + 0.0 AS x2, round(y2 - 7, 4) + 0.0 AS y2 FROM {_BOX}")
def box_crop(spark, d):
    return _out(_boxes(spark, d), B.crop_box(_cols(), 12, 7))


@query(f"SELECT l_orderkey, l_linenumber, round(greatest(0, least(111, x1)), 4) + 0.0 AS x1, round(greatest(0, least(63, y1)), 4) + 0.0 AS y1, round(greatest(0, least(111, x2)), 4) + 0.0 AS x2, round(greatest(0, least(63, y2)), 4) + 0.0 AS y2 FROM {_BOX}")
def box_clip(spark, d):
    return _out(_boxes(spark, d), B.clip_box(_cols(), 64, 112))


@query(f"SELECT l_orderkey, l_linenumber, round(224 - x2 - 1, 4) + 0.0 AS x1, round(y1, 4) + 0.0 AS y1, round(224 - x1 - 1, 4) + 0.0 AS x2, round(y2, 4) + 0.0 AS y2 FROM {_BOX}")
def box_flip(spark, d):
    return _out(_boxes(spark, d), B.flip_box(_cols(), 224))


@query("""SELECT p_partkey, CASE WHEN h >= w THEN trunc(256 * h / w)::INT ELSE 256 END AS new_h, CASE WHEN h >= w THEN 256 ELSE trunc(256 * w / h)::INT END AS new_w FROM (SELECT p_partkey, (p_size + 10)::DOUBLE AS h, p_retailprice AS w FROM part)""")
def short_side_resize(spark, d):
    h, w = B.short_side(F.col("p_size") + F.lit(10.0), F.col("p_retailprice"), 256)
    return table(spark, d, "part").select("p_partkey", h.alias("new_h"), w.alias("new_w"))


def _jitter_sql(size: str) -> str:
    u = U("'5:' || p_partkey || ':short'")
    return f"""SELECT p_partkey, CASE WHEN h >= w THEN trunc(s * h / w)::INT ELSE s::INT END AS new_h, CASE WHEN h >= w THEN s::INT ELSE trunc(s * w / h)::INT END AS new_w
    FROM (SELECT p_partkey, (p_size + 10)::DOUBLE AS h, p_retailprice::DOUBLE AS w, round_even({size.format(u=u)}, 0) AS s FROM part)"""


def _jitter(spark, d, inverse: bool):
    h, w = B.short_side_jitter(F.col("p_size") + F.lit(10.0), F.col("p_retailprice").cast("double"), 256, 320, 5, F.col("p_partkey"), inverse=inverse)
    return table(spark, d, "part").select("p_partkey", h.cast("int").alias("new_h"), w.cast("int").alias("new_w"))


@query(_jitter_sql("256 + 64 * {u}"))
def short_side_jitter(spark, d):
    return _jitter(spark, d, inverse=False)


@query(_jitter_sql("1.0::DOUBLE / (1.0::DOUBLE / 320 + (1.0::DOUBLE / 256 - 1.0::DOUBLE / 320) * {u})"))
def short_side_jitter_inverse(spark, d):
    return _jitter(spark, d, inverse=True)


@query("""SELECT p_partkey, CASE WHEN h > w THEN h - 20 ELSE ceil((h - 20) / 2.0)::INT END AS y, CASE WHEN h > w THEN ceil((w - 20) / 2.0)::INT ELSE w - 20 END AS x, round_even((h - 16) / 2.0, 0)::INT AS cy FROM (SELECT p_partkey, p_size + 20 AS h, (p_partkey % 70 + 20)::INT AS w FROM part)""")
def crop_offsets(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") + 20).alias("h"), (F.col("p_partkey") % 70 + 20).cast("int").alias("w"))
    (y, x), (cy, _) = B.uniform_crop(F.col("h"), F.col("w"), 20, 2), B.center_crop(F.col("h"), F.col("w"), 16, 16)
    return p.select("p_partkey", y.alias("y"), x.alias("x"), cy.alias("cy"))


def _rrc_sql(linear: bool = False) -> str:
    """With linear the aspect is drawn as it is, and every second draw swaps height and width."""
    tries = []
    size = "CASE WHEN turned THEN {1} ELSE {0} END"
    w, h = "round_even(sqrt(area * aspect), 0)::INT", "round_even(sqrt(area / aspect), 0)::INT"
    w, h = (size.format(w, h), size.format(h, w)) if linear else (w, h)
    for k in range(3):
        u = lambda n, k=k: U(f"'2:' || p_partkey || ':{k}:{n}'")
        tries.append(f"SELECT p_partkey, height, width, {k} AS k, height * width * (0.3 + (1.0 - 0.3) * {u('area')}) AS area, {f"0.75::DOUBLE + (1.35::DOUBLE - 0.75::DOUBLE) * {u('ratio')}" if linear else f"exp(ln(0.75::DOUBLE) + (ln(1.35::DOUBLE) - ln(0.75::DOUBLE)) * {u('ratio')})"} AS aspect, {u('switch')} < 0.5 AS turned, {u('i')} AS ui, {u('j')} AS uj FROM s")
    return f"""WITH s AS (SELECT p_partkey, (p_size + 30)::INT AS height, (p_partkey % 90 + 30)::INT AS width FROM part), t AS ({" UNION ALL ".join(tries)}),
d AS (SELECT *, {w} AS w, {h} AS h FROM t),
f AS (SELECT p_partkey, floor(ui * (height - h + 1))::INT AS i, floor(uj * (width - w + 1))::INT AS j, h, w FROM d WHERE w <= width AND h <= height AND w > 0 AND h > 0 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY k) = 1),
c AS (SELECT p_partkey, height, width, least(CASE WHEN width / height::DOUBLE < 0.75 THEN round_even(width / 0.75::DOUBLE, 0)::INT ELSE height END, height) AS h, least(CASE WHEN width / height::DOUBLE > 1.35 THEN round_even(height * 1.35::DOUBLE, 0)::INT ELSE width END, width) AS w FROM s)
SELECT c.p_partkey, coalesce(f.i, (c.height - c.h) // 2)::INT AS i, coalesce(f.j, (c.width - c.w) // 2)::INT AS j, coalesce(f.h, c.h) AS h, coalesce(f.w, c.w) AS w FROM c LEFT JOIN f USING (p_partkey)"""


def _rrc(spark, d, **options):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") + 30).cast("int").alias("height"), (F.col("p_partkey") % 90 + 30).cast("int").alias("width"))
    return p.select("p_partkey", B.resized_crop(F.col("height"), F.col("width"), (0.3, 1.0), (0.75, 1.35), 3, 2, F.col("p_partkey"), **options).alias("b")).select("p_partkey", "b.i", "b.j", "b.h", "b.w")


@query(_rrc_sql())
def rrc_params(spark, d):
    return _rrc(spark, d)


@query(_rrc_sql(linear=True))
def rrc_params_switched(spark, d):
    return _rrc(spark, d, log_scale=False, switch=True)


@query("""WITH c AS (SELECT doc_id, 'rand-m' || doc_id % 11 || '-n' || doc_id % 4 + 1 || '-mstd0.' || doc_id % 10 || '-inc' || doc_id % 2 AS s FROM documents)
SELECT doc_id, split_part(substr(s, 7), '-', 1)::DOUBLE AS m, split_part(split_part(s, '-n', 2), '-', 1)::DOUBLE AS n, round(split_part(split_part(s, '-mstd', 2), '-', 1)::DOUBLE, 6) AS mstd FROM c""")
def policy_parse(spark, d):
    i = F.col("doc_id")
    s = F.concat(F.lit("rand-m"), i % 11, F.lit("-n"), i % 4 + 1, F.lit("-mstd0."), i % 10, F.lit("-inc"), i % 2)
    o = R.parse_column(s)
    return table(spark, d, "documents").select("doc_id", o["m"].alias("m"), o["n"].alias("n"), F.round(o["mstd"], 6).alias("mstd"))


_OPS = ", ".join(f"({i}, '{n}', {f}::DOUBLE, {o}::DOUBLE, {s}, {w})" for i, (n, f, o, s, w) in enumerate(R.OPERATIONS))


@query(f"""SELECT doc_id, k::INT AS pick, op, round(CASE WHEN whole THEN trunc(0.7::DOUBLE * factor) ELSE 0.7::DOUBLE * factor * CASE WHEN is_signed AND {U("'4:' || doc_id || ':' || k || ':sign'")} > 0.5 THEN -1 ELSE 1 END END + off, 6) AS argument, {U("'4:' || doc_id || ':' || k || ':p'")} < 0.5 AS applied
FROM documents, range(2) r(k) JOIN (VALUES {_OPS}) o(op_id, op, factor, off, is_signed, whole) ON op_id = ('0x' || substr(md5('4:' || doc_id || ':' || k || ':op'), 1, 8))::BIGINT % 15""")
def policy_draw(spark, d):
    drawn = R.draw(table(spark, d, "documents").select("doc_id"), "doc_id", "rand-m7-n2", 4)
    return drawn.select("doc_id", "pick", "op", F.round("argument", 6).alias("argument"), "applied")


_WEIGHTS = ", ".join(f"({i}, '{n}', {R.CHOICE_WEIGHTS[0][n]}::DOUBLE)" for i, (n, *_) in enumerate(R.OPERATIONS) if n in R.CHOICE_WEIGHTS[0])


@query(f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY -ln({U("'6:' || doc_id || ':' || op_id || ':race'")}) / weight, op_id) - 1)::INT AS pick, op
FROM documents, (VALUES {_WEIGHTS}) o(op_id, op, weight) QUALIFY pick < 3""")
def policy_choice(spark, d):
    """Operations by weight, no operation twice."""
    return R.draw(table(spark, d, "documents").select("doc_id"), "doc_id", "rand-m7-n3-w0", 6).select("doc_id", "pick", "op")


@query("""WITH g AS (SELECT id, -0.05 + 0.1 * (id // 25) / 4 AS dx, -0.05 + 0.1 * ((id // 5) % 5) / 4 AS dy, -0.05 + 0.1 * (id % 5) / 4 AS dz FROM range(125) r(id)),
f AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 2), c AS (SELECT a.e AS a, b.e AS b FROM f a, f b WHERE a.vec_id = 0 AND b.vec_id = 1)
SELECT id, round(dx, 6) + 0.0 AS dx, round(dz, 6) + 0.0 AS dz, round(list_avg([abs(a[i] + dx * 3 + dy * 2 + dz - b[i]) for i in range(1, 65)]), 6) AS energy FROM g, c""")
def energy_grid(spark, d):
    """The energy of each action of a grid: the context, one row, goes to every candidate."""
    e = table(spark, d, "embeddings").where("vec_id < 2").select("vec_id", A.dbl(F.col("embedding")).alias("e"))
    two = F.broadcast(e.agg(F.max(F.when(F.col("vec_id") == 0, F.col("e"))).alias("a"), F.max(F.when(F.col("vec_id") == 1, F.col("e"))).alias("b")))  # one row
    g = C.action_grid(spark, 5, 0.05).crossJoin(two)
    moved = F.transform("a", lambda x: x + F.col("dx") * 3 + F.col("dy") * 2 + F.col("dz"))
    return g.select("id", (F.round("dx", 6) + 0.0).alias("dx"), (F.round("dz", 6) + 0.0).alias("dz"), F.round(A.l1_distance(moved, F.col("b")), 6).alias("energy"))


def _goal_cost(c, step=0):
    a = [F.get("a_0", i) for i in range(3)]
    return C.euclid(a, [F.lit(0.03), F.lit(-0.02), F.lit(0.01)])


_N = lambda axis: f"sqrt(-2 * ln((('0x' || substr(md5('0:0:' || id || ':0:{axis}:u'), 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE)) * cos(2 * pi() * {U(f"'0:0:' || id || ':0:{axis}:v'")})"


@query(f"""WITH c AS (SELECT id, {", ".join(f"greatest(-0.05, least(0.05, 0.05 * {_N(i)}))::DOUBLE AS a{i}" for i in range(3))} FROM range(400) r(id)),
b AS (SELECT *, sqrt((a0 - 0.03) * (a0 - 0.03) + (a1 + 0.02) * (a1 + 0.02) + (a2 - 0.01) * (a2 - 0.01)) AS score FROM c ORDER BY score, id LIMIT 10)
SELECT axis, round(CASE axis WHEN 0 THEN avg(a0) WHEN 1 THEN avg(a1) ELSE avg(a2) END, 6) AS mean, round(CASE axis WHEN 0 THEN stddev_samp(a0) WHEN 1 THEN stddev_samp(a1) ELSE stddev_samp(a2) END, 6) AS std FROM b, range(3) x(axis) GROUP BY axis""")
def cem_step(spark, d):
    c = C.candidates(spark, 400, [[0.0] * 4], [[0.05, 0.05, 0.05, 0.75]], 0, 0)
    best = c.withColumn("score", _goal_cost(c)).orderBy("score", "id").limit(10)
    per = best.select(F.posexplode(F.slice("a_0", 1, 3)).alias("axis", "v"))
    return per.groupBy(F.col("axis").cast("long").alias("axis")).agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"))


@query()
def cem_plan(spark, d):
    found = C.plan(spark, _goal_cost, steps=4)
    return spark.range(1).select(F.posexplode(F.array(*(F.lit(float(v)) for v in found[0]))).alias("axis", "value"))


@query("SELECT s AS step, round(CASE WHEN s < 20 THEN 0.0002::DOUBLE + s / 20.0 * (0.0006 - 0.0002) WHEN s < 80 THEN 0.0006 ELSE 0.0006 + (s - 80) / 20.0 * (0.000001 - 0.0006) END::DOUBLE, 9) AS lr FROM range(100) r(s)")
def schedule_wsd(spark, d):
    return spark.range(100).select(F.col("id").alias("step"), F.round(H.warmup_stable_decay(F.col("id"), 20, 20, 100, 2e-4, 6e-4, 1e-6), 9).alias("lr"))


@query("SELECT s AS step, round(CASE WHEN s < 10 THEN 0.0001::DOUBLE + s / 10.0 * (0.001 - 0.0001) ELSE greatest(0.00001, 0.00001 + (0.001 - 0.00001) * 0.5 * (1 + cos(pi() * (s - 10) / 90.0))) END::DOUBLE, 9) AS lr FROM range(100) r(s)")
def schedule_cosine(spark, d):
    return spark.range(100).select(F.col("id").alias("step"), F.round(H.warmup_cosine(F.col("id"), 10, 100, 1e-4, 1e-3, 1e-5), 9).alias("lr"))


@query("SELECT s AS step, round(least(0.4, 0.4 + (0.04 - 0.4) * 0.5 * (1 + cos(pi() * s / 100.0)))::DOUBLE, 9) AS wd FROM range(110) r(s)")
def schedule_wd(spark, d):
    return spark.range(110).select(F.col("id").alias("step"), F.round(H.cosine_decay(F.col("id"), 100, 0.04, 0.4), 9).alias("wd"))


@query("SELECT s AS step, round((0.5 + (0.1 - 0.5) * s / 50.0)::DOUBLE, 9) AS value, round(least(1.0, 0.996 + s * 0.004 / 50)::DOUBLE, 9) AS ema, round(CASE WHEN s < 10 THEN 0 WHEN s < 30 THEN 2.0 * (s - 10) / 20 ELSE 2.0 END::DOUBLE, 9) AS ramp FROM range(60) r(s)")
def schedule_linear(spark, d):
    s = F.col("id")
    return spark.range(60).select(s.alias("step"), F.round(H.linear_decay(s, 50, 0.5, 0.1), 9).alias("value"), F.round(H.momentum_ramp(s, 50, 0.996, 1.0), 9).alias("ema"), F.round(H.delayed_ramp(s, 10, 30, 2.0), 9).alias("ramp"))


@query("WITH RECURSIVE r(n, x) AS (SELECT 0, 1.0::DOUBLE UNION ALL SELECT n + 1, x * 0.9 + sin(n + 1) FROM r WHERE n < 30) SELECT n::BIGINT AS step, round(x, 6) AS state FROM r")
def rollout_recursive(spark, d):
    """An autoregressive roll-out: each step's state from the one before, as a fold over the steps."""
    states = F.aggregate(F.sequence(F.lit(1), F.lit(30)), F.array(F.lit(1.0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) * 0.9 + F.sin(n.cast("double")))))
    return spark.range(1).select(F.posexplode(states).alias("step", "state")).select(F.col("step").cast("long").alias("step"), F.round("state", 6).alias("state"))
