"""Queries over metrics, ordered computations and poses: events stand for logs and trajectories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import poses as P
from ..operators import metrics as M
from .registry import query, table

E = "(SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
#: Each vector as five views of twelve class scores.
VIEWS = f"(SELECT vec_id, label, v, generate_subscripts(e, 1) - 1 AS c, unnest(e) AS x FROM (SELECT vec_id, label, v, e[v * 12 + 1 : v * 12 + 12] AS e FROM {E}, range(5) r(v)))"


def _e(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", A.dbl(F.col("embedding")).alias("e"))


def _views(spark, d):
    views = A.split_clips(F.col("e"), 5, 12)
    return _e(spark, d).select("vec_id", "label", F.posexplode(views).alias("v", "s"))


_ENSEMBLE = f"""
WITH p AS (SELECT vec_id, label, v, c, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id, v) AS p FROM {VIEWS}),
m AS (SELECT vec_id, label, c, avg(p) AS p FROM p GROUP BY 1, 2, 3),
best AS (SELECT vec_id, label, c AS pred FROM m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, c) = 1)
"""


def _ensemble(spark, d):
    p = _views(spark, d).select("vec_id", "label", F.posexplode(A.softmax(F.col("s"))).alias("c", "p"))
    m = p.groupBy("vec_id", "label", "c").agg(F.avg("p").alias("p"))
    return m.groupBy("vec_id", "label").agg(F.max(F.struct("p", (-F.col("c")).alias("i"))).alias("b")).select("vec_id", "label", (-F.col("b.i")).cast("long").alias("pred"))


@query(_ENSEMBLE + "SELECT vec_id, pred, pred = label AS hit FROM best")
def ensemble_top1(spark, d):
    return _ensemble(spark, d).select("vec_id", "pred", (F.col("pred") == F.col("label")).alias("hit"))


@query(_ENSEMBLE + ", b AS (SELECT vec_id // 48 AS b, avg((pred = label)::INT) AS m, sum((pred = label)::INT) AS s, count(*) AS n FROM best GROUP BY 1) SELECT round(100 * avg(m), 6) AS mean_of_means, round(100 * sum(s) / sum(n), 6) AS micro, count(*)::BIGINT AS batches FROM b")
def mean_of_means_acc(spark, d):
    m = M.mean_of_means(_ensemble(spark, d), F.floor(F.col("vec_id") / 48), (F.col("pred") == F.col("label")).cast("int"))
    return m.select(F.round(100 * F.col("mean_of_means"), 6).alias("mean_of_means"), F.round(100 * F.col("micro"), 6).alias("micro"), "batches")


@query(f"""WITH b AS (SELECT vec_id, label, v, c AS pred FROM {VIEWS} QUALIFY row_number() OVER (PARTITION BY vec_id, v ORDER BY x DESC, c) = 1), h AS (SELECT v, 100.0 * avg((pred = label)::INT) AS acc FROM b GROUP BY 1)
SELECT round(max(acc), 6) AS best, round(avg(acc), 6) AS mean, round(min(acc), 6) AS worst, arg_max(v, acc * 1000 - v) AS head FROM h""")
def best_head(spark, d):
    h = _views(spark, d).groupBy("v").agg((100.0 * F.avg((M.best(F.col("s")) == F.col("label")).cast("int"))).alias("acc"))
    return h.agg(F.round(F.max("acc"), 6).alias("best"), F.round(F.avg("acc"), 6).alias("mean"), F.round(F.min("acc"), 6).alias("worst"), F.max_by(F.col("v").cast("long"), F.col("acc") * 1000 - F.col("v")).alias("head"))


_RECALL = """, t AS (SELECT vec_id, label, max((c = label)::INT) AS hit FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, c) <= 5) GROUP BY 1, 2),
k AS (SELECT label, sum(hit) AS tp, count(*) AS n FROM t GROUP BY 1) SELECT round(100 * sum(tp / (n + 1e-8)) / count(*), 6) AS recall, round(100.0 * sum(tp) / sum(n), 6) AS accuracy, count(*)::BIGINT AS classes FROM k"""


@query(f"WITH s AS (SELECT vec_id, label, generate_subscripts(e, 1) - 1 AS c, unnest(e) AS x FROM (SELECT vec_id, label, e[1:12] AS e FROM {E}))" + _RECALL)
def class_mean_recall(spark, d):
    r = M.class_mean_recall(_e(spark, d), F.slice("e", 1, 12), F.col("label"))
    return r.select(F.round("recall", 6).alias("recall"), F.round("accuracy", 6).alias("accuracy"), "classes")


@query(f"WITH s AS (SELECT vec_id, label, c, CASE WHEN c % 3 <> 1 THEN 1 / (1 + exp(-x)) ELSE 0 END AS x FROM (SELECT vec_id, label, generate_subscripts(e, 1) - 1 AS c, unnest(e) AS x FROM (SELECT vec_id, label, e[1:12] AS e FROM {E})))" + _RECALL)
def valid_class_recall(spark, d):
    valid = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda c: c % 3 != 1)
    r = M.class_mean_recall(_e(spark, d), F.transform(F.slice("e", 1, 12), A.sigmoid), F.col("label"), valid=valid)
    return r.select(F.round("recall", 6).alias("recall"), F.round("accuracy", 6).alias("accuracy"), "classes")


@query(f"""WITH n AS (SELECT c, 'class ' || c AS name FROM range(12) r(c)) SELECT vec_id, string_agg(name, ',' ORDER BY place) AS names FROM (
SELECT vec_id, c, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, c) AS place FROM {VIEWS} WHERE v = 0) JOIN n USING (c) WHERE place <= 3 GROUP BY 1""")
def top_k_labels(spark, d):
    names = spark.range(12).select(F.col("id").cast("int").alias("c"), F.concat(F.lit("class "), F.col("id")).alias("name"))  # a row per class
    t = _e(spark, d).select("vec_id", F.posexplode(M.top_k(F.slice("e", 1, 12), 3)).alias("place", "c")).join(F.broadcast(names), "c")
    return t.groupBy("vec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda s: s["name"]), ",").alias("names"))


@query("""SELECT event_type, round(arg_max(value, event_id), 6) AS last, round(sum(value * (event_id % 7 + 1)) / sum(event_id % 7 + 1), 6) AS avg, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(sum(value * (event_id % 7 + 1)), 3) AS total, sum(event_id % 7 + 1)::BIGINT AS n FROM events GROUP BY 1""")
def meter_stats(spark, d):
    m = M.meter(table(spark, d, "events"), "value", F.col("event_id") % 7 + 1, "event_id", "event_type")
    return m.select("event_type", *(F.round(c, 3 if c == "total" else 6).alias(c) for c in ("last", "avg", "lo", "hi", "total")), "n")


@query("SELECT source AS fpc, round(avg(n / 24.0), 6) AS share FROM (SELECT source, doc_id // 24 AS b, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def batch_share(spark, d):
    per = table(spark, d, "documents").groupBy("source", F.floor(F.col("doc_id") / 24)).agg(F.count("*").alias("n"))
    return per.groupBy(F.col("source").alias("fpc")).agg(F.round(F.avg(F.col("n") / 24.0), 6).alias("share"))


@query("""SELECT least(floor(l_quantity / 5), 9)::BIGINT AS bx, least(floor(l_discount / 0.01), 9)::BIGINT AS by, round(sum(l_extendedprice), 2) AS weight, count(*)::BIGINT AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_discount BETWEEN 0 AND 0.1 GROUP BY 1, 2""")
def hist2d_weighted(spark, d):
    h = M.histogram_2d(table(spark, d, "lineitem"), "l_quantity", "l_discount", F.col("l_extendedprice"), 10, (0.0, 50.0), (0.0, 0.1))
    return h.select("bx", "by", F.round("weight", 2).alias("weight"), "n")


@query("""SELECT event_id, round(coalesce(avg(value) OVER w + 3 * stddev_pop(value) OVER w, 1e9), 5) AS bound, value > coalesce(avg(value) OVER w + 3 * stddev_pop(value) OVER w, 'inf'::DOUBLE) AS rejected
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""")
def trailing_bound(spark, d):
    b = M.trailing_bound(table(spark, d, "events"), "value", ["ts", "event_id"], 30, 3.0, "user_id")
    return b.select("event_id", F.round(F.least(F.col("bound"), F.lit(1e9)), 5).alias("bound"), (F.col("value") > F.col("bound")).alias("rejected"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(CASE WHEN r = 1 THEN 1.0 ELSE 0.1 END::DOUBLE * pow(0.9::DOUBLE, n - r) * value), 6) AS ema, count(*)::BIGINT AS n FROM r GROUP BY 1""")
def ema_closed_form(spark, d):
    return M.ema(table(spark, d, "events"), "value", ["ts", "event_id"], 0.9, "user_id").select("user_id", F.round("ema", 6).alias("ema"), "n")


@query("""WITH g AS (SELECT l_suppkey, k, k - row_number() OVER (PARTITION BY l_suppkey ORDER BY k) AS g FROM (SELECT DISTINCT l_suppkey, l_orderkey // 8 AS k FROM lineitem)),
s AS (SELECT l_suppkey, min(k) AS lo, max(k) AS hi FROM g GROUP BY l_suppkey, g) SELECT l_suppkey, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ',' ORDER BY lo) AS ranges FROM s GROUP BY 1""")
def range_compress(spark, d):
    return M.islands(table(spark, d, "lineitem").select("l_suppkey", F.floor(F.col("l_orderkey") / 8).alias("k")), "k", "l_suppkey")


@query("""SELECT c.event_id, v.value AS seen FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT user_id, ts, max_by(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON c.user_id = v.user_id AND c.ts >= v.ts""")
def frame_lookup_asof(spark, d):
    e = table(spark, d, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("seen"))
    return M.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "seen").select("event_id", "seen")


@query("""SELECT epoch_ms(floor(epoch(ts) / 21600)::BIGINT * 21600000) AS start, event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS top FROM events GROUP BY 1, 2""")
def telemetry_tumbling(spark, d):
    w = table(spark, d, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("top"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "mean", "top")


_POSE = """WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, sin(value) AS x, cos(value * 2) AS y, sin(value / 3) AS z,
sin(value * 5) AS rx, sin(value * 7) * 1.2 AS ry, sin(value * 11) * 2 AS rz, (sin(value) + 1) / 2 AS g FROM events)"""
#: R = Rz Ry Rx of the angles a, b, c as nine columns with a suffix.
_ROT = lambda a, b, c, s: f"cos({c})*cos({b}) AS {s}11, cos({c})*sin({b})*sin({a})-sin({c})*cos({a}) AS {s}12, cos({c})*sin({b})*cos({a})+sin({c})*sin({a}) AS {s}13, sin({c})*cos({b}) AS {s}21, sin({c})*sin({b})*sin({a})+cos({c})*cos({a}) AS {s}22, sin({c})*sin({b})*cos({a})-cos({c})*sin({a}) AS {s}23, -sin({b}) AS {s}31, cos({b})*sin({a}) AS {s}32, cos({b})*cos({a}) AS {s}33"
POSE = ("x", "y", "z", "rx", "ry", "rz", "g")


def _poses(spark, d):
    v = F.col("value")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    made = [F.sin(v), F.cos(v * 2), F.sin(v / 3), F.sin(v * 5), F.sin(v * 7) * 1.2, F.sin(v * 11) * 2, (F.sin(v) + 1) / 2]
    return table(spark, d, "events").select("user_id", "event_id", t.alias("t"), *(c.alias(n) for c, n in zip(made, POSE, strict=True)))


def _before(p):
    w = Window.partitionBy("user_id").orderBy("t")
    return p.select("*", *(F.lag(c).over(w).alias(f"{c}0") for c in POSE)).where("x0 IS NOT NULL")


@query(_POSE + " SELECT event_id, round(x - lag(x) OVER w, 6) + 0.0 AS dx, round(y - lag(y) OVER w, 6) + 0.0 AS dy, round(z - lag(z) OVER w, 6) + 0.0 AS dz, round(g - lag(g) OVER w, 6) + 0.0 AS dg FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t) QUALIFY dx IS NOT NULL")
def pose_delta(spark, d):
    p = _before(_poses(spark, d))
    return p.select("event_id", *((F.round(F.col(c) - F.col(f"{c}0"), 6) + 0.0).alias(f"d{c}") for c in ("x", "y", "z", "g")))


def _euler_sql(r31: str, r32: str, r33: str, r21: str, r11: str) -> str:
    return f"round(atan2({r32}, {r33}), 5) + 0.0 AS a, round(asin(greatest(-1, least(1, -({r31})))), 5) + 0.0 AS b, round(atan2({r21}, {r11}), 5) + 0.0 AS c"


def _dot(rows: str, a: str, b: str) -> str:
    return "+".join(f"{a}{rows[0]}{k}*{b}{rows[1]}{k}" for k in "123")


_DELTA = f""", q AS (SELECT *, lag(rx) OVER w AS ax, lag(ry) OVER w AS ay, lag(rz) OVER w AS az FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)),
r AS (SELECT event_id, {_ROT("rx", "ry", "rz", "e")}, {_ROT("ax", "ay", "az", "s")} FROM q WHERE ax IS NOT NULL)"""


@query(_POSE + _DELTA + f" SELECT event_id, {_euler_sql(*(_dot(x, 'e', 's') for x in ('31', '32', '33', '21', '11')))} FROM r")
def rotation_delta(spark, d):
    p = _before(_poses(spark, d))
    start, end = ([F.col(f"{c}{s}") for c in POSE] for s in ("0", ""))
    return p.select("event_id", *((F.round(v, 5) + 0.0).alias(n) for v, n in zip(P.difference(start, end)[3:6], "abc", strict=True)))


def _mul(rows: str, a: str, b: str) -> str:
    return "+".join(f"{a}{rows[0]}{k}*{b}{k}{rows[1]}" for k in "123")


@query(_POSE + f", r AS (SELECT event_id, x, g, {_ROT('rx * 0.3', 'ry * 0.3', 'rz * 0.3', 'e')}, {_ROT('rx', 'ry', 'rz', 's')} FROM p) SELECT event_id, round(x + 0.5, 6) AS x, greatest(0.0, least(1.0, round(g + 0.4, 6))) AS g, {_euler_sql(*(_mul(x, 'e', 's') for x in ('31', '32', '33', '21', '11')))} FROM r")
def pose_compose(spark, d):
    p = _poses(spark, d)
    pose = [F.col(c) for c in POSE]
    action = [F.lit(0.5), F.lit(0.0), F.lit(0.0), *(F.col(c) * 0.3 for c in ("rx", "ry", "rz")), F.lit(0.4)]
    new = P.compose(pose, action)
    return p.select("event_id", F.round(new[0], 6).alias("x"), F.round(new[6], 6).alias("g"), *((F.round(v, 5) + 0.0).alias(n) for v, n in zip(new[3:6], "abc", strict=True)))


def _tmul(rows: str, a: str, b: str) -> str:
    return "+".join(f"{a}{k}{rows[0]}*{b}{k}{rows[1]}" for k in "123")


@query(_POSE + f", r AS (SELECT event_id, x - 0.1 AS px, y - 0.2 AS py, z - 0.3 AS pz, {_ROT('0.4', '0.5', '0.6', 'e')}, {_ROT('rx', 'ry', 'rz', 's')} FROM p) SELECT event_id, round(e11*px+e21*py+e31*pz, 6) + 0.0 AS x, round(e12*px+e22*py+e32*pz, 6) + 0.0 AS y, round(e13*px+e23*py+e33*pz, 6) + 0.0 AS z, {_euler_sql(*(_tmul(x, 'e', 's') for x in ('31', '32', '33', '21', '11')))} FROM r")
def frame_change(spark, d):
    frame = [F.lit(v) for v in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6)]
    new = P.in_frame(frame, [F.col(c) for c in POSE[:6]])
    names = (("x", 6), ("y", 6), ("z", 6), ("a", 5), ("b", 5), ("c", 5))
    return _poses(spark, d).select("event_id", *((F.round(v, n) + 0.0).alias(c) for v, (c, n) in zip(new, names, strict=True)))


@query("SELECT count(*)::BIGINT AS steps, count(*) FILTER (WHERE isnan(value))::BIGINT AS bad, count(*) FILTER (WHERE event_id % 10 = 0 OR isnan(value) OR isinf(value))::BIGINT AS logged FROM events")
def log_cadence(spark, d):
    v = F.col("value")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    return table(spark, d, "events").agg(F.count("*").alias("steps"), F.count_if(F.isnan(v)).alias("bad"), F.count_if((F.col("event_id") % 10 == 0) | odd).alias("logged"))
