"""Queries over array algebra: embeddings stand for token and score vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from .registry import query, table

E = "(SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def _e(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", A.dbl(F.col("embedding")).alias("e"))


def _long(df, column: str, name: str, *keep: str, digits: int = 6):
    return df.select(*keep, F.posexplode(column).alias("pos", name)).withColumns({"pos": F.col("pos").cast("long"), name: F.round(F.col(name), digits) + 0.0})


@query(f"""WITH s AS (SELECT vec_id, generate_subscripts(e, 1) - 1 AS pos, unnest(e) AS x FROM {E}),
m AS (SELECT vec_id, avg(x) AS m, var_pop(x) AS v FROM s GROUP BY 1) SELECT vec_id, pos, round((x - m) / sqrt(v + 1e-5), 5) + 0.0 AS x FROM s JOIN m USING (vec_id)""")
def layer_norm(spark, d):
    return _long(_e(spark, d).withColumn("x", A.layer_norm(F.col("e"))), "x", "x", "vec_id", digits=5)


@query(f"""WITH s AS (SELECT vec_id, generate_subscripts(e, 1) - 1 AS pos, unnest(e) AS x FROM {E}),
m AS (SELECT vec_id, pos // 16 AS c, avg(x) AS m, var_pop(x) AS v FROM s GROUP BY 1, 2) SELECT s.vec_id, pos, round((x - m) / sqrt(v + 1e-5), 5) + 0.0 AS x FROM s JOIN m ON s.vec_id = m.vec_id AND c = pos // 16""")
def chunk_layer_norm(spark, d):
    return _long(_e(spark, d).withColumn("x", A.chunk_layer_norm(F.col("e"), 4, 16)), "x", "x", "vec_id", digits=5)


@query(f"""WITH s AS (SELECT vec_id, generate_subscripts(e, 1) - 1 AS pos, unnest(e) AS x FROM {E}), z AS (SELECT vec_id, sum(exp(x)) AS z FROM s GROUP BY 1)
SELECT vec_id, pos, round(exp(x) / z, 6) AS p FROM s JOIN z USING (vec_id)""")
def softmax(spark, d):
    return _long(_e(spark, d).withColumn("p", A.softmax(F.col("e"))), "p", "p", "vec_id")


@query(f"SELECT vec_id, round(list_sum([1 / (1 + exp(-x)) for x in e]), 5) AS total FROM {E}")
def sigmoid_scores(spark, d):
    return _e(spark, d).select("vec_id", F.round(A.fold(F.transform("e", A.sigmoid)), 5).alias("total"))


PAIRS = f"(SELECT a.vec_id, a.label, a.e AS e, b.e AS f FROM {E} a JOIN {E} b ON b.vec_id = a.vec_id + 1)"


def _pairs(spark, d):
    a = _e(spark, d)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return a.join(b, "vec_id")


@query(f"SELECT vec_id, round(list_dot_product(e, f) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f))), 6) AS cosine FROM {PAIRS}")
def cosine(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(A.cosine(F.col("e"), F.col("f")), 6).alias("cosine"))


@query(f"SELECT vec_id, round(list_avg([abs(e[i] - f[i]) for i in range(1, 65)]), 6) AS l1 FROM {PAIRS}")
def l1_distance(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(A.l1_distance(F.col("e"), F.col("f")), 6).alias("l1"))


@query(f"""WITH m AS (SELECT label, vec_id, list_avg([pow(abs(e[i] - f[i]), 1.5) for i in range(1, 65)]) / 1.5 AS l FROM {PAIRS}), g AS (SELECT label, avg(l) AS l FROM m GROUP BY 1)
SELECT label, round(l, 6) AS loss, round((SELECT avg(l) FROM g), 6) AS mean_of_means FROM g""")
def lp_loss(spark, d):
    per = _pairs(spark, d).groupBy("label").agg(F.avg(A.lp_loss(F.col("e"), F.col("f"), 1.5)).alias("l"))
    return per.crossJoin(per.agg(F.avg("l").alias("m"))).select("label", F.round("l", 6).alias("loss"), F.round("m", 6).alias("mean_of_means"))  # a row per label


_GRID = """
WITH c AS (SELECT vec_id AS token, vec_id // 512 AS sample, vec_id // 64 AS f, (vec_id % 64) // 8 AS y, vec_id % 8 AS x, label < 3 AS hidden FROM embeddings),
dist AS (SELECT a.token, min(sqrt((a.f - b.f) * (a.f - b.f) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))) AS dmin FROM c a JOIN c b ON b.hidden AND b.sample = a.sample WHERE NOT a.hidden GROUP BY 1)
"""


def _grid_distance(spark, d):
    """Least distance on the grid from each visible token to the hidden ones of its sample.

    A sample is 512 tokens, 8 frames of 8 x 8, over the whole table; one without hidden tokens gives no rows. Tokens of
    a sample are an array, so the nearest join is a fold inside one row and never a join of all with all.
    """
    f, y, x = A.token_position(F.col("vec_id"), 8, 8)
    c = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 512).alias("sample"), F.struct(F.col("vec_id").alias("token"), f.alias("f"), y.alias("y"), x.alias("x"), (F.col("label") < 3).alias("hidden")).alias("t"))
    s = c.groupBy("sample").agg(F.collect_list("t").alias("all"))
    sq = lambda v: v * v
    hidden = F.filter("all", lambda t: t["hidden"])
    nearest = lambda t: F.array_min(F.transform(hidden, lambda h: F.sqrt((sq(t["f"] - h["f"]) + sq(t["y"] - h["y"]) + sq(t["x"] - h["x"])).cast("double"))))
    seen = F.filter("all", lambda t: ~t["hidden"])
    return s.where(F.size(hidden) > 0).select(F.inline(F.transform(seen, lambda t: F.struct(t["token"].alias("token"), nearest(t).alias("dmin")))))


@query(_GRID + "SELECT token, round(dmin, 6) AS dmin FROM dist")
def mask_min_distance(spark, d):
    return _grid_distance(spark, d).select("token", F.round("dmin", 6).alias("dmin"))


@query(_GRID + f", l AS (SELECT vec_id, list_avg([abs(x) for x in e]) AS l FROM {E}) SELECT round(avg(l / dmin), 6) AS loss, count(*)::BIGINT AS n FROM dist JOIN l ON vec_id = token")
def distance_weighted_loss(spark, d):
    size = _e(spark, d).select(F.col("vec_id").alias("token"), (A.fold(F.col("e"), F.abs) / F.size("e")).alias("l"))
    return _grid_distance(spark, d).join(size, "token").agg(F.round(F.avg(F.col("l") / F.col("dmin")), 6).alias("loss"), F.count("*").alias("n"))


@query("""SELECT p AS pos, i AS dim, round(CASE WHEN i < 8 THEN sin(p * pow(10000.0::DOUBLE, -(i / 8.0))) ELSE cos(p * pow(10000.0::DOUBLE, -((i - 8) / 8.0))) END, 6) + 0.0 AS x FROM range(50) a(p), range(16) b(i)""")
def sincos_1d(spark, d):
    rows = spark.range(50).select(F.col("id").alias("pos"), F.posexplode(A.sincos(16, F.col("id"))).alias("dim", "x"))
    return rows.select("pos", F.col("dim").cast("long").alias("dim"), (F.round("x", 6) + 0.0).alias("x"))


@query("""WITH g AS (SELECT t // 16 AS f, (t % 16) // 4 AS y, t % 4 AS x, t FROM range(64) r(t)), a AS (SELECT t, i, CASE WHEN i < 8 THEN f WHEN i < 12 THEN y ELSE x END AS p, CASE WHEN i < 8 THEN i WHEN i < 12 THEN i - 8 ELSE i - 12 END AS k, CASE WHEN i < 8 THEN 4 ELSE 2 END AS h FROM g, range(16) d(i))
SELECT t AS token, i AS dim, round(CASE WHEN k < h THEN sin(p * pow(10000.0::DOUBLE, -(k::DOUBLE / h))) ELSE cos(p * pow(10000.0::DOUBLE, -((k - h)::DOUBLE / h))) END, 6) + 0.0 AS x FROM a""")
def sincos_3d(spark, d):
    """Depth takes half of the dimensions, height and width a quarter each."""
    f, y, x = A.token_position(F.col("id"), 4, 4)
    table_ = F.concat(A.sincos(8, f), A.sincos(4, y), A.sincos(4, x))
    rows = spark.range(64).select(F.col("id").alias("token"), F.posexplode(table_).alias("dim", "x"))
    return rows.select("token", F.col("dim").cast("long").alias("dim"), (F.round("x", 6) + 0.0).alias("x"))


@query(f"SELECT label, round(avg(ln(list_sum([exp(x) for x in e])) - e[label + 1]), 6) AS loss FROM {E} GROUP BY 1")
def cross_entropy(spark, d):
    return _e(spark, d).groupBy("label").agg(F.round(F.avg(A.cross_entropy(F.col("e"), F.col("label"))), 6).alias("loss"))


@query(f"""WITH s AS (SELECT vec_id, unnest(e) AS x, CASE WHEN generate_subscripts(e, 1) - 1 = label THEN 1.0 ELSE 0.0 END AS t FROM {E}),
p AS (SELECT *, 1 / (1 + exp(-x)) AS p, greatest(x, 0) - x * t + ln(1 + exp(-abs(x))) AS ce FROM s)
SELECT vec_id, round(sum(ce * pow(1 - (p * t + (1 - p) * (1 - t)), 2) * (0.25 * t + 0.75 * (1 - t)))::DOUBLE, 6) AS loss FROM p GROUP BY 1""")
def focal_loss(spark, d):
    return _e(spark, d).select("vec_id", F.round(A.fold(A.focal_terms(F.col("e"), F.col("label"))), 6).alias("loss"))


@query(f"SELECT vec_id, round(list_sum([(x * 255 - 0.485 * 255) / (0.229 * 255) for x in e]), 5) AS total FROM {E}")
def normalize_channels(spark, d):
    """The plain form; the oracle uses the one that is multiplied through by 255."""
    return _e(spark, d).select("vec_id", F.round(A.fold(F.transform("e", lambda x: (x - 0.485) / 0.229)), 5).alias("total"))


@query(f"SELECT vec_id, round(list_sum([CASE WHEN abs(x) < 0.25 THEN 0.0 ELSE greatest(-0.75, least(0.75, x)) END for x in e])::DOUBLE, 6) AS total FROM {E}")
def clamp_and_zero(spark, d):
    return _e(spark, d).select("vec_id", F.round(A.fold(F.transform("e", lambda x: A.zero_small(A.clamp(x, -0.75, 0.75), 0.25))), 6).alias("total"))


@query("""WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY 1) SELECT conv_id, array_to_string([t[i % len(t) + 1] for i in range(12)], ',') AS padded FROM c""")
def circulant_pad(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t"))
    return c.select("conv_id", F.array_join(A.circulant_pad(F.col("t"), F.lit(12)), ",").alias("padded"))


@query(f"SELECT vec_id, round(list_sum(list_concat(e, f)[-24:]), 6) AS total, 24::BIGINT AS n FROM {PAIRS}")
def sliding_fifo(spark, d):
    w = A.slide(F.col("e"), F.col("f"), 24)
    return _pairs(spark, d).select("vec_id", F.round(A.fold(w), 6).alias("total"), F.size(w).cast("long").alias("n"))


@query(f"""WITH s AS (SELECT vec_id, generate_subscripts(e, 1) - 1 AS pos, unnest(e) AS x FROM {E})
SELECT vec_id, pos, row_number() OVER (PARTITION BY vec_id ORDER BY x, pos) - 1 AS place FROM s""")
def sort_and_restore(spark, d):
    """argsort and its inverse: argsort of the argsort is each element's place."""
    return _long(_e(spark, d).withColumn("place", A.argsort(A.argsort(F.col("e")))), "place", "place", "vec_id").withColumn("place", F.col("place").cast("long"))


@query("SELECT p AS pos, round(p * 15.0 / 23.0, 6) AS scaled FROM range(24) r(p)")
def rope_rescale(spark, d):
    return spark.range(24).select(F.col("id").alias("pos"), F.round(A.rope_rescale(F.col("id"), 16, 24), 6).alias("scaled"))


@query(f"SELECT vec_id, len(e) - 5 AS n, round(list_sum(e[1:len(e) - 5]), 6) AS total FROM {E}")
def drop_last_tokens(spark, d):
    kept = A.drop_last(F.col("e"), 5)
    return _e(spark, d).select("vec_id", F.size(kept).cast("long").alias("n"), F.round(A.fold(kept), 6).alias("total"))


@query("SELECT g AS pos, i AS chunk_copy, (g // 5) * 10 + i * 5 + g % 5 AS place FROM range(20) a(g), range(2) b(i)")
def repeat_interleave(spark, d):
    """Each chunk of 5 rows twice in a row."""
    r = spark.range(20).withColumn("chunk_copy", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    return r.select(F.col("id").alias("pos"), "chunk_copy", (F.floor(F.col("id") / 5) * 10 + F.col("chunk_copy") * 5 + F.col("id") % 5).alias("place"))
