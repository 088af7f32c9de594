"""Queries over the smaller operators: replicas, set algebra of masks, positional joins, guards, counts by epoch."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import hooks
from ..operators.indexing import global_index
from .registry import query, table

E = "(SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


@query("SELECT page_id, i AS frame, url FROM pages, range(4) r(i)")
def image_repeat(spark, d):
    """An image stands for all frames of a clip."""
    return table(spark, d, "pages").select("page_id", F.posexplode(F.array_repeat("url", 4)).alias("frame", "url")).select("page_id", F.col("frame").cast("long").alias("frame"), "url")


@query("SELECT event_id, value FROM events WHERE NOT isnan(value)")
def nan_guard(spark, d):
    return table(spark, d, "events").select("event_id", hooks.no_nan(F.col("value")).alias("value"))


@query("""WITH t AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events), n AS (SELECT user_id, count(*) AS n FROM t GROUP BY 1)
SELECT n.user_id, k AS pos, t.event_id, t.value FROM n, range(6) r(k) JOIN t ON t.user_id = n.user_id AND t.t = k * (n.n // 6)""")
def frame_gather_join(spark, d):
    """Frames of an index list joined to the rows of their trajectory."""
    t = table(spark, d, "events").select("user_id", "event_id", "value", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("t"))
    picked = t.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: k * F.floor(F.col("n") / 6))).alias("pos", "t"))
    return picked.join(t, ["user_id", "t"]).select("user_id", F.col("pos").cast("long").alias("pos"), "event_id", "value")


@query("SELECT count(*)::BIGINT AS num_clips, (count(*) // (4 * 8))::BIGINT AS num_batches, count(DISTINCT l_orderkey)::BIGINT AS num_videos FROM lineitem")
def clip_counts(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("num_clips"), F.floor(F.count("*") / 32).alias("num_batches"), F.count_distinct("l_orderkey").alias("num_videos"))


@query(f"""SELECT a.vec_id, round(list_sum([0.99 * a.e[i] + 0.01 * b.e[i] for i in range(1, 65)])::DOUBLE, 6) AS total FROM {E} a JOIN {E} b ON b.vec_id = a.vec_id + 1""")
def parameter_ema(spark, d):
    """Two sets of named parameters joined by name; the slow one moves a hundredth of the way."""
    slow = table(spark, d, "embeddings").select("vec_id", A.dbl(F.col("embedding")).alias("e"))
    fast = slow.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return slow.join(fast, "vec_id").select("vec_id", F.round(A.fold(F.zip_with("e", "f", lambda x, y: 0.99 * x + 0.01 * y)), 6).alias("total"))


@query(f"SELECT sum(len(e))::BIGINT AS n_parameters, count(*)::BIGINT AS n_tensors FROM {E}")
def parameter_count(spark, d):
    return table(spark, d, "embeddings").agg(F.sum(F.size("embedding")).alias("n_parameters"), F.count("*").alias("n_tensors"))


_SETS = "(SELECT conv_id, list(DISTINCT turn) AS a, list(DISTINCT length(text) % 12) AS b FROM conversations GROUP BY 1)"


@query(f"SELECT conv_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS u, array_to_string(list_sort(list_intersect(a, b)), ',') AS i, array_to_string([x for x in range(16) if NOT list_contains(a, x)], ',') AS c FROM {_SETS}")
def mask_set_algebra(spark, d):
    s = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("turn").alias("a"), F.collect_set((F.length("text") % 12).cast("long")).alias("b"))
    show = lambda x: F.array_join(F.array_sort(x), ",")
    return s.select("conv_id", show(F.array_union("a", "b")).alias("u"), show(F.array_intersect("a", "b")).alias("i"), show(F.array_except(F.sequence(F.lit(0), F.lit(15)).cast("array<long>"), "a")).alias("c"))


@query(f"""SELECT m * n + place AS row_id, v AS vec_id, m AS mask_id, round(CASE m WHEN 0 THEN e[1] + e[3] ELSE e[8] + e[8] END, 6) AS total
FROM (SELECT vec_id AS v, e, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS n FROM {E}), range(2) r(m)""")
def mask_concat(spark, d):
    """Masks gathered one after the other, the rows of the first mask before those of the second.

    A row's id is its place among all vectors, moved by the number of vectors for each mask before its own.
    """
    masks = F.array(F.array(F.lit(0), F.lit(2)), F.array(F.lit(7), F.lit(7)))
    e = table(spark, d, "embeddings").select("vec_id", A.dbl(F.col("embedding")).alias("e"))
    n = F.broadcast(e.agg(F.count("*").alias("n")))  # one row
    t = global_index(e, "vec_id", "place").crossJoin(n).select("vec_id", "e", "place", "n", F.posexplode(masks).alias("mask_id", "mask"))
    m = F.col("mask_id").cast("long")
    return t.select((m * F.col("n") + F.col("place")).alias("row_id"), "vec_id", m.alias("mask_id"), F.round(A.fold(A.gather(F.col("e"), F.col("mask"))), 6).alias("total"))


@query("""SELECT extract(day FROM ts)::BIGINT AS epoch, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM events GROUP BY 1""")
def meters_per_epoch(spark, d):
    e = table(spark, d, "events").groupBy(F.dayofmonth("ts").cast("long").alias("epoch"))
    return e.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("lo"), F.round(F.max("value"), 6).alias("hi"))


@query("""SELECT vec_id, c AS clip, round(sin(c * 4), 6) AS p0, round(cos(c * 4), 6) AS p1 FROM embeddings, range(3) r(c)""")
def position_gather(spark, d):
    """Rows of a position table joined to each clip by its time index."""
    positions = spark.range(12).select(F.col("id").alias("t"), A.sincos(2, F.col("id")).alias("p"))  # twelve rows
    clips = table(spark, d, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<long>")).alias("clip")).withColumn("t", F.col("clip") * 4)
    return clips.join(F.broadcast(positions), "t").select("vec_id", "clip", F.round(F.get("p", 0), 6).alias("p0"), F.round(F.get("p", 1), 6).alias("p1"))


@query("SELECT vec_id, round(e[1] - e[2], 6) AS s0, round(e[3] * 2, 6) AS s1 FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def model_scores(spark, d):
    """A registered model on Arrow batches of vectors."""
    f = hooks.score("linear", weights=[[1.0, -1.0, 0.0], [0.0, 0.0, 2.0]])
    s = table(spark, d, "embeddings").select("vec_id", f(F.slice(A.dbl(F.col("embedding")), 1, 3)).alias("s"))
    return s.select("vec_id", F.round(F.get("s", 0), 6).alias("s0"), F.round(F.get("s", 1), 6).alias("s1"))


@query("SELECT doc_id, first, first + 511 AS last FROM (SELECT doc_id, unnest(range(0, n_chars - 511, 256)) AS first FROM documents)")
def udtf_windows(spark, d):
    spark.udtf.register("sliding_windows", hooks.windows_udtf())
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return spark.sql("SELECT doc_id, w.first, w.last FROM {docs}, LATERAL sliding_windows(0L, n_chars, 512L, 256L) w", docs=docs)


@query("SELECT conv_id, turn, length(text)::BIGINT AS n FROM conversations WHERE role = 'user' UNION ALL SELECT NULL, NULL, NULL FROM conversations WHERE role <> 'user'")
def flat_map_errors(spark, d):
    """A stage that fails on some rows: they come back as error rows."""

    def one(r: dict) -> list[dict]:
        if r["role"] != "user":
            raise ValueError("not a user's turn")
        return [{"conv_id": r["conv_id"], "turn": r["turn"], "n": len(r["text"])}]

    made = hooks.flat_map(table(spark, d, "conversations"), one, "conv_id long, turn long, n long")
    return made.select("conv_id", "turn", "n")


@query()
def trailing_filter_exact(spark, d):
    """The accepted-only trailing bound is recursive: a key's rows in order, the batch twin of the stateful stream."""
    from ..streaming.streams import TrailingFilter

    events = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return TrailingFilter(n=30, k=2.0, abort=False).batch(events, "user_id", ["ts", "event_id"], "value", "event_id")
