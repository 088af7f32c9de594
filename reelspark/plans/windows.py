"""Queries over window generators: clip indices, anticipation windows, views, token positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import windows as W
from ..functions.randoms import uniform
from ..operators import manifests as M
from .registry import query, table


def _clips_sql(frames: int, step: int, clips: int, overlap: bool) -> str:
    """The three branches by unnesting (clip, position) pairs, for recordings of n_chars frames."""
    span = frames * step
    return f"""
WITH r AS (SELECT doc_id, n_chars AS n, n_chars // {clips} AS p FROM documents),
b AS (SELECT doc_id, i, n, p,
  CASE WHEN p > {span} THEN {span} WHEN {overlap} THEN least({span}, n) - 1 ELSE p END AS hi,
  CASE WHEN p > {span} THEN {frames} WHEN {overlap} THEN (least({span}, n) - 1) // {step} ELSE p // {step} END AS k,
  CASE WHEN p > {span} OR NOT {overlap} THEN i * p WHEN n > {span} THEN i * ((n - {span}) // greatest({clips} - 1, 1)) ELSE 0 END AS shift
  FROM r, range({clips}) c(i) WHERE CASE WHEN {overlap} THEN n >= 2 ELSE p >= 1 END)
SELECT doc_id, i AS clip, j AS pos, (floor(least(CASE WHEN j >= k THEN hi::DOUBLE WHEN k > 1 AND j = k - 1 THEN hi::DOUBLE WHEN k > 1 THEN j * (hi::DOUBLE / (k - 1)) ELSE 0 END, (hi - 1)::DOUBLE)))::BIGINT + shift AS frame
FROM b, range({frames}) f(j)"""


def _clips(spark, d, frames, step, clips, overlap):
    made = W.clip_indices(F.col("n_chars"), frames, step, clips, overlap)
    docs = table(spark, d, "documents").select("doc_id", made.alias("plan")).where("plan IS NOT NULL")
    return docs.select("doc_id", F.posexplode("plan").alias("clip", "frames")).select("doc_id", F.col("clip").cast("long").alias("clip"), F.posexplode("frames").alias("pos", "frame")).withColumn("pos", F.col("pos").cast("long"))


@query(_clips_sql(8, 4, 2, False))
def clip_indices_long(spark, d):
    return _clips(spark, d, 8, 4, 2, False)


@query(_clips_sql(16, 64, 4, False))
def clip_indices_short(spark, d):
    return _clips(spark, d, 16, 64, 4, False)


@query(_clips_sql(16, 64, 4, True))
def clip_indices_overlap(spark, d):
    return _clips(spark, d, 16, 64, 4, True)


@query("""WITH r AS (SELECT doc_id, n_chars // 2 AS p, ('0x' || substr(md5('9:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents)
SELECT doc_id, sum(f)::BIGINT AS total FROM (SELECT doc_id, floor(floor(u * greatest(p - 32, 1)) + least(CASE WHEN j = 7 THEN 32.0::DOUBLE ELSE j * (32.0::DOUBLE / 7) END, 31.0::DOUBLE)) + i * p AS f FROM r, range(2) c(i), range(8) g(j) WHERE p > 32) GROUP BY 1""")
def clip_indices_random(spark, d):
    plan = W.clip_indices(F.col("n_chars"), 8, 4, 2, draw=uniform(9, F.col("doc_id")))
    docs = table(spark, d, "documents").where(F.floor(F.col("n_chars") / 2) > 32)
    return docs.select("doc_id", F.aggregate(F.flatten(plan), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""SELECT doc_id, unnest(range(4)) AS clip, n_chars AS fps, trunc(2.5 * n_chars / 16)::BIGINT AS step FROM documents""")
def clip_plan_explode(spark, d):
    step = W.step_from_duration(2.5, F.col("n_chars"), 16)
    return table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<long>")).alias("clip"), F.col("n_chars").alias("fps"), step.alias("step"))


@query("SELECT doc_id, trunc(4.0 * ceil(n_chars / 7.0) / 16)::BIGINT AS step FROM documents")
def frame_step_duration(spark, d):
    return table(spark, d, "documents").select("doc_id", W.step_from_duration(4.0, F.col("n_chars") / 7.0, 16).alias("step"))


@query("SELECT doc_id, nullif(floor(ceil(n_chars / 50.0) / 8)::BIGINT, 0) AS step FROM documents")
def frame_step_fps(spark, d):
    return table(spark, d, "documents").select("doc_id", W.step_from_fps(F.col("n_chars") / 50.0, 8).alias("step"))


_ACTIONS = """
WITH train AS (SELECT DISTINCT l_returnflag, l_partkey FROM lineitem WHERE l_linenumber <= 3),
val AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey, l_quantity::BIGINT AS start, (l_quantity + l_linenumber * 10)::BIGINT AS stop FROM lineitem v
  WHERE l_linenumber > 3 AND EXISTS (SELECT 1 FROM train t WHERE t.l_returnflag = v.l_returnflag AND t.l_partkey = v.l_partkey)),
verbs AS (SELECT l_returnflag, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS verb FROM (SELECT DISTINCT l_returnflag FROM train)),
anchored AS (SELECT *, trunc(start * 0.25::DOUBLE + 0.75::DOUBLE * stop - trunc(1.0::DOUBLE * 30))::BIGINT AS anchor FROM val JOIN verbs USING (l_returnflag))
"""


def _anchored(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", F.col("l_quantity").cast("long").alias("start"), (F.col("l_quantity") + F.col("l_linenumber") * 10).cast("long").alias("stop"))
    train = li.where("l_linenumber <= 3").select("l_returnflag", "l_partkey")
    val = M.known_only(li.where("l_linenumber > 3"), train, ["l_returnflag", "l_partkey"])
    verbs = M.encode(val, M.vocabulary(train, ["l_returnflag"], "verb"), ["l_returnflag"], "verb", strict=False)
    return verbs.withColumn("anchor", W.anticipation_anchor(F.col("start"), F.col("stop"), F.lit(1.0), F.lit(0.25), F.lit(30.0)))


@query(_ACTIONS + "SELECT verb, j AS pos, count(*)::BIGINT AS n, sum(greatest(0, anchor - (8 - j) * 3))::BIGINT AS total, count(DISTINCT greatest(0, anchor - (8 - j) * 3))::BIGINT AS distinct_frames FROM anchored, range(8) r(j) GROUP BY 1, 2")
def anticipation_windows(spark, d):
    """The flagship: known pairs, dense verb ids, the frames before each action, per-class counts."""
    a = _anchored(spark, d).select("verb", F.posexplode(W.anticipation_indices(F.col("anchor"), F.lit(30.0), 8.0, 8)).alias("pos", "frame"))
    return a.groupBy("verb", F.col("pos").cast("long").alias("pos")).agg(F.count("*").alias("n"), F.sum("frame").alias("total"), F.count_distinct("frame").alias("distinct_frames"))


@query(_ACTIONS + "SELECT l_orderkey, l_linenumber, anchor, list_sum([greatest(0, anchor - (8 - j) * 3) for j in range(8)])::BIGINT AS total FROM anchored")
def anticipation_index_sum(spark, d):
    frames = W.anticipation_indices(F.col("anchor"), F.lit(30.0), 8.0, 8)
    return _anchored(spark, d).select("l_orderkey", "l_linenumber", "anchor", F.aggregate(frames, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("""SELECT p_partkey, string_agg((v * ((greatest(p_size * 10, p_retailprice::INT) - least(p_size * 10, p_retailprice::INT)) // 2))::BIGINT, ',' ORDER BY v) AS offsets FROM part, range(3) r(v) GROUP BY 1""")
def view_offsets(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(W.view_offsets(F.col("p_size") * 10, F.rint("p_retailprice").cast("int"), 3), ",").alias("offsets"))


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events) WHERE t % 4 = 0""")
def stride_select(spark, d):
    t = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    kept = table(spark, d, "events").groupBy("user_id").agg(t.alias("all")).select("user_id", F.explode(A.stride_select(F.col("all"), 4)).alias("e"))
    return kept.select("user_id", "e.event_id", "e.value")


@query("SELECT vec_id, vec_id // 196 AS frame, (vec_id % 196) // 14 AS grid_row, vec_id % 14 AS grid_col FROM embeddings")
def token_position(spark, d):
    frame, row, col = A.token_position(F.col("vec_id"), 14, 14)
    return table(spark, d, "embeddings").select("vec_id", frame.alias("frame"), row.alias("grid_row"), col.alias("grid_col"))


@query("""SELECT vec_id, (1568 + 196 * trunc(vec_id * 0.01::DOUBLE * 8 / 2)::BIGINT) AS first_token, (1568 + 196 * trunc(vec_id * 0.01::DOUBLE * 8 / 2)::BIGINT + 195) AS last_token FROM embeddings""")
def future_tokens(spark, d):
    ids = W.future_tokens(1568, 14, F.col("vec_id") * 0.01, 8.0, 2, 2)
    return table(spark, d, "embeddings").select("vec_id", F.element_at(ids, 1).alias("first_token"), F.element_at(ids, -1).alias("last_token"))


@query("""WITH t AS (SELECT conv_id, count(*) * 40 AS n, ('0x' || substr(md5('4:' || conv_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM conversations GROUP BY 1)
SELECT conv_id, (64 + floor(u * (n - 64)))::BIGINT - 64 AS first_frame, (64 + floor(u * (n - 64)))::BIGINT - 64 + 56 AS last_frame FROM t WHERE n > 64""")
def trajectory_window(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id").agg((F.count("*") * 40).alias("n"))
    w = W.trajectory_window(F.col("n"), F.lit(30.0), 4.0, 8, uniform(4, F.col("conv_id")))
    return t.select("conv_id", w.alias("w")).where("w IS NOT NULL").select("conv_id", F.element_at("w", 1).alias("first_frame"), F.element_at("w", -1).alias("last_frame"))


@query("""SELECT vec_id, c AS clip, round(list_sum(embedding[c * 16 + 1 : c * 16 + 16]::DOUBLE[]), 6) AS total FROM embeddings, range(4) r(c)""")
def split_clips(spark, d):
    clips = A.split_clips(A.dbl(F.col("embedding")), 4, 16)
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(clips).alias("clip", "part")).select("vec_id", F.col("clip").cast("long").alias("clip"), F.round(A.fold(F.col("part")), 6).alias("total"))


@query("""SELECT vec_id, c AS clip, s AS view_id, ((vec_id * 3 + s) * 4 + c) AS flat FROM embeddings, range(4) r(c), range(3) v(s)""")
def rekey_views(spark, d):
    """Clip-major to view-major: (sample, view, clip) as one flat place."""
    e = table(spark, d, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<long>")).alias("clip")).withColumn("view_id", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<long>")))
    return e.select("vec_id", "clip", "view_id", ((F.col("vec_id") * 3 + F.col("view_id")) * 4 + F.col("clip")).alias("flat"))
