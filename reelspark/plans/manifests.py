"""Queries over manifests: scans, unions, predicates, joins, sharding (documents and pages stand for manifests)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.randoms import hash32, uniform
from ..operators import manifests as M
from ..operators import sampling as S
from ..operators.indexing import concat_ranges, global_index, locate
from .registry import query, table


@query("""SELECT source_id, local_id, path, label FROM (
SELECT 0 AS source_id, row_number() OVER (ORDER BY doc_id) - 1 AS local_id, source || '/' || doc_id AS path, lang AS label FROM documents
UNION ALL SELECT 1, row_number() OVER (ORDER BY page_id) - 1, url, NULL FROM pages)""")
def manifest_union(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("path"), F.col("lang").alias("label"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("path"))
    return M.union_sources([docs, pages], "doc_id").select("source_id", "local_id", "path", "label")


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT source, n, sum(n) OVER (ORDER BY source) AS hi FROM s)
SELECT doc_id AS idx, source AS in_source, (doc_id - (hi - n))::BIGINT AS local FROM (SELECT doc_id FROM documents) JOIN r ON doc_id >= hi - n AND doc_id < hi""")
def concat_index(spark, d):
    docs = table(spark, d, "documents")
    ranges = concat_ranges(docs.groupBy("source").agg(F.count("*").alias("n")), "source", "n")
    return locate(docs.select(F.col("doc_id").alias("idx")), "idx", ranges).select("idx", F.col("source").alias("in_source"), "local")


@query("""SELECT doc_id, round((CASE substr(source, 4)::INT % 3 WHEN 0 THEN 0.335 WHEN 1 THEN 0.1 ELSE 0.565 END)::DOUBLE / count(*) OVER (PARTITION BY source), 9) AS sample_weight FROM documents""")
def source_weights(spark, d):
    rest = F.substring("source", 4, 9).cast("int") % 3
    weight = F.when(rest == 0, 0.335).when(rest == 1, 0.1).otherwise(0.565)
    return M.source_weight(table(spark, d, "documents").select("doc_id", "source"), "source", weight).select("doc_id", F.round("sample_weight", 9).alias("sample_weight"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 64 * 16")
def length_filter(spark, d):
    return table(spark, d, "documents").where(F.col("n_chars") >= 64 * 16).select("doc_id", "n_chars")


@query("SELECT doc_id, strlen(text)::BIGINT AS size_bytes FROM documents WHERE strlen(text) <= 4096")
def size_filter(spark, d):
    size = F.octet_length("text").cast("long")
    return table(spark, d, "documents").where(size <= 4096).select("doc_id", size.alias("size_bytes"))


@query("SELECT doc_id FROM documents WHERE n_chars > 16 * 8")
def strict_length_filter(spark, d):
    return table(spark, d, "documents").where(F.col("n_chars") > 16 * 8).select("doc_id")


@query("""SELECT lower(split_part(url, '.', -1)) IN ('jpg', 'jpeg', 'png', 'html') AS is_image, count(*)::BIGINT AS n FROM pages GROUP BY 1""")
def suffix_dispatch(spark, d):
    suffix = F.lower(F.element_at(F.split("url", r"\."), -1))
    return table(spark, d, "pages").groupBy(suffix.isin("jpg", "jpeg", "png", "html").alias("is_image")).agg(F.count("*").alias("n"))


@query("SELECT page_id, split_part(split_part(url, '/', -1), '.', 1) AS video_id FROM pages")
def path_video_id(spark, d):
    return table(spark, d, "pages").select("page_id", F.substring_index(F.substring_index("url", "/", -1), ".", 1).alias("video_id"))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'base/' || p || '/videos/' || v || '.MP4' ELSE 'base/' || p || '/' || v || '.MP4' END AS path
FROM (SELECT page_id, split_part(url, '/', -1) AS v, split_part(split_part(url, '/', -1), '_', 1) AS p FROM pages)""")
def path_template(spark, d):
    v = F.substring_index("url", "/", -1)
    p = F.substring_index(v, "_", 1)
    videos = F.when(F.col("page_id") % 2 == 0, F.lit("videos"))
    return table(spark, d, "pages").select("page_id", F.concat_ws("/", F.lit("base"), p, videos, F.concat(v, F.lit(".MP4"))).alias("path"))


@query("SELECT page_id, split_part(split_part(url, '//', -1), '/', 1) AS host, split_part(url, '/', -1) || '_left' AS camera FROM pages")
def camera_name(spark, d):
    host = F.substring_index(F.element_at(F.split("url", "//"), -1), "/", 1)
    return table(spark, d, "pages").select("page_id", host.alias("host"), F.concat(F.element_at(F.split("url", "/"), -1), F.lit("_left")).alias("camera"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def exists_semi(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT source, count(*)::BIGINT AS missing FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1")
def missing_anti(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("missing"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem v WHERE l_linenumber > 3 AND EXISTS
(SELECT 1 FROM lineitem t WHERE t.l_linenumber <= 3 AND t.l_returnflag = v.l_returnflag AND t.l_partkey = v.l_partkey)""")
def known_pair_semi(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    train, val = li.where("l_linenumber <= 3"), li.where("l_linenumber > 3")
    return M.known_only(val, train, ["l_returnflag", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_returnflag, l_linestatus, l_linenumber, dense_rank() OVER (ORDER BY l_returnflag, l_linestatus, l_linenumber) - 1 AS class_id FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem)")
def vocab_dense_ids(spark, d):
    return M.vocabulary(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("""WITH v AS (SELECT l_partkey, dense_rank() OVER (ORDER BY l_partkey) - 1 AS class_id FROM (SELECT DISTINCT l_partkey FROM lineitem))
SELECT l_orderkey, l_linenumber, class_id FROM lineitem JOIN v USING (l_partkey)""")
def label_encode(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return M.encode(li, M.vocabulary(li, ["l_partkey"]), ["l_partkey"]).select("l_orderkey", "l_linenumber", "class_id")


@query("""WITH c AS (SELECT lang, count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi FROM documents GROUP BY 1)
SELECT lang, n::BIGINT AS n, lo AS first_doc, hi AS last_doc, (SELECT min(n) FROM c)::BIGINT AS min_class FROM c""")
def class_min_count(spark, d):
    c = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return c.crossJoin(c.agg(F.min("n").alias("min_class")))  # one row


@query("""SELECT l_orderkey, count(*)::BIGINT AS n, string_agg(l_quantity::BIGINT || ':' || l_partkey || ':' || l_linenumber, ',' ORDER BY l_quantity, l_partkey, l_linenumber) AS actions FROM lineitem GROUP BY 1""")
def annotation_lists(spark, d):
    item = F.struct("l_quantity", "l_partkey", "l_linenumber")
    shown = F.transform("a", lambda x: F.concat_ws(":", x["l_quantity"].cast("long"), x["l_partkey"], x["l_linenumber"]))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("a")).select("l_orderkey", F.size("a").cast("long").alias("n"), F.array_join(shown, ",").alias("actions"))


@query("""SELECT o_orderkey, n.n_name, l.n_lines FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey
JOIN (SELECT l_orderkey, count(*)::BIGINT AS n_lines FROM lineitem GROUP BY 1) l ON l.l_orderkey = o_orderkey""")
def annotation_join(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(customers, "o_custkey").join(nations, "n_nationkey").join(lines, "o_orderkey").select("o_orderkey", "n_name", "n_lines")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i % 8 = 3")
def shard_round_robin(spark, d):
    return global_index(table(spark, d, "documents").select("doc_id"), "doc_id").where("idx % 8 = 3").select("doc_id")


@query("""SELECT doc_id, i % 4 AS node, (i // 4) % 3 AS worker FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)""")
def shard_two_level(spark, d):
    i = F.col("idx")
    return global_index(table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", (i % 4).alias("node"), (F.floor(i / 4) % 3).alias("worker"))


@query("""SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) - 1 AS place FROM (SELECT doc_id, ('0x' || substr(md5('7:2:' || doc_id), 1, 8))::BIGINT AS h FROM documents)""")
def epoch_shuffle(spark, d):
    docs = table(spark, d, "documents").select("doc_id", hash32(7, 2, F.col("doc_id")).alias("h"))
    return global_index(docs, "h", "place", ties=["doc_id"]).select("doc_id", "place")


@query("""WITH w AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS hi, sum(n_chars) OVER () AS tot FROM documents),
u AS (SELECT i, ('0x' || substr(md5('11:' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM range(500) r(i))
SELECT i AS draw, doc_id FROM u JOIN w ON floor(u * tot) >= hi - n_chars AND floor(u * tot) < hi""")
def weighted_draw(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("weight"))
    return S.weighted_draws(docs, "doc_id", "weight", 500, seed=11).select("draw", "doc_id")


@query("""WITH o AS (SELECT * FROM (VALUES (0, 0), (1, 1), (2, 1), (3, 1), (4, 2)) t(place, source)), picks AS (SELECT i, source FROM range(600) r(i) JOIN o ON (i + 2) % 5 = place)
SELECT i AS draw, source AS in_source, ((i * 4 + 2) % (100 * (source + 1)) + CASE source WHEN 0 THEN 0 WHEN 1 THEN 100 ELSE 300 END)::BIGINT AS idx FROM picks""")
def weighted_round_robin(spark, d):
    return S.round_robin_draws(spark, sizes=[100, 200, 300], weights=[1, 3, 1], replicas=4, rank=2, n=600)


@query()
def two_stage_draw(spark, d):
    """numpy's generator, so there is no SQL form; pinned values are in the tests."""
    sizes = [r.n for r in table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy("source").collect()]
    return S.two_stage(spark, sizes, [1.0] * len(sizes), replicas=4, seed=0, epoch=0, n=200)


@query()
def permutation_draw(spark, d):
    """Rows of each source in a seeded order, source by weight; numpy's generator, so the tests hold its properties."""
    sizes = [r.n for r in table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy("source").collect()]
    return S.permutation_draws(spark, sizes, [1.0] * len(sizes), replicas=2, seed=0, epoch=0, n=2 * sum(sizes))


@query("""WITH h AS (SELECT source, doc_id, ('0x' || substr(md5('5:' || doc_id), 1, 8))::BIGINT AS h FROM documents) SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 AS pass_place FROM h""")
def source_permutation(spark, d):
    return S.per_source_permutation(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 5)


@query("SELECT user_id, min(event_id) AS first_at FROM events GROUP BY 1")
def first_appearance_unique(spark, d):
    return M.first_appearance(table(spark, d, "events"), "user_id", "event_id")


@query("""WITH c AS (SELECT lang, dense_rank() OVER (ORDER BY lang) - 1 AS target FROM (SELECT DISTINCT lang FROM documents)),
l AS (SELECT lang || '_' || doc_id || '.png' AS line FROM documents JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id))
SELECT 'root/' || split_part(line, '_', 1) || '/' || line AS path, target FROM l JOIN c ON lang = split_part(line, '_', 1)""")
def subset_scan(spark, d):
    """A list names the rows to keep; the labelled documents stand for it."""
    docs = table(spark, d, "documents")
    lines = docs.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id").select(F.concat(F.col("lang"), F.lit("_"), F.col("doc_id"), F.lit(".png")).alias("line"))
    named = lines.withColumn("lang", F.split("line", "_")[0])
    return M.encode(named, M.vocabulary(docs, ["lang"], "target"), ["lang"], "target").select(F.concat_ws("/", F.lit("root"), "lang", "line").alias("path"), "target")


@query("""WITH v AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents WHERE n_chars >= 500)
SELECT doc_id, doc_id AS use FROM v UNION ALL
SELECT d.doc_id, v.doc_id FROM (SELECT doc_id, ('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT AS h FROM documents WHERE n_chars < 500) d JOIN v ON v.place = d.h % v.n""")
def resample_rejects(spark, d):
    return M.refill(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", F.col("n_chars") >= 500).select("doc_id", "use")


@query("""SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, (row_number() OVER (ORDER BY doc_id) - 1) // 24 AS batch_id FROM documents QUALIFY batch_id < (SELECT count(*) // 24 FROM documents)""")
def batch_buckets(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    whole = F.broadcast(docs.agg(F.floor(F.count("*") / 24).alias("whole")))
    return global_index(docs, "doc_id").withColumn("batch_id", F.floor(F.col("idx") / 24)).crossJoin(whole).where("batch_id < whole").drop("whole")


@query("SELECT doc_id, i // 24 AS batch_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i // 24 >= 5")
def skip_batches(spark, d):
    return global_index(table(spark, d, "documents").select("doc_id"), "doc_id").withColumn("batch_id", F.floor(F.col("idx") / 24)).where("batch_id >= 5").drop("idx")


@query("""SELECT i AS itr, doc_id FROM (SELECT unnest(range(greatest(1500, count(*) + count(*) // 2))) AS i FROM documents) JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents) ON place = i % n""")
def cyclic_refill(spark, d):
    """Draws go round the documents: 1,500, or one and a half rounds where that is more, so that all are met and it wraps."""
    ids = table(spark, d, "documents").select("doc_id")
    docs, n = global_index(ids, "doc_id", "_place"), ids.count()
    draws = spark.range(max(1500, n + n // 2)).select(F.col("id").alias("itr"), (F.col("id") % max(n, 1)).alias("_place"))
    return draws.join(docs, "_place").select("itr", "doc_id")


@query("""SELECT doc_id, round(('0x' || substr(md5('3:0:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 1.5 + 0.25, 9) AS ahead FROM documents""")
def uniform_draws(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(uniform(3, 0, F.col("doc_id")) * 1.5 + 0.25, 9).alias("ahead"))


@query("""SELECT page_id, ['left', 'right', 'wrist'][1 + ('0x' || substr(md5('5:' || page_id), 1, 8))::BIGINT % 3] AS view FROM pages""")
def random_view(spark, d):
    views = F.array(F.lit("left"), F.lit("right"), F.lit("wrist"))
    return table(spark, d, "pages").select("page_id", F.get(views, (hash32(5, F.col("page_id")) % 3).cast("int")).alias("view"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT replace(replace('module.backbone.' || lang || '.module.w', 'module.', ''), 'backbone.', '') AS name, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def state_key_rename(spark, d):
    state = F.create_map(F.concat(F.lit("module.backbone."), F.col("lang"), F.lit(".module.w")), F.lit(1))
    renamed = F.transform_keys(state, lambda k, v: F.replace(F.replace(k, F.lit("module."), F.lit("")), F.lit("backbone."), F.lit("")))
    return table(spark, d, "documents").select(F.explode(F.map_keys(renamed)).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("""SELECT format('{:d},{:05d},{:.3f}', extract(day FROM ts)::INT, event_id, value) AS line FROM events""")
def csv_log_lines(spark, d):
    return table(spark, d, "events").select(F.format_string("%d,%05d,%.3f", F.dayofmonth("ts"), "event_id", "value").alias("line"))


@query("""SELECT s_suppkey, r_name AS camera, r_regionkey * 1.5::DOUBLE AS x, -1.0 * n_nationkey AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def extrinsics_by_camera(spark, d):
    """Each trajectory's extrinsics of the camera that its view names, out of those of all its cameras."""
    regions = table(spark, d, "region")
    cameras = F.broadcast(regions.agg(F.map_from_entries(F.collect_list(F.struct(F.concat("r_name", F.lit("_left")), F.col("r_regionkey") * 1.5))).alias("cameras")))  # one row
    nations = table(spark, d, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), "r_name")
    t = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(nations), "s_nationkey").crossJoin(cameras)
    all_ = F.transform_values("cameras", lambda k, v: F.array(v, -1.0 * F.col("s_nationkey")))
    found = t.select("s_suppkey", F.col("r_name").alias("camera"), M.of_camera(all_, F.col("r_name")).alias("e"))
    return found.select("s_suppkey", "camera", F.get("e", 0).alias("x"), F.get("e", 1).alias("y"))


@query("""SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5""")
def top_k_per_source(spark, d):
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, d, "documents").select("source", "doc_id", "n_chars").withColumn("place", place).where("place <= 5").drop("place")
