"""Queries through files: what a sink writes to the shared folder, a source reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import arrays, files, sinks
from .registry import query, table


@query("SELECT 'clips/' || doc_id || '.mp4' AS path, doc_id % 7 AS label FROM documents")
def delimited_manifest(spark, d):
    """A manifest of lines with a blank between path and label."""
    path = shared_folder(spark, "clips.csv")
    line = F.concat(F.lit("clips/"), F.col("doc_id").cast("string"), F.lit(".mp4 "), (F.col("doc_id") % 7).cast("string"))
    table(spark, d, "documents").select(line.alias("value")).write.text(path)
    return files.manifest(spark, path).select("path", F.col("label").cast("long").alias("label"))


@query("SELECT 'my clips/' || page_id || '.mp4' AS path, page_id % 5 AS label FROM pages")
def double_colon_manifest(spark, d):
    """Paths with blanks, which only the separator '::' can tell from the label."""
    path = shared_folder(spark, "clips.csv")
    line = F.concat(F.lit("my clips/"), F.col("page_id").cast("string"), F.lit(".mp4::"), (F.col("page_id") % 5).cast("string"))
    table(spark, d, "pages").select(line.alias("value")).write.text(path)
    return files.manifest(spark, path).select("path", F.col("label").cast("long").alias("label"))


_MIXED = "SELECT {s}::BIGINT AS source_id, row_number() OVER (ORDER BY {k}) - 1 AS local_id, '{s}/' || {k} AS path, round({w} / count(*) OVER (), 9) AS sample_weight FROM {t}"


@query(_MIXED.format(s=0, k="doc_id", w="1.0", t="documents") + " UNION ALL " + _MIXED.format(s=1, k="page_id", w="3.0", t="pages"))
def manifest_mixture(spark, d):
    """Two manifests in the order of their files, rows weighing their source's weight by its number of rows."""
    paths = [shared_folder(spark, "a.csv"), shared_folder(spark, "b.csv")]
    for s, (name, key) in enumerate((("documents", "doc_id"), ("pages", "page_id"))):
        rows = table(spark, d, name).select(key).orderBy(key)
        rows.select(F.concat(F.lit(f"{s}/"), F.col(key).cast("string"), F.lit(" 0")).alias("value")).write.text(paths[s])
    rows, _ = files.mixture(spark, paths, [1.0, 3.0])
    return rows.select(F.col("source_id").cast("long").alias("source_id"), F.col("local_id").cast("long").alias("local_id"), "path", F.round("sample_weight", 9).alias("sample_weight"))


@query("""SELECT 'P' || l_orderkey AS video_id, (l_linenumber * 10)::BIGINT AS start_frame, (l_linenumber * 10 + 9)::BIGINT AS stop_frame,
(l_partkey % 97)::BIGINT AS verb_class, (l_suppkey % 300)::BIGINT AS noun_class FROM lineitem""")
def annotation_csv(spark, d):
    """Annotations with a header, written and read by their schema."""
    path, key = shared_folder(spark, "annotations"), F.col("l_linenumber").cast("long")
    rows = table(spark, d, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_orderkey").cast("string")).alias("video_id"), (key * 10).alias("start_frame"), (key * 10 + 9).alias("stop_frame"),
        (F.col("l_partkey") % 97).alias("verb_class"), (F.col("l_suppkey") % 300).alias("noun_class"),
    )
    rows.write.option("header", "true").csv(path)
    return files.annotations(spark, path).select("video_id", *(F.col(c).cast("long").alias(c) for c in ("start_frame", "stop_frame", "verb_class", "noun_class")))


@query("""SELECT 'root/' || split_part(line, '_', 1) || '/' || line AS path, split_part(line, '_', 1) AS class_name
FROM (SELECT coalesce(source, 'none') || '_' || doc_id AS line FROM documents)""")
def subset_list(spark, d):
    """Lines <class>_<id>, whose class is what comes before the first '_'."""
    path = shared_folder(spark, "subset")
    line = F.concat_ws("_", F.coalesce("source", F.lit("none")), F.col("doc_id").cast("string"))
    table(spark, d, "documents").select(line.alias("value")).write.text(path)
    return files.subset(spark, path, "root")


@query("SELECT (n_nationkey)::BIGINT AS class_id, n_name AS label FROM nation")
def label_map_json(spark, d):
    """A JSON object of id -> label; a vocabulary of fixed size is one object."""
    path = shared_folder(spark, "labels")
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name")))
    table(spark, d, "nation").agg(F.to_json(pairs).alias("value")).coalesce(1).write.text(path)
    return arrays.label_map(spark, path).select(F.col("class_id").cast("long").alias("class_id"), "label")


@query("""SELECT 'epoch,n,most' AS line UNION ALL
SELECT printf('%d,%05d,%d', extract(day FROM ts)::BIGINT, count(*)::BIGINT, max(event_id)::BIGINT) FROM events GROUP BY extract(day FROM ts)""")
def typed_log(spark, d):
    """A log of a row per epoch: printf formats, one header."""
    path = shared_folder(spark, "log")
    epochs = table(spark, d, "events").groupBy(F.dayofmonth("ts").alias("epoch")).agg(F.count("*").alias("n"), F.max("event_id").alias("most"))
    sinks.typed_csv(epochs, path, [("%d", "epoch"), ("%05d", "n"), ("%d", "most")], order=["epoch"])
    return spark.read.text(path).withColumnRenamed("value", "line")


_ORDERS = "(SELECT o_orderkey % 2 AS rank, o_orderkey // 2 % 2 AS worker, o_orderkey AS step, o_orderstatus AS status FROM orders)"


@query(f"""SELECT rank::BIGINT AS rank, worker::BIGINT AS worker, step || ',"' || status || '"' AS line FROM {_ORDERS}
UNION ALL SELECT DISTINCT rank::BIGINT, worker::BIGINT, '"step","status"' FROM {_ORDERS}""")
def telemetry_log(spark, d):
    """Lines in a folder per rank and worker, strings quoted, a header in each."""
    path, key = shared_folder(spark, "telemetry"), F.col("o_orderkey")
    rows = table(spark, d, "orders").select((key % 2).alias("rank"), (F.floor(key / 2) % 2).alias("worker"), key.alias("step"), F.col("o_orderstatus").alias("status"))
    sinks.telemetry(rows, path, order="step", first=True)
    return spark.read.option("lineSep", "\r\n").text(path).select(F.col("rank").cast("long").alias("rank"), F.col("worker").cast("long").alias("worker"), F.col("value").alias("line"))


@query("SELECT s_suppkey, s_nationkey FROM supplier")
def snapshot_epochs(spark, d):
    """A table kept as the latest one and, every second epoch, under its epoch too."""
    path = shared_folder(spark, "snapshots")
    errors = sinks.snapshot(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), path, epoch=4, every=2)
    if errors:
        raise ValueError("; ".join(errors))
    return spark.read.parquet(f"{path}/e4")
