"""Queries on small tables that are larger than the bounds once written into them."""

import math

from reelspark.plans import catalogue


def _vectors(spark, path, n, label):
    rows = [(i, [((i * 7 + k) % 13) / 13 - 0.4 for k in range(64)], label(i)) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return rows


def test_grid_distance_of_every_sample(spark, tmp_path):
    # the third sample, 1024..1535, has no hidden token
    rows = _vectors(spark, tmp_path, 1700, lambda i: 5 if 1024 <= i < 1536 else i * i % 10)
    place = lambda i: (i // 64, i % 64 // 8, i % 8)
    hidden = [i for i, _, label in rows if label < 3]
    want = {}
    for i, _, label in rows:
        near = [math.dist(place(i), place(h)) for h in hidden if h // 512 == i // 512]
        if label >= 3 and near:
            want[i] = min(near)
    got = {r.token: r.dmin for r in catalogue.QUERIES["mask_min_distance"](spark, str(tmp_path)).collect()}
    assert got == {i: round(x, 6) for i, x in want.items()} and max(got) >= 1536
    loss = catalogue.QUERIES["distance_weighted_loss"](spark, str(tmp_path)).first()
    mean = sum(sum(map(abs, rows[i][1])) / 64 / x for i, x in want.items()) / len(want)
    assert loss.n == len(want) and abs(loss.loss - mean) < 2e-6


def test_mask_concat_of_every_vector(spark, tmp_path):
    rows = _vectors(spark, tmp_path, 700, lambda i: i % 10)
    got = {r.row_id: r for r in catalogue.QUERIES["mask_concat"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(1400))
    for row_id, r in got.items():
        e = rows[row_id % 700][1]
        assert (r.mask_id, r.vec_id) == divmod(row_id, 700)
        assert abs(r.total - (e[0] + e[2] if r.mask_id == 0 else e[7] + e[7])) < 1e-5


def test_windows_and_clips_of_long_documents(spark, tmp_path):
    sizes = {1: 0, 2: 511, 3: 512, 4: 999, 5: 1000, 6: 20_000, 7: 60_001}
    spark.createDataFrame(list(sizes.items()), "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalogue.QUERIES["udtf_windows"](spark, str(tmp_path)).collect())
    assert got == [(i, k, k + 511) for i, n in sizes.items() for k in range(0, n - 511, 256)]
    got = sorted(tuple(r) for r in catalogue.QUERIES["clip_plan_explode"](spark, str(tmp_path)).collect())
    assert got == [(i, c, n, int(2.5 * n / 16)) for i, n in sizes.items() for c in range(4)]


def test_refill_wraps_and_log_has_all(spark, tmp_path):
    spark.range(2000).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalogue.QUERIES["cyclic_refill"](spark, str(tmp_path)).collect())
    assert got == [(i, i % 2000) for i in range(3000)]
    spark.range(250).selectExpr("id AS event_id", "timestamp_ntz'2024-01-05 00:00:00' AS ts", "id / 8 AS value").write.parquet(f"{tmp_path}/events.parquet")
    lines = {r.line for r in catalogue.QUERIES["csv_log_lines"](spark, str(tmp_path)).collect()}
    assert len(lines) == 250 and "5,00249,31.125" in lines
