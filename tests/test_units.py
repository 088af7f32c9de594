"""Pinned values, numpy restatements and edge cases of the functions and operators."""

import datetime
import decimal
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.functions import arrays as A
from reelspark.functions import pixels as X
from reelspark.functions import poses as P
from reelspark.functions import randoms as U
from reelspark.functions import windows as W
from reelspark.operators import boxes, hooks, indexing, manifests, masks, metrics, policy, sampling
from reelspark.sources import arrays as SA
from reelspark.sources import files, sinks
from reelspark.streaming import streams


def test_concat_index():
    sizes = [10, 20, 30, 40]
    want = {0: (0, 0), 9: (0, 9), 10: (1, 0), 29: (1, 19), 30: (2, 0), 59: (2, 29), 60: (3, 0), 99: (3, 39)}
    assert {i: indexing.locate_one(sizes, i) for i in want} == want
    for i in (-1, 100):
        with pytest.raises(IndexError):
            indexing.locate_one(sizes, i)


def test_sampler_pinned_values(spark):
    sizes = [100, 200, 300]
    assert U.two_stage_draws(sizes, [1, 1, 1], 1, 0, 0, 0, 2) == [202, 26]
    assert U.two_stage_draws(sizes, [1, 2000, 1], 8, 3, 0, 0, 2) == [135, 143]
    assert U.two_stage_draws(sizes, [1, 10, 1], 4, 2, 0, 0, 2, shuffle=False) == [102, 106]
    got = [r.idx for r in sampling.round_robin_draws(spark, sizes, [1, 10, 1], 4, 2, 50).orderBy("draw").collect()]
    assert got == U.two_stage_draws(sizes, [1, 10, 1], 4, 2, 0, 0, 50, shuffle=False)
    with pytest.raises(ValueError):
        U.two_stage_draws(sizes, [0.5, 1, 1], 1, 0, 0, 0, 1, shuffle=False)


def test_shuffled_shards_cover(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    seen = [[r.k for r in sampling.shuffled_shard(rows, "k", 1, 2, rank, 4).collect()] for rank in range(4)]
    assert {len(s) for s in seen} == {3} and {k for s in seen for k in s} == set(range(10))
    cut = [r.k for rank in range(4) for r in sampling.shuffled_shard(rows, "k", 1, 2, rank, 4, drop_last=True).collect()]
    assert len(cut) == len(set(cut)) == 8


def clip_reference(n, frames, step, clips, overlap):
    span, part, out = frames * step, n // clips, []
    for i in range(clips):
        if part > span:
            at = np.clip(np.linspace(0, span, frames), 0, span - 1).astype(np.int64) + i * part
        elif not overlap:
            k = part // step
            at = np.concatenate([np.linspace(0, part, k), np.full(frames - k, part)])
            at = np.clip(at, 0, part - 1).astype(np.int64) + i * part
        else:
            reach = min(span, n) - 1
            k = reach // step
            at = np.concatenate([np.linspace(0, reach, k), np.full(frames - k, reach)])
            at = np.clip(at, 0, reach - 1).astype(np.int64) + (i * ((n - span) // (clips - 1)) if n > span and clips > 1 else 0)
        out.append(at.tolist())
    return out


@pytest.mark.parametrize("frames,step,clips,overlap", [(8, 4, 2, False), (16, 2, 3, True), (4, 7, 1, False), (16, 4, 8, True)])
def test_clip_indices(spark, frames, step, clips, overlap):
    lengths = [n for n in (16, 17, 33, 64, 100, 257, 777) if n // clips >= 1 and min(frames * step, n) > 1]
    df = spark.createDataFrame([(n,) for n in lengths], "n int").select("n", W.clip_indices(F.col("n"), frames, step, clips, overlap).alias("p"))
    assert {r.n: r.p for r in df.collect()} == {n: clip_reference(n, frames, step, clips, overlap) for n in lengths}


def test_clip_indices_too_short(spark):
    assert spark.range(1).select(W.clip_indices(F.lit(3), 8, 4, 8).alias("p")).first().p is None


def test_anticipation_window(spark):
    r = spark.range(1).select(W.anticipation_indices(F.lit(10), F.lit(30.0), 8.0, 8).alias("p"), W.anticipation_indices(F.lit(10), F.lit(4.0), 8.0, 8).alias("q")).first()
    assert r.p == [max(0, 10 - 24 + 3 * i) for i in range(8)] and r.q is None


def test_rotations(spark):
    rng = np.random.default_rng(0)
    angles = [[*rng.uniform(-3.1, 3.1, 1), *rng.uniform(-1.5, 1.5, 1), *rng.uniform(-3.1, 3.1, 1)] for _ in range(50)] + [[0.3, math.pi / 2, 0.0], [0.3, -math.pi / 2, 0.0]]
    df = spark.createDataFrame([tuple(map(float, a)) for a in angles], "a double, b double, c double")
    back = df.select("a", "b", "c", *(v.alias(n) for v, n in zip(P.euler(P.rotation(F.col("a"), F.col("b"), F.col("c"))), "xyz", strict=True)))
    for r in back.collect():
        assert np.allclose([r.a, r.b, r.c], [r.x, r.y, r.z], atol=1e-6)


def test_pose_round_trip(spark):
    start, end = ([F.lit(float(v)) for v in p] for p in ([1, 2, 3, 0.1, 0.2, 0.3, 0.5], [2, 1, 0, -0.4, 0.6, 1.1, 0.9]))
    r = spark.range(1).select(*(v.alias(f"v{i}") for i, v in enumerate(P.compose(start, P.difference(start, end))))).first()
    assert np.allclose(list(r), [2, 1, 0, -0.4, 0.6, 1.1, 0.9])


def test_arrays(spark):
    e = F.array(*(F.lit(float(x)) for x in (3, 1, 2, 2)))
    flat = F.array(F.lit(1.0), F.lit(1.0))
    r = spark.range(1).select(A.argsort(e).alias("a"), A.layer_norm(flat).alias("z"), A.softmax(e).alias("s"), A.complement(F.array(F.lit(1), F.lit(3)), 5).alias("c"), A.gather(e, F.array(F.lit(2), F.lit(0), F.lit(2))).alias("g"), A.slide(e, e, 3).alias("w"), A.circulant_pad(e, F.lit(6)).alias("p")).first()
    assert r.a == [1, 2, 3, 0] and r.z == [0.0, 0.0] and abs(sum(r.s) - 1) < 1e-12 and r.c == [0, 2, 4] and r.g == [2.0, 3.0, 2.0] and r.w == [1.0, 2.0, 2.0] and r.p == [3.0, 1.0, 2.0, 2.0, 3.0, 1.0]


def test_probit_and_truncated_normal(spark):
    r = spark.range(2000).select(U.truncated_normal(0.0, 1.0, -2.0, 2.0, 1, F.col("id")).alias("x")).toPandas().x
    assert r.between(-2, 2).all() and abs(r.mean()) < 0.08 and abs(r.std() - 0.88) < 0.05
    p = spark.range(1).select(U.probit(F.lit(0.975)).alias("a"), U.probit(F.lit(0.01)).alias("b")).first()
    assert abs(p.a - 1.959964) < 1e-5 and abs(p.b + 2.326348) < 1e-5


def test_seeds_are_64_bit():
    s = U.lcg_seeds(1, 2, 3, 4)
    assert len(set(s)) == 4 and all(0 <= x < 1 << 32 for x in s)


def test_indexing_with_ties_and_empty(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "k int, v int")
    rows = indexing.global_index(df, "v", ties=["k"]).collect()
    assert sorted(r.idx for r in rows) == list(range(50)) and [r.v for r in sorted(rows, key=lambda r: r.idx)] == sorted(r.v for r in rows)
    assert indexing.global_index(df.where("k < 0"), "k").count() == 0


def test_manifest_operators(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "c string, i int")
    words = manifests.vocabulary(df.where("c = 'a'"), ["c"])
    with pytest.raises(Exception, match="class id"):
        manifests.encode(df, words, ["c"]).collect()
    assert manifests.encode(df, words, ["c"], strict=False).count() == 2
    filled = manifests.refill(df, "i", F.col("c") == "a").collect()
    assert {r.i for r in filled} == {1, 2, 3, 4} and {r.use for r in filled} <= {1, 3}


def test_masks_invariants(spark):
    rows = spark.range(40).select(F.col("id").alias("k"), (F.col("id") % 4).alias("b"))
    cfg = masks.MaskConfig(blocks=8, max_keep=40)
    made = masks.make_masks(rows, "k", "b", 2, 8, 8, cfg, seed=3).collect()
    for b in range(4):
        own = [r for r in made if r.b == b]
        assert len({len(r.context) for r in own}) == 1 == len({len(r.target) for r in own}) and len(own[0].context) <= 40
    for r in made:
        assert not set(r.context) & set(r.target) and r.context == sorted(r.context)
    swapped = masks.make_masks(rows, "k", "b", 2, 8, 8, masks.MaskConfig(inverse=True), seed=3).collect()
    plain = masks.make_masks(rows, "k", "b", 2, 8, 8, masks.MaskConfig(), seed=3).collect()
    assert {(r.k, tuple(r.context)) for r in swapped} == {(r.k, tuple(r.target)) for r in plain}


def test_recall_with_ties_and_absent_classes(spark):
    df = spark.createDataFrame([([1.0, 1.0, 0.0], 1), ([0.0, 0.0, 1.0], 2), ([1.0, 0.0, 0.0], 2)], "s array<double>, l int")
    r = metrics.class_mean_recall(df, F.col("s"), F.col("l"), k=1).first()
    assert r.classes == 2 and abs(r.accuracy - 100 / 3) < 1e-6 and abs(r.recall - 25.0) < 1e-5


def test_islands_and_histogram_edges(spark):
    df = spark.createDataFrame([(1, x) for x in (0, 1, 2, 2, 5)] + [(2, 9)], "g int, x long")
    assert {r.g: r.ranges for r in metrics.islands(df, "x", "g").collect()} == {1: "0-2,5", 2: "9"}
    pts = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (1.5, 0.0)], "x double, y double")
    assert {(r.bx, r.by) for r in metrics.histogram_2d(pts, "x", "y", F.lit(1.0), 4, (0.0, 1.0), (0.0, 1.0)).collect()} == {(0, 0), (3, 3)}


def test_policy_grammar():
    assert policy.parse("rand-m7-n4-mstd0.5-inc1") == {"m": 7.0, "n": 4.0, "mstd": 0.5, "w": -1.0, "inc": 1.0}
    assert policy.parse("rand-m9-inc0-zz3")["inc"] == 1.0
    with pytest.raises(ValueError):
        policy.parse("other-m1")


def test_pixels():
    rng = np.random.default_rng(0)
    clip = rng.integers(0, 255, (4, 20, 26, 3), dtype=np.uint8)
    assert np.allclose(X.normalize(X.to_tensor(clip)), X.normalize_bytes(clip), atol=1e-4)
    assert X.crop(clip, 2, 3, 8, 9).shape == (4, 8, 9, 3) and (X.flip(X.flip(clip)) == clip).all()
    assert X.resize_short(clip, 10).shape == (4, 10, 13, 3) and np.allclose(X.resize(clip, 20, 26), clip)
    assert (X.frame_pad(clip, 6)[4:] == clip[:2]).all()
    for op in X.POLICY_OPS:
        assert X.policy_op(clip, op, 0.5).shape == clip.shape
    assert (X.policy_op(clip, "Invert", 0) == 255 - clip).all() and (X.policy_op(clip, "Posterize", 8) == clip).all() and (X.policy_op(clip, "Rotate", 0) == clip).all()
    erased = X.erase(clip, 1, 1, 3, 3, "const", rng)
    assert (erased[:, 1:4, 1:4] == 0).all() and (erased[:, 5:] == clip[:, 5:]).all()
    x = rng.standard_normal((5, 8))
    for pairs in (True, False):
        assert np.allclose(X.rotary(x, np.zeros(5), pairs), x)
    assert np.allclose(np.linalg.norm(X.rotary(x, np.arange(5.0), True), axis=1), np.linalg.norm(x, axis=1))


def test_pixel_function_on_rows(spark):
    clip = np.arange(2 * 4 * 4 * 3, dtype=np.uint8).reshape(2, 4, 4, 3)
    df = spark.createDataFrame([(clip.tobytes(), [2, 4, 4, 3]), (None, None)], "data binary, shape array<int>")
    r = df.select(X.apply_to_clips(X.to_tensor)("data", "shape").alias("o")).collect()
    assert r[0].o.shape == [3, 2, 4, 4] and r[1].o.data is None


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x/1.mp4 3\nx/2.mp4 4\n")
    (tmp_path / "b.csv").write_text("y y/1.mp4::7\n")
    np.save(tmp_path / "c.npy", np.array(["p", "q"]))
    rows, sizes = files.mixture(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.npy")], [1.0, 2.0, 4.0])
    got = sorted((r.source_id, r.local_id, r.path, r.label, r.sample_weight) for r in rows.collect())
    assert got == [(0, 0, "x/1.mp4", 3, 0.5), (0, 1, "x/2.mp4", 4, 0.5), (1, 0, "y y/1.mp4", 7, 2.0), (2, 0, "p", 0, 2.0), (2, 1, "q", 0, 2.0)]
    assert [(r.lo, r.hi) for r in sizes.orderBy("source_id").collect()] == [(0, 2), (2, 3), (3, 5)]
    with pytest.raises(ValueError):
        files.manifest(spark, "z.bin")
    with pytest.raises(KeyError):
        files.SOURCES.make("nothing")


def test_trajectories_and_folders(spark, tmp_path):
    d = tmp_path / "t" / "run1"
    d.mkdir(parents=True)
    (d / "a.json").write_text("{broken")
    (d / "b.json").write_text(json.dumps({"camera": "left"}))
    np.savez(d / "trajectory.npz", states=np.ones((3, 6)), gripper=np.zeros(3), extrinsics=np.zeros((3, 6)))
    SA.register(spark)
    rows = spark.read.format("trajectory").load(str(tmp_path / "t")).orderBy("t").collect()
    assert [r.t for r in rows] == [0, 1, 2] and len(rows[0].state) == 7 and json.loads(rows[0].meta) == {"camera": "left"}
    assert SA.json_sidecars(spark, str(d / "*.json"), "camera string").first().camera == "left"
    for c in ("b", "a"):
        (tmp_path / "img" / c).mkdir(parents=True)
        (tmp_path / "img" / c / "1.png").write_bytes(b"x")
    assert sorted((r.class_name, r.target) for r in SA.class_folders(spark, str(tmp_path / "img")).collect()) == [("a", 0), ("b", 1)]
    (tmp_path / "labels.json").write_text('{"0": "zero", "1": "one"}')
    assert {r.class_id: r.label for r in SA.label_map(spark, str(tmp_path / "labels.json")).collect()} == {0: "zero", 1: "one"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 0.51239)], "epoch int, itr int, loss double")
    sinks.typed_csv(df, str(tmp_path / "log"), [("%d", "epoch"), ("%05d", "itr"), ("%.3f", "loss")])
    more = spark.createDataFrame([(2, k, 0.25 * k) for k in range(50, 0, -1)], "epoch int, itr int, loss double").repartition(7)
    sinks.typed_csv(more, str(tmp_path / "log"), [("%d", "epoch"), ("%05d", "itr"), ("%.3f", "loss")], ["epoch", "itr"])
    first, second = sorted((p.read_text() for p in (tmp_path / "log").glob("*.csv")), key=len)
    assert first == "epoch,itr,loss\n1,00002,0.512\n"
    assert second.split("\n") == [*(f"2,{k:05d},{0.25 * k:.3f}" for k in range(1, 51)), ""]
    sinks.options(spark, str(tmp_path / "options"), {"a": {"b": [1, 2]}})
    assert files.load_options(spark.read.text(str(tmp_path / "options")).first()[0]) == {"a": {"b": [1, 2]}}
    assert sinks.snapshot(df, str(tmp_path / "snap"), 4, 2) == [] and (tmp_path / "snap" / "e4").exists()
    assert sinks.fresh_folder("run", True, False, datetime.datetime(2024, 1, 2, 3, 4, 5)) == "run_24_01_02_03_04_05"


def test_telemetry_files(spark, tmp_path):
    import csv
    import io

    rows = [(r, w, float(t), f'a "{t}", b' if t else None, t) for r in range(2) for w in range(2) for t in range(5)]
    kind = "rank int, worker int, timestamp double, name string, n int"
    for first, part in ((True, rows[::-1]), (True, rows[::-1]), (False, [(0, 1, 9.0, "z", 9)])):
        sinks.telemetry(spark.createDataFrame(part, kind).repartition(3), str(tmp_path / "t"), first=first)
    for r in range(2):
        for w in range(2):
            texts = sorted((p.read_bytes().decode() for p in (tmp_path / "t" / f"rank={r}" / f"worker={w}").glob("part-*")), key=len, reverse=True)
            buffer = io.StringIO()
            out = csv.writer(buffer, quoting=csv.QUOTE_NONNUMERIC)
            out.writerows([["timestamp", "name", "n"], *(x[2:] for x in rows if x[:2] == (r, w))])
            assert texts == [buffer.getvalue(), *(['9.0,"z",9\r\n'] if (r, w) == (0, 1) else [])]


def test_index_of_many_rows_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(indexing, "RANGE_ROWS", 50)
    monkeypatch.setattr(indexing, "RANGES", 64)
    rows = [(7 if i % 3 else i * 13 % 401, i * 7919 % 3000) for i in range(3000)] + [(None, -1)]
    df = spark.createDataFrame(rows, "k int, t int").repartition(5)
    got = {(r.k, r.t): r.idx for r in indexing.global_index(df, "k", ties=["t"]).collect()}
    assert [x for x, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])) and sorted(got.values()) == list(range(3001))
    sizes = [r["count"] for r in indexing._ranged(df, F.col("k"), ["t"]).groupBy("_range").count().collect()]
    assert max(sizes) < 250
    weighted = spark.createDataFrame([(i, i % 4) for i in range(400)], "k int, w int")
    sums, want = 0, {}
    for i in range(400):
        for _ in range(i % 4):
            want[sums] = i
            sums += 1
    drawn = sampling.weighted_draws(weighted, "k", "w", 5000, 3).withColumn("at", F.floor(U.uniform(3, F.col("draw")) * sums)).collect()
    assert len(drawn) == 5000 and all(r.k == want[r.at] for r in drawn)
    assert sampling.weighted_draws(weighted.where("w = 0"), "k", "w", 5, 3).count() == 0


def test_round_robin_across_sources(spark):
    """Counted by hand: the draw's number steps on through all sources."""
    got = [(r.in_source, r.idx) for r in sampling.round_robin_draws(spark, [100, 200, 300], [1, 2, 1], 4, 2, 7).orderBy("draw").collect()]
    assert got == [(1, 102), (2, 306), (0, 10), (1, 114), (1, 118), (2, 322), (0, 26)]


def test_permutation_draws(spark):
    got = sampling.permutation_draws(spark, [40, 60], [1, 3], 2, 0, 0, 200).collect()
    for rank in range(2):
        mine = sorted((r.draw, r.in_source, r.idx) for r in got if r.rank == rank)
        assert len(mine) == 200
        for source, size, offset in ((0, 40, 0), (1, 60, 40)):
            seen = [i for _, s, i in mine if s == source]
            own = set(range(offset + rank, offset + size, 2))
            assert len(seen) > len(own) and set(seen[: len(own)]) == own and len(set(seen[len(own) : 2 * len(own)])) == len(seen[len(own) : 2 * len(own)])


def test_mixture_follows_the_files(spark, tmp_path):
    for name, lo, hi in (("a", 0, 3), ("b", 3, 900), ("c", 900, 905)):
        (tmp_path / "m.csv").mkdir(exist_ok=True)
        (tmp_path / "m.csv" / f"{name}.csv").write_text("".join(f"clip{i} {i}\n" for i in range(lo, hi)))
    rows, sizes = files.mixture(spark, [str(tmp_path / "m.csv"), str(tmp_path / "m.csv" / "c.csv")], [1.0, 2.0])
    got = {(r.source_id, r.local_id): r.label for r in rows.collect()}
    assert got == {(0, i): i for i in range(905)} | {(1, i): 900 + i for i in range(5)} and [r.n for r in sizes.orderBy("source_id").collect()] == [905, 5]


def test_recall_merges(spark):
    rows = [(i, [((i * 7 + c * 5) % 11) / 11 for c in range(6)], i % 4) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, s array<double>, y int")
    m = metrics.Recall(2)
    parts = [m.of(df.where(f"i % 3 = {k}"), F.col("s"), F.col("y")) for k in range(3)]
    state = m.update(m.merge(m.zero(spark), *parts[:2]), df.where("i % 3 = 2"), F.col("s"), F.col("y"))
    whole = metrics.class_mean_recall(df, F.col("s"), F.col("y"), 2, eps=0.0).first()
    got = m.value(state).first()
    assert abs(got.recall - whole.recall) < 1e-9 and got.accuracy == whole.accuracy and got.classes == 4


def test_erase_plans(spark):
    clip = spark.range(40).withColumns({"h": F.lit(100), "w": F.lit(80)})
    plan = lambda **o: boxes.erase_plan(F.col("h"), F.col("w"), 8, (0.02, 0.3), 0.3, 1, F.col("id"), **o)
    got = clip.select(plan().alias("a"), plan(cube=False, count=2).alias("b"), plan(splits=4).alias("c"), plan(probability=0.0).alias("d")).collect()
    for r in got:
        assert {x.frame for x in r.a} == set(range(8)) and len({x[1:] for x in r.a}) == 1 and len(r.b) <= 16 and len({x[1:] for x in r.b}) > 2
        assert [x.frame for x in r.c] == list(range(2, 8)) and r.d == []
        assert all(x.h < 100 and x.w < 80 and 0 <= x.i <= 100 - x.h and 0 <= x.j <= 80 - x.w and x.h * x.w <= 0.31 * 8000 for x in r.a + r.b)


def test_flat_map_schemas(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    made = hooks.flat_map(df, lambda r: [{"x": decimal.Decimal(r["a"]), "y": {"p": r["a"], "q": "z"}}], "x decimal(10, 2), y struct<p: int, q: string>")
    assert sorted((r.x, r.y.p, r.error) for r in made.collect()) == [(1, 1, None), (2, 2, None)]


def test_camera_without_extrinsics(spark):
    df = spark.createDataFrame([("a", {"a_left": [1.0]})], "c string, m map<string,array<double>>")
    assert df.select(manifests.of_camera(F.col("m"), F.col("c"))).first()[0] == [1.0]
    with pytest.raises(Exception, match="no extrinsics of camera b"):
        df.select(manifests.of_camera(F.col("m"), F.lit("b"))).collect()


def test_options_and_retries():
    assert files.load_options('{"a": {"b": 1}}', {"a.c": 2}) == {"a": {"b": 1, "c": 2}}
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert files.with_retries(flaky, 3, lambda s: None) == "ok"
    with pytest.raises(ZeroDivisionError):
        files.with_retries(lambda: 1 / 0, 2, lambda s: None)


def test_trailing_filter():
    f = streams.TrailingFilter(n=4, k=1.0, most=1)
    trail, rejected, seen = [], 0, []
    for v in (1.0, 1.0, 2.0, 50.0, 1.0):
        ok, rejected = f.step(trail, rejected, v)
        seen.append(ok)
    assert seen == [True, True, True, False, True] and 50.0 not in trail
    with pytest.raises(ValueError):
        f.step(trail, rejected, 99.0)


def test_trailing_filter_stream_is_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts", "event_id", "value")
    f = streams.TrailingFilter(n=30, k=1.0, abort=False)
    batch = {(r.user_id, r.event_id, r.accepted) for r in f.batch(src, "user_id", ["ts", "event_id"], "value", "event_id").collect()}
    src.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    out = streams.drain(f.stream(live, "user_id", ["ts", "event_id"], "value", "event_id"), "filtered", str(tmp_path / "cp"))
    assert {tuple(r) for r in out.collect()} == batch


def test_telemetry_windows(spark):
    df = spark.createDataFrame([(float(t), 50.0, t, 2) for t in range(0, 25)], "timestamp double, cpu_percent double, read_bytes long, num_threads int")
    assert sorted(r.n for r in streams.telemetry_windows(df).collect()) == [5, 10, 10]


def test_count_batches(spark):
    df = spark.range(10)
    assert streams.count_batches(df, "id", 4).groupBy("batch_id").count().count() == 3
    assert streams.count_batches(df, "id", 4, drop_last=True).count() == 8


def test_read_clips(spark):
    from reelspark.operators import hooks

    def decoder(path):
        if path == "broken":
            raise OSError("cannot open")
        return 10, lambda frames: np.array([[[[f]]] for f in frames], dtype=np.uint8)

    plan = spark.createDataFrame([("a", 0, [0, 2]), ("a", 1, [9, 10]), ("broken", 0, [0]), ("b", 5, [])], "path string, clip_id long, frames array<long>")
    got = {(r.path, r.clip_id): r for r in hooks.read_clips(plan, decoder).collect()}
    assert got["a", 0].shape == [2, 1, 1, 1] and bytes(got["a", 0].data) == b"\x00\x02" and got["a", 0].error is None
    assert "IndexError" in got["a", 1].error and "cannot open" in got["broken", 0].error and got["b", 5].data is None


def test_models_and_guards(spark):
    from reelspark.operators import hooks

    with pytest.raises(KeyError):
        hooks.score("none")
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "x array<double>")
    assert [r[0] for r in df.select(hooks.score("identity")("x")).collect()] == [[1.0, 2.0], None]
    with pytest.raises(Exception, match="NaN"):
        spark.range(1).select(hooks.no_nan(F.lit(float("nan")))).collect()


def test_clip_pipelines():
    clip = np.random.default_rng(1).integers(0, 255, (4, 30, 40, 3), dtype=np.uint8)
    out = X.train_clip(clip, {"ops": [("Invert", 0)], "box": (2, 3, 20, 20), "flip": True, "erase": (0, 0, 4, 4), "frames": 6}, 16)
    assert out.shape == (3, 6, 16, 16) and (out[:, :, :4, :4] == 0).all()
    views = X.eval_views(clip, 24, 3)
    assert len(views) == 3 and all(v.shape == (3, 4, 24, 24) for v in views) and not np.allclose(views[0], views[2])
    assert X.compose(X.flip, X.flip)(clip).tobytes() == clip.tobytes() and X.to_tensor_signed(clip).min() >= -1
    assert X.resize_positions(np.ones((16, 8)), (4, 4), (6, 6)).shape == (36, 8)


def test_hue():
    import colorsys

    clip = np.random.default_rng(1).integers(0, 256, (1, 5, 5, 3))
    clip[0, 0] = 77
    for turn in (0.0, 0.1, -0.3, 0.5):
        out = X.adjust_hue(clip, turn)
        for p, q in zip(clip.reshape(-1, 3), out.reshape(-1, 3), strict=True):
            h, s, v = colorsys.rgb_to_hsv(*(p / 255))
            assert np.allclose(np.array(colorsys.hsv_to_rgb((h + turn) % 1, s, v)) * 255, q, atol=0.01)
    same = X.color_jitter(clip, ["hue", "brightness"], {"hue": 0.2})
    assert np.allclose(same, X.adjust_hue(clip, 0.2))


def test_geometric_fill():
    clip = np.arange(2 * 3 * 3 * 1, dtype=np.uint8).reshape(2, 3, 3, 1)
    assert (X.affine(clip, move_x=1)[:, :, -1] == X.FILL).all()
    assert (X.affine(clip, move_x=1, fill=0)[:, :, -1] == 0).all()
    assert (X.rotate(clip, 90, bilinear=True) == X.rotate(clip, 90)).all()
    half = X.affine(clip.astype(float), move_x=0.5, bilinear=True)
    assert np.allclose(half[:, :, :2], (clip[:, :, :2].astype(float) + clip[:, :, 1:]) / 2)


def test_clip_transforms_and_collator(spark):
    plan = spark.createDataFrame([("a", 1, [0, 1, 2, 3]), ("a", 2, [40, 41, 42, 43]), ("a", 3, [98, 99, 100, 101]), ("b", 4, [0, 1])], "path string, clip_id int, frames array<int>")

    def decoder(path):
        if path == "b":
            raise OSError("broken")
        return 100, lambda at: np.array(at, np.uint8).reshape(-1, 1, 1, 1)

    made = hooks.read_clips(plan, decoder, shared_transform=lambda x: x[::-1], transform=lambda x: x + 100, clips=2, stretch=32)
    got = {(r.clip_id, r.part): r for r in made.collect()}
    assert list(got[1, 0].data) == [103, 102] and list(got[1, 1].data) == [101, 100] and list(got[2, 0].data) == [143, 142]
    assert got[1, 0].shape == [2, 1, 1, 1] and "frames outside" in got[3, 0].error and "broken" in got[4, 0].error and len(got) == 6

    rows = spark.createDataFrame([(0, 2, 5.0), (0, 1, 4.0), (1, 3, 7.0)], "batch int, id int, x double")
    out = hooks.collated(rows, "batch", "id", ["x"], lambda p: {"xs": p["x"].tolist(), "n": len(p)}, "xs array<double>, n long")
    assert sorted(map(tuple, out.collect())) == [(0, [4.0, 5.0], 2), (1, [7.0], 1)]


def test_resize_positions():
    ramp = np.stack(np.meshgrid(np.arange(4), np.arange(6), np.arange(6), indexing="ij"), axis=-1).reshape(-1, 3).astype(float)
    out = X.resize_positions(ramp, (4, 6, 6), (8, 3, 12)).reshape(8, 3, 12, 3)
    assert np.allclose(out[:, 0, 0, 0], [0, 0.25, 0.75, 1.25, 1.75, 2.25, 2.75, 3]) and np.allclose(out[0, :, 0, 1], [0.5, 2.5, 4.5])
    assert np.allclose(X.resize_positions(ramp, (4, 6, 6), (4, 6, 6)), ramp)
    flat = np.full((16, 2), 3.0)
    assert np.allclose(X.resize_positions(flat, (4, 4), (7, 7), cubic=True), 3.0)
    line = np.repeat(np.arange(8.0), 8)[:, None]
    inner = X.resize_positions(line, (8, 8), (16, 16), cubic=True).reshape(16, 16)[4:12, 8]
    assert np.allclose(inner, np.arange(4, 12) / 2 - 0.25, atol=0.05)  # this kernel bends a ramp slightly
    assert np.allclose(X.resize_positions(line, (8, 8), (8, 8), cubic=True), line)
