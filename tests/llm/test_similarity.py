"""Embeddings, near copies, decontamination, language and the pipeline against brute force."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from reelspark.llm import components, op3_embeddings, op4_decontaminate, op5_language, op6_minhash, op8_mix

from . import fixtures as X


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    nodes = sorted({x for p in pairs if None not in p and p[0] != p[1] for x in p})
    u = X.Union(len(nodes))
    for a, b in pairs:
        if a is not None and a != b:
            u.join(nodes.index(a), nodes.index(b))
    assert got == {n: nodes[u.find(i)] for i, n in enumerate(nodes)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tiles_meet_once(spark):
    rows = spark.createDataFrame([(k, i, n) for k, n in ((1, 5), (2, 1), (3, 23)) for i in range(n)], "k int, m long, n long")
    met = collections.Counter()
    groups = collections.defaultdict(list)
    for r in components.tiled(rows, ["k"], "n", "m", tile=4).collect():
        groups[r.k, r.tile_i, r.tile_j].append((r.m, r.side))
    for (k, i, j), members in groups.items():
        for x in range(len(members)):
            for y in range(x + 1, len(members)):
                if i == j or members[x][1] != members[y][1]:
                    met[k, *sorted((members[x][0], members[y][0]))] += 1
    assert met == collections.Counter((k, a, b) for k, n in ((1, 5), (3, 23)) for a in range(n) for b in range(a + 1, n))


def brute_vectors(rows: list[tuple]) -> collections.Counter:
    sound = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    n, u = len(rows), X.Union(len(rows))
    ids = [(i is None, i) for i, _ in rows]
    order = sorted(range(n), key=lambda k: (ids[k][0], ids[k][1] or 0))
    links = [0] * n
    for p in range(n):
        for q in range(n):
            a, b = order[p], order[q]
            if p != q and sound[a] and sound[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                    links[a] += 1
                    u.join(p, q)
    place = {k: p for p, k in enumerate(order)}
    out = collections.Counter()
    for k, (i, _) in enumerate(rows):
        c = rows[order[u.find(place[k])]][0] if sound[k] else i
        out[i, links[k], c, i == c if i is not None else True] += 1
    return out


def test_embeddings(spark, tmp_path):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 5] + 0.08 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(60)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (201, rows[0][1]), (202, None), (203, []), (204, [0.0] * 16), (205, [float("nan")] * 16), (206, [1.0, None] + [0.0] * 14), (207, [float("inf")] * 16), (208, [1.0] * 8), (209, [1.0] * 8), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, n_links string")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert collections.Counter(tuple(r) for r in op3_embeddings.op3_embedding_dedup(spark, str(tmp_path)).collect()) == brute_vectors(rows)


def test_sketches_keep_linked_vectors():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 48))
    y = rng.standard_normal((3000, 48))
    y -= (x * y).sum(1, keepdims=True) / (x * x).sum(1, keepdims=True) * x
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    z = 0.95 * x + np.sqrt(1 - 0.95**2) * y  # at the threshold
    planes = rng.standard_normal((48, op3_embeddings.SKETCH))
    assert ((x @ planes > 0) != (z @ planes > 0)).sum(1).max() <= op3_embeddings.most_apart(0.95) < 0.25 * op3_embeddings.SKETCH


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def brute_near(rows: list[tuple], n: int) -> collections.Counter:
    sets = [shingles(t, n) for _, t, *_ in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    u = X.Union(len(rows))
    for p in range(len(order)):
        for q in range(p):
            a, b = sets[order[p]], sets[order[q]]
            if a and b and rows[order[p]][0] is not None and rows[order[q]][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                u.join(p, q)
    out = collections.Counter()
    for p, k in enumerate(order):
        i = rows[k][0]
        c = rows[order[u.find(p)]][0] if i is not None else None
        out[i, len(sets[k]), c, i is None or i == c] += 1
    return out


def near_rows():
    r = random.Random(4)
    rows = X.texts()
    for g in range(6):
        words = X.prose((12, 25, 60, 120, 300, 800)[g], 500 + g).split()
        for i in range(25):
            w = list(words)
            for _ in range(r.randint(0, max(1, len(w) // 14))):
                w[r.randrange(len(w))] = f"new{r.randint(0, 9)}"
            rows.append((1000 + 100 * g + i, " ".join(w), "en", "a"))
    return rows


@pytest.mark.parametrize("hot", [op6_minhash.HOT_CLASSES, 40, 0])
def test_near_copies(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(op6_minhash, "HOT_CLASSES", hot)
    rows = near_rows() + [(3000 + i, "copied " + X.prose(40, 9), "en", "a") for i in range(60)] + [(None, "copied " + X.prose(40, 9), "en", "a")] * 20
    got = collections.Counter(tuple(r) for r in op6_minhash.op6_minhash_dedup(spark, X.write(spark, tmp_path, rows)).collect())
    assert got == brute_near(rows, 2)


def test_estimate_is_close():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2))
    errors = []
    for share in (0.3, 0.6, 0.8, 0.95):
        keep = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[:keep]], rng.integers(0, 1 << 63, len(a) - keep, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
        x, y = op6_minhash.registers([a, b])
        errors.append(abs(op6_minhash._estimate((x == y).mean()) - share))
    assert max(errors) < 0.15 and op6_minhash.miss_chance(0.8) < 1e-7


def test_intersections_agree():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, 100).astype(np.uint64)) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    assert op6_minhash._intersections(sets, i, j).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]


def words(text):
    return (text or "").encode().lower().split()


def brute_leaks(docs, items):
    """Best (overlap, matched, first word) of each (doc_id, item_id), over all ways to lay an item on a text."""
    best = {}
    for i, t, *_ in docs:
        d = words(t)
        for item, text in items:
            b = words(text)
            n = min(13, len(b))
            for shift in range(-len(b), len(d)) if b and set(b) & set(d) else ():
                same = [0 <= shift + k < len(d) and d[shift + k] == b[k] for k in range(len(b))]
                if sum(same) < 0.8 * n:
                    continue
                for s in range(len(b) - n + 1):
                    top = sum(same[s : s + n])
                    if top >= 0.8 * n:
                        best[i, item] = max(best.get((i, item), (0, 0, 0)), (top / n, top, -(shift + s)))
    return {k: (x, m, -back) for k, (x, m, back) in best.items()}


def found_leaks(spark, d):
    return {(r.doc_id, r.item_id): (r.overlap, r.matched, r.doc_start) for r in op4_decontaminate.op4_decontaminate(spark, d).collect()}


def test_leaks(spark, tmp_path):
    r = random.Random(8)
    items = [(i, X.prose(n, 700 + i, 3000)) for i, n in enumerate((30, 45, 20, 14, 5, 4, 13))] + [(98, None), (99, ""), (None, X.prose(16, 790, 3000))]
    rows = [x for x in X.texts() if x[0] != 1]
    for k in range(30):
        item = words(items[k % 5][1])
        w = [x.decode() for x in item]
        for at in r.sample(range(len(w)), len(w) // 8):
            w[at] = "swapped"
        lo = r.randint(0, len(w) // 4)
        rows.append((2000 + k, X.prose(r.randint(0, 40), 800 + k) + " " + " ".join(w[lo:]) + "  " + X.prose(r.randint(0, 40), 900 + k).upper(), "en", "a"))
    rows += [(2100, items[-1][1], "en", "a"), (None, "so " + items[0][1], "en", "a")]
    d = X.write(spark, tmp_path, rows, benchmark=spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, hashes string"))
    want = brute_leaks(rows, items)
    assert found_leaks(spark, d) == want and len(want) > 25 and (2100, None) in want and (None, 0) in want


def test_leaks_of_all_lengths_and_places(spark, tmp_path, monkeypatch):
    """Items of 1 to 40 words, each with as many words replaced as 0.8 allows, at random places and at all of the worst ones."""
    monkeypatch.setattr(op4_decontaminate, "PIECE", 16)
    r = random.Random(3)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 41)]
    rows = []
    for n, text in items:
        size = min(13, n)
        spare = size - next(k for k in range(size + 1) if k >= 0.8 * size)
        ways = {tuple(sorted(r.sample(range(size), spare))) for _ in range(6)} | {tuple(range(at, at + spare)) for at in range(size - spare + 1)}
        for way in ways:
            at = r.randint(0, n - size)
            w = text.split()[at : at + size]
            for k in way:
                w[k] = "other"
            rows.append((len(rows), X.prose(r.randint(0, 20), len(rows)) + " " + " ".join(w) + " " + X.prose(r.randint(0, 20), 5000 + len(rows)), "en", "a"))
            for k in range(size):  # one more replaced
                if k not in way:
                    w[k] = "other"
                    break
            rows.append((len(rows), " ".join(w), "en", "a"))
    d = X.write(spark, tmp_path, rows, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    want = brute_leaks(rows, items)
    assert found_leaks(spark, d) == want and len({i for _, i in want}) == 40


def test_leaks_of_long_and_repeating_items(spark, tmp_path):
    long_ = X.prose(20_000, 11, 4000)
    again = "go on " * 600
    rows = [(1, long_, "en", "a"), (2, "well " + long_[: len(long_) // 2], "en", "a"), (3, again, "en", "a"), (4, X.prose(500, 12), "en", "a")]
    items = [(7, long_), (8, again), (9, again + "x"), (10, long_)]
    d = X.write(spark, tmp_path, rows, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = found_leaks(spark, d)
    assert got == {(1, 7): (1.0, 13, 0), (1, 10): (1.0, 13, 0), (2, 7): (1.0, 13, 1), (2, 10): (1.0, 13, 1), (3, 8): (1.0, 13, 0), (3, 9): (1.0, 13, 0)}


def test_clean_keeps_rows_apart(spark):
    item = X.prose(30, 1)
    rows = [(None, "so " + item, 1), (None, "clean", 2), (None, None, 3), (5, item, 4), (5, "clean too", 5), (5, "clean too", 5)]
    docs = spark.createDataFrame([(*x, 0, "c") for x in rows], "doc_id long, text string, r1 int, c1 int, row string")
    left = op4_decontaminate.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == docs.columns and sorted(x.r1 for x in left.collect()) == [2, 3, 5, 5]


def test_leaks_without_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op4_decontaminate, "SEED_ROWS", 0)
    item = X.prose(30, 1)
    d = X.write(spark, tmp_path, [(1, "so " + item + " it is", "en", "a"), (2, X.prose(100, 2), "en", "a"), (None, item, "en", "a")], benchmark=spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.overlap, r.doc_start) for r in op4_decontaminate.op4_decontaminate(spark, d).collect()} == {(1, 7, 1.0, 1), (None, 7, 1.0, 0)}


def test_language_held_out(spark):
    from reelspark.llm.catalogue import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01")
    r = found.join(docs, "doc_id").toPandas()
    held = r[r.held_out]
    assert 0.2 < len(held) / len(r) < 0.3 and (held.lang == held.lang_pred).mean() > 0.98 and r.score.between(0, 1).all()


def test_language_edges(spark, tmp_path):
    rows = X.texts() + [(3000 + i, t * 20, lang, "a") for i, (t, lang) in enumerate([("the quick brown fox ", "en"), ("der schnelle braune fuchs ", "de")] * 10)]
    got = op5_language.op5_language_id(spark, X.write(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (5, 6, 9, 10)] == ["und"] * 4 and by[5].score == 0 and by[3000].lang_pred == "en"
    unlabelled = X.documents(spark, [(1, "words here", None, "a")])
    assert op5_language.identify(unlabelled, op5_language.language_model(unlabelled), ("doc_id",)).first().lang_pred == "und"


def test_code_switched_text():
    words_ = {"en": "the quick brown fox jumps over that lazy dog with them".split(), "de": "der schnelle braune fuchs springt über den faulen hund".split()}
    r = random.Random(0)
    data = []
    for _ in range(200):
        a, b = r.sample(["en", "de"], 2)
        x, y = [r.choice(words_[a]) for _ in range(12)], [r.choice(words_[b]) for _ in range(12)]
        data.append((x + y, np.array([["de", "en"].index(a)] * 12 + [["de", "en"].index(b)] * 12)))
    model = op5_language.Model(["de", "en"], set()).fit(data)
    post, n = op5_language.Tagger(model).posteriors(pa.array(["the quick brown fox jumps der schnelle braune fuchs springt", None, "..."]))
    assert n.tolist() == [10, 0, 0] and post.argmax(1).tolist() == [1] * 5 + [0] * 5 and np.allclose(post.sum(1), 1)


def test_forward_backward_is_exact():
    """Marginals against the sum over all label sequences."""
    rng = np.random.default_rng(0)
    m = op5_language.Model(["a", "b", "c"], set())
    m.moves, m.begin = rng.standard_normal((3, 3)), rng.standard_normal(3)
    scores = rng.standard_normal((2, 4, 3))
    post, _ = m.posteriors(scores, np.array([4, 3]))
    for s, n in ((0, 4), (1, 3)):
        want, total = np.zeros((n, 3)), 0.0
        for path in np.ndindex(*[3] * n):
            p = np.exp(m.begin[path[0]] + sum(scores[s, i, k] for i, k in enumerate(path)) + sum(m.moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += p
            for i, k in enumerate(path):
                want[i, k] += p
        assert np.allclose(post[s, :n], want / total)


def test_scores_against_a_plain_chain(spark, tmp_path):
    """The query's labels and scores from the model's weights, by a loop over each whole text's words."""
    lines = {"en": "the quick brown fox jumps over that lazy dog", "de": "der schnelle braune fuchs springt über den faulen hund"}
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(lines[lang].split()) for _ in range(r.randint(1, 60))), lang, "a") for i in range(120) for lang in [("en", "de")[i % 2]]]
    rows += [(500, None, "en", "a"), (501, "... 12", "de", "a"), (502, "e\u0301t\u0301 \u0301 fox", "en", "a"), (503, lines["en"] + " 1 " + lines["de"], None, "a")]
    docs = X.documents(spark, rows)
    model = op5_language.language_model(docs)
    got = {x.doc_id: x for x in op5_language.op5_language_id(spark, X.write(spark, tmp_path, rows)).collect()}
    assert op5_language.words_of(pa.array(["e\u0301t\u0301 \u0301 fox"])).to_pylist() == [["e\u0301t\u0301", "", "fox"]]
    for i, text, *_ in rows:
        ws = [w for w in op5_language.words_of(pa.array([text], pa.string())).to_pylist()[0] if w]
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not ws:
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        e, move = np.exp(model.emissions(ws)), np.exp(model.moves)
        alpha, beta = [e[0] * np.exp(model.begin)], [np.ones(2)]
        for x in e[1:]:
            alpha.append((alpha[-1] @ move) * x)
        for x in e[:0:-1]:
            beta.append(move @ (x * beta[-1]))
        post = np.array(alpha) * np.array(beta[::-1])
        mean = (post / post.sum(1, keepdims=True)).mean(0)
        assert got[i].lang_pred == model.labels[mean.argmax()] and abs(got[i].score - mean.max()) < 1e-6


def test_long_texts_are_one_chain():
    rng = np.random.default_rng(0)
    model = op5_language.Model(["a", "b", "c"], set())
    model.moves = 4 * np.eye(3)
    tagger = op5_language.Tagger(model)
    tagger.rows = np.concatenate([np.zeros((1, 3)), rng.standard_normal((40, 3))])
    tagger.known = np.zeros(41)
    index, sizes = rng.integers(1, 41, 700), np.array([500, 0, 200])
    post = tagger.marginals(index, sizes)
    for lo, hi in ((0, 500), (500, 700)):
        whole, _ = model.posteriors(tagger.rows[index[lo:hi]][None], np.array([hi - lo]))
        assert np.abs(post[lo:hi] - whole[0]).max() < 1e-9


def test_keys_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 6, "c"), (2, 9, "d"), (None, None, "e")], "k long, c long, v string")
    got = {r.v: r.k for r in components.settled(rows, "k", "c").collect()}
    assert got == {"a": 1 ^ 5, "b": 1 ^ 5, "c": 1 ^ 6, "d": 2, "e": None}
    assert components.settled(rows.where("c <> 6"), "k", "c").columns == ["k", "v"]


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, d)
        assert kept.columns == docs.columns, name
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        assert {r.doc_id for r in kept.collect()} <= ids
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in before.collect()]
    near = brute_near(rows, 5)
    assert all(c == i for i, _, c, _ in near)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, d).orderBy("start").collect()
    assert len(last) == kept.count() and [r.start for r in last] == np.concatenate([[0], np.cumsum([r.n_tokens for r in last])[:-1]]).tolist()


def pipeline_rows():
    r = random.Random(6)
    lines = {"en": X.prose(400, 41, 90).split(), "de": "der schnelle braune fuchs springt über den faulen hund und läuft durch große wälder".split()}
    rows = [(i, " ".join(r.choice(lines[lang]) for _ in range(r.randint(8, 80))), lang, "abc"[i % 3]) for i in range(90) for lang in [("en", "de")[i % 2]]]
    item = X.prose(20, 777, 3000)
    rows += [(200, "Все люди рождаются свободными и равными в своем достоинстве и правах", None, "a"), (201, None, "en", "a"), (202, "", None, None), (203, "12 --", "en", "a"), (None, rows[0][1], None, None), (None, rows[0][1], None, None), (None, rows[3][1], "de", "b")]
    rows += [(300 + i, rows[7][1], "de", "a") for i in range(4)] + [(310, rows[9][1], "de", "a")] * 3 + [(400, f"{rows[4][1]} {item} {rows[5][1]}", "en", "a"), (401, " ".join(w if k % 9 else "other" for k, w in enumerate(item.split())), "en", "b")]
    return rows, item


def test_pipeline_stages(spark, tmp_path):
    """Each stage against brute force on its own input, with other columns that have the names of the stages' own."""
    rows, item = pipeline_rows()
    d = X.write(spark, tmp_path, rows, benchmark=spark.createDataFrame([(1, item), (2, "fuchs"), (3, None)], "item_id long, text string"))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for k, c in enumerate(("row", "gone", "again", "r1", "_0", "draw", "first")):
        docs = docs.withColumn(c, F.lit(k))
    content = lambda df: collections.Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())
    stage = {name: lambda df, f=f: f(spark, df, d) for name, f in corpus_pipeline.STAGES}

    named = stage["language_id"](docs)
    assert named.columns == docs.columns and content(docs) - content(named) == collections.Counter({x: 1 for x in rows if x[0] in (200, 201, 202, 203)})

    kept = stage["minhash_dedup"](docs)
    want = collections.Counter()
    least = brute_near(rows, 5)
    for x in set(rows):
        if x[0] is None or any(i == x[0] and stays for i, _, _, stays in least):
            want[x] = 1
    assert kept.columns == docs.columns and content(kept) == want

    clean = stage["decontaminate"](docs)
    leaks = brute_leaks(rows, [(1, item)])
    assert clean.columns == docs.columns and content(clean) == collections.Counter(x for x in rows if (x[0], 1) not in leaks) and {i for i, _ in leaks} == {400, 401}

    mixed = stage["mix_sources"](docs)
    planned = op8_mix.mix_plan(docs).groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t")).collect()
    made = collections.Counter()
    for (_, t, _, s), n in content(mixed).items():
        made[s] += n * len((t or "").split())
    assert mixed.columns == docs.columns and all(made[r.source] == r.k and abs(r.k - r.t) <= 1 + 0.01 * r.t for r in planned)


def test_pipeline_edges(spark, tmp_path):
    d = X.write(spark, tmp_path, [r for r in X.texts() if r[0] != 1], benchmark=spark.createDataFrame([(1, X.prose(50, 3))], "item_id long, text string"))
    ids = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, d).collect())
    assert 30 not in ids and 5 not in ids and 10 not in ids and len({2, 3, 4, 20} & set(ids)) <= 1
    empty = X.write(spark, tmp_path / "none", [], benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, empty).count() == 0
