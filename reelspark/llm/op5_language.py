"""Language ID with a linear-chain conditional random field over words.

Words are runs of letters and of marks behind letters, lower-cased. Their features: affixes of one to four letters, character bigrams and
trigrams, and the word itself where the lexicon of the training sample has it. Label-to-label transitions are learned with them, from pure
segments and from segments spliced of two languages, so that code-switched text can change label. Words are
labelled by forward-backward over the whole text: segments of SEGMENT words are summed up as label-to-label matrices,
which carry the messages from segment to segment, and all segments then run side by side. A text's score for a language
is the mean posterior of its words that have a letter.

Posteriors choose between learned languages only. Evidence that a text is in one of them is its known share, the mean
share of its words' letter trigrams that the sample holds; it does not depend on how many languages there are.

The model is fitted on the driver from a bounded, seeded sample of labelled rows (SAMPLE_ROWS), whole texts, in which
every label of the table has its share; prediction covers all words of all texts.

Defined results: a null text, or one without a letter, is `und` with score 0; null labels are not learned from; a
null doc_id counts as its own text "" when it is dealt to the held-out part; repeated rows are predicted each; an
empty table, or one without labels, gives `und` throughout; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, lean, mix64, slices, table

#: Labelled rows that the model is fitted on at most, and segments taken from them; both are shared out over the labels.
SAMPLE_ROWS, SAMPLE_SEGMENTS = 600, 2000
SEGMENT, EPOCHS, BUCKETS, SEED = 64, 25, 1 << 16, 5
#: Places of the table that says which trigrams the sample holds.
TRIGRAMS = 1 << 20
UND = "und"


def features(words: list[str], lexicon: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each hashed affix, n-gram and lexicon feature of lower-cased words."""
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.cumsum(sizes + 2) - sizes - 2
    owner = np.repeat(np.arange(len(words)), sizes + 2)
    every = np.arange(len(words))
    out = []

    def add(kind: int, who: np.ndarray, first: np.ndarray, n: int) -> None:
        h = np.full(len(first), kind, dtype=np.uint64)
        for k in range(n):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + chars[first + k])
        out.append((who, h))

    for n in (2, 3):
        first = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
        add(n, owner[first], first, n)
    for n in range(1, 5):
        who = every[sizes >= n]
        add(10 + n, who, starts[who] + 1, n)
        add(20 + n, who, starts[who] + 1 + sizes[who] - n, n)
    own = [i for i, w in enumerate(words) if w in lexicon]
    out.append((np.array(own, dtype=np.int64), np.array([xxhash.xxh3_64_intdigest(words[i]) for i in own], dtype=np.uint64)))
    who, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return who.astype(np.int32), (h % np.uint64(BUCKETS)).astype(np.int32)


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, place in the table) of each letter trigram of lower-cased words, their ends marked."""
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    first = np.flatnonzero(owner[: max(len(owner) - 2, 0)] == owner[2:])
    h = mix64((chars[first] << np.uint64(42)) ^ (chars[first + 1] << np.uint64(21)) ^ chars[first + 2])
    return owner[first], (h % np.uint64(TRIGRAMS)).astype(np.int64)


class Model:
    """Weights (bucket x label), transitions and the forward-backward over padded segments."""

    def __init__(self, labels: list[str], lexicon: set[str]):
        self.labels, self.lexicon = labels, lexicon
        k = len(labels)
        self.weights, self.moves, self.begin = np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k)
        self.seen = np.zeros(TRIGRAMS, dtype=bool)

    def emissions(self, words: list[str]) -> np.ndarray:
        who, bucket = features(words, self.lexicon)
        return np.stack([np.bincount(who, weights=self.weights[bucket, j], minlength=len(words)) for j in range(len(self.labels))], 1)

    def known(self, words: list[str]) -> np.ndarray:
        """Share of each word's trigrams that the sample holds."""
        who, place = trigrams(words)
        return np.bincount(who, weights=self.seen[place], minlength=len(words)) / np.maximum(np.bincount(who, minlength=len(words)), 1)

    def posteriors(self, scores: np.ndarray, lengths: np.ndarray, pairs: bool = False):
        """scores: S x T x K emissions, padded; lengths in descending order. Marginals S x T x K, and summed pair marginals."""
        return self.chain(np.exp(scores - scores.max(2, keepdims=True)), lengths, pairs)

    def chain(self, e: np.ndarray, lengths: np.ndarray, pairs: bool = False, before: np.ndarray | None = None, after: np.ndarray | None = None):
        """posteriors() of exponentials of scores; before and after, S x K, are what the text around a segment says of its ends."""
        s, t, k = e.shape
        move = np.exp(self.moves)
        alpha, beta = np.zeros((t, s, k)), np.ones((t, s, k))
        live = [int(np.searchsorted(-lengths, -i, side="left")) for i in range(t + 1)]  # segments longer than i
        if after is not None:
            beta[lengths - 1, np.arange(s)] = after
        a = e[:, 0] * (np.exp(self.begin) if before is None else before)
        alpha[0] = a / a.sum(1, keepdims=True)
        for i in range(1, t):
            n = live[i]
            a = (alpha[i - 1, :n] @ move) * e[:n, i]
            alpha[i, :n] = a / a.sum(1, keepdims=True)
        both = np.zeros((k, k))
        for i in range(t - 2, -1, -1):
            n = live[i + 1]
            right = e[:n, i + 1] * beta[i + 1, :n]
            b = right @ move.T
            if pairs:
                z = alpha[i, :n][:, :, None] * move * right[:, None, :]
                both += (z / z.sum((1, 2), keepdims=True)).sum(0)
            beta[i, :n] = b / b.sum(1, keepdims=True)
        post = alpha * beta
        post /= np.maximum(post.sum(2, keepdims=True), 1e-300)
        return post.transpose(1, 0, 2), both

    def fit(self, segments: list[tuple[list[str], np.ndarray]]) -> Model:
        """Adagrad on the conditional log-likelihood of (words, labels)."""
        segments = sorted(segments, key=lambda x: -len(x[0]))
        vocabulary: dict[str, int] = {}
        words = np.full((len(segments), SEGMENT), -1)
        gold = np.zeros((len(segments), SEGMENT), dtype=np.int64)
        for i, (ws, ls) in enumerate(segments):
            words[i, : len(ws)] = [vocabulary.setdefault(w, len(vocabulary)) for w in ws]
            gold[i, : len(ls)] = ls
        lengths = (words >= 0).sum(1)
        owner, feat = features(list(vocabulary), self.lexicon)
        self.seen[trigrams(list(vocabulary))[1]] = True
        k, mask = len(self.labels), words >= 0
        one = np.eye(k)[gold] * mask[:, :, None]
        gold_moves = np.zeros((k, k))
        np.add.at(gold_moves, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
        squares = [np.full(x.shape, 1e-8) for x in (self.weights, self.moves, self.begin)]
        flat, total = words[mask], mask.sum()
        for _ in range(EPOCHS):
            emit = np.stack([np.bincount(owner, weights=self.weights[feat, j], minlength=len(vocabulary)) for j in range(k)], 1)
            scores = np.where(mask[:, :, None], emit[np.maximum(words, 0)], 0)
            post, moves = self.posteriors(scores, lengths, pairs=True)
            off = (one - post * mask[:, :, None])[mask]
            by_word = np.stack([np.bincount(flat, weights=off[:, j], minlength=len(vocabulary)) for j in range(k)], 1)
            grad = np.stack([np.bincount(feat, weights=by_word[owner, j], minlength=BUCKETS) for j in range(k)], 1)
            steps = ((self.weights, grad / total), (self.moves, (gold_moves - moves) / total), (self.begin, (one[:, 0] - post[:, 0]).sum(0) / total))
            for (x, g), q in zip(steps, squares, strict=True):
                g = g - 1e-6 * x
                q += g * g
                x += 0.3 * g / np.sqrt(q)
        return self


def words_of(texts: pa.Array) -> pa.ListArray:
    """The words of each text: a letter and the letters and marks behind it, lower-cased; some words may be empty."""
    letters = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}]+", " ")
    letters = pc.replace_substring_regex(letters, r"(^| )\p{M}+", r"\1")
    return pc.split_pattern(pc.utf8_trim(letters, " "), " ")


def shares(counts: dict[str, int], total: int) -> dict[str, int]:
    """How many of its items each label gives to a sample of total: even shares, and what rare labels leave over goes to the others.

    Each label gives one at least, also where there are more labels than total.
    """
    out: dict[str, int] = {}
    for i, label in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[label] = min(counts[label], max(1, (total - sum(out.values())) // (len(counts) - i)))
    return out


def train(labelled: DataFrame, rows: int = SAMPLE_ROWS, segments: int = SAMPLE_SEGMENTS) -> Model | None:
    """Fit on at most rows rows of labelled (doc_id, text, lang), shared out over all labels, in the order of a seeded hash.

    The rows of each label are counted first, so that few more than wanted pass the hash and are ordered at all; a
    label's first row passes whatever its hash is. Rows without a letter have nothing to learn from and take no place.
    """
    some = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    some = some.withColumn("_order", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(1 << 40)))
    found = some.groupBy("lang").agg(F.count("*").alias("n"), F.min("_order").alias("first")).collect()
    if not found:
        return None
    quota = shares({r.lang: r.n for r in found}, rows)
    bounds = [(r.lang, max(r.first, int(min(1.0, (2 * quota[r.lang] + 40) / r.n) * (1 << 40))), quota[r.lang]) for r in found]
    limits = F.broadcast(labelled.sparkSession.createDataFrame(bounds, "lang string, _least long, _quota long"))  # one row per label
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_order", "text"))
    near = some.join(limits, "lang").where(F.col("_order") <= F.col("_least")).withColumn("_place", place)
    sample = near.where(F.col("_place") <= F.col("_quota")).orderBy("_order", "lang", "text").select("lang", "text").collect()
    labels = sorted({r.lang for r in sample})
    if not labels:
        return None
    rng = np.random.default_rng(SEED)
    pieces: list[tuple[list[str], int]] = []
    for r, ws in zip(sample, words_of(pa.array([r.text for r in sample], pa.string())).to_pylist(), strict=True):
        ws = [w for w in ws if w]
        pieces += [(ws[i : i + SEGMENT], labels.index(r.lang)) for i in range(0, len(ws), SEGMENT)]
    if not pieces:
        return None
    left = shares(dict(Counter(label for _, label in pieces)), segments)
    mixed, pieces = [pieces[i] for i in rng.permutation(len(pieces))], []
    for ws, label in mixed:
        if left[label]:
            left[label] -= 1
            pieces.append((ws, label))
    counts: dict[str, int] = {}
    for ws, _ in pieces:
        for w in ws:
            counts[w] = counts.get(w, 0) + 1
    data = [(ws, np.full(len(ws), label)) for ws, label in pieces]
    for i, j in zip(rng.permutation(len(pieces)), rng.permutation(len(pieces)), strict=True):  # spliced of two
        (a, x), (b, y) = pieces[i], pieces[j]
        a, b = a[: int(rng.integers(1, SEGMENT // 2 + 1))], b[: int(rng.integers(1, SEGMENT // 2 + 1))]
        data.append((a + b, np.array([x] * len(a) + [y] * len(b))))
    model = Model(labels, {w for w, n in counts.items() if n > 2}).fit(data)
    give_back()
    return model


class Tagger:
    """Mean posteriors of whole texts; emissions of words met first, the frequent ones, are kept."""

    KEEP = 200_000

    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[str, int] = {"": 0}
        self.rows, self.known = np.zeros((1, len(model.labels))), np.zeros(1)

    def _index(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > self.KEEP:
            self.memo = memo = dict(itertools.islice(memo.items(), self.KEEP // 2))
            self.rows, self.known = self.rows[: self.KEEP // 2].copy(), self.known[: self.KEEP // 2].copy()
        new = [w for w in words if w not in memo]
        if new:
            memo.update(zip(new, range(len(memo), len(memo) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, self.model.emissions(new)])
            self.known = np.concatenate([self.known, self.model.known(new)])
        return np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))

    def look(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row of each word of all texts in rows and known, number of words of each text)."""
        split = words_of(texts)
        enc = split.flatten().dictionary_encode()
        names = enc.dictionary.to_pylist()
        at = enc.indices.to_numpy()
        sizes = np.asarray(split.value_lengths(), dtype=np.int64)
        if "" in names:
            blank = at == names.index("")
            sizes = sizes - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[blank], minlength=len(sizes))
            at = at[~blank]
        return (self._index(names)[at] if len(at) else at.astype(np.int64)), sizes

    def _messages(self, e: np.ndarray, first: np.ndarray, lengths: np.ndarray, number: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(before, after) of each segment: segments are consecutive, number counts them within their text, last ends it."""
        move, begin = np.exp(self.model.moves), np.exp(self.model.begin)
        k = len(begin)
        before, after = np.tile(begin, (len(first), 1)), np.ones((len(first), k))
        some = np.flatnonzero((number > 0) | ~last)
        if not len(some):
            return before, after
        carry = np.empty((len(first), k, k))  # what a segment makes of the label in front of it (of its first word, in a text's first)
        some = some[np.argsort(-lengths[some], kind="stable")]
        for lo in range(0, len(some), 4096):
            o = some[lo : lo + 4096]
            step = np.where((number[o] == 0)[:, None, None], np.eye(k), move) * e[first[o]][:, None, :]
            for i in range(1, int(lengths[o[0]])):
                n = int(np.searchsorted(-lengths[o], -i, side="left"))
                x = (step[:n].reshape(-1, k) @ move).reshape(n, k, k) * e[first[o[:n]] + i][:, None, :]
                step[:n] = x / x.max((1, 2), keepdims=True)
            carry[o] = step
        order = np.argsort(number, kind="stable")
        cuts = np.searchsorted(number[order], np.arange(int(number.max()) + 2))
        state = np.tile(begin, (len(first), 1))
        for n in range(1, len(cuts) - 1):  # the segments of that number, after those in front of them
            at = order[cuts[n] : cuts[n + 1]]
            x = np.einsum("si,sij->sj", state[at - 1], carry[at - 1])
            state[at] = x / x.max(1, keepdims=True)
            before[at] = state[at] @ move
        for n in range(len(cuts) - 2, 0, -1):
            at = order[cuts[n] : cuts[n + 1]]
            x = np.einsum("sij,sj->si", carry[at], after[at])
            after[at - 1] = x / x.max(1, keepdims=True)
        return before, after

    def marginals(self, index: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """words x labels of texts of sizes words each, every text one chain."""
        post = np.zeros((len(index), len(self.model.labels)))
        if not len(index):
            return post
        e = self.rows[index]
        e = np.exp(e - e.max(1, keepdims=True))
        ends = np.cumsum(sizes)
        pieces = -(-sizes // SEGMENT)
        number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(ends - sizes, pieces) + SEGMENT * number
        lengths = np.minimum(SEGMENT, np.repeat(ends, pieces) - first)
        before, after = self._messages(e, first, lengths, number, first + lengths == np.repeat(ends, pieces))
        order = np.argsort(-lengths, kind="stable")
        for lo in range(0, len(order), 4096):
            o = order[lo : lo + 4096]
            n = lengths[o]
            inside = np.arange(n[0]) < n[:, None]
            place = np.where(inside, first[o][:, None] + np.arange(n[0]), 0)
            p, _ = self.model.chain(e[place], n, False, before[o], after[o])
            post[place[inside]] = p[inside]
        return post

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words x labels marginals of all texts, number of words of each text)."""
        index, sizes = self.look(texts)
        return self.marginals(index, sizes), sizes


def _predict(model: Model | None, text: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = model and Tagger(model)
        for part in slices(batches, 400):
            label, score, known = [UND] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows)
            if tagger:
                index, sizes = tagger.look(part.column(text))
                post = np.concatenate([tagger.marginals(index, sizes), tagger.known[index][:, None]], axis=1)
                total = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(post, axis=0)])
                ends = np.cumsum(sizes)
                mean = (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1)[:, None]
                some, mean, known = sizes > 0, mean[:, :-1], np.clip(mean[:, -1], 0, 1)
                label = [model.labels[k] if ok else UND for k, ok in zip(mean.argmax(1).tolist(), some.tolist(), strict=True)]
                score = np.where(some, np.clip(mean.max(1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names), pa.array(label, pa.string()), pa.array(score), pa.array(known)], [*part.schema.names, "lang_pred", "score", "known_share"])

    return lean(run)


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = (), into: tuple[str, str, str] = ("lang_pred", "score", "known_share")) -> DataFrame:
    """The columns of keep, then the label, its score and the known share under the names of into; the text alone is looked at."""
    text = f"_{keep.index('text')}" if "text" in keep else "text"
    inner = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)), *([] if "text" in keep else ["text"]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields)
    named = inner.mapInArrow(_predict(model, text), f"{fields}, lang_pred string, score double, known_share double")
    return named.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), F.col("lang_pred").alias(into[0]), F.col("score").alias(into[1]), F.col("known_share").alias(into[2]))


def language_model(docs: DataFrame) -> Model | None:
    return train(docs.where(~held_out()))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, language_model(docs), ("doc_id",)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "known_share")
