"""Toxicity: a counterfactual-regularised classifier.

A sparse logistic regression over the presence of words and of character
n-grams inside words, fitted on a bounded sample of labelled texts. Beside the
loss on labels, it pays for every change of score when identity terms of a
labelled text are swapped for others of their group ("women" for "men"), so
that a neutral mention of a group does not raise the score.

Fitting: the labels (at most ``SAMPLE_ROWS`` rows, by hash of the id) meet the
texts in a broadcast join. Of texts of one label with the same smallest shingle
hash, the one with the smallest id (then text) stands for those that share
``COPIES`` of their shingles with it; all others count as texts of their own.
Features are hashed to 64 bits. A first pass counts texts per hash bucket and
label, a second one brings the features of telling buckets to the driver
(bounded by the sample), where the weights are fitted. Scoring reads whole
texts and needs only the weights.

Defined cases: null and empty texts have no feature and get the score of the
intercept; a text labelled several times is toxic if half its labels or more
say so; null labels are ignored; with no labelled rows every score is 0.5 less
one step (0.49); repeated rows get one score each; an empty table gives an
empty table; columns named like a result give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm._batches import LOWER, Texts, add_columns, byte_slices, byte_table, hash_sample, mix, stored, table, whole_row, word_hashes
from llm.simhash import _shingle_hashes

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE_ROWS = 12_000
#: Share of shingles from which two texts are near copies, told from this many of their smallest hashes.
COPIES, SIGNATURE = 0.5, 64
NGRAMS = (4, 5, 6)
BUCKET_BITS, TOP_BUCKETS, TOP_FEATURES = 20, 8192, 2048
L1, COUNTERFACTUAL = 2e-4, 1.0
#: Words end at ASCII characters that are neither letters nor digits.
SEPARATORS = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Terms of one group stand for each other in a counterfactual text.
IDENTITY_GROUPS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["female", "male"], ["mothers", "fathers"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["gay", "lesbian", "bisexual", "transgender", "straight"],
    ["black", "white", "asian", "latino", "arab"], ["african", "european", "american", "mexican", "chinese", "indian"],
    ["old", "young"], ["disabled", "deaf", "blind"], ["immigrants", "refugees", "natives"],
    ["mujeres", "hombres"], ["femmes", "hommes"], ["frauen", "männer"],
]


def _swaps(groups: list[list[str]]) -> dict[bytes, bytes]:
    return {a.encode(): b.encode() for g in groups for a, b in zip(g, g[1:] + g[:1])}


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of several words and the index of each word's first: the
    word itself and its n-grams, ends marked."""
    t = Texts.of(words)
    n = len(t)
    size = np.diff(t.offsets)
    begin = t.offsets[:-1] + 2 * np.arange(n)  # each word between two marks
    data = np.full(len(t.data) + 2 * n, 32, dtype=np.uint8)
    data[np.arange(len(t.data)) + np.repeat(2 * np.arange(n) + 1, size)] = t.data
    owners, hashes = [np.arange(n)], [word_hashes(data, begin + 1, begin + 1 + size)]
    value = data.astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(n), size + 2)
    rolled = value
    for k in range(2, max(NGRAMS) + 1):
        if len(value) < k:
            break
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + value[k - 1:]
        if k in NGRAMS:
            inside = owner[:len(rolled)] == owner[k - 1:]
            owners.append(owner[:len(rolled)][inside])
            hashes.append(mix(rolled[inside] + np.uint64(k)))
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owner, kind="stable")
    return h[order], np.searchsorted(owner[order], np.arange(n + 1))


def _gather(first: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Positions of the ranges ``first[i]:first[i + 1]`` for each i in ``which``."""
    size = first[which + 1] - first[which]
    return np.arange(int(size.sum())) + np.repeat(first[which] - (np.cumsum(size) - size), size)


def _coded(texts: Texts) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the code of each word, and the index of each text's first."""
    texts = Texts(LOWER[texts.data], texts.offsets)
    starts, ends, first = texts.words(SEPARATORS)
    inside = ~SEPARATORS[texts.data]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(texts.data[inside])])
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), first


def text_features(texts: Texts, swaps: dict[bytes, bytes] | None = None) -> Iterator[np.ndarray | None]:
    """Distinct feature hashes of each text; with ``swaps``, of its
    counterfactual (None where it mentions no group)."""
    words, codes, first = _coded(texts)
    if swaps is not None:
        plain = words.to_pylist()
        named = np.array([w in swaps for w in plain], dtype=bool)
        words = pa.array([swaps.get(w, w) for w in plain], type=pa.large_binary())
    features, begin = word_features(words)
    for a, b in zip(first, first[1:]):
        own = np.unique(codes[a:b])
        if swaps is not None and not named[own].any():
            yield None
        else:
            yield np.unique(features[_gather(begin, own)])


@dataclass
class Model:
    """Weights of feature hashes (ascending)."""

    intercept: float = float(np.log(0.49 / 0.51))
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def scores(self, texts: Texts) -> np.ndarray:
        logit = np.full(len(texts), self.intercept)
        if len(self.features) and len(texts):
            words, codes, first = _coded(texts)
            table_ = np.zeros(1 << 16, dtype=bool)
            table_[(self.features >> np.uint64(48)).astype(np.int64)] = True
            h, begin = word_features(words)
            maybe = np.flatnonzero(table_[(h >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.features, h[maybe]), len(self.features) - 1)
            known = self.features[at] == h[maybe]
            at, word = at[known], np.searchsorted(begin, maybe[known], side="right") - 1
            first_of = np.searchsorted(word, np.arange(len(words) + 1))
            told = np.flatnonzero((np.diff(first_of) > 0)[codes])  # words with a weight
            which = codes[told]
            text = np.searchsorted(first, told, side="right") - 1
            pair = np.unique(np.repeat(text, np.diff(first_of)[which]) * len(self.features) + at[_gather(first_of, which)])
            logit += np.bincount(pair // len(self.features), weights=self.weights[pair % len(self.features)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_weights(rows: list[np.ndarray], labels: np.ndarray, swapped: list[tuple[int, np.ndarray]], always: np.ndarray,
                l1: float = L1, counterfactual: float = COUNTERFACTUAL, steps: int = 400) -> Model:
    """Weights from the features of texts, their labels, and the features of
    counterfactual texts as (index of the text, features). Features in
    ``always`` are kept whether telling or not."""
    y = labels.astype(float)
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    if not pos or not neg:
        return Model() if not len(y) else Model(intercept=3.0 if pos else -3.0)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    names, col = np.unique(np.concatenate([*rows, always]), return_inverse=True)
    col = col[:len(row)]
    p, q = np.bincount(col, weights=y[row], minlength=len(names)), np.bincount(col, weights=1 - y[row], minlength=len(names))
    share = (p + q) / len(y)
    z = (p / pos - q / neg) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / pos + 1 / neg))
    order = np.lexsort((names, -np.abs(z)))
    chosen = np.zeros(len(names), dtype=bool)
    chosen[order[:TOP_FEATURES]] = True
    chosen &= (np.abs(z) >= 4) & (p + q >= 3)
    chosen |= np.isin(names, always)
    names = names[chosen]
    if not len(names):
        return Model(intercept=float(np.log(pos / neg)))

    def indexed(parts: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        r = np.repeat([i for i, _ in parts], [len(x) for _, x in parts]).astype(np.int64)
        f = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, dtype=np.uint64)
        at = np.minimum(np.searchsorted(names, f), len(names) - 1)
        ok = names[at] == f
        return r[ok], at[ok]

    r0, c0 = indexed(list(enumerate(rows)))
    # difference of a counterfactual and its text, as signed entries
    r1, c1 = indexed([(k, x) for k, (_, x) in enumerate(swapped)])
    r2, c2 = indexed([(k, rows[i]) for k, (i, _) in enumerate(swapped)])
    entry, at = np.unique(np.concatenate([r1, r2]) * len(names) + np.concatenate([c1, c2]), return_inverse=True)
    sd = np.bincount(at, weights=np.concatenate([np.ones(len(r1)), -np.ones(len(r2))]), minlength=len(entry))
    rd, cd, sd = (entry // len(names))[sd != 0], (entry % len(names))[sd != 0], sd[sd != 0]
    w, b = np.zeros(len(names)), float(np.log(pos / neg))
    v, vb, t = w.copy(), b, 1.0
    steepest = (np.bincount(r0, minlength=len(y)).max() + 1) / 4 + (2 * counterfactual * np.bincount(rd).max() if len(rd) else 0)
    rate = 1 / steepest
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(np.bincount(r0, weights=v[c0], minlength=len(y)) + vb))) - y
        grad = np.bincount(c0, weights=g[r0], minlength=len(w)) / len(y)
        if len(rd):
            change = np.bincount(rd, weights=sd * v[cd], minlength=len(swapped))
            grad += 2 * counterfactual * np.bincount(cd, weights=sd * change[rd], minlength=len(w)) / len(swapped)
        step = v - rate * grad
        w2, b2 = np.sign(step) * np.maximum(np.abs(step) - rate * l1, 0), vb - rate * g.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    used = w != 0
    return Model(float(b), names[used], w[used])


def learns_from(doc_id) -> F.Column:
    """Rows whose labels may be learned: the others are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def _with_signature(df: DataFrame) -> DataFrame:
    """``signature``: the smallest distinct shingle hashes, ascending, and
    ``sketch``, the first of them (0 without words), equal for most near copies."""
    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            h, begin = _shingle_hashes(Texts.of(column), 4)
            h = (h >> np.uint64(1)).view(np.int64)  # in the same order when signed
            least = [np.unique(h[a:b])[:SIGNATURE] for a, b in zip(begin, begin[1:])]
            return [pa.array(least, type=pa.list_(pa.int64())), pa.array([int(x[0]) if len(x) else 0 for x in least], type=pa.int64())]
        return work

    return add_columns(df, "text", [T.StructField("signature", T.ArrayType(T.LongType())), T.StructField("sketch", T.LongType())], make)


def _once(rows: DataFrame) -> DataFrame:
    """(text, y) of the rows (id, text, y), near copies once."""
    signed = stored(_with_signature(rows.select("id", F.coalesce("text", F.lit("")).alias("text"), "y")), "toxicity-labelled")
    first = stored(signed.groupBy("sketch", "y").agg(F.min(F.struct("id", "text", "signature")).alias("first")), "toxicity-first")
    both = signed.join(first.select("sketch", "y", F.col("first.signature").alias("other")), ["sketch", "y"])
    least = F.slice(F.array_sort(F.array_union("signature", "other")), 1, SIGNATURE)
    shared = F.size(F.array_intersect(least, F.array_intersect("signature", "other")))
    apart = both.where(shared < COPIES * F.size(least)).select("text", "y").distinct()
    return first.select("first.text", "y").unionByName(apart)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample_rows: int = SAMPLE_ROWS, groups: list[list[str]] | None = None, counterfactual: float = COUNTERFACTUAL) -> Model:
    """A model from the labelled rows of ``docs`` that ``labels`` covers.
    ``counterfactual``: weight of the penalty on changes under swapped terms."""
    spark = docs.sparkSession
    swaps = _swaps(IDENTITY_GROUPS if groups is None else groups)
    label = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        (F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("y"))
    sample = hash_sample(label.where(learns_from(F.col("id"))), sample_rows, "id")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(sample), "id")
    # an id borne by many rows counts once, so the sample bounds the texts too
    rows = rows.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("one")).select("id", "one.text", "one.y")
    train = stored(_once(rows), "toxicity-sample")
    sizes = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return fit_weights([], np.zeros(0), [], np.zeros(0, dtype=np.uint64))
    shift = np.uint64(64 - BUCKET_BITS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64)
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                for y, f in zip(batch.column(1).to_pylist(), text_features(Texts.of(batch.column(0)))):
                    n[y][np.unique((f >> shift).astype(np.int64))] += 1
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[1][at]), pa.array(n[0][at])], names=["bucket", "p", "q"])

    sums = train.mapInArrow(counted, "bucket long, p long, q long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    share = (F.col("p") + F.col("q")) / F.lit(float(pos + neg))
    z = (F.col("p") / pos - F.col("q") / neg) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / pos + 1 / neg))
    best = sums.where("p + q >= 3").select("bucket", F.abs(z).alias("z")).where("z >= 3").orderBy(F.desc("z"), "bucket").limit(TOP_BUCKETS)
    always = word_features(pa.array(sorted(swaps), type=pa.large_binary()))[0]
    open_ = np.zeros(1 << BUCKET_BITS, dtype=bool)
    open_[[r.bucket for r in best.collect()]] = True
    open_[(always >> shift).astype(np.int64)] = True

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                texts = Texts.of(batch.column(0))
                cut = lambda f: f[open_[(f >> shift).astype(np.int64)]].tobytes()
                own = [cut(f) for f in text_features(texts)]
                other = [None if f is None else cut(f) for f in text_features(texts, swaps)]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, type=pa.binary()), pa.array(other, type=pa.binary())], names=["y", "own", "other"])

    got = train.mapInArrow(telling, "y int, own binary, other binary").collect()
    got.sort(key=lambda r: (r.y, bytes(r.own), r.other is not None, bytes(r.other or b"")))
    features = [np.frombuffer(r.own, dtype=np.uint64) for r in got]
    swapped = [(i, np.frombuffer(r.other, dtype=np.uint64)) for i, r in enumerate(got) if r.other is not None]
    return fit_weights(features, np.array([r.y for r in got]), swapped, np.unique(always), counterfactual=counterfactual)


def score(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``score`` (0 to 1) of each whole text."""
    def make():
        return lambda column: [pa.array(model.scores(Texts.of(column)))]

    return add_columns(df, text_col, [T.StructField("score", T.DoubleType())], make, keep)


def op8_toxicity(spark, sf_dir: str, counterfactual: float = COUNTERFACTUAL) -> DataFrame:
    """One row per document: score, prediction, and whether it was held out."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels"), counterfactual=counterfactual), keep=["doc_id"])
    return out.select("doc_id", (~learns_from(F.col("doc_id"))).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are not predicted toxic."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select(whole_row(docs).alias("row"), F.col("text")), model, keep=["row"])
    return scored.where("score < 0.5").select("row.*")
