"""Benchmark decontamination by winnowing.

Words: ASCII letters in lower case, maximal runs of letters, digits and
non-ASCII bytes. From every window of ``w`` consecutive k-grams the one with the
smallest hash is kept, in benchmark items and documents alike, so any shared
span of ``k + w - 1`` words shares a kept k-gram. Kept k-grams meet by equality
of hash; every meeting is extended along both texts, word bytes compared, and
the words of runs as long as a window are hit.

Windows are ``WINDOW`` words; an item of fewer words is one window. Items of one
length below that form a class with k-grams to suit.

A benchmark of at most ``BROADCAST_BYTES`` (sum of text bytes, asked for first)
is sent to the tasks, and documents need no shuffle. A larger one meets the
documents in shuffled joins of fingerprints, then of candidate pairs, with the
same results.

Defined cases: null and empty texts have no words, hits or items; an item
without words never occurs; items that repeat an id count once, an item without
id counts as one with the empty id; repeated documents get one row each; empty
tables give empty results or rows without hits; columns of the frame named like
a result give way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm._batches import LOWER, Texts, add_columns, byte_slices, mix, stored, table, whole_row, word_hashes
from llm.toxicity import SEPARATORS

WINDOW, GRAM = 10, 5
#: Text bytes up to which a benchmark is sent to every task.
BROADCAST_BYTES = 16 << 20
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Words:
    """Word positions, hashes and bytes of several texts."""

    def __init__(self, column: pa.Array):
        t = Texts.of(column)
        self.texts = Texts(LOWER[t.data], t.offsets)
        self.starts, self.ends, self.first = self.texts.words(SEPARATORS)
        self.hashes = word_hashes(self.texts.data, self.starts, self.ends)

    def spelled(self, a: int, b: int) -> list[bytes]:
        data = self.texts.data[self.starts[a]:self.ends[b - 1]].tobytes()
        base = self.starts[a]
        return [data[s - base:e - base] for s, e in zip(self.starts[a:b], self.ends[a:b])]


def gram(length: int) -> tuple[int, int]:
    """k and w for windows of ``length`` words."""
    k = min(GRAM, length)
    return k, length - k + 1


def fingerprints(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the kept k-grams for windows of ``length``."""
    k, w = gram(length)
    n = len(words.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    rolled = words.hashes[:n].copy()
    for j in range(1, k):
        rolled = rolled * _STEP + words.hashes[j:n + j]
    rolled = mix(rolled)
    text = np.repeat(np.arange(len(words.texts)), np.diff(words.first))
    whole = text[:n] == text[k - 1:]
    keep = np.zeros(n, dtype=bool)
    m = n - w + 1
    if m > 0:
        least = rolled[:m].copy()
        for j in range(1, w):
            np.minimum(least, rolled[j:m + j], out=least)
        full = text[:m] == text[k + w - 2:]
        for j in range(w):
            keep[j:m + j] |= full & (rolled[j:m + j] == least)
    at = np.flatnonzero(keep & whole)
    return rolled[at], at


def runs(doc: Words, a: int, b: int, item: Words, c: int, d: int, shift: int, length: int) -> list[tuple[int, int]]:
    """Ranges of document words (within ``a:b``) equal to the item words (``c:d``)
    that lie ``shift`` before them, ``length`` words long at least."""
    lo, hi = max(a, c + shift), min(b, d + shift)
    if hi - lo < length:
        return []
    same = np.concatenate([[False], doc.hashes[lo:hi] == item.hashes[lo - shift:hi - shift], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    found = []
    for s, e in zip(edge[::2] + lo, edge[1::2] + lo):
        if e - s >= length:
            equal = [x == y for x, y in zip(doc.spelled(s, e), item.spelled(s - shift, e - shift))] + [False]
            begin = s
            for i, ok in enumerate(equal):
                if not ok:
                    if s + i - begin >= length:
                        found.append((begin, s + i))
                    begin = s + i + 1
    return found


class Benchmark:
    """Items with their fingerprints, ready to be looked up."""

    def __init__(self, ids: list, texts: pa.Array):
        self.ids, self.words = ids, Words(texts)
        first = self.words.first
        self.size = np.diff(first)
        self.item_of = np.repeat(np.arange(len(ids)), self.size)
        self.classes = []
        for length in sorted({min(int(n), WINDOW) for n in self.size if n}):
            h, at = fingerprints(self.words, length)
            own = np.minimum(self.size[self.item_of[at]], WINDOW) == length
            order = np.argsort(h[own], kind="stable")
            h, at = h[own][order], at[own][order]
            maybe = np.zeros(1 << 16, dtype=bool)
            maybe[(h >> np.uint64(48)).astype(np.int64)] = True
            self.classes.append((length, h, at, maybe))

    def hits(self, doc: Words) -> list[tuple[int, int, int, int]]:
        """(text, item, first word, end) of every run of equal words."""
        seen: set = set()
        found = []
        for length, h, at, maybe in self.classes:
            own, place = fingerprints(doc, length)
            likely = maybe[(own >> np.uint64(48)).astype(np.int64)]
            own, place = own[likely], place[likely]
            lo, hi = np.searchsorted(h, own), np.searchsorted(h, own, side="right")
            for i in np.flatnonzero(hi > lo):
                p = int(place[i])
                text = int(np.searchsorted(doc.first, p, side="right")) - 1
                for q in at[lo[i]:hi[i]].tolist():
                    item, shift = int(self.item_of[q]), p - q
                    if (item, shift, text) in seen:
                        continue
                    seen.add((item, shift, text))
                    for s, e in runs(doc, int(doc.first[text]), int(doc.first[text + 1]), self.words,
                                     int(self.words.first[item]), int(self.words.first[item + 1]), shift, length):
                        found.append((text, item, s, e))
        return found



_BUILT: dict[bytes, Benchmark] = {}


def _shared(ids: list[str], texts: list[bytes]) -> Benchmark:
    """The benchmark of these items, built once in a worker process."""
    digest = hashlib.blake2b(repr(ids).encode())
    for t in texts:
        digest.update(len(t).to_bytes(8, "little") + t)
    if digest.digest() not in _BUILT:
        _BUILT.clear()
        _BUILT[digest.digest()] = Benchmark(ids, pa.array(texts, type=pa.binary()))
    return _BUILT[digest.digest()]


RESULT = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
          T.StructField("item_ids", T.ArrayType(T.StringType()))]


def _local(df: DataFrame, ids: list[str], texts: list[bytes], text_col: str, keep: list[str] | None) -> DataFrame:
    def make():
        bench = _shared(ids, texts)

        def work(column: pa.Array) -> list[pa.Array]:
            doc = Words(column)
            edge = np.zeros(len(doc.hashes) + 1, dtype=np.int64)
            items: list[set] = [set() for _ in range(len(doc.texts))]
            for text, item, s, e in bench.hits(doc):
                edge[s] += 1
                edge[e] -= 1
                items[text].add(ids[item])
            hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
            return [pa.array(np.diff(doc.first)), pa.array(hit[doc.first[1:]] - hit[doc.first[:-1]]),
                    pa.array([sorted(x) for x in items], type=pa.list_(pa.string()))]
        return work

    return add_columns(df, text_col, RESULT, make, keep)


def _prints(lengths: list[int]):
    """Task function: (key, text) to distinct (key, length, h)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                words = Words(batch.column(1))
                size = np.diff(words.first)
                for length in lengths:
                    h, at = fingerprints(words, length)
                    text = np.searchsorted(words.first, at, side="right") - 1
                    rows = pd.DataFrame({"t": text, "h": h.view(np.int64), "n": np.minimum(size[text], WINDOW)}).drop_duplicates()
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows["t"])), pa.array(np.full(len(rows), length)), pa.array(rows["h"]), pa.array(rows["n"])],
                        names=["key", "length", "h", "n"])
    return work


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, item, item_text) pairs to hit ranges of words."""
    for whole in batches:
        for batch in byte_slices(whole, "text"):
            out = []
            docs, items = Words(batch.column(1)), batch.column(3)
            for i, (key, name) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                bench = Benchmark([name], items.slice(i, 1))
                one = Words(batch.column(1).slice(i, 1)) if batch.num_rows > 1 else docs
                out += [(key, name, s, e) for _, _, s, e in bench.hits(one)]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], type=t) for j, t in
                                              enumerate((pa.binary(), pa.string(), pa.int64(), pa.int64()))], names=["key", "item", "s", "e"])


def _shuffled(df: DataFrame, items: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The same by shuffled joins: texts are known by their hash, so copies are
    looked at once and a common passage meets distinct texts only."""
    def key(c):
        return F.unhex(F.sha2(F.coalesce(F.col(c), F.lit("")).cast("binary"), 256))

    source = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").alias("text")).withColumn("key", key("text"))
    texts = source.select("key", "text").where("length(text) > 0").dropDuplicates(["key"])
    item = items.select("item", "text", F.unhex(F.sha2(F.concat_ws("\x00", "item", "text").cast("binary"), 256)).alias("key")).dropDuplicates(["key"])
    schema = "key binary, length long, h long, n long"
    lengths = list(range(1, WINDOW + 1))
    of_item = stored(item.select("key", "text").mapInArrow(_prints(lengths), schema).where("length = n"), "item-prints")
    used = [r.length for r in of_item.select("length").distinct().collect()]
    of_doc = texts.mapInArrow(_prints(used), schema)
    pairs = of_doc.join(of_item.select("length", "h", F.col("key").alias("item_key")), ["length", "h"]).select("key", "item_key").distinct()
    full = pairs.join(item.select(F.col("key").alias("item_key"), "item", F.col("text").alias("item_text")), "item_key").join(texts, "key")
    hits = stored(full.select("key", "text", "item", "item_text").mapInArrow(_verify, "key binary, item string, s long, e long"), "hits")
    before = Window.partitionBy("key").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    fresh = hits.select("key", "s", "e").distinct().withColumn("done", F.coalesce(F.max("e").over(before), F.lit(0)))
    n_hit = fresh.groupBy("key").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "done"))).alias("n_hit"))
    names = hits.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))

    def count():
        return lambda column: [pa.array(np.diff(Words(column).first))]

    counted = add_columns(source, "text", RESULT[:1], count, ["row", "key"])
    out = counted.join(n_hit, "key", "left").join(names, "key", "left")
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                      F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def find_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
               keep: list[str] | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with ``n_words``, ``n_hit`` (words inside an occurrence of a
    benchmark window) and ``item_ids`` (items with occurring windows)."""
    new = {f.name for f in RESULT}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"),
                             F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 16)).first()[0] or 0
    if size > broadcast_bytes:
        return _shuffled(df, items, text_col, keep)
    rows = sorted((r.item, r.text) for r in items.collect())
    return _local(df, [r[0] for r in rows], [r[1].encode() for r in rows], text_col, keep)


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """One row per document: words, hit words, and the items that occur."""
    out = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", F.array_sort("item_ids")).cast("binary"), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


def drop_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without a hit word."""
    rows = docs.select(whole_row(docs).alias("row"), F.col("text"))
    return find_leaks(rows, table(spark, sf_dir, "benchmark"), keep=["row"]).where("n_hit = 0").select("row.*")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
iw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id, {_WORDS} AS ws FROM benchmark),
iwin AS (SELECT DISTINCT id, k, array_to_string(ws[i:i + k - 1], ' ') AS g
         FROM (SELECT id, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM iw WHERE len(ws) > 0)),
dwin AS (SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g
         FROM (SELECT r, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM iwin) WHERE len(ws) >= k)),
m AS (SELECT r, k, i, id FROM dwin JOIN iwin USING (k, g)),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
its AS (SELECT r, count(DISTINCT id) AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS s FROM m GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
