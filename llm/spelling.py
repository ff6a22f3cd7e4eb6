"""Spelling variants of frequent words, found with k-d trees over letter counts.

Words are counted over all texts (partial counts in each task, one shuffle).
Two words that differ by one replaced code point have letter-count vectors at
L1 distance 2 at most, by one inserted code point at distance 1. So each length
is searched twice: for words of the same length within 2, and for words one
longer within 1.

The top of the tree is a shuffle: vectors summed over a few letter groups cut
the words of a length into boxes, and a word is sent only to the boxes within
reach of its own (each pair of boxes of one length meets once). Below, every box
gets a k-d tree of its own in one task; batches of words descend it together and
skip each branch whose bounding box is out of reach. What comes back is verified
letter by letter. A box of more than ``BOX_WORDS`` words is dealt to several
tasks, each with a tree of its part, so memory is bounded and no pair is lost.

The variant's form is its near word of largest count, if that is at least
``RATIO`` times its own; roots follow forms by pointer doubling (counts grow at
each step, so there is no cycle and the number of rounds is a logarithm of the
logarithm of the largest count).

Defined cases: null and empty texts have no words; a null id is hashed as an
empty string; repeated rows count each; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm._batches import mix, stored, table

MIN_CHARS, MIN_COUNT, RATIO, DROP_MOD = 5, 3, 2, 97
#: Letter groups of the boxes; words of one box in one task; points of a leaf.
GROUPS, BOX_WORDS, LEAF = 4, 50_000, 256
#: Words that a counting task holds before it hands partial counts on.
HELD = 300_000
#: Cells of a distance table worked out at once.
CELLS = 1 << 21
DIMS = 32
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


# -- counting ---------------------------------------------------------------
def _count_words(min_chars: int, drop_mod: int, held: int):
    """Task function: (id, text) to partial (word, n). One occurrence in
    ``drop_mod`` or so of a document's words loses a letter, by crc32."""
    runs = re.compile(f"[a-z\u00C0-\u00FF]{{{min_chars},}}").findall  # maximal runs, as shorter ones cannot match
    crc = zlib.crc32

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                found = runs(text.encode().translate(_LOWER).decode())
                base = crc(f"{'' if i is None else i}:".encode())
                cut = {}
                for word in [w for w in set(found) if not crc(w.encode(), base) % drop_mod]:
                    at = crc(word.encode(), base) % len(word)
                    cut[word] = word[:at] + word[at + 1:]
                total.update(map(cut.get, found, found) if cut else found)
                if len(total) > held:
                    yield flush()
                    total.clear()
        yield flush()

    return work


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_count: int = MIN_COUNT, drop_mod: int = DROP_MOD, held: int = HELD) -> DataFrame:
    """(word, n) of the words of enough code points and occurrences."""
    rows = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    parts = rows.mapInArrow(_count_words(min_chars, drop_mod, held), "word string, n long").where(F.char_length("word") >= min_chars)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# -- boxes --------------------------------------------------------------------
#: What a row does in a box: it is searched, or it searches (a box that is its
#: own, another of its length, or one of the next length).
SEARCHED, OWN, OTHER, LONGER = range(4)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)


def _vectors(codes: np.ndarray) -> np.ndarray:
    """Letter counts: a to z, and the other letters folded into the last
    dimensions (folding never lengthens a distance)."""
    n = len(codes)
    dim = np.where((codes >= 97) & (codes < 123), codes.astype(np.int64) - 97, 26 + codes % (DIMS - 26))
    at = dim + DIMS * np.arange(n)[:, None]
    return np.bincount(at.ravel(), minlength=n * DIMS).reshape(n, DIMS).astype(np.int32)


def _marks(vectors: np.ndarray) -> np.ndarray:
    """64 bits of which two vectors differ in no more than their distance: a
    bit for a letter that occurs, and one for a letter that occurs again."""
    return np.packbits(np.concatenate([vectors > 0, vectors > 1], axis=1), axis=1).view(np.uint64).ravel()


def _boxes(groups: int, search: bool = True):
    """Task function: (word, n) to rows (length, box, role, word, n); without
    ``search`` only the rows that are searched. Letter sums of a box are hashed
    to one number; two boxes of a length that fell together would only be one
    larger box."""
    same = [tuple((k == j) * 1 - (k == i) * 1 for k in range(groups)) for i, j in combinations(range(groups), 2)]
    longer = [tuple((k == i) * 1 for k in range(groups)) for i in range(groups)]
    moves = [(SEARCHED, [(0,) * groups])] + [(OWN, [(0,) * groups]), (OTHER, same), (LONGER, longer)] * search
    factors = mix(np.arange(1, groups + 1, dtype=np.uint64)).view(np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(0).to_pylist()
            letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
            length = np.array([len(w) for w in words])
            begin = np.cumsum(length) - length
            sums = np.stack([np.add.reduceat((letters % groups == g).astype(np.int64), begin) for g in range(groups)], axis=1)
            for role, ways in moves:
                for way in ways:
                    to = sums + np.array(way)
                    ok = np.flatnonzero((to >= 0).all(axis=1))
                    at = pa.array(ok)
                    yield pa.RecordBatch.from_arrays([
                        pa.array((length[ok] + (role == LONGER)).astype(np.int32)), pa.array((to[ok] * factors).sum(axis=1)),
                        pa.array(np.full(len(ok), role, dtype=np.int32)), batch.column(0).take(at), batch.column(1).take(at)], names=["length", "box", "role", "word", "n"])

    return work


# -- trees ----------------------------------------------------------------------
class Tree:
    """A k-d tree of integer points: nodes hold the bounding box of their
    points and are cut at the median of the widest dimension."""

    def __init__(self, points: np.ndarray, ids: np.ndarray | None = None, leaf: int = LEAF):
        self.ids = np.arange(len(points)) if ids is None else ids
        self.points, self.marks = points, None
        self.low, self.high = points.min(axis=0), points.max(axis=0)
        self.halves: list[Tree] = []
        wide = int(np.argmax(self.high - self.low))
        if len(points) > leaf and self.high[wide] > self.low[wide]:
            middle = np.partition(points[:, wide], (len(points) - 1) // 2)[(len(points) - 1) // 2]
            left = points[:, wide] <= middle if middle < self.high[wide] else points[:, wide] < middle
            self.halves = [Tree(points[m], self.ids[m], leaf) for m in (left, ~left)]
            self.points = None
        else:
            self.marks = _marks(points)

    def within(self, queries: np.ndarray, radius: int, marks: np.ndarray, at: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, point numbers) at L1 distance ``radius`` or less;
        ``marks``: those of the queries."""
        at = np.arange(len(queries)) if at is None else at
        q = queries[at]
        at = at[(np.maximum(self.low - q, 0) + np.maximum(q - self.high, 0)).sum(axis=1) <= radius]
        if not len(at):
            return
        for half in self.halves:
            yield from half.within(queries, radius, marks, at)
        if not self.halves:
            for b in range(0, len(self.marks), CELLS):  # equal points fill a leaf of any size
                there = self.marks[b:b + CELLS]
                step = max(1, CELLS // len(there))
                for a in range(0, len(at), step):
                    i, j = np.nonzero(np.bitwise_count(marks[at[a:a + step], None] ^ there[None]) <= radius)
                    i, j = at[a:a + step][i], j + b
                    near = np.abs(queries[i] - self.points[j]).sum(axis=1) <= radius
                    yield i[near], self.ids[j[near]]


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of code points differ by one replaced code point (equal
    widths) or by one more in ``b``."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    front = np.cumprod(a == b[:, :-1], axis=1).sum(axis=1)
    back = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= a.shape[1]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (length, box, block, role, word, n) sorted by the first four to
    near pairs: a searches b, which has its length or one code point more."""
    here, held, index = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
        marks = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(marks, marks[1:]):
            place, role = tuple(keys[:3, lo].tolist()), int(keys[3, lo])
            if place != here:
                here, held, index = place, [], None
            if role == SEARCHED:
                held.append(batch.slice(lo, hi - lo))
                continue
            if not held:
                continue  # an empty box
            if index is None:
                names = pa.concat_arrays([b.column(4) for b in held])
                n = pa.concat_arrays([b.column(5) for b in held])
                codes = _codes(names.to_pylist())
                index = names, n, codes, Tree(_vectors(codes))
            names, n, codes, tree = index
            asked, asked_n = batch.column(4).slice(lo, hi - lo), batch.column(5).slice(lo, hi - lo)
            own = _codes(asked.to_pylist())
            vectors = _vectors(own)
            for i, j in tree.within(vectors, 1 if role == LONGER else 2, _marks(vectors)):
                good = _one_edit(own[i], codes[j])
                i, j = pa.array(i[good]), pa.array(j[good])
                a, b, a_n, b_n = asked.take(i), names.take(j), asked_n.take(i), n.take(j)
                out = pa.RecordBatch.from_arrays([a, a_n, b, b_n], names=["a", "a_n", "b", "b_n"])
                if role == OWN:  # words of one box meet both ways
                    out = out.filter(pc.less(a, b))
                if out.num_rows:
                    yield out


def near_words(words: DataFrame, groups: int = GROUPS, box_words: int = BOX_WORDS) -> DataFrame:
    """Pairs (a, a_n, b, b_n) of ``words`` (word, n; distinct) that differ by one
    edit, each pair once."""
    base, place = words.select("word", "n"), "length int, box long, role int, word string, n long"
    rows = base.mapInArrow(_boxes(groups), place)
    large = (base.mapInArrow(_boxes(groups, search=False), place).groupBy("length", "box").agg(F.count("*").alias("c")).where(F.col("c") > box_words)
             .select("length", "box", F.ceil(F.col("c") / box_words).cast("int").alias("blocks")))
    dealt = rows.join(large, ["length", "box"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = dealt.withColumn("block", F.explode(F.when(F.col("role") == SEARCHED, F.array(F.pmod(F.hash("word"), F.col("blocks"))))
                                                 .otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    sent = placed.select("length", "box", "block", "role", "word", "n").repartition("length", "box", "block")
    return sent.sortWithinPartitions("length", "box", "block", "role").mapInArrow(_search, "a string, a_n long, b string, b_n long")


# -- forms -----------------------------------------------------------------------
def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form) without cycles, by pointer doubling."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = at.select(F.col("word").alias("w"), F.col("root").alias("r"))
        moved = at.join(step, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved"))
        held = stored(moved, "spelling-roots")
        at = held.select("word", "root")
        if not held.where("moved").limit(1).count():
            return at


def spelling_groups(words: DataFrame, ratio: int = RATIO, groups: int = GROUPS, box_words: int = BOX_WORDS) -> DataFrame:
    """One row per row of ``words`` (word, n; distinct, one letter or more):
    its form and that form's count (null if none), the root of its chain of
    forms, and the number of near words."""
    pairs = near_words(words, groups, box_words)
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                                         F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    top, top_n = F.col("best.near"), -F.col("best.less")
    has = top_n >= ratio * F.col("n")
    named = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, top).alias("form"), F.when(has, top_n).alias("form_n")), "spelling-forms")
    roots = _roots(named.where("form is not null"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_groups(spark, sf_dir: str) -> DataFrame:
    """One row per frequent word of the documents."""
    return spelling_groups(stored(word_counts(table(spark, sf_dir, "documents")), "spelling-words"))
