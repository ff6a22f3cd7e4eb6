"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint per text: a bit is 1 where it is set in over half the
XXH64 hashes of the text's word shingles. Two fingerprints link when at most
``max_bits`` bits differ. To find links, fingerprints are cut into the fewest
segments for which one must differ by at most one bit (``max_bits`` 4: three
segments); each segment is indexed once for every wildcard position, so a
segment that differs in one bit meets its partner in the variant that masks
this bit. Variants meet by equality after one shuffle of (key, fingerprint)
rows of distinct fingerprints only; every meeting is verified on all 64 bits.

Inside a set of fingerprints that share a variant the links are gathered as a
spanning forest: at most one row per member, never all pairs, with the same
connected components. Large sets are first cut again by the same method over
the bits that are not shared, so no comparison of all members is needed.

Defined cases: null and empty texts have fingerprint 0 and link like any other;
repeated rows get one row each; a null id counts as larger than every other, and
a component of null ids only has a null id; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm._batches import LOWER, SPACE, Texts, add_columns, stored, table, whole_row
from llm.components import components

WORDS, MAX_BITS, SEED = 4, 4, 42
#: Sets above this size are cut again over their other bits.
DENSE = 2048
_SPREAD = np.zeros(256, dtype=np.uint64)  # bit i of a byte, in byte i of a word
for _i in range(8):
    _SPREAD |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_i)) & np.uint64(1)) << np.uint64(8 * _i)


def _shingle_hashes(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and the index of each text's first."""
    data = LOWER[texts.data]
    starts, ends, first = texts.words(SPACE)
    inside = ~SPACE[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # a word and the one separator after it
    place = np.cumsum(keep) - keep
    joined = data[keep]
    if len(starts):
        s, e = place[starts], place[starts] + (ends - starts)
    else:
        s = e = starts
    gap = e < len(joined)
    joined[e[gap][~_starts_word(s, e, gap)]] = 32
    body = joined.tobytes()
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(n_words - words + 1, 1), 0)
    begin = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=begin[1:])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], n) + np.repeat(first[:-1], n)
    last = np.minimum(at + words - 1, np.repeat(first[1:], n) - 1)
    digest = xxhash.xxh64_intdigest
    out = np.fromiter((digest(body[a:b], SEED) for a, b in zip(s[at].tolist(), e[last].tolist())), dtype=np.uint64, count=len(at))
    return out, begin


def _starts_word(s: np.ndarray, e: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Where a word follows the last one without a separator (another text)."""
    out = np.zeros(int(gap.sum()), dtype=bool)
    nxt = np.append(s[1:], -1)[gap]
    out[:] = nxt == e[gap]
    return out


def fingerprints(texts: Texts, words: int = WORDS) -> np.ndarray:
    """The fingerprint (unsigned 64 bits) of each text."""
    hashes, begin = _shingle_hashes(texts, words)
    n = np.diff(begin)
    counts = np.zeros((len(n), 64), dtype=np.int64)
    full = np.flatnonzero(n)
    if len(full):
        # counters of 8 bits hold blocks of up to 255 hashes
        blocks = -(-n[full] // 255)
        firsts = np.repeat(begin[:-1][full], blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        block_of = np.cumsum(blocks) - blocks
        for i, byte in enumerate(hashes.view(np.uint8).reshape(-1, 8).T):
            held = np.add.reduceat(_SPREAD[byte], firsts)
            counts[full, 8 * i:8 * i + 8] = np.add.reduceat(held.view(np.uint8).reshape(-1, 8).astype(np.int64), block_of, axis=0)
    bits = (2 * counts > n[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def add_fingerprint(df: DataFrame, text_col: str = "text", words: int = WORDS, keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``fingerprint`` (the 64 bits as a signed long)."""
    def make():
        return lambda column: [pa.array(fingerprints(Texts.of(column), words).view(np.int64))]

    return add_columns(df, text_col, [T.StructField("fingerprint", T.LongType())], make, keep)


def _segments(n_bits: int, max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by at most one bit."""
    k = max_bits // 2 + 1
    edges = [round(i * n_bits / k) for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what links of at most ``max_bits`` bits connect: each
    round compares one member with all not yet reached."""
    out, left = [], fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _popcount(left ^ x) <= max_bits
            if near.any():
                found = left[near]
                out.append((np.full(len(found), x), found))
                left = left[~near]
                queue.extend(found)
    return out


def _links(fps: np.ndarray, free: list[int], max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning links among distinct fingerprints that may differ only in the
    ``free`` bits."""
    if len(fps) <= DENSE or len(free) < 12:
        return _forest(fps, max_bits)
    out = []
    for a, width in _segments(len(free), max_bits):
        for skip in range(a, a + width):
            shared = [free[i] for i in range(a, a + width) if i != skip]
            mask = np.uint64(sum(1 << b for b in shared))
            key = fps & mask
            order = np.argsort(key, kind="stable")
            cut = np.flatnonzero(np.diff(key[order])) + 1
            rest = [b for b in free if b not in set(shared)]
            for group in np.split(fps[order], cut):
                if 1 < len(group) < len(fps):
                    out += _links(group, rest, max_bits)
                elif len(group) == len(fps):
                    return out + _forest(group, max_bits)
    return out


def _variants(fp: str, max_bits: int):
    """Array of (variant number, segment with one bit masked) keys, as longs."""
    keys = []
    for a, width in _segments(64, max_bits):
        for skip in range(a, a + width):
            mask = ((1 << width) - 1) & ~(1 << (skip - a))
            value = F.shiftrightunsigned(F.col(fp), a).bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))
            keys.append(value + F.lit(skip << 40).cast("long") if width <= 40 else F.xxhash64(F.lit(skip), value))
    return F.array(*keys)


def _join_variants(max_bits: int):
    """Task function: (key, fp) rows sorted by key to links (a, b)."""
    skip_of = {skip: (a, width) for a, width in _segments(64, max_bits) for skip in range(a, a + width)}

    def sets(batches: Iterator[pa.RecordBatch]):
        key, fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        held: list = []
        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            held.append((k, f))
            if k[0] == k[-1] and held[0][0][0] == k[0]:
                continue  # all of one key so far
            key, fp = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            last = np.searchsorted(key, key[-1])
            yield key[:last], fp[:last]
            held = [(key[last:], fp[last:])]
        if held:
            yield tuple(np.concatenate([x[i] for x in held]) for i in (0, 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in sets(b for b in batches if b.num_rows):
            found = []
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(begin, len(key)))
            for i in begin[size == 2]:
                if _popcount(fp[i] ^ fp[i + 1]) <= max_bits:
                    found.append((fp[i:i + 1], fp[i + 1:i + 2]))
            for i, n in zip(begin[size > 2], size[size > 2]):
                skip = int(key[i] >> 40)
                a, width = skip_of.get(skip, (0, 0))
                free = [b for b in range(64) if not a <= b < a + width or b == skip]
                found += _links(fp[i:i + n], free, max_bits)
            if found:
                a, b = (np.concatenate([x[j] for x in found]).view(np.int64) for j in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return work


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints (column
    ``fingerprint``): a spanning set with the components of all links."""
    rows = distinct.select(F.explode(_variants("fingerprint", max_bits)).alias("key"), F.col("fingerprint").alias("fp"))
    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_join_variants(max_bits), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``df``: the id, ``fingerprint`` (long) and
    ``component_id`` (smallest id reachable over links)."""
    base = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    prints = stored(add_fingerprint(base, words=words, keep=["id"]), "simhash")
    top = F.lit((1 << 63) - 1)
    nodes = stored(prints.groupBy("fingerprint").agg(F.min(F.coalesce("id", top)).alias("least")), "simhash-nodes")
    links = stored(fingerprint_links(nodes, max_bits).distinct(), "simhash-links")
    found = components(links)  # node, root
    ids = nodes.join(found, nodes.fingerprint == found.node)
    of_root = ids.groupBy("root").agg(F.min("least").alias("least"))
    linked = found.join(of_root, "root").select(F.col("node").alias("fingerprint"), F.col("least").alias("joint"))
    # stored, so that both sides of the last join are plain shuffles and a hot fingerprint can be split
    named = stored(nodes.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("joint", "least").alias("component")), "simhash-named")
    return prints.join(named, "fingerprint").select(
        F.col("id").alias(id_col), "fingerprint", F.nullif("component", top).alias("component_id"))


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: fingerprint as 16 hex digits, and component."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: exactly one row of each component, the one with the smallest
    id (nulls last), then text hash, then row key. Rows are told apart by a
    stored row key, never by id, so null and repeated ids lose no other row."""
    kept = docs.select(whole_row(docs).alias("all"), F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"),
                       F.xxhash64("text").alias("hash"), "text")
    rows = stored(add_fingerprint(kept, keep=["all", "row", "id", "hash"]), "simhash-rows")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "hash", "row")
    nodes = stored(rows.groupBy("fingerprint").agg(F.min(order).alias("best")), "simhash-nodes")
    links = stored(fingerprint_links(nodes).distinct(), "simhash-links")
    found = components(links)  # node, root: the smallest fingerprint
    named = nodes.join(found, nodes.fingerprint == found.node, "left").select(F.coalesce("root", "fingerprint").alias("component"), "best")
    best = named.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    return rows.join(best, "row", "left_semi").select("all.*")
