"""Jaccard self-join of word shingle sets by T-occurrence search (DivideSkip).

Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their
distinct shingles. A partner of a document of n shingles shares at least
T = ceil(percent / 100 * n) of them, so it occurs on T of the document's
inverted lists. The steps:

1. Inverted lists. Texts are cut into groups of a few megabytes; each group
   sends the postings of its distinct sets to the hash ranges of the shingles
   (packed: sorted hashes as differences, document numbers). A range merges its
   postings and answers each group with the lists that hold another set too, and
   their lengths. Lists of one are dropped: no partner is on them.
2. A set with fewer than T such lists has no partner. Of the others, the shortest
   lists, all but T - 1, must hold every partner; sets that meet on one of these
   are candidates. Each list names its smallest set only, and connected sets
   form a block: no pair is written.
3. Inside a block the sets are searched one after another by DivideSkip over the
   block's own inverted lists: the short lists are merged by a heap, documents
   seen T - L times are probed in the L long lists by binary search, and those
   with the required overlap are linked. Found sets leave the lists, so the links
   are a spanning forest, never all pairs, with the same components.
4. A block of more than ``BLOCK`` shingles is dealt to several tasks, with one
   common set among them; what is not yet in its largest class then searches all
   parts. Memory is bounded by a part; time there grows with the sets outside
   the largest class.

Equal sets are searched once, told apart by a 64-bit hash; shingles are told
apart by XXH64.

Defined cases: null texts and texts without words have no shingles and link with
nothing (each is its own component); repeated rows get a row each; a null id
counts as larger than every other, and a component of null ids only has a null
id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm._batches import SLICE_BYTES, Texts, byte_slices, mix, stored, table
from llm.components import components
from llm.simhash import _shingle_hashes

WORDS, PERCENT = 4, 85
#: Text bytes of a group, hash ranges of a partition, shingles of a part of a block.
GROUP_BYTES, RANGES, BLOCK = 8 << 20, 4, 250_000
#: Weight of a binary probe against a merge step in the choice of L.
PROBE = 0.0085


# -- packing --------------------------------------------------------------------
def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length, bytes of equal weight together, compressed."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(body: bytes, *kinds: str) -> list[np.ndarray]:
    data, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), dtype=np.uint8), [], 0
    widths = [np.dtype(k).itemsize for k in kinds]
    n = len(data) // sum(widths)
    for kind, width in zip(kinds, widths):
        out.append(np.ascontiguousarray(data[at:at + n * width].reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return out


def _least(n: np.ndarray | int, percent: int):
    """Fewest shingles that a set of ``n`` shares with a partner."""
    return -(-percent * n // 100)


# -- 1. inverted lists ---------------------------------------------------------
MEMBERS = "ids array<long>, which array<int>, node array<long>, n array<int>"


def _postings(words: int, ranges: int, group_bytes: int):
    """Task function: (id, text) to rows (range, g, members or postings of a group)."""
    def group(g: int, held: list) -> Iterator[pa.RecordBatch]:
        ids = [i for part, _, _ in held for i in part.to_pylist()]
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.concatenate([n for _, _, n in held]))
        h = np.concatenate([x for _, x, _ in held])
        held.clear()
        order = np.argsort(h, kind="stable")
        h, d = h[order], doc[order]
        del order, doc
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[first], d[first]
        n = np.bincount(d, minlength=len(ids)).astype(np.int32)
        node = mix(n.astype(np.uint64))
        by_doc = np.argsort(d, kind="stable")
        full = np.flatnonzero(n)
        if len(full):
            node[full] += np.add.reduceat(mix(h[by_doc] + np.uint64(1)), (np.cumsum(n) - n)[full])
        sets, one = np.unique(node[full], return_index=True)  # equal sets once
        which = np.full(len(ids), -1, dtype=np.int32)
        which[full] = np.searchsorted(sets, node[full])
        kept = np.zeros(len(ids), dtype=bool)
        kept[full[one]] = True
        h, d = h[kept[d]], which[d[kept[d]]]
        at = ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        edges = np.searchsorted(at, np.arange(ranges + 1, dtype=np.uint64))
        rows = [r for r in range(ranges) if edges[r] < edges[r + 1]]
        bodies = [_pack(np.diff(h[a:b], prepend=np.uint64(0)), d[a:b].astype(np.uint32)) for a, b in ((edges[r], edges[r + 1]) for r in rows)]
        none = [None] * len(rows)
        yield pa.RecordBatch.from_arrays([
            pa.array([g % ranges] + rows, pa.int32()), pa.array([g] * (len(rows) + 1), pa.int64()),
            pa.array([ids] + none, pa.list_(pa.int64())), pa.array([which] + none, pa.list_(pa.int32())),
            pa.array([sets.view(np.int64)] + none, pa.list_(pa.int64())), pa.array([n[full[one]]] + none, pa.list_(pa.int32())),
            pa.array([None] + bodies, pa.binary())], names=["range", "g", "ids", "which", "node", "n", "body"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a group's number must be the same if its task runs again
        g, held, size = TaskContext.get().partitionId() << 32, [], 0
        for whole in batches:
            for batch in byte_slices(whole, "text", min(group_bytes, SLICE_BYTES)):
                hashes, begin = _shingle_hashes(Texts.of(batch.column(1)), words)
                held.append((batch.column(0), hashes, np.diff(begin)))
                size += batch.column(1).nbytes
                if size >= group_bytes:
                    yield from group(g, held)
                    g, held, size = g + 1, [], 0
        if held:
            yield from group(g, held)

    return work


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range to rows (g, members or body): each group's postings
    on lists of two sets or more, with the length of the list."""
    def answer(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(body, "uint64", "uint32") for _, body in held]
        h = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        d = np.concatenate([p[1] for p in parts])
        of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.argsort(h, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        size = np.diff(np.append(begin, len(h)))
        length = np.empty(len(h), dtype=np.uint32)
        length[order] = np.repeat(size, size)
        rows = []
        for i, (g, _) in enumerate(held):
            lo, hi = np.searchsorted(of, [i, i + 1])
            pick = np.flatnonzero(length[lo:hi] > 1) + lo
            if len(pick):
                rows.append((g, _pack(np.diff(h[pick], prepend=np.uint64(0)), d[pick], length[pick])))
        none = [None] * len(rows)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.int64()), pa.array(none, pa.list_(pa.int64())), pa.array(none, pa.list_(pa.int32())),
                                              pa.array(none, pa.list_(pa.int64())), pa.array(none, pa.list_(pa.int32())), pa.array([b for _, b in rows], pa.binary())],
                                             names=["g", "ids", "which", "node", "n", "body"])

    here, held = None, []
    for batch in batches:
        place, body = batch.column(0).to_pylist(), batch.column(6)
        members = body.is_null()
        if members.true_count:
            some = batch.filter(members)
            yield pa.RecordBatch.from_arrays(some.columns[1:], names=["g", "ids", "which", "node", "n", "body"])
        groups = batch.column(1).to_pylist()
        for i, r in enumerate(place):
            if not body[i].is_valid:
                continue
            if r != here and held:
                yield from answer(held)
                held = []
            here = r
            held.append((groups[i], body[i].as_py()))
    if held:
        yield from answer(held)


# -- 2. candidates ------------------------------------------------------------------
def _chosen(percent: int):
    """Task function: rows sorted by g, members first, to the sets that may have
    a partner: (node, n, keys ordered by list length, how many of them are short)."""
    def group(node, n, bodies) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(b, "uint64", "uint32", "uint32") for b in bodies]
        h = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        d, length = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        have = np.bincount(d, minlength=len(node))
        least = _least(n.astype(np.int64), percent)
        ok = have >= least
        pick = ok[d]
        h, d, length = h[pick], d[pick], length[pick]
        order = np.lexsort((h, length, d))
        h, d = h[order], d[order]
        edges = np.searchsorted(d, np.arange(len(node) + 1))
        for i in np.flatnonzero(ok & (have > 0)):
            keys = h[edges[i]:edges[i + 1]].view(np.int64)
            yield int(node[i]), int(n[i]), keys, keys[:have[i] - least[i] + 1]

    def batch_of(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                           pa.array([r[2].tobytes() for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                                          names=["node", "n", "keys", "short"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, node, n, bodies = None, None, None, []

        def done():
            if bodies and node is not None:
                rows = []
                for r in group(node, n, bodies):
                    rows.append(r)
                    if sum(len(x[2]) for x in rows[-64:]) > 400_000 or len(rows) >= 512:
                        yield batch_of(rows)
                        rows.clear()
                if rows:
                    yield batch_of(rows)

        for batch in batches:
            for i, g in enumerate(batch.column(0).to_pylist()):
                if g != here:
                    yield from done()
                    here, node, n, bodies = g, None, None, []
                if batch.column(3)[i].is_valid:
                    node, n = (np.array(batch.column(c)[i].as_py(), dtype=np.int64) for c in (3, 4))
                else:
                    bodies.append(batch.column(5)[i].as_py())
        yield from done()

    return work


# -- 3. DivideSkip -------------------------------------------------------------------
class Lists:
    """Inverted lists over some sets, for T-occurrence searches among those
    still alive."""

    def __init__(self, n: np.ndarray, keys: list[np.ndarray], percent: int):
        self.n, self.percent = n, percent
        self.names, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        self.doc = np.repeat(np.arange(len(n)), [len(k) for k in keys])
        self.of = np.split(inverse, np.cumsum([len(k) for k in keys])[:-1])
        self.alive = np.ones(len(n), dtype=bool)
        self._lay(inverse, self.doc)

    def _lay(self, lists: np.ndarray, doc: np.ndarray) -> None:
        order = np.argsort(lists, kind="stable")
        self.lists, self.docs = lists[order], doc[order]
        self.start = np.searchsorted(self.lists, np.arange(len(self.names) + 1))
        self.place = self.lists * len(self.n) + self.docs  # ascending
        self.laid = int(self.alive.sum())

    def drop(self, gone: np.ndarray) -> None:
        """Take sets out; the lists are laid anew when half of them are dead."""
        self.alive[gone] = False
        left = int(self.alive.sum())
        if left and 2 * left < self.laid:
            keep = self.alive[self.docs]
            self._lay(self.lists[keep], self.docs[keep])

    def search(self, n: int, lists: np.ndarray) -> np.ndarray:
        """Alive sets that link with a set of ``n`` shingles on these lists."""
        length = self.start[lists + 1] - self.start[lists]
        lists = lists[np.argsort(length, kind="stable")]
        length = np.sort(length)
        lists, length = lists[length > 0], length[length > 0]
        least = int(_least(n, self.percent))
        if len(lists) < least or not len(lists):
            return np.zeros(0, dtype=np.int64)
        long = min(int(least / (PROBE * np.log2(max(2, length[-1])) + 1)), least - 1)
        short = len(lists) - long
        merged = heapq.merge(*[self.docs[self.start[x]:self.start[x + 1]].tolist() for x in lists[:short].tolist()])
        seen = [(doc, sum(1 for _ in same)) for doc, same in groupby(merged)]
        seen = [(doc, k) for doc, k in seen if k >= least - long and self.alive[doc]]
        if not seen:
            return np.zeros(0, dtype=np.int64)
        doc, count = (np.array(x, dtype=np.int64) for x in zip(*seen))
        step = max(1, (1 << 20) // len(doc))
        for a in range(short, len(lists), step):
            probe = lists[a:a + step, None] * len(self.n) + doc[None]
            at = np.minimum(np.searchsorted(self.place, probe), len(self.place) - 1)
            count += (self.place[at] == probe).sum(axis=0)
        return doc[100 * count >= self.percent * (n + self.n[doc] - count)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the lists of ``keys`` (those that exist)."""
        at = np.minimum(np.searchsorted(self.names, keys), len(self.names) - 1)
        return at[self.names[at] == keys]


def _forest(n: np.ndarray, keys: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links with the components of all links: each set searches those not yet reached."""
    index, out = Lists(n, keys, percent), []
    for root in range(len(n)):
        if not index.alive[root]:
            continue
        index.drop(np.array([root]))
        queue = [root]
        while queue and index.alive.any():
            x = queue.pop()
            found = index.search(int(n[x]), index.of[x])
            if len(found):
                out += [(x, int(y)) for y in found]
                index.drop(found)
                queue.extend(found.tolist())
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows sorted by block and part, cut at each part."""
    here, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(2)])
        marks = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(marks, marks[1:]):
            place = tuple(key[:, lo].tolist())
            if place != here and held:
                yield held
                held = []
            here = place
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held


def _column(held: list[pa.RecordBatch], i: int) -> np.ndarray:
    return np.concatenate([b.column(i).to_numpy() for b in held])


def _keys(held: list[pa.RecordBatch], i: int) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=np.int64) for b in held for x in b.column(i)]


def _link_batch(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _inside(percent: int):
    """Task function: rows (block, part, node, n, keys) to links inside each part."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _parts(batches):
            node, n = _column(held, 2), _column(held, 3)
            if len(node) > 1:
                links = _forest(n, _keys(held, 4), percent)
                yield _link_batch([node[i] for i, _ in links], [node[j] for _, j in links])

    return work


def _across(percent: int):
    """Task function: rows (block, part, asks, node, n, keys, class) sorted by
    block, part and asks: the sets that ask search the others, for one link
    into each other class."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _parts(batches):
            asks, node, n, keys, group = _column(held, 2), _column(held, 3), _column(held, 4), _keys(held, 5), _column(held, 6)
            there, asking = np.flatnonzero(asks == 0), np.flatnonzero(asks == 1)
            if not len(there):
                continue
            index, a, b = Lists(n[there], [keys[i] for i in there], percent), [], []
            for q in asking:
                found = there[index.search(int(n[q]), index.find(keys[q]))]
                found = found[group[found] != group[q]]
                _, one = np.unique(group[found], return_index=True)
                a += [node[q]] * len(one)
                b += node[found[one]].tolist()
            yield _link_batch(a, b)

    return work


# -- the join ----------------------------------------------------------------------------
def _block_links(sets: DataFrame, found: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) between the candidate ``sets`` (node, n, keys) that ``found``
    (node, root) puts into one block."""
    rows = stored(sets.join(found, "node").select(F.col("root").alias("block"), "node", "n", "keys"), "jaccard-blocks")
    parts = rows.groupBy("block").agg(F.ceil(F.sum("n") / block).cast("int").alias("parts"))
    dealt = rows.join(parts, "block")
    own = F.array(F.pmod(F.hash("node"), F.col("parts")))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    part = F.explode(F.when(F.col("node") == F.col("block"), every).otherwise(own))
    sent = dealt.select("block", part.alias("part"), "node", "n", "keys").repartition("block", "part").sortWithinPartitions("block", "part")
    inside = stored(sent.mapInArrow(_inside(percent), "a long, b long"), "jaccard-links")
    large = dealt.where("parts > 1")
    if not large.limit(1).count():
        return inside
    classes = components(inside)
    named = stored(large.join(classes, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root"), "jaccard-classes")
    sizes = named.groupBy("block", "class").agg(F.count("*").alias("c"))
    best = sizes.groupBy("block").agg(F.max(F.struct("c", "class")).alias("m")).select("block", F.col("m.class").alias("most"))
    asks = F.explode(F.when(F.col("class") == F.col("most"), F.array(F.struct(F.lit(0).alias("asks"), F.pmod(F.hash("node"), F.col("parts")).alias("part")))).otherwise(
        F.concat(F.array(F.struct(F.lit(0).alias("asks"), F.pmod(F.hash("node"), F.col("parts")).alias("part"))),
                 F.transform(every, lambda p: F.struct(F.lit(1).alias("asks"), p.alias("part"))))))
    asked = named.join(best, "block").withColumn("to", asks).select("block", "to.part", "to.asks", "node", "n", "keys", "class")
    asked = asked.repartition("block", "part").sortWithinPartitions("block", "part", "asks")
    return inside.unionByName(asked.mapInArrow(_across(percent), "a long, b long"))


def similar_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
                 group_bytes: int = GROUP_BYTES, block: int = BLOCK) -> DataFrame:
    """One row per row of ``df``: ``id``, ``n_shingles`` (long) and
    ``component_id`` (smallest id reachable over links, the own one included)."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = partitions * RANGES
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    posted = base.mapInArrow(_postings(words, ranges, group_bytes), f"range int, g long, {MEMBERS}, body binary")
    dealt = posted.repartitionById(partitions, F.expr(f"range div {RANGES}").cast("int")).sortWithinPartitions("range")
    lists = stored(dealt.mapInArrow(_answers, f"g long, {MEMBERS}, body binary"), "jaccard-lists")
    groups = lists.repartition("g").sortWithinPartitions("g", F.col("body").isNotNull())
    chosen = groups.mapInArrow(_chosen(percent), "node long, n long, keys binary, short array<long>")
    sets = stored(chosen.dropDuplicates(["node"]), "jaccard-sets")
    short = sets.select(F.explode("short").alias("key"), "node")
    hubs = short.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1")
    meet = stored(short.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "jaccard-meet")
    links = stored(_block_links(sets.drop("short"), components(meet), percent, block), "jaccard-links")
    found = components(links)

    top = F.lit((1 << 63) - 1)
    members = lists.where(F.col("node").isNotNull())
    rows = members.select(F.inline(F.arrays_zip("ids", "which")), F.col("node").alias("nodes"), F.col("n").alias("sizes")).select(
        F.col("ids").alias("id"), F.when(F.col("which") >= 0, F.get("nodes", F.col("which"))).alias("node"),
        F.when(F.col("which") >= 0, F.get("sizes", F.col("which"))).otherwise(0).cast("long").alias("n_shingles"))
    rows = stored(rows, "jaccard-rows")
    nodes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.coalesce("id", top)).alias("least"))
    nodes = stored(nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-nodes")
    least = nodes.groupBy("root").agg(F.min("least").alias("component"))
    named = stored(nodes.join(least, "root").select(F.col("node").alias("named"), "component"), "jaccard-named")
    return rows.join(named, F.col("node") == F.col("named"), "left").select(
        "id", "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.nullif("component", top)).alias("component_id"))


def op12_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """One row per document: size of its shingle set, and component."""
    return similar_sets(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


_W = "[^\\x20\\x09-\\x0D]+"
ORACLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS ws FROM documents),
sh AS (SELECT DISTINCT r, array_to_string(ws[i:i + 3], ' ') AS s FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(r, z) AS (SELECT r, r FROM n UNION SELECT reach.r, link.y FROM reach JOIN link ON reach.z = link.x),
least AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.z GROUP BY reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN least USING (r)
"""
