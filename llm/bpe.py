"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last 32 bytes cuts texts into chunks where its low bits
are zero, so passages that documents share give the same chunks wherever they
stand. Each distinct chunk is encoded once in the whole job, and the ids go
back to every document that holds it. A chunk's first and last word may go on in
its neighbours: at each join the words on both sides are encoded again as one,
over as many chunks as it takes to reach white space on either side, where the
tokenizer always cuts and both encodings agree.

Two shuffles, no text or id list twice in one of them from the same slice:
documents of a slice (a block) send each of their distinct chunks to the task
its hash names, packed and compressed by task; the ids come back packed to the
task of the block, which puts documents together. A chunk that a third of all
documents hold is one entry a block. The input should be a stored table (a
block is known by its partition and place, so a recomputed partition must hold
the same rows).

Defined cases: null and empty texts have no ids and decode to the empty text;
repeated rows get one row each; an empty table gives an empty table; columns of
the frame named like a result give way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm._batches import SPACE, Texts, add_columns, byte_slices, mix, table
from llm._pieces import PieceEncoder

#: Mean, least and largest bytes of a chunk; bytes of a block.
CHUNK, LEAST, LARGEST, BLOCK = 1024, 64, 16384, 6 << 20
_GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
#: Of the packed parts that are shuffled.
LEVEL = 6
_ROWS = "dest int, block long, kind int, part binary"
#: Ids that a task keeps of chunks it has seen; what an entry takes beside them.
STORE_BYTES, ENTRY_BYTES = 256 << 20, 150


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_chunks(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the chunks of all texts, and the index of each text's
    first. Cuts depend on the 32 bytes before them only, but that chunks shorter
    than LEAST go on and longer than LARGEST are cut, and never inside a character."""
    h = _GEAR[t.data]
    step = 1
    while step < 32:  # h of 1, 2, 4, ... 32 bytes
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    cut = np.flatnonzero((h >> np.uint32(32 - (CHUNK.bit_length() - 1))) == 0) + 1
    cut = cut[cut < len(t.data)]
    text = np.searchsorted(t.offsets, cut, side="right") - 1
    cut = cut[cut - t.offsets[text] >= 32]
    starts = np.unique(np.concatenate([t.offsets[:-1][np.diff(t.offsets) > 0], cut]))
    own = np.searchsorted(t.offsets, starts, side="right") - 1
    out: list[int] = []
    last = -1
    ends = np.append(starts[1:], len(t.data))
    for s, e, begins in zip(starts.tolist(), ends.tolist(), (starts == t.offsets[own]).tolist()):
        if begins or s - last >= LEAST:
            out.append(s)
            last = s
        while e - last > LARGEST:
            last += LARGEST
            out.append(last)
    starts = np.array(out, dtype=np.int64)
    while len(starts):
        inside = (t.data[starts] & 0xC0) == 0x80
        if not inside.any():
            break
        starts[inside] -= 1
    starts = np.unique(starts)
    return starts, np.searchsorted(starts, t.offsets)


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + b"".join(parts))


def _unpack(packed: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(data, dtype=np.int64, count=1)[0])
    size = np.frombuffer(data, dtype=np.int64, count=n, offset=8)
    ends = 8 * (n + 1) + np.cumsum(size)
    return [data[e - s:e] for s, e in zip(size.tolist(), ends.tolist())]


def _send(keep: int, n_dest: int):
    """Blocks of documents to their layout and their distinct chunks."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in byte_slices(whole, "__text", BLOCK):
                t = Texts.of(batch.column(keep))
                starts, first = cut_chunks(t)
                body = t.data.tobytes()
                digest = xxhash.xxh3_128_digest
                ends = np.append(starts[1:], len(t.data))
                names = [digest(body[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
                number: dict[bytes, int] = {}
                codes = np.fromiter((number.setdefault(x, len(number)) for x in names), dtype=np.int32, count=len(names))
                where = np.unique(codes, return_index=True)[1]
                dest = (np.frombuffer(b"".join(number), dtype=np.uint64)[::2] % np.uint64(n_dest)).astype(np.int64)
                chunks = [body[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())]
                head, tail = _open_ends(Texts.of(pa.array(chunks, type=pa.large_binary())))
                sink = pa.BufferOutputStream()
                rows = pa.RecordBatch.from_arrays(batch.columns[:keep], names=batch.schema.names[:keep])
                with pa.ipc.new_stream(sink, rows.schema) as writer:
                    writer.write_batch(rows)
                before = b"".join([c[:h] for c, h in zip(chunks, head.tolist())])
                after = b"".join([c[len(c) - z:] for c, z in zip(chunks, tail.tolist()) if z > 0])
                layout = _pack(np.diff(first), codes, head.astype(np.int32), tail.astype(np.int32), before, after, sink.getvalue().to_pybytes())
                out = [(int(block % n_dest), block, 0, layout)]
                for d in np.unique(dest):
                    mine = np.flatnonzero(dest == d)
                    inner = [chunks[i][head[i]:len(chunks[i]) - max(tail[i], 0)] for i in mine.tolist()]
                    out.append((int(d), block, 1, _pack(mine.astype(np.int32), np.array([len(x) for x in inner], dtype=np.int32), b"".join(inner))))
                yield _rows(out)
                block += 1
    return work


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)],
                                      names=["dest", "block", "kind", "part"])


def _open_ends(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of each chunk before its first white space, and after its last
    (-1: it has none, and all of it is open)."""
    at = np.flatnonzero(SPACE[t.data])
    lo, hi = np.searchsorted(at, t.offsets[:-1]), np.searchsorted(at, t.offsets[1:])
    some = hi > lo
    head, tail = np.diff(t.offsets), np.full(len(t), -1, dtype=np.int64)
    head[some] = at[lo[some]] - t.offsets[:-1][some]
    tail[some] = t.offsets[1:][some] - at[hi[some] - 1] - 1
    return head, tail


def _id_type(encoder: PieceEncoder) -> type:
    return np.uint16 if encoder.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32


def _encode_chunks(path: str):
    """What lies between the open ends of chunks is encoded, each distinct one
    of a task once (while ``STORE_BYTES`` hold them); every block that sent it gets its ids."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.shared(path, "words")
        digest, width = xxhash.xxh3_128_digest, _id_type(encoder)
        done: dict[bytes, bytes] = {}
        held = 0
        for whole in batches:
            for batch in byte_slices(whole, "part", BLOCK // 8):
                asked, fresh = [], {}
                for block, kind, part in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    if kind == 0:
                        yield _rows([(0, block, 0, part)])
                        continue
                    mine, size, text = _unpack(part)
                    ends = np.cumsum(np.frombuffer(size, dtype=np.int32), dtype=np.int64).tolist()
                    inner = [text[a:b] for a, b in zip([0, *ends], ends)]
                    names = [digest(x) for x in inner]
                    fresh.update((name, x) for name, x in zip(names, inner) if name not in done)
                    asked.append((block, mine, names))
                ids, first = encoder.encode(Texts.of(pa.array(list(fresh.values()), type=pa.large_binary())))
                ids = ids.astype(width)
                for i, name in enumerate(fresh):
                    done[name] = ids[first[i]:first[i + 1]].tobytes()
                    held += len(done[name]) + ENTRY_BYTES
                for block, mine, names in asked:
                    got = [done[x] for x in names]
                    yield _rows([(0, block, 1, _pack(mine, np.array([len(g) for g in got], dtype=np.int32), b"".join(got)))])
                if held > STORE_BYTES:  # a chunk that comes again is encoded again
                    done.clear()
                    held = 0
    return work


def _assemble(layout: bytes, parts: list[bytes], encoder: PieceEncoder) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Ids of a block's documents, the index of each document's first, and the
    block's other columns."""
    counts, codes, heads, tails, before, after, rows = _unpack(layout)
    counts, codes = np.frombuffer(counts, dtype=np.int64), np.frombuffer(codes, dtype=np.int32)
    heads, tails = np.frombuffer(heads, dtype=np.int32).astype(np.int64), np.frombuffer(tails, dtype=np.int32).astype(np.int64)
    n, opens = len(heads), tails < 0
    h, t = np.cumsum(heads).tolist(), np.cumsum(np.maximum(tails, 0)).tolist()
    head, tail = [before[a:b] for a, b in zip([0, *h], h)], [after[a:b] for a, b in zip([0, *t], t)]
    size, width = np.zeros(n + 1, dtype=np.int64), _id_type(encoder)
    bodies, order = [], []
    for part in parts:
        mine, sizes, ids = _unpack(part)
        order.append(np.frombuffer(mine, dtype=np.int32))
        size[order[-1]] = np.frombuffer(sizes, dtype=np.int32) // np.dtype(width).itemsize
        bodies.append(np.frombuffer(ids, dtype=width).astype(np.uint32))
    order = np.concatenate(order) if order else np.zeros(0, dtype=np.int32)
    if len(order) != n:
        raise RuntimeError("a block lacks chunks: its partition was recomputed with other rows")
    # what is encoded again: before, between and after the chunks of a document
    joins: list[bytes] = []
    sequence: list[int] = []  # bodies >= 0; join i as -1 - i
    first = [0]
    at = 0
    listed = codes.tolist()
    for count in counts.tolist():
        text: list[bytes] = []
        for code in listed[at:at + count]:
            text.append(head[code])
            if opens[code]:
                continue  # no white space: the window widens over the next chunk
            joins.append(b"".join(text))
            sequence += (-len(joins), code)
            text = [tail[code]]
        joins.append(b"".join(text))
        sequence.append(-len(joins))
        first.append(len(sequence))
        at += count
    join_ids, join_first = encoder.encode(Texts.of(pa.array(joins, type=pa.large_binary())))
    begin = np.zeros(n + 1, dtype=np.int64)
    begin[order] = np.cumsum(size[order]) - size[order]
    flat = np.concatenate([join_ids, *bodies]) if bodies else join_ids
    seq = np.array(sequence, dtype=np.int64)
    is_join = seq < 0
    start = np.where(is_join, join_first[np.where(is_join, -1 - seq, 0)], len(join_ids) + begin[np.where(is_join, 0, seq)])
    length = np.where(is_join, np.diff(join_first)[np.where(is_join, -1 - seq, 0)], size[np.where(is_join, 0, seq)])
    end = np.cumsum(length)
    where = np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - (end - length), length)
    return flat[where], np.concatenate([[0], end])[np.array(first)], rows


def decode_ids(ids: np.ndarray, first: np.ndarray, tokens: pa.Array) -> pa.Array:
    """Decoded texts (tokens joined by a space, as a tokenizer without a decoder does)."""
    lists = pa.LargeListArray.from_arrays(pa.array(first), tokens.take(pa.array(ids)))
    return pc.binary_join(lists, pa.scalar(b" ", type=pa.large_binary()))


#: Results to choose from.
FIELDS = {
    "n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(),
    "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(),
}


def _results(names: tuple[str, ...], ids: np.ndarray, first: np.ndarray, tokens: pa.Array) -> list[pa.Array]:
    decoded = decode_ids(ids, first, tokens) if {"decoded", "decoded_sha256"} & set(names) else None
    make = {
        "n_tokens": lambda: pa.array(np.diff(first)),
        "ids": lambda: pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32))),
        "decoded": lambda: pc.cast(decoded, pa.string()),
        "ids_sha256": lambda: pa.array([hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest() for a, b in zip(first, first[1:])], type=pa.string()),
        "decoded_sha256": lambda: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded], type=pa.string()),
    }
    return [make[x]() for x in names]


def _receive(path: str, names: list[str], results: tuple[str, ...]):
    """Rows sorted by block and kind to documents with their results."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.shared(path, "words")
        tokens = encoder.tokens()

        def done(layout, parts):
            ids, first, rows = _assemble(layout, parts, encoder)
            for batch in pa.ipc.open_stream(rows):
                yield pa.RecordBatch.from_arrays(batch.columns + _results(results, ids, first, tokens), names=names)

        block = layout = None
        parts: list[bytes] = []
        for batch in batches:
            for b, kind, part in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if kind == 0:
                    if layout is not None:
                        yield from done(layout, parts)
                    block, layout, parts = b, part, []
                elif b == block:
                    parts.append(part)
        if layout is not None:
            yield from done(layout, parts)
    return work


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, results: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
           keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of every row of ``df`` and the
    results of encoding its whole text and decoding the ids."""
    path = path or default_path()
    new = set(results)
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    fields = [T.StructField(x, FIELDS[x]) for x in results]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)] or [F.lit(0).alias("k0")], F.col(f"`{text_col}`").alias("__text"))
    sent = source.mapInArrow(_send(max(1, len(keep)), n), _ROWS)
    coded = sent.repartitionById(n, F.col("dest")).mapInArrow(_encode_chunks(path), _ROWS)
    home = coded.repartition(n, "block").sortWithinPartitions("block", "kind")
    kept = [df.schema[c] for c in keep] or [T.StructField("k0", T.IntegerType())]
    schema = T.StructType([T.StructField(f"k{i}", f.dataType) for i, f in enumerate(kept)] + fields)
    out = home.mapInArrow(_receive(path, schema.names, results), schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *results)


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with ``decoded``, the text of the ids in an array column (null: empty)."""
    path = path or default_path()
    packed = df.withColumn("__ids", F.coalesce(F.col(ids_col), F.array().cast("array<int>")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = PieceEncoder.shared(path, "words").tokens()
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pc.cast(decode_ids(ids, first, tokens), pa.string())],
                                             names=batch.schema.names[:-1] + ["decoded"])

    keep = [c for c in df.columns if c.lower() != "decoded"]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("decoded", T.StringType())])
    return packed.select(*keep, "__ids").mapInArrow(work, schema)


DIGEST = ("n_tokens", "ids_sha256", "decoded_sha256")


def op5_bpe_chunks(spark, sf_dir: str) -> DataFrame:
    """One row per document: number and digests of ids and decoded text."""
    return encode(table(spark, sf_dir, "documents"), results=DIGEST, keep=["doc_id"])


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: ids of every document that is left."""
    return encode(docs, results=DIGEST, keep=["doc_id"])
