"""Token-id files: one zstandard frame a document, under a shared dictionary.

A file set is a folder of Parquet tables, so any store that Spark writes will do
and a task that is run again replaces its own file:

* ``dictionary``: one row, ``hash`` (SHA-256) and ``bytes`` of the dictionary,
  ``end_id``, and ``width`` (2 or 4 bytes an id, little-endian, unsigned);
* ``segments``: rows in ascending order of document id, each with ``shard`` and
  ``number`` (its place), ``dict_hash``, ``first_id`` and ``last_id``, ``start``
  (ids of the shard before it), and for its documents the arrays ``doc_ids``,
  ``n_tokens`` and ``offsets`` (one more than documents) into ``payload``, the
  frames end to end.

A reader gets at one short document with the segment's row and one frame. The
dictionary is trained on the serialized ids of a bounded sample of documents
(``SAMPLE_DOCS`` by hash, ``SAMPLE_CHARS`` characters of each); it
bears on the size only. All documents are encoded whole.

Defined cases: null and empty texts hold the end id alone; documents without id
come first; rows that repeat an id are kept, in order of their text's hash; an
empty table gives a file set without segments; other columns are not stored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm._batches import Texts, byte_slices, hash_sample, shared_folder, table
from llm._pieces import PieceEncoder

END_ID, LEVEL = 2, 3
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 2000, 8000, 64 << 10
SLICE_BYTES, SEGMENT_BYTES = 12 << 20, 1 << 20
_SEGMENT = ("shard int, number int, dict_hash string, first_id long, last_id long, start long, doc_ids array<long>, "
            "n_tokens array<long>, offsets array<long>, payload binary")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _serialized(t: Texts, encoder: PieceEncoder, end_id: int, width: int) -> tuple[bytes, np.ndarray]:
    """Ids of all texts with the end id after each, as bytes, and the index of
    each text's first id."""
    ids, first = encoder.encode(t)
    out = np.insert(ids, first[1:], end_id).astype("<u2" if width == 2 else "<u4")
    return out.tobytes(), first + np.arange(len(first))


def _dictionary(content: bytes):
    """A trained dictionary, or plain content where training had too few samples."""
    return zstandard.ZstdCompressionDict(content) if content else None


def train_dictionary(samples: list[bytes]) -> bytes:
    samples = [s for s in samples if s]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def write(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
          end_id: int = END_ID) -> None:
    """Encodes every text of ``df`` into a file set at ``path``."""
    spark = df.sparkSession
    tokenizer = tokenizer or default_path()
    width = 2 if max(PieceEncoder.shared(tokenizer, "spaced").tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.shared(tokenizer, "spaced")
        for batch in batches:
            data, first = _serialized(Texts.of(batch.column(0)), encoder, end_id, width)
            yield pa.RecordBatch.from_arrays([pa.array([data[width * a:width * b] for a, b in zip(first, first[1:])], type=pa.binary())], names=["ids"])

    sample = hash_sample(docs.withColumn("text", F.substring("text", 1, SAMPLE_CHARS)), SAMPLE_DOCS, "id", "text")
    content = train_dictionary(sorted(bytes(r.ids) for r in sample.select("text").mapInArrow(serialize, "ids binary").collect()))
    name = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(name, content, end_id, width)], "hash string, bytes binary, end_id int, width int").coalesce(1).write.parquet(f"{path}/dictionary")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.shared(tokenizer, "spaced")
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(content), write_content_size=True)
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                data, first = _serialized(Texts.of(batch.column(1)), encoder, end_id, width)
                frames = [packer.compress(data[width * a:width * b]) for a, b in zip(first.tolist(), first[1:].tolist())]
                ends = np.cumsum([len(f) for f in frames])
                cut = np.flatnonzero(np.diff(ends // SEGMENT_BYTES)) + 1
                edges = [0, *cut.tolist(), len(frames)]
                rows = []
                for a, b in zip(edges, edges[1:]):
                    ids, n = batch.column(0).slice(a, b - a).to_pylist(), np.diff(first[a:b + 1]).tolist()
                    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames[a:b]])]).tolist()
                    rows.append((shard, number, name, ids[0], ids[-1], start, ids, n, offsets, b"".join(frames[a:b])))
                    number, start = number + 1, start + sum(n)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(
                    (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))],
                    names=["shard", "number", "dict_hash", "first_id", "last_id", "start", "doc_ids", "n_tokens", "offsets", "payload"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(n, F.asc_nulls_first("id"), "h").sortWithinPartitions(F.asc_nulls_first("id"), "h")
    ordered.select("id", "text").mapInArrow(segments, _SEGMENT).write.option("compression", "none").parquet(f"{path}/segments")


class Reader:
    """A file set. ``frames`` and ``documents`` decode; nothing else is read whole."""

    def __init__(self, spark: SparkSession, path: str):
        head = spark.read.parquet(f"{path}/dictionary").first()
        self.spark, self.name, self.content, self.end_id, self.width = spark, head.hash, bytes(head.bytes), head.end_id, head.width
        if hashlib.sha256(self.content).hexdigest() != self.name:
            raise ValueError("the dictionary does not match its hash")
        self.segments = spark.read.schema(_SEGMENT).parquet(f"{path}/segments")

    def _decoded(self, rows: DataFrame, schema: str, make, wanted: set | None = None) -> DataFrame:
        """``make(ids)`` for each document of the segments (of ``wanted`` only),
        after its id, start within the shard, and number of tokens."""
        name, content, kind = self.name, self.content, "<u2" if self.width == 2 else "<u4"

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(content))
            for batch in batches:
                cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
                for i in range(batch.num_rows):
                    if cols["dict_hash"][i].as_py() != name:
                        raise ValueError("a segment was written under another dictionary")
                    payload, offsets = cols["payload"][i].as_buffer(), cols["offsets"][i].as_py()
                    start = cols["start"][i].as_py()
                    out = []
                    for j, (doc, n) in enumerate(zip(cols["doc_ids"][i].as_py(), cols["n_tokens"][i].as_py())):
                        if wanted is None or doc in wanted:
                            ids = np.frombuffer(unpacker.decompress(payload[offsets[j]:offsets[j + 1]]), dtype=kind)
                            if len(ids) != n:
                                raise ValueError("a frame does not hold its number of ids")
                            out.append((cols["shard"][i].as_py(), doc, start, n, make(ids)))
                        start += n
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], type=t) for k, t in enumerate(types)],
                                                     names=["shard", "id", "start", "n_tokens", "value"])

        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64() if schema == "long" else pa.list_(pa.int64())]
        cols = ["shard", "dict_hash", "start", "doc_ids", "n_tokens", "offsets", "payload"]
        return rows.select(cols).mapInArrow(work, f"shard int, id long, start long, n_tokens long, value {schema}")

    def documents(self, ids: list[int]) -> DataFrame:
        """``doc_id``, ``n_tokens`` and ``ids`` of some documents: only segments
        whose range holds one are read, and only their frames decompressed."""
        wanted = set(ids)
        near = F.lit(False)
        for i in sorted(wanted):
            near = near | ((F.col("first_id").isNull() | (F.col("first_id") <= i)) & (F.col("last_id") >= i))
        out = self._decoded(self.segments.where(near), "array<long>", lambda x: x.tolist(), wanted)
        return out.select(F.col("id").alias("doc_id"), "n_tokens", F.col("value").alias("ids"))

    def checksums(self) -> DataFrame:
        """For every document: ``doc_id``, ``start`` (ids of all documents
        before it), ``n_tokens`` and ``ids_crc32`` (of 32-bit ids)."""
        n_ids = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
        sums = {r.shard: r.n for r in self.segments.groupBy("shard").agg(F.sum(n_ids).alias("n")).collect()}  # one row a shard
        before, total = {}, 0
        for shard in sorted(sums):
            before[shard] = total
            total += sums[shard]
        bases = self.spark.createDataFrame(list(before.items()), "shard int, base long")
        out = self._decoded(self.segments, "long", lambda x: zlib.crc32(x.astype("<u4").tobytes()))
        return out.join(F.broadcast(bases), "shard").select(
            F.col("id").alias("doc_id"), (F.col("start") + F.col("base")).alias("start"), "n_tokens", F.col("value").alias("ids_crc32"))


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    """One row per document, from the files: start, length and CRC-32 of its ids."""
    path = shared_folder(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path)
    return Reader(spark, path).checksums()
