"""Helpers shared by the text operators: Arrow batches in byte-bounded slices,
and vectorised word boundaries over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20


def byte_table(characters: bytes) -> np.ndarray:
    """True at the bytes of ``characters``."""
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(characters, dtype=np.uint8)] = True
    return table


#: ASCII white space: x20 and x09 to x0D.
SPACE = byte_table(b" \t\n\x0b\x0c\r")
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Texts:
    """The UTF-8 bytes of several texts: ``data`` end to end, text i in
    ``data[offsets[i]:offsets[i + 1]]``. Nulls are empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    @classmethod
    def of(cls, column: pa.Array) -> "Texts":
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary()).fill_null(b"")
        _, off, data = column.buffers()
        offsets = np.frombuffer(off, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        if data is None or len(column) == 0:
            return cls(np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64))
        return cls(np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def words(self, is_separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends (byte positions) of the maximal runs of bytes that
        are no separators, none across two texts, and the index of the first
        word of each text (one more entry than texts)."""
        inside = ~is_separator[self.data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(self.data))]
        begin[edges] = inside[edges]
        end[edges - 1] = inside[edges - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings ``data[starts[i]:ends[i]]`` of ascending, disjoint
    ranges as one Arrow array."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    if len(starts) and offsets[-1] != len(data):
        mark = np.zeros(len(data) + 1, dtype=np.int8)
        mark[starts] += 1
        np.subtract.at(mark, ends, 1) if len(np.unique(ends)) != len(ends) else mark.__setitem__(ends, mark[ends] - 1)
        data = data[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each text's range ``first[i]:first[i + 1]``."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def byte_slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` holding about ``limit`` bytes of the
    named text column, one row at least; no text is cut."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes, dtype=np.int64) // max(1, limit)
    starts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        yield batch.slice(a, b - a)


def add_columns(df: DataFrame, text_col: str, fields: list[T.StructField],
                make: Callable[[], Callable[[pa.Array], list[pa.Array]]], keep: list[str] | None = None,
                slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``df`` with columns worked out from its text column.

    ``make()`` runs once in each task and returns a function from a text
    column (an Arrow array) to the new columns. ``keep``: the columns that
    stay (default: all). A column of ``df`` named like a new one (names
    compare without case) gives way to it.
    """
    new = {f.name.lower() for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    out = T.StructType([df.schema[c] for c in keep] + fields)
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for batch in byte_slices(whole, "__text", slice_bytes):
                yield pa.RecordBatch.from_arrays(batch.columns[:-1] + f(batch.column(len(keep))), names=keep + [x.name for x in fields])

    return source.mapInArrow(work, out)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder named by ``spark.checkpoint.dir``; a private
    one only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="llm-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the
    lineage, and a lost executor costs no recomputation."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame):
    """The row as one struct, whatever its columns are called: a stage that
    carries it apart from its own columns gives every value back as it was."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hash_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most ``rows`` rows, those of the smallest hash of ``keys``. A threshold
    on the hash leaves about three times as many before any task gathers its
    smallest, so what reaches one place does not grow with the number of tasks."""
    n, h = df.count(), F.xxhash64(*keys)
    if n > 3 * rows:
        df = df.where(F.pmod(h, F.lit(1 << 40)) < (1 << 40) * 3 * rows // n)
    return df.orderBy(F.pmod(h, F.lit(1 << 40)), h).limit(rows)


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range (ascending and disjoint, none empty)."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(begin - starts, lengths)
    place = at - np.repeat(starts, lengths)
    powers = np.full(int(lengths.max()) + 1, _FACTOR, dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    return mix(np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * powers[place], begin))
