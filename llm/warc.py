"""WARC files of pages, and a Merkle fixity audit of their replicas.

``write`` packs pages into WARC/1.1 files (one gzip member a record, about
``FILE_BYTES`` each), kept as rows (shard, file, content) of a Parquet table so
that any store will do, with an index of every record's byte range.

The audit hashes, for each replica, every record's bytes with its offset and
length (leaves), and builds trees over the ordered ranges: ``FANOUT`` children a
node within a file, then files of a shard, then shards. Trees of two replicas
are compared from the root; only the children of nodes that differ are looked
at, level by level, down to the records that are damaged or missing.

Defined cases: null html and URLs are written as empty ones; pages without id
come first; repeated pages are records of their own; an empty table gives no
files, and a clean audit; other columns of the pages are not written. A file
that a replica lacks has all its records missing; bytes after the last record
differ as a range of their own (``page_id`` null).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm._batches import byte_slices, shared_folder, stored, table

FILE_BYTES, FANOUT, LEVELS = 4 << 20, 16, 3
DATE = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str, body: bytes) -> bytes:
    """One WARC record, uncompressed."""
    digest = hashlib.sha256(body).hexdigest()
    name = hashlib.md5(f"{page_id}\n{url}\n{digest}".encode()).hexdigest()
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}>",
            f"WARC-Date: {DATE}", "WARC-Target-URI: " + " ".join(url.split()), f"WARC-Payload-Digest: sha256:{digest}",
            "Content-Type: text/html; charset=utf-8", f"WARC-Page-Id: {'' if page_id is None else page_id}", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member (no time stamp, so equal records are equal bytes)."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, body) of the records of a WARC file."""
    at, step = 0, 1 << 16
    while at < len(content):
        unpacker = zlib.decompressobj(31)
        out, place = [], at
        while not unpacker.eof:
            if place >= len(content):
                raise ValueError(f"the record at {at} is cut off")
            out.append(unpacker.decompress(content[place:place + step]))
            place = min(place + step, len(content))
        end = place - len(unpacker.unused_data)
        head, _, rest = b"".join(out).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
        yield at, end - at, fields, rest[:int(fields["Content-Length"])]
        at = end


_FILES = "shard int, file string, content binary, records array<struct<seq:int,page_id:long,url:string,offset:long,length:long>>"


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the pages as WARC files at ``path`` and returns the table of files:
    ``shard``, ``file``, ``content`` and ``records`` (the index)."""
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"),
                        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    rows = rows.withColumn("h", F.xxhash64("url", "html")).repartitionByRange(n, F.asc_nulls_first("page_id"), "h").sortWithinPartitions(
        F.asc_nulls_first("page_id"), "h").drop("h")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = TaskContext.get().partitionId(), 0
        body, index, offset = [], [], 0

        def done() -> pa.RecordBatch:
            name = f"part-{shard:06d}-{number:06d}.warc.gz"
            kind = pa.list_(pa.struct([("seq", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([shard], type=pa.int32()), pa.array([name]), pa.array([b"".join(body)], type=pa.binary()),
                                               pa.array([index], type=kind)], names=["shard", "file", "content", "records"])

        for whole in batches:
            for batch in byte_slices(whole, "html"):
                for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    data = member(record(page_id, url, html.encode()))
                    index.append({"seq": len(index), "page_id": page_id, "url": url, "offset": offset, "length": len(data)})
                    body.append(data)
                    offset += len(data)
                    if offset >= FILE_BYTES:
                        yield done()
                        body, index, offset, number = [], [], 0, number + 1
        if body:
            yield done()

    rows.mapInArrow(pack, _FILES).write.option("compression", "none").parquet(path)
    return spark.read.schema(_FILES).parquet(path)


def read(files: DataFrame) -> DataFrame:
    """Records of WARC files (``file``, ``content``): file, offset, length, page_id, url, html."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(name, at, n, int(h["WARC-Page-Id"]) if h["WARC-Page-Id"] else None, h["WARC-Target-URI"], b.decode()) for at, n, h, b in parse(content)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(
                    (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["file", "offset", "length", "page_id", "url", "html"])

    return files.select("file", "content").mapInArrow(work, "file string, offset long, length long, page_id long, url string, html string")


def leaves(files: DataFrame) -> DataFrame:
    """(shard, file, seq, hash) of the files of one replica (shard, file,
    records, content) at the byte ranges of their index; a range that is not
    there (or a null content) has a null hash. The last leaf of a file is what
    follows its records."""
    both = files.select("shard", "file", "records.offset", "records.length", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, name, offset, length = (batch.column(c)[i].as_py() for c in range(4))
                content = batch.column(4)[i].as_buffer()
                data = memoryview(content) if content is not None else None
                out = []
                for a, n in zip(offset, length):
                    whole = data is not None and a + n <= len(data)
                    out.append(hashlib.sha256(np.array([a, n], dtype="<i8").tobytes() + bytes(data[a:a + n])).digest() if whole else None)
                end = offset[-1] + length[-1] if offset else 0
                out.append(hashlib.sha256(bytes(data[end:])).digest() if data is not None else None)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(out), type=pa.int32()), pa.array([name] * len(out)),
                                                  pa.array(range(len(out)), type=pa.int32()), pa.array(out, type=pa.binary())], names=["shard", "file", "seq", "hash"])

    return both.mapInArrow(work, "shard int, file string, seq int, hash binary")


def _joined(nodes: DataFrame, by: list[str], order: str) -> DataFrame:
    """Parents of nodes: the hash of their children's hashes in order (at most
    FANOUT children, files of a shard, or shards)."""
    child = F.struct(F.col(order).alias("o"), F.coalesce(F.hex("hash"), F.lit("missing")).alias("h"))
    text = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(child)), lambda x: F.concat_ws(":", x.o.cast("string"), x.h)))
    return nodes.groupBy(*by).agg(F.unhex(F.sha2(text.cast("binary"), 256)).alias("hash"))


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels of the tree, leaves first: nodes of 1, 16, 256, 4096 records of a
    file, then files (a few top nodes each), shards, and the root. The nodes of
    16 records are stored; what is above them is a fraction of their size."""
    levels = [leaf.withColumnRenamed("seq", "node")]
    for i in range(LEVELS):
        up = levels[-1].withColumn("up", F.floor(F.col("node") / FANOUT).cast("int"))
        level = _joined(up, ["shard", "file", "up"], "node").withColumnRenamed("up", "node")
        levels.append(level if i else stored(level, "nodes"))
    top = levels[-1]
    files = _joined(top, ["shard", "file"], "node")
    shards = _joined(files, ["shard"], "file")
    root = _joined(shards.withColumn("all", F.lit(1)), ["all"], "shard")
    return [*levels, files, shards, root]


def audit(ours: DataFrame, replica: DataFrame) -> DataFrame:
    """Records of ``ours`` (as ``write`` returns it) whose bytes differ in
    ``replica`` (file, content): shard, file, seq, offset, length, page_id, url
    and ``status`` (changed, missing, or trailing). A file that only the replica
    has is one row ``extra``, one that it has several times a row ``repeated``
    (without seq); of the latter the copy with the least SHA-256 is compared."""
    index = ours.select("shard", "file", "records")
    copies = stored(replica.groupBy("file").agg(F.count("*").alias("copies")), "copies")
    extra = copies.join(index.select("file"), "file", "left_anti").select("file", F.lit("extra").alias("status"), F.lit(None).cast("int").alias("shard"))
    repeated = copies.where("copies > 1").join(index.select("file", "shard"), "file").select("file", F.lit("repeated").alias("status"), "shard")
    twice = repeated.select("file")
    least = Window.partitionBy("file").orderBy("digest")
    one = (replica.select("file", "content").join(twice, "file", "left_semi").withColumn("digest", F.sha2("content", 256))
           .withColumn("k", F.row_number().over(least)).where("k = 1").select("file", "content"))
    replica = replica.select("file", "content").join(twice, "file", "left_anti").unionByName(one)
    mine = tree(stored(leaves(ours), "leaves"))
    theirs = tree(stored(leaves(index.join(replica.select("file", "content"), "file", "left")), "leaves"))
    keys = [["all"], ["shard"], ["shard", "file"]] + [["shard", "file", "node"]] * (LEVELS + 1)
    differ = None
    for depth, (a, b, by) in enumerate(zip(reversed(mine), reversed(theirs), keys)):
        if depth == 1:  # children of the root
            a = a.join(F.broadcast(differ), F.lit(1) == F.col("all"), "left_semi")
        elif depth in (2, 3):  # files of a shard, top nodes of a file
            a = a.join(differ, keys[depth - 1], "left_semi")
        elif depth > 3:
            above = differ.withColumnRenamed("node", "up")
            a = a.withColumn("up", F.floor(F.col("node") / FANOUT).cast("int")).join(above, ["shard", "file", "up"], "left_semi").drop("up")
        seen = a.join(b.withColumnRenamed("hash", "other"), by, "left")
        differ = seen.where(~F.col("hash").eqNullSafe(F.col("other"))).select(*by, *(["other"] if depth == len(keys) - 1 else []))
    found = differ.withColumnRenamed("node", "seq")
    records = index.select("shard", "file", F.inline("records"))
    out = found.join(records, ["shard", "file", "seq"], "left")
    status = F.when(F.col("other").isNull(), "missing").when(F.col("offset").isNull(), "trailing").otherwise("changed")
    damaged = out.select("shard", "file", "seq", "offset", "length", "page_id", "url", status.alias("status"))
    return damaged.unionByName(extra.unionByName(repeated), allowMissingColumns=True)


def damaged_replica(files: DataFrame) -> DataFrame:
    """A second copy of the files in which some went bad: one bit of each record
    whose page id hashes to 0 of 100 is flipped, and of each 24 shards the files
    of one lack their last byte, those of the next are lost, those of the third
    are there twice, and those of the fourth under another name as well."""
    bad = F.transform(F.filter("records", lambda r: F.pmod(F.xxhash64(r.page_id), F.lit(100)) == 0), lambda r: r.offset + F.floor(r.length / 2))
    fate = F.pmod("shard", F.lit(24))
    short = fate == 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content, places, cut in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                data = bytearray(content)
                for p in places:
                    data[p] ^= 1
                out.append(bytes(data[:len(data) - cut]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.binary())], names=["file", "content"])

    names = (F.when(fate == 3, F.array("file", "file")).when(fate == 4, F.array(F.col("file"), F.concat(F.lit("copy-of-"), "file"))).otherwise(F.array("file")))
    held = files.where(fate != 2).select(F.explode(names).alias("file"), "content", bad.alias("bad"), short.cast("int").alias("cut"))
    return held.mapInArrow(work, "file string, content binary")


def op7_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """The pages as WARC files, and every record found damaged in a replica."""
    files = write(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    return audit(files, damaged_replica(files)).select("page_id", "url", "file", "seq", "offset", "length", "status")
