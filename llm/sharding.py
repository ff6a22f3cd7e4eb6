"""Shards of near equal bytes by Karmarkar-Karp differencing.

Rows of equal text stay together; a group weighs the bytes of all its rows. The
differencing method keeps partial partitions (``n_shards`` sums each, largest
first), takes the two of largest spread again and again, and adds them in
opposite order, so that large sums meet small ones.

It runs in tasks: groups are dealt by hash into buckets of about ``BUCKET``
groups, each task differences its groups down to one partial partition, and
the partial partitions of ``FAN`` buckets are differenced in turn, level by
level, until one is left. No group list passes through the driver.

Defined cases: null texts weigh and group as empty ones; a group heavier than a
shard's share fills its shard alone as far as balance allows (groups are never
split); repeated rows get a slot each; an empty table gives an empty table;
other columns are left out, so none can clash.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm._batches import stored, table

BUCKET, FAN = 32_768, 512
#: Bytes that a row costs beside its text.
ROW_BYTES = 16


def difference(weights: np.ndarray, n_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Differencing of partial partitions (rows of ``weights``: sums, largest
    first). Returns the sums of the last one, largest first, and for each input
    and each of its parts the part of the last one that holds it."""
    n, k = weights.shape
    sums = list(weights)
    left = np.zeros(max(n - 1, 0), dtype=np.int64)
    right = np.zeros(max(n - 1, 0), dtype=np.int64)
    orders = np.zeros((max(n - 1, 0), k), dtype=np.int32)
    heap = [(int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    for step in range(n - 1):
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        sums.append(both[order])
        sums[a] = sums[b] = None
        left[step], right[step], orders[step] = a, b, order
        heapq.heappush(heap, (int(sums[-1][-1] - sums[-1][0]), n + step))
    # from the last partition down: which of its parts holds each part
    where = [None] * (2 * n - 1)
    where[-1] = np.arange(k, dtype=np.int32)
    for step in range(n - 2, -1, -1):
        own, order = where[n + step], orders[step]
        of_left = np.empty(k, dtype=np.int32)
        of_left[order] = own
        where[left[step]] = of_left
        where[right[step]] = of_left[::-1]
        where[n + step] = None
    return sums[-1], np.stack(where[:n])


def _first_level(n_shards: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "text_key"], ascending=[False, True], ignore_index=True)
        weights = np.zeros((len(pdf), n_shards), dtype=np.int64)
        weights[:, 0] = pdf["weight"]
        sums, where = difference(weights, n_shards)
        own = pd.DataFrame({"bucket": pdf["bucket"], "text_key": pdf["text_key"], "part": where[:, 0], "weight": pdf["weight"]})
        parts = pd.DataFrame({"bucket": pdf["bucket"][0], "text_key": None, "part": np.arange(n_shards), "weight": sums})
        return pd.concat([own, parts], ignore_index=True)
    return work


def _next_level(n_shards: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "part"], ignore_index=True)
        buckets = pdf["bucket"].to_numpy()[::n_shards]
        sums, where = difference(pdf["weight"].to_numpy().reshape(-1, n_shards), n_shards)
        up = pdf["up"][0]
        down = pd.DataFrame({"up": up, "bucket": np.repeat(buckets, n_shards), "part": np.tile(np.arange(n_shards), len(buckets)), "up_part": where.ravel(), "weight": 0})
        parts = pd.DataFrame({"up": up, "bucket": -1, "part": -1, "up_part": np.arange(n_shards), "weight": sums})
        return pd.concat([down, parts], ignore_index=True)
    return work


def shard_groups(groups: DataFrame, n_shards: int) -> DataFrame:
    """(text_key, shard) for groups (text_key, weight)."""
    n = groups.count()
    buckets = max(1, -(-n // BUCKET))
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("text_key"), F.lit(buckets)))
    first = stored(dealt.select("bucket", "text_key", "weight").groupBy("bucket").applyInPandas(
        _first_level(n_shards), "bucket long, text_key string, part int, weight long"), "shards-0")
    placed = first.where("text_key is not null").select("text_key", "bucket", "part")
    sums = first.where("text_key is null").select("bucket", "part", "weight")
    while buckets > 1:
        buckets = -(-buckets // FAN)
        level = stored(sums.withColumn("up", F.floor(F.col("bucket") / FAN)).groupBy("up").applyInPandas(
            _next_level(n_shards), "up long, bucket long, part int, up_part int, weight long"), "shards")
        down = level.where("bucket >= 0").select("bucket", "part", "up", "up_part")
        placed = placed.join(down, ["bucket", "part"]).select("text_key", F.col("up").alias("bucket"), F.col("up_part").alias("part"))
        sums = level.where("bucket < 0").select(F.col("up").alias("bucket"), F.col("up_part").alias("part"), "weight")
    return placed.select("text_key", F.col("part").alias("shard"))


def shard(df: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, ``size``, ``text_crc32``, ``shard`` and
    ``slot`` (gapless from 0 within the shard)."""
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = stored(df.select(
        F.col(f"`{id_col}`").alias("id"), (F.octet_length(body) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), F.md5(body).alias("text_key"), F.monotonically_increasing_id().alias("row")), "sizes")
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("weight"))
    held = rows.join(shard_groups(groups, n_shards), "text_key").select("id", "size", "text_crc32", "shard", "row")
    # slots: rows are counted by shard and block, and numbered inside blocks
    n_blocks = max(1, -(-rows.count() // BUCKET))
    held = held.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)))
    held = stored(held, "shard-rows")
    counts = held.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row")) - 1
    return held.withColumn("place", place).join(base, ["shard", "block"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("place") + F.col("base")).cast("long").alias("slot"))


def op3_kk_shards(spark, sf_dir: str) -> DataFrame:
    """One row per document: its shard of 40 under the law ``bytes``."""
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
