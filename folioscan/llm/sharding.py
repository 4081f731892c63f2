"""Sharding by a Feistel permutation with cycle walking over global row numbers (operator 10).

Every row gets a global number 0..N-1 that depends on the rows alone: rows are dealt to buckets by a hash of their key,
numbered inside the bucket, and offset by the buckets before. A keyed Feistel network permutes the numbers; a value at N
or above walks on through the permutation until it falls below N. The permuted number p gives shard p mod S and slot
p div S, so shard sizes differ by one row at most, and locate() and row_at() compute both ways without a table.

Law: "rows". Defined cases: null text counts as none (size 1), a very long text is read whole for its size and checksum; rows
are numbered also if doc_ids are null or repeat, rows that agree in doc_id, size and checksum are interchangeable; equal texts are spread like any other rows; an empty
table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm import common

SHARDS, SEED, ROUNDS = 16, 20240607, 6
#: Rows that a numbering bucket is planned for, and the most buckets: the offsets are a table of MAX_BUCKETS rows at most.
BUCKET_ROWS, MAX_BUCKETS = 20_000, 1 << 16


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _keys(seed: int) -> list[int]:
    with np.errstate(over="ignore"):
        return [int(_mix(np.array([seed + 1 + r], dtype=np.uint64), 2 * r + 1)[0]) for r in range(ROUNDS)]


def _half(n: int) -> int:
    """Bits of a half: the domain 2^(2 * half) holds n and is under 4n (or 4)."""
    return max(1, -(-max(1, n - 1).bit_length() // 2))


def _feistel(x: np.ndarray, half: int, keys: list[int], back: bool = False) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mix(left, key) & mask), left
        else:
            left, right = right, left ^ (_mix(right, key) & mask)
    return (left << np.uint64(half)) | right


def permute(numbers: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """The place of each number 0..n-1 in the reproducible shuffle of n rows; back: the number at each place."""
    with np.errstate(over="ignore"):
        keys, half = _keys(seed), _half(n)
        out = _feistel(numbers.astype(np.uint64), half, keys, back)
        while (out_of := out >= np.uint64(n)).any():
            out[out_of] = _feistel(out[out_of], half, keys, back)
    return out.astype(np.int64)


def locate(number: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of a global row number."""
    p = int(permute(np.array([number]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The global row number at a shard's slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """a's keys equal b's _keys, nulls too."""
    return functools.reduce(Column.__and__, [a[k].eqNullSafe(b[f"_{k}"]) for k in keys])


def numbered(light: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """light with a gapless long column row_number from 0, which depends on the rows' keys alone; and the row count.

    Rows that agree in all keys more often than a bucket is planned for come after the others. They are interchangeable, so
    they are numbered within tasks, and these by how many such rows there are before: no bucket holds them.
    """
    hot = light.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > BUCKET_ROWS).select(*[F.col(k).alias(f"_{k}") for k in keys])
    hot = common.materialise(hot, "shard-hot")
    if hot.isEmpty():
        return _numbered(light, keys)
    rest, total = _numbered(light.join(hot, _same(light, hot, keys), "left_anti"), keys)
    some = common.materialise(light.join(hot, _same(light, hot, keys), "left_semi").withColumn("_m", F.monotonically_increasing_id()), "shard-equal")
    some = some.withColumn("_part", F.shiftright("_m", 33))
    counts = some.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    # a row for each task that has such rows: at most as many as there are rows for BUCKET_ROWS, times tasks
    before = F.sum("_n").over(Window.orderBy(*[F.col(k).asc_nulls_first() for k in keys], "_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_task"), F.coalesce(before, F.lit(0)).alias("_before"))
    within = some.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_m")))
    placed = within.join(counts, _same(within, counts, keys) & (within["_part"] == counts["_task"]))
    placed = placed.select(*light.columns, (F.lit(total) + F.col("_before") + F.col("_at") - 1).alias("row_number"))
    return rest.select(*light.columns, "row_number").unionByName(placed), total + some.count()


def _numbered(light: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    rows = light.count()
    buckets = min(MAX_BUCKETS, max(1, -(-rows // BUCKET_ROWS)))
    dealt = light.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    counts = {r["_bucket"]: r["count"] for r in dealt.groupBy("_bucket").count().collect()}  # MAX_BUCKETS rows at most
    offsets, total = [], 0
    for b in range(buckets):
        offsets.append((b, total))
        total += counts.get(b, 0)
    table = light.sparkSession.createDataFrame(offsets, "_bucket int, _offset long")
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*[F.col(k).asc_nulls_first() for k in keys]))
    out = dealt.withColumn("_place", place).join(F.broadcast(table), "_bucket")
    return out.withColumn("row_number", F.col("_offset") + F.col("_place") - 1).drop("_bucket", "_offset", "_place"), total


def shard(light: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """light with row_number, shard int and slot long. light is read three times: hand over few, stored columns."""
    rows, n = numbered(light, keys)

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for numbers in batches:
            yield pd.Series(permute(numbers.to_numpy(), n, seed))

    rows = rows.withColumn("_p", place("row_number"))
    return rows.withColumn("shard", F.pmod("_p", F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"_p div {shards}")).drop("_p")


def query(spark, sf_dir):
    docs = common.read_table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    light = common.materialise(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "shard-rows")
    return shard(light, ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
