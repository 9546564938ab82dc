"""Sharding: a uniform shuffle with exact shard sizes from a hypergeometric matrix.

The rows are dealt to source partitions by a hash. The number of rows that each
source partition sends to each shard is drawn exactly, from the multivariate
hypergeometric distribution, so the shard sizes are the ones asked for (counts
at most one apart, law ``rows``). Each partition is permuted locally, its first
rows go to shard 0, the next to shard 1 and so on as drawn; after the exchange
each shard is permuted again, which gives the slots.

Both permutations order by seeded hashes of the row, so a task that runs again
makes the same choice. The matrix is drawn in tasks, by a tree of splits.
A shard is not ordered in one task: slots are ranks within
(shard, bucket) plus the number of rows in the buckets before.

Edge cases: a null text has size 1 and the CRC-32 of no bytes; null ids are
dealt like others; rows that are equal in both id and text differ only by rank,
so any order of them is the same result; an empty table gives an empty result;
only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, text_of

N_SHARDS = 8
SEED = 20240229
ROWS_PER_PARTITION = 20_000
#: Branches of a node in the tree of splits.
FAN = 1024


def shard_sizes(n: int, n_shards: int) -> list[int]:
    return [n // n_shards + (j < n % n_shards) for j in range(n_shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """One exact draw; numpy draws up to 10**9 rows, beyond that the law is inverted outwards from its mode."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(good, sample)
    mode = min(max((sample + 1) * (good + 1) // (good + bad + 2), low), high)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at = math.exp(choose(good, mode) + choose(bad, sample - mode) - choose(good + bad, sample))
    left = rng.random() - at
    up, down, p, q = mode, mode, at, at
    while left > 0 and (up < high or down > low):
        if up < high:
            p *= (good - up) * (sample - up) / ((up + 1) * (bad - sample + up + 1))
            up += 1
            left -= p
            if left <= 0:
                return up
        if down > low:
            q *= down * (bad - sample + down) / ((good - down + 1) * (sample - down + 1))
            down -= 1
            left -= q
            if left <= 0:
                return down
    return mode


def matrix(counts: list[int], room: list[int], rng: np.random.Generator) -> np.ndarray:
    """Exact counts of rows that each of ``counts`` puts into each of ``room``; rows sum to ``counts``, columns to ``room``."""
    left = [int(x) for x in room]
    out = np.zeros((len(counts), len(room)), dtype=np.int64)
    for p, n in enumerate(counts):
        rest, behind = int(n), sum(left)
        for j in range(len(left)):
            behind -= left[j]
            out[p, j] = hypergeometric(rng, left[j], behind, rest) if rest else 0
            rest -= int(out[p, j])
            left[j] -= int(out[p, j])
    return out


def _dealt(seed: int, level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("child")
        rng = np.random.default_rng([seed, level, int(rows["node"].iloc[0])])
        drawn = matrix(rows["n"].tolist(), list(rows["room"].iloc[0]), rng)
        return pd.DataFrame({"node": rows["child"].to_numpy(), "room": list(drawn)})

    return deal


def allotted(counts: DataFrame, sizes: list[int], n_parts: int, seed: int) -> DataFrame:
    """part and room (its rows for each shard) of all source partitions ``counts`` (part, n), drawn by a tree of splits.

    A node of the tree stands for up to ``FAN`` nodes below it; the rows that it
    may put into each shard are dealt among them in one task, so no task and no
    driver sees more than ``FAN`` counts.
    """
    levels = 1
    while FAN**levels < n_parts:
        levels += 1
    rooms = counts.sparkSession.createDataFrame([(0, sizes)], "node bigint, room array<bigint>")
    for level in range(levels - 1, -1, -1):
        below = counts.groupBy(F.floor(F.col("part") / FAN**level).cast("long").alias("child")).agg(F.sum("n").alias("n"))
        below = below.withColumn("node", F.floor(F.col("child") / FAN).cast("long")).join(rooms, "node")

        rooms = below.groupBy("node").applyInPandas(_dealt(seed, level), "node bigint, room array<bigint>")
    return rooms.select(F.col("node").cast("int").alias("part"), "room")


def shuffle(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    text = text_of()
    n = docs.count()
    n_parts = max(8 * n_shards, -(-n // rows_per_partition))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), "doc_id", text).alias("first_key"),
        F.xxhash64(F.lit(seed + 1), "doc_id", text).alias("second_key"),
    ).withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 2), "first_key"), F.lit(n_parts)).cast("int"))
    rooms = allotted(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")), shard_sizes(n, n_shards), n_parts, seed)
    # For each shard, the local rank at which the part's rows for it end.
    ends = F.transform("room", lambda x, i: F.aggregate(F.slice("room", 1, i + 1), F.lit(0).cast("long"), lambda t, y: t + y))
    deal = rooms.select("part", ends.alias("ends"))
    local = W.partitionBy("part").orderBy("first_key", "doc_id", "size")
    ranked = rows.withColumn("rank", F.row_number().over(local)).join(deal, "part")
    shard = F.size(F.filter("ends", lambda e: e < F.col("rank")))
    n_buckets = max(1, n_parts // n_shards)
    sent = ranked.select("doc_id", "size", "text_crc32", "second_key", shard.cast("int").alias("shard"))
    # The bucket is the leading part of the unsigned second key, so buckets are in the order of keys.
    bucket = F.floor((F.shiftrightunsigned("second_key", 33).cast("double") / float(1 << 31)) * n_buckets).cast("int")
    sent = sent.withColumn("bucket", bucket)
    sizes = sent.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = W.partitionBy("shard", "bucket").orderBy(F.shiftrightunsigned("second_key", 1), "second_key", "doc_id", "size")
    placed = sent.withColumn("rank", F.row_number().over(within)).join(before, ["shard", "bucket"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_hypergeometric_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle(table(spark, sf_dir, "documents"))


QUERIES = {"op7_hypergeometric_shuffle": op7_hypergeometric_shuffle}
ORACLES: dict[str, str] = {}
