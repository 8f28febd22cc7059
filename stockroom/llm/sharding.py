"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, records are range-partitioned.

Records are ordered by (hash of the text, number of the written record), so equal texts stand together. A sample weighted by size (each
record draws a key ``-log(u) / size``, the smallest keys are taken) gives the boundaries of many more ranges than
shards. The ranges' exact sizes are then summed; ranges that came out overfull are sampled again inside and
subdivided. Whole ranges are dealt to shards in order, cut where the running sum of bytes comes nearest to each
shard's share. Law: ``bytes``; a shard misses its share by less than a range, that is a small fraction of a shard.
A group of equal texts may be parted: boundaries fall into one that is as large as a range, also if its rows are equal
in all columns.

Everything the driver gets is bounded by the sample's size. Defined results. Null text: no bytes, size 1, CRC-32 0.
Null ``doc_id`` and repeated rows: ordinary records (equal texts stand in the order in which they were written). A text
larger than a shard's share fills a shard alone. Other columns are ignored. An empty table gives an empty result. With fewer records than
shards some shards stay empty.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_batches

SHARDS = 8
#: Ranges for each shard, and sampled records for each range.
RANGES_A_SHARD = 128
SAMPLES_A_RANGE = 12
#: A range is overfull beyond so many times the mean, and is subdivided so often at most.
OVERFULL = 2.0
ROUNDS = 4

Key = tuple[int, int]


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the order key (h, k) of each record: a few bytes in place of the text."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("k"),
    )


def sample(records: DataFrame, n: int, seed: int = 0) -> list[Key]:
    """Keys of ``n`` records drawn with chances in proportion to size, in order. The draw is a hash of the key, so it is the same in every run."""
    u = (F.shiftrightunsigned(F.xxhash64("k", "h", F.lit(seed)), 11).cast("double") + 1.0) / float(2**53 + 1)
    rows = records.select("h", "k", (-F.log(u) / F.col("size")).alias("draw")).orderBy("draw").limit(n).select("h", "k").collect()
    return sorted((r.h, r.k) for r in rows)


def quantiles(keys: list[Key], ranges: int) -> list[Key]:
    """Boundaries that cut the sample into so many ranges of like weight; a range starts at its boundary."""
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def ranges_at(boundaries: list[Key], h: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each key, the number of boundaries that are not larger."""
    bh, bk = (np.array([b[i] for b in boundaries], np.int64) for i in (0, 1))
    out, below = np.searchsorted(bh, h, "right"), np.searchsorted(bh, h, "left")
    for at in np.unique(below[out > below]):  # texts that boundaries share: the second part of the key decides
        rows = (below == at) & (out > below)
        upto = out[rows][0]
        out[rows] = at + np.searchsorted(bk[at:upto], k[rows], "right")
    return out


def with_range(records: DataFrame, boundaries: list[Key]) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            r = ranges_at(boundaries, batch.column("h").to_numpy(), batch.column("k").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r, pa.int32())], names=[*batch.schema.names, "r"])

    out = map_batches(records, batches, "doc_id long, size long, text_crc32 long, h long, k long, r int")
    records.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")  # rows are small here
    return out


def deal(sums: dict[int, tuple[int, int]], ranges: int, shards: int) -> list[tuple[int, int]]:
    """(shard, first slot) of each range: whole ranges in order, cut nearest to each shard's share of the bytes."""
    ends, run = [], 0
    for r in range(ranges):
        run += sums.get(r, (0, 0))[0]
        ends.append(run)
    cuts = []
    for j in range(1, shards):
        want = run * j / shards
        i = bisect.bisect_left(ends, want)
        before = ends[i - 1] if i else 0
        cuts.append(i if want - before <= ends[i] - want else i + 1)
    out, slots = [], [0] * shards
    for r in range(ranges):
        shard = bisect.bisect_right(cuts, r)
        out.append((shard, slots[shard]))
        slots[shard] += sums.get(r, (0, 0))[1]
    return out


def shard(docs: DataFrame, shards: int = SHARDS, ranges_a_shard: int = RANGES_A_SHARD, samples_a_range: int = SAMPLES_A_RANGE) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is not ``key``)."""
    records = materialize(sized(docs), "shard-records")
    least = -(2**63)
    wanted = shards * ranges_a_shard
    boundaries = quantiles([(h, least) for h, _ in sample(records, wanted * samples_a_range)], wanted)  # a boundary stands before all records of a text
    for turn in range(ROUNDS + 1):
        dealt = with_range(records, boundaries)
        sums = {r.r: (r.size, r.n) for r in dealt.groupBy("r").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
        share = sum(x for x, _ in sums.values()) / wanted
        full = {r: x for r, (x, n) in sums.items() if x > OVERFULL * share and n > 1}
        if not full or turn == ROUNDS:
            break
        inside = sample(dealt.where(F.col("r").isin(list(full))), len(full) * 8 * samples_a_range, turn + 1)
        at = ranges_at(boundaries, *(np.array([x[i] for x in inside], np.int64) for i in (0, 1)))
        more = {b for r, x in full.items() for b in quantiles([x for x, own in zip(inside, at.tolist(), strict=True) if own == r], math.ceil(x / share))}
        if not more.difference(boundaries):
            break
        boundaries = sorted({*boundaries, *more})
    place = docs.sparkSession.createDataFrame([(r, s, slot) for r, (s, slot) in enumerate(deal(sums, len(boundaries) + 1, shards))], "r int, shard int, first long")
    number = F.row_number().over(Window.partitionBy("r").orderBy("h", "k", "size")) - 1
    return (
        dealt.withColumn("number", number)
        .join(F.broadcast(place), "r")  # one row a range, and their number is a parameter
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("number")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
