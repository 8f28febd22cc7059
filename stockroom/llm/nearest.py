"""Approximate nearest neighbours by cross-polytope hashing with multiprobe, reranked exactly.

A unit vector is turned by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) and falls
to the nearest signed axis. Each of ``TABLES`` tables has a rotation of its own. Every row stands in one bucket of
each table; a query visits the ``PROBES`` axes nearest to it. What a query meets is reranked by the exact Euclidean
distance of the original vectors in double precision. Large buckets are cut into blocks of a bounded number of rows,
and the query goes to every block, so a bucket that holds a third of all rows is no single task's work.

Defined results. Vectors that are null, empty, zero or hold a null or non-finite component take no part. Only vectors
of one length can meet. A query meets all rows but those with its own id; rows that repeat an id count once, with the
smallest distance. Ties go to the smaller id. Null ids take no part. Queries that met fewer than ``k`` rows are
answered exactly, block by block, so they get all candidates if there are fewer than ``k``. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import importable, map_batches

TABLES, PROBES = 10, 16
#: Rows of a bucket that a task compares at once.
BLOCK = 4096
FOUND = "query_id long, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows; their length is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        y = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng([table, width]).choice(np.array([-1.0, 1.0]), (3, width))
    for s in signs:
        x = hadamard(x * s)
    return x


def nearest_axes(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """For each row the ``probes`` nearest signed axes, nearest first: 2 i for +axis i, 2 i + 1 for -axis i."""
    turned = rotate(x, table)
    signed = np.stack([turned, -turned], axis=2).reshape(len(x), -1)
    return np.argsort(-signed, axis=1, kind="stable")[:, :probes]


def valid_vectors(table: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, v, dim) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return table.select(F.col(id_).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(fine).withColumn("dim", F.size("v"))


def with_buckets(vectors: DataFrame, tables: int, probes: int) -> DataFrame:
    """(id, v, dim, spot): one row for each bucket that a vector stands in or visits."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            dims = batch.column("dim").to_numpy()
            flat, offsets = batch.column("v").flatten().to_numpy(), np.concatenate([[0], np.cumsum(dims)])
            spots: list = [None] * len(dims)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                x = flat[offsets[rows][:, None] + np.arange(dim)]
                peak = np.abs(x).max(axis=1, keepdims=True)
                x = x / peak
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                axes = [nearest_axes(x, t, probes) for t in range(tables)]
                both = np.concatenate([a + (t << 32) for t, a in enumerate(axes)], axis=1)
                for r, s in zip(rows.tolist(), both, strict=True):
                    spots[r] = s
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "v", "dim")), pa.array(spots, pa.list_(pa.int64()))], names=["id", "v", "dim", "spots"])

    return map_batches(vectors, batches, "id long, v array<double>, dim int, spots array<long>").select("id", "v", "dim", F.explode("spots").alias("spot"))


def _compare(k: int):
    """The k nearest rows of a block for each query that comes to it."""

    def one(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            x, ids = np.array(rows.v.tolist(), np.float64), rows.id.to_numpy()
            for q, v in zip(queries.id, queries.v, strict=True):
                score = np.sqrt(((x - np.asarray(v, np.float64)) ** 2).sum(axis=1))
                order = np.lexsort((ids, score))
                order = order[ids[order] != q]
                _, first = np.unique(ids[order], return_index=True)
                best = order[np.sort(first)][:k]
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return one


def _meet(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): queries (id, v, dim, spot) against the rows of the same spot, block by block."""
    counts = rows.groupBy("dim", "spot").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    counts = F.broadcast(counts)  # as many rows as there are axes in all tables
    placed = rows.join(counts, ["dim", "spot"]).select("id", "v", "dim", "spot", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    sent = queries.join(counts, ["dim", "spot"]).select("id", "v", "dim", "spot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    key = ["dim", "spot", "block"]
    return sent.groupBy(*key).cogroup(placed.groupBy(*key)).applyInPandas(_compare(k), FOUND)


def nearest(table: DataFrame, queries: DataFrame, k: int = 10, id_: str = "vec_id", vector: str = "embedding", tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of ``table`` found for each row of ``queries``."""
    importable(table.sparkSession)
    rows, asked = valid_vectors(table, id_, vector), valid_vectors(queries, id_, vector).dropDuplicates(["id", "v"])
    found = materialize(_meet(with_buckets(asked, tables, probes), with_buckets(rows, tables, 1), k), "met-vectors")
    met = found.groupBy(F.col("query_id").alias("id")).agg(F.countDistinct("vec_id").alias("met")).where(F.col("met") >= k)
    lacking = materialize(asked.join(met.hint("shuffle_merge"), "id", "left_anti").select("id", "v", "dim"), "lacking-queries")
    if not lacking.isEmpty():
        found = found.unionByName(_meet(lacking.withColumn("spot", F.lit(0).cast("long")), rows.withColumn("spot", F.lit(0).cast("long")), k))
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
