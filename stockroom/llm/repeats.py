"""Runs of windows that occur more than once, found with one shuffle; shared by the two repeat removers.

``later`` says which occurrences go: those in a larger document (``"doc"``) or in a larger document or at a later
place of the same one (``"place"``). Runs meet by their gram. Two things keep a gram that a third of all documents
hold from meeting in one task: each map task first settles what repeats inside itself (such a run is marked
``again``, with where it stands first, and travels under a key of its own), and grams that a sample shows to be
frequent are dealt by their whole run, which is what has to meet. The result does not depend on either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_batches
from .grams import U64, Common, mix, runs

#: Runs that a task holds before it settles them.
HELD = 1_500_000
#: One in so many documents is looked at for frequent grams; a gram is frequent from so many sampled runs on, and
#: from one in so many of them, which bounds how many there are.
SAMPLED, FREQUENT, ONE_IN = 64, 16, 10_000

#: place: first window, number of windows (under 128), settled in the task (2), frequent gram (1), as bits.
RUN = "key long, c long, doc long, place long"


def settle(parts: list[tuple], later: str, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of RUN from arrays (a, c, doc, s, w). A settled run has its first place in key (upper half) and c."""
    a, c, doc, s, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((s, doc, c, a))
    a, c, doc, s, w = a[order], c[order], doc[order], s[order], w[order]
    head = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
    first = np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))
    again = doc > doc[first]
    if later == "place":
        again |= s > s[first]
    often = np.isin(a, frequent) & ~again
    own = mix(doc.view(U64) * U64(0x9E3779B97F4A7C15) + s.astype(U64) + a) & U64(0xFFFFFFFF)
    key = np.where(again, (s[first].astype(U64) << U64(32)) | own, np.where(often, mix(a ^ c), a)).view(np.int64)
    c = np.where(again, doc[first], c.view(np.int64))
    place = (s.astype(np.int64) << 9) | (w.astype(np.int64) << 2) | (again.astype(np.int64) << 1) | often
    for at in range(0, len(a), 100_000):
        k = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (key, c, doc, place)], names=["key", "c", "doc", "place"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")


def frequent_grams(docs: DataFrame, symbols: Callable[[bytes], np.ndarray], length: int, gram: int, common: np.ndarray | None = None) -> np.ndarray:
    """Grams that many documents of a sample hold: at most ``ONE_IN`` of them."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            last = None if common is None else Common(common)
            found = [np.unique(runs(symbols(t.as_py()), length, gram, last)[0]) for t in batch.column("text").cast(pa.large_binary())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["a"])

    rows = map_batches(_texts(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0), batches, "a long")
    counts = rows.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    total = rows.count()
    return np.array([r.a for r in counts.where(F.col("n") * ONE_IN >= total).collect()], np.int64).view(U64)


def run_rows(docs: DataFrame, symbols: Callable[[bytes], np.ndarray], length: int, gram: int, later: str, common: np.ndarray | None = None) -> DataFrame:
    """All runs of all documents, as rows of RUN. ``common``: gram hashes that are picked last."""
    frequent = frequent_grams(docs, symbols, length, gram, common)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        last = None if common is None else Common(common)
        for batch in it:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for doc, text in zip(ids, batch.column("text").cast(pa.large_binary()), strict=True):
                a, c, s, w = runs(symbols(text.as_py()), length, gram, last)
                if len(a):
                    parts.append((a, c, np.full(len(a), doc, np.int64), s, w))
                    held += len(a)
                if held >= HELD:
                    yield from settle(parts, later, frequent)
                    parts, held = [], 0
        if parts:
            yield from settle(parts, later, frequent)

    return map_batches(_texts(docs), batches, RUN)


def with_first(rows: DataFrame, later: str) -> DataFrame:
    """doc, s, w, key, c of each run, with ``src_doc, src_s`` (where an equal run stands first), ``gone`` (that is earlier),
    ``often`` (its gram occurs again) and ``mixed`` (in other surroundings)."""
    again, hot = F.col("place").bitwiseAND(F.lit(2)) != 0, F.col("place").bitwiseAND(F.lit(1)) != 0
    equal, gram = Window.partitionBy("key", "c").orderBy("doc", "place"), Window.partitionBy("key")
    seen = (
        rows.withColumn("src_doc", F.first("doc").over(equal))
        .withColumn("src_place", F.first("place").over(equal))
        .withColumn("n", F.count("*").over(gram))
        .withColumn("lo", F.min("c").over(gram))
        .withColumn("hi", F.max("c").over(gram))
    )
    src_doc = F.when(again, F.col("c")).otherwise(F.col("src_doc"))
    src_s = F.when(again, F.shiftright("key", 32)).otherwise(F.shiftright("src_place", 9)).cast("int")
    s = F.shiftright("place", 9).cast("int")
    earlier = src_doc < F.col("doc")
    if later == "place":
        earlier = earlier | ((src_doc == F.col("doc")) & (src_s < s))
    return seen.select(
        "doc",
        s.alias("s"),
        F.shiftright("place", 2).bitwiseAND(F.lit(127)).cast("int").alias("w"),
        src_doc.alias("src_doc"),
        src_s.alias("src_s"),
        earlier.alias("gone"),
        (again | hot | (F.col("n") > 1)).alias("often"),
        (~again & (hot | (F.col("lo") != F.col("hi")))).alias("mixed"),
    )


def repeated_runs(rows: DataFrame, later: str) -> tuple[DataFrame, DataFrame]:
    """(runs that go: doc, s, w, src_doc, src_s; runs to look into window by window: doc, s, w).

    A run goes if an equal run stands earlier. A run that is the first of its kind, but whose gram also occurs in
    runs that differ, may still share some of its windows with those: it is looked into.
    """
    flow = materialize(with_first(rows, later).where("gone OR mixed").drop("often"), "repeated-runs")
    return flow.where("gone").select("doc", "s", "w", "src_doc", "src_s"), flow.where("NOT gone").select("doc", "s", "w")


def by_document(spans: DataFrame, *columns: str) -> DataFrame:
    """Spans gathered for each document (a document's spans are bounded by its length)."""
    return spans.groupBy("doc").agg(F.collect_list(F.struct(*columns)).alias("spans"))
