"""Suffix-array dedup: remove every byte covered by a ``length``-byte string that also starts earlier.

A sparse suffix array: the suffixes that start at anchors (the picked gram of each window, see ``grams``) are
range-partitioned by their gram's bytes, then what follows it, with sampled splitters, each bucket sorts its own by multikey quicksort and
settles the windows of neighbours that share the gram, and what stands at a bucket's two ends is compared across the
boundaries. Runs of windows whose whole surroundings repeat are settled beforehand, by aggregates alone.

A window is anchored at a gram that few documents hold, if it holds one: grams that a sample shows to be common come
last in the choice. Windows that reach over the edge of a passage that many documents share are then told apart by what
is their own, instead of meeting by the passage; equal windows still choose alike, whatever the sample shows.

Defined results. Null text: empty. Texts shorter than ``length`` bytes: kept whole. Null ``doc_id``: the row is kept
whole and removes nothing elsewhere. ``doc_id`` is a key: rows that repeat one with the same text are handled alike
(neither stands earlier than the other); with another text, they share the union of their spans, cut to each text.
Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize
from .common import map_batches, quoted
from .grams import BYTES, U64, Common, covered, picked, prefix_sums, stretch_hash
from .repeats import SAMPLED, _texts, by_document, repeated_runs, run_rows

LENGTH = 100
GRAM = 32
#: Windows compared at once in a bucket (a gram with more of them is still taken whole).
BLOCK = 1_000_000
#: A gram is common from so many sampled documents on, and from one in so many of what those hold, which bounds them.
COMMON, COMMON_ONE_IN = 8, 1_000_000
SUFFIX = "lead binary, next long, before long, a long, doc long, s int, w int, p int, context binary"
FOUND = "doc long, s int, w int, a long, h long"


def byte_symbols(raw: bytes) -> np.ndarray:
    return BYTES[np.frombuffer(raw, np.uint8)]


def _as_key(raw: bytes) -> int:
    """Eight leading bytes as a signed number that sorts like the bytes."""
    return int.from_bytes(raw[:8].ljust(8, b"\0"), "big") - (1 << 63)


def common_grams(docs: DataFrame, gram: int) -> np.ndarray:
    """Hashes of the grams, at any place, that many documents of a sample hold: at most ``COMMON_ONE_IN`` of them. They
    decide where windows are anchored, not what is found."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = []
            for t in batch.column("text").cast(pa.large_binary()):
                sums = prefix_sums(byte_symbols(t.as_py()))
                at = np.arange(max(0, len(sums) - gram))
                found.append(np.unique(stretch_hash(sums, at, at + gram)))
            if found:
                own, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], names=["a", "n"])

    rows = map_batches(_texts(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0), batches, "a long, n long")
    counts = rows.groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    counts = materialize(counts, "common-grams")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return np.array([r.a for r in counts.where(F.col("n") * COMMON_ONE_IN >= total).collect()], np.int64).view(U64)


def _suffixes(length: int, gram: int, common: np.ndarray):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = Common(common)
        for batch in it:
            rows: list[list] = [[] for _ in range(9)]
            docs, looks = batch.column("doc").to_pylist(), batch.column("spans")
            texts = batch.column("text").cast(pa.large_binary())
            for i, doc in enumerate(docs):
                raw = texts[i].as_py() or b""
                look = looks[i].values
                if look is None or not len(look):
                    continue
                for s, w in zip(look.field("s").to_pylist(), look.field("w").to_pylist(), strict=True):
                    context = raw[s : s + w + length - 1]
                    if len(context) < w + length - 1:
                        continue  # of another text with the same doc_id
                    sums = prefix_sums(byte_symbols(context))
                    at = np.arange(length - gram + 1)
                    own = stretch_hash(sums, at, at + gram)
                    p = picked(last.ranks(own))
                    a = int(own[p : p + 1].view(np.int64)[0])
                    for col, v in zip(rows, (context[p : p + gram], _as_key(context[p + gram :]), _as_key(context[max(0, p - 8) : p][::-1]), a, doc, s, w, p, context), strict=True):
                        col.append(v)
            if rows[0]:
                types = [pa.binary()] + [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["lead", "next", "before", "a", "doc", "s", "w", "p", "context"])

    return batches


def multikey_sort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings given as rows of big-endian words, and the number of each one's group of equals.

    Multikey quicksort, a word at a time: rows are sorted by the first word, then only those that tie are sorted by
    the next one inside their tie, until none ties or the words end.
    """
    order = np.arange(len(keys))
    group = np.zeros(len(keys), np.int64)
    open_ = np.arange(len(keys))  # places of the order whose group still ties
    for depth in range(keys.shape[1]):
        if not len(open_):
            break
        word = keys[order[open_], depth]
        by = np.lexsort((word, group[open_]))
        order[open_], word, own = order[open_][by], word[by], group[open_][by]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (word[1:] != word[:-1])])
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        size = np.bincount(np.cumsum(new) - 1)
        open_ = open_[np.repeat(size > 1, size)]
    return order, group


def _alike(x: np.ndarray, y: int, n: np.ndarray) -> np.ndarray:
    """Whether the first n bytes (8 at most) of keys are those of y."""
    n = np.minimum(n, 8)
    return (n == 0) | (((x ^ y).view(U64) >> (U64(64) - U64(8) * np.maximum(n, 1).astype(U64))) == 0)


def _at_ends(group: np.ndarray, after: np.ndarray, before: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which windows can equal one in the bucket before or behind.

    Suffixes of a gram are in the order of what follows it, then of what stands before it. Windows that hold ``right``
    bytes behind the gram are equal only if those are, so they stand together in that order, and beyond the bucket only
    if they are the same at its first or last suffix; likewise the ``left`` bytes, where all of the key behind is equal.
    """
    out = np.zeros(len(group), bool)
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        order = own[np.lexsort((before[own], after[own]))]
        for end in (order[0], order[-1]):
            follows = _alike(after[own], after[end], right[own])
            out[own] |= follows & ((right[own] < 8) | _alike(before[own], before[end], left[own]))
    return out


def _bucket(length: int, gram: int):
    """Settle a bucket's suffixes; give the runs that go, and the windows at the bucket's ends with their hash."""

    def rows(doc, s, w, a=None, h=None) -> pa.RecordBatch:
        none = pa.nulls(len(doc), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array(s.astype(np.int32)), pa.array(w.astype(np.int32)), none if a is None else pa.array(a), none if h is None else pa.array(h)],
            names=["doc", "s", "w", "a", "h"],
        )

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in it if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        a, doc, s, w, p, after, before = (table[x].to_numpy() for x in ("a", "doc", "s", "w", "p", "next", "before"))
        contexts = table["context"].to_pylist()
        del table, got
        size = np.fromiter(map(len, contexts), np.int64, len(contexts))
        raw = np.frombuffer(b"".join(contexts), np.uint8)
        del contexts
        start = np.cumsum(size) - size
        words = -(-gram // 8)
        keys = raw[(start + p)[:, None] + np.arange(words * 8 if gram % 8 == 0 else gram)]
        if gram % 8:
            keys = np.pad(keys, ((0, 0), (0, words * 8 - gram)))
        keys = np.ascontiguousarray(keys).view(">u8").astype(U64)
        order, group = multikey_sort(keys)
        del keys
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        tails = np.append(heads[1:], len(order))
        weight = np.add.reduceat(w[order], heads)
        at = 0
        while at < len(heads):  # blocks of whole groups
            upto = at + max(1, int(np.searchsorted(np.cumsum(weight[at:]), BLOCK, "right")))
            k = order[heads[at] : tails[upto - 1]]
            edge = np.zeros(len(k), bool)
            if at == 0:
                edge[: tails[0]] = True
            if upto == len(heads):
                edge[heads[-1] - heads[at] :] = True
            n = w[k].astype(np.int64)
            row = np.repeat(np.arange(len(k)), n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            h = np.empty(len(row), U64)
            ends = np.cumsum(n)
            lo = 0
            while lo < len(k):  # texts hashed a stretch at a time
                hi = lo + max(1, int(np.searchsorted(np.cumsum(size[k[lo:]]), 1 << 20, "right")))
                own = k[lo:hi]
                sizes = size[own]
                offset = np.cumsum(sizes) - sizes
                place = np.arange(sizes.sum()) - np.repeat(offset, sizes) + np.repeat(start[own], sizes)
                sums = prefix_sums(BYTES[raw[place]])
                w0, w1 = (ends[lo - 1] if lo else 0), ends[hi - 1]
                first = offset[row[w0:w1] - lo] + nth[w0:w1]
                h[w0:w1] = stretch_hash(sums, first, first + length)
                lo = hi
            of = np.repeat(group[heads[at] : tails[upto - 1]], n)
            d, place = doc[k][row], s[k][row] + nth
            by = np.lexsort((place, d, h, of))
            new = np.concatenate([[True], (of[by][1:] != of[by][:-1]) | (h[by][1:] != h[by][:-1])])
            first = by[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            goes = np.zeros(len(row), bool)
            goes[by] = (d[by] > d[first]) | (place[by] > place[first])
            if goes.any():  # neighbouring windows of a row that go become a run
                i = np.flatnonzero(goes)
                new = np.concatenate([[True], (i[1:] != i[:-1] + 1) | (row[i[1:]] != row[i[:-1]])])
                b = np.flatnonzero(new)
                yield rows(d[i[b]], place[i[b]], np.diff(np.append(b, len(i))))
            left = np.flatnonzero(edge[row] & ~goes)
            if len(left):  # only those that can equal a window beyond the bucket's ends
                left = left[_at_ends(of[left], after[k][row[left]], before[k][row[left]], nth[left] + length - gram - p[k][row[left]], p[k][row[left]] - nth[left])]
            for b in range(0, len(left), 100_000):
                j = left[b : b + 100_000]
                yield rows(d[j], place[j], np.ones(len(j), np.int64), a[k][row[j]], h[j].view(np.int64))
            at = upto

    return batches


def spans_to_remove(docs: DataFrame, texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, s, w): runs of windows that also stand earlier. ``texts``: doc_id and text, dealt by doc_id."""
    common = common_grams(docs, gram)
    gone, look = repeated_runs(run_rows(docs, byte_symbols, length, gram, "place", common), "place")
    looks = by_document(look, "s", "w")
    joined = texts.join(looks.hint("shuffle_merge"), texts.doc_id == looks.doc, "left").select(F.col("doc_id").alias("doc"), "text", "spans")
    suffixes = map_batches(joined, _suffixes(length, gram, common), SUFFIX)
    # by the bytes that a bucket sorts by, so that only its first and last gram can go on in another
    dealt = suffixes.repartitionByRange(F.col("lead"), F.col("next"), F.col("before"), F.col("doc"), F.col("s"))
    found = map_batches(dealt, _bucket(length, gram), FOUND)
    inside = found.where("h IS NULL").select("doc", "s", "w")
    ends = found.where("h IS NOT NULL")
    ranked = ends.withColumn("r", F.rank().over(Window.partitionBy("a", "h").orderBy("doc", "s")))
    across = ranked.where("r > 1").select("doc", "s", "w")
    return gone.select("doc", "s", "w").unionByName(inside).unionByName(across)


def _cut(length: int, carry: bool):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, texts, spans = batch.column("doc_id"), batch.column("text").cast(pa.large_binary()), batch.column("spans")
            out: list[list] = [[] for _ in range(4)]
            for i in range(batch.num_rows):
                raw = texts[i].as_py() or b""
                span = spans[i].values
                removed = pieces = 0
                kept = raw
                if span is not None and len(span):
                    gone = covered(span.field("s").to_numpy().astype(np.int64), span.field("w").to_numpy().astype(np.int64), length, len(raw))
                    removed = int(gone.sum())
                    pieces = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                for col, v in zip(out, (len(raw), removed, pieces, kept), strict=True):
                    col.append(v)
            columns = {
                "doc_id": ids,
                **{name: pa.array(c, pa.int64()) for name, c in zip(("n_bytes", "n_removed", "n_spans"), out[:3], strict=True)},
                "kept": pa.array(out[3], pa.binary()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in out[3]], pa.string()),
            }
            if carry:
                columns |= {"kept_text": pa.array([k.decode("utf-8", "ignore") for k in out[3]], pa.string()), "row": batch.column("row")}
            yield pa.RecordBatch.from_pydict(columns)

    return batches


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left), kept_sha256.

    ``carry``: also kept_text (characters that were cut in two left out) and row (the document's own columns).
    """
    own = [F.struct(*(F.col(quoted(c)) for c in docs.columns if c != "text")).alias("row")] if carry else []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *own).repartition("doc_id")
    spans = by_document(spans_to_remove(docs, texts.select("doc_id", "text"), length, gram), "s", "w")
    joined = texts.join(spans.hint("shuffle_merge"), texts.doc_id == spans.doc, "left").select("doc_id", "text", "spans", *(["row"] if carry else []))
    schema = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    if carry:
        schema = schema.add("kept_text", "string").add("row", texts.schema["row"].dataType)
    return map_batches(joined, _cut(length, carry), schema)
