"""Substring dedup by De Bruijn compaction: remove words of windows that also start in a smaller document.

A window of ``length`` words is an edge of a De Bruijn graph (from its first to its last ``length - 1`` words).
Edges that pick the same gram at the same place follow each other without branching, so they travel as one stretch
(``grams``). Stretches whose gram occurs more than once meet in a Spark join; a stretch that repeats whole is a
nonbranching piece, one whose gram also has other surroundings holds a branch and is taken apart into its edges.
Pieces and edges carry the coordinates of their source, the smallest document that holds them; those that follow
each other both in the document and in its source compact into one span. A last join fetches the digest of the words
at each source and keeps only spans that read the same there.

Defined results. Null or blank text: no words. Fewer than ``length`` words: kept whole. Null ``doc_id``: kept whole
and removes nothing elsewhere. Windows that repeat only inside one document stay. Rows that repeat a ``doc_id``
with the same text are handled alike; with another text, they share the union of their spans, cut to each text.
Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of
from .grams import _SECOND, covered, prefix_sums, stretch_hash, word_symbols
from .repeats import HELD, RUN, by_document, repeated_runs, run_rows, settle, with_first

LENGTH = 13
GRAM = 5


def symbols_of_words(raw: bytes) -> np.ndarray:
    return word_symbols(raw)[0]


def _edges(length: int):
    """Each stretch taken apart into its edges, settled inside the task like the stretches were."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, none = [], 0, np.empty(0, np.uint64)
        for batch in it:
            looks = batch.column("spans")
            for i, (doc, raw) in enumerate(zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True)):
                symbols = symbols_of_words(raw)
                look = looks[i].values
                if look is None:
                    continue
                s, w = look.field("s").to_numpy().astype(np.int64), look.field("w").to_numpy().astype(np.int64)
                at = np.unique(np.repeat(s - (np.cumsum(w) - w), w) + np.arange(w.sum()))
                at = at[at + length <= len(symbols)]
                if len(at):
                    e = stretch_hash(prefix_sums(symbols), at, at + length)
                    f = stretch_hash(prefix_sums(symbols, _SECOND), at, at + length, _SECOND)
                    parts.append((e, f, np.full(len(at), doc, np.int64), at, np.ones(len(at), np.int64)))
                    held += len(at)
                if held >= HELD:
                    yield from settle(parts, "doc", none)
                    parts, held = [], 0
        if parts:
            yield from settle(parts, "doc", none)

    return batches


def compact(s: np.ndarray, w: np.ndarray, of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Join pieces of one document that follow each other there and in their source; (s, w, src_doc, src_s)."""
    order = np.lexsort((s, s - at, of))
    s, w, of, at = s[order], w[order], of[order], at[order]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | ((s - at)[1:] != (s - at)[:-1]) | (s[1:] > (s + w)[:-1])])
    head = np.flatnonzero(new)
    end = np.maximum.reduceat(s + w, head)
    return s[head], end - s[head], of[head], at[head]


def _digest(raw: bytes, starts: np.ndarray, ends: np.ndarray, s: np.ndarray, w: np.ndarray, length: int) -> list[bytes | None]:
    """Digest of the words that w windows from s cover; None where the text ends before."""
    last = s + w + length - 2
    return [xxhash.xxh3_128_digest(b" ".join(raw[starts[i] : ends[j]].split())) if j < len(starts) else None for i, j in zip(s.tolist(), last.tolist(), strict=True)]


def _spans(length: int, joined: bool):
    """Spans with the digest of their words; ``joined``: pieces are compacted first (else they are sources asked for)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            pieces, parts = batch.column("spans"), []
            for i, (doc, raw) in enumerate(zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True)):
                own = pieces[i].values
                if own is None:
                    continue
                s, w = (own.field(x).to_numpy().astype(np.int64) for x in ("s", "w"))
                of, at = (own.field(x).to_numpy().astype(np.int64) for x in ("src_doc", "src_s")) if joined else (np.full(len(s), doc), s)
                if joined:
                    s, w, of, at = compact(s, w, of, at)
                _, starts, ends = word_symbols(raw)
                parts.append((np.full(len(s), doc), s, w, of, at, _digest(raw, starts, ends, s, w, length)))
            if parts:
                doc, s, w, of, at = (np.concatenate([p[k] for p in parts]) for k in range(5))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(s, pa.int64()).cast(pa.int32()), pa.array(w, pa.int64()).cast(pa.int32()), pa.array(of, pa.int64()), pa.array(at, pa.int64()).cast(pa.int32()), pa.array([d for p in parts for d in p[5]], pa.binary())],
                    names=["doc", "s", "w", "src_doc", "src_s", "digest"],
                )

    return batches


_SPAN = "doc long, s int, w int, src_doc long, src_s int, digest binary"


def repeated_spans(docs: DataFrame, texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Verified spans (doc, s, w windows, src_doc, src_s): each reads the same at its source, in a smaller document."""

    def at_text(spans: DataFrame) -> DataFrame:
        return texts.join(spans.hint("shuffle_merge"), texts.doc_id == spans.doc, "left").select("doc_id", "text", "spans")

    gone, look = repeated_runs(run_rows(docs, symbols_of_words, length, gram, "doc"), "doc")
    edges = with_first(map_batches(at_text(by_document(look, "s", "w")), _edges(length), RUN), "doc")
    pieces = gone.unionByName(edges.where("gone").select(*gone.columns))
    spans = map_batches(at_text(by_document(pieces, "s", "w", "src_doc", "src_s")), _spans(length, True), _SPAN)
    asked = spans.select(F.col("src_doc").alias("doc"), F.col("src_s").alias("s"), "w").distinct()
    sources = map_batches(at_text(by_document(asked, "s", "w")), _spans(length, False), _SPAN).select(F.col("doc").alias("src_doc"), F.col("s").alias("src_s"), "w", "digest").distinct()
    return spans.join(sources.hint("shuffle_merge"), ["src_doc", "src_s", "w", "digest"]).select("doc", "s", "w", "src_doc", "src_s")


def _cut(length: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            spans = batch.column("spans")
            total, gone_, kept = [], [], []
            for i, raw in enumerate(texts_of(batch)):
                words, span = raw.split(), spans[i].values
                total.append(len(words))
                if span is not None and len(span):
                    gone = covered(span.field("s").to_numpy().astype(np.int64), span.field("w").to_numpy().astype(np.int64), length, len(words))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                gone_.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone_, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    return batches


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (words left, one space between), kept_sha256."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartition("doc_id")
    spans = by_document(repeated_spans(docs, texts, length, gram), "s", "w")
    joined = texts.join(spans.hint("shuffle_merge"), texts.doc_id == spans.doc, "left").select("doc_id", "text", "spans")
    return map_batches(joined, _cut(length), "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
