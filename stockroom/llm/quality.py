"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text only; labels, language, source and ids never enter them. Trees are grown on
histograms of binned statistics (second-order boosting of the log loss), then flattened: feature, threshold, left
child and value of all nodes stand in four arrays, and scoring walks all rows and trees a level at a time in numpy.

The training sample is bounded: at most ``SAMPLE`` labelled rows, those with the smallest hash of their id. Statistics
are computed and scores given for every document.

Defined results. Null or empty text: the statistics of an empty text, scored like any other. Very long texts are read
whole. Null ``doc_id``: scored, held out (no remainder). Rows that repeat a ``doc_id`` are scored one by one; a
document with several labels trains once for each. Null labels do not train. Other columns are ignored. Without two
classes of labels to learn from, every score is the share of label 1 (1 if there is no label at all, so that nothing
is rejected unseen). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .grams import prefix_sums, stretch_hash, word_symbols

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 40_000
#: Score from which a document is predicted to be good.
THRESHOLD = 0.7
ROUNDS, DEPTH, RATE, BINS, SMOOTH, LEAST = 120, 5, 0.12, 64, 1.0, 8.0

#: Names of the statistics, in the order of the array.
STATISTICS = (
    "log_bytes", "log_words", "mean_word", "sd_word", "longest_word", "letters", "upper", "digits", "blanks", "lines", "other_ascii", "high_bytes",
    "pipes", "full_stops", "commas", "bangs", "hashes", "stars", "percents", "braces", "angle", "slashes", "underscores", "quotes", "colons",
    "different_words", "top_word", "top_pair", "different_pairs", "different_fives", "neighbour_repeats", "words_a_line", "different_lines", "top_line",
    "short_words", "long_words", "capital_words", "symbol_words", "stop_ended_words", "byte_entropy", "rare_bytes", "different_bytes",
)
_CLASSES = {"letters": b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "blanks": b" \t", "lines": b"\n", "pipes": b"|", "full_stops": b".", "commas": b",", "bangs": b"!?", "hashes": b"#", "stars": b"*", "percents": b"%&", "braces": b"{}[]()", "angle": b"<>", "slashes": b"/\\", "underscores": b"_-=", "quotes": b"'\"", "colons": b":;"}
_LETTER = np.zeros(256, bool)
_LETTER[list(_CLASSES["letters"])] = True
_LETTER[128:] = True


def _spread(h: np.ndarray) -> tuple[float, float]:
    """Share of different values and of the most frequent one."""
    if not len(h):
        return 1.0, 0.0
    n = np.unique(h, return_counts=True)[1]
    return len(n) / len(h), n.max() / len(h)


def statistics(raw: bytes) -> np.ndarray:
    """The statistics of one text."""
    b = np.frombuffer(raw, np.uint8)
    n = max(1, len(b))
    seen = np.bincount(b, minlength=256)
    symbols, starts, ends = word_symbols(raw)
    size = ends - starts
    words = max(1, len(size))
    share = {k: seen[list(v)].sum() / n for k, v in _CLASSES.items()}
    different, top = _spread(symbols)
    places = np.arange(len(symbols))
    sums = prefix_sums(symbols)
    pairs = stretch_hash(sums, places[:-1], places[:-1] + 2) if len(symbols) > 1 else symbols[:0]
    fives = stretch_hash(sums, places[:-4], places[:-4] + 5) if len(symbols) > 4 else symbols[:0]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for x in lines:
        counts[x] = counts.get(x, 0) + 1
    p = seen[seen > 0] / n
    first = b[starts] if len(starts) else b[:0]
    last = b[ends - 1] if len(ends) else b[:0]
    inner = np.concatenate([[0], np.cumsum(~_LETTER[b])]) if len(b) else np.zeros(1, np.int64)
    odd = inner[ends] - inner[starts] if len(ends) else size
    two_different, two_top = _spread(pairs)
    value = share | {
        "log_bytes": np.log1p(len(b)), "log_words": np.log1p(len(size)), "mean_word": size.sum() / words, "sd_word": size.std() if len(size) else 0.0, "longest_word": np.log1p(size.max()) if len(size) else 0.0,
        "other_ascii": (seen[:128].sum() - sum(seen[list(v)].sum() for k, v in _CLASSES.items() if k != "upper")) / n, "high_bytes": seen[128:].sum() / n,
        "different_words": different, "top_word": top, "top_pair": two_top, "different_pairs": two_different, "different_fives": _spread(fives)[0], "neighbour_repeats": (symbols[1:] == symbols[:-1]).sum() / words,
        "words_a_line": np.log1p(len(size) / max(1, len(lines))), "different_lines": len(counts) / max(1, len(lines)), "top_line": max(counts.values(), default=0) / max(1, len(lines)),
        "short_words": (size <= 2).sum() / words, "long_words": (size >= 12).sum() / words, "capital_words": ((first >= 65) & (first <= 90)).sum() / words, "symbol_words": (2 * odd > size).sum() / words,
        "stop_ended_words": ((last == 46) | (last == 33) | (last == 63)).sum() / words, "byte_entropy": -(p * np.log2(p)).sum(), "rare_bytes": (seen[:32].sum() - seen[9] - seen[10] - seen[13]) / n, "different_bytes": (seen > 0).sum() / 256,
    }
    return np.array([value[k] for k in STATISTICS], np.float64)


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row's text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [statistics(t.as_py() or b"") for t in batch.column("text").cast(pa.large_binary())]
            flat = np.concatenate(rows) if rows else np.empty(0)
            ends = np.arange(len(rows) + 1) * len(STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["doc_id", "x"])

    return map_batches(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), batches, "doc_id long, x array<double>")


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the id as text leaves 2 when divided by 4 (a null id is held out too)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


class Trees:
    """Boosted trees, flattened. A leaf is its own child and its threshold sends every row to it."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, value: np.ndarray, roots: np.ndarray, depth: int, base: float) -> None:
        self.feature, self.threshold, self.left, self.value, self.roots, self.depth, self.base = feature, threshold, left, value, roots, depth, base

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        at = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = self.left[at] + (x[row, self.feature[at]] > self.threshold[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Grow trees level by level on histograms of the binned columns."""
    share = y.mean() if len(y) else 1.0
    base = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    feature, threshold, left, value, roots = [], [], [], [], []
    n, width = x.shape if len(x) else (0, len(STATISTICS))
    if 0 < share < 1:
        cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        raw = np.full(n, base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-12)
            node = np.zeros(n, np.int64)  # place among the level's open nodes; -1: in a leaf
            first = len(feature)
            roots.append(first)
            level = [first]
            for k in (feature, threshold, left, value):
                k.append(0)
            out = np.zeros(n)
            for d in range(depth + 1):
                live = np.flatnonzero(node >= 0)
                m = len(level)
                g_all, h_all = (np.bincount(node[live], v[live], m) for v in (grad, hess))
                best, choice = np.full(m, 1e-6), [None] * m
                if d < depth:
                    for j in range(width):
                        key = node[live] * bins + binned[live, j]
                        g, h = (np.bincount(key, v[live], m * bins).reshape(m, bins).cumsum(axis=1)[:, :-1] for v in (grad, hess))
                        gr, hr = g_all[:, None] - g, h_all[:, None] - h
                        gain = g * g / (h + SMOOTH) + gr * gr / (hr + SMOOTH) - (g_all * g_all / (h_all + SMOOTH))[:, None]
                        gain[(h < LEAST / 4) | (hr < LEAST / 4)] = -1
                        gain[:, len(cuts[j]) :] = -1
                        at = gain.argmax(axis=1)
                        for i in np.flatnonzero(gain[np.arange(m), at] > best):
                            best[i], choice[i] = gain[i, at[i]], (j, int(at[i]))
                following, place = [], np.full(node.shape, -1)
                for i, at in enumerate(level):
                    rows = live[node[live] == i]
                    if choice[i] is None:
                        feature[at], threshold[at], left[at] = 0, np.inf, at
                        value[at] = -rate * g_all[i] / (h_all[i] + SMOOTH)
                        out[rows] = value[at]
                        continue
                    j, cut = choice[i]
                    feature[at], threshold[at], left[at], value[at] = j, cuts[j][cut], len(feature), 0.0
                    for k in (feature, threshold, left, value):
                        k += [0, 0]
                    place[rows] = len(following) + (binned[rows, j] > cut)
                    following += [left[at], left[at] + 1]
                node, level = place, following
                if not level:
                    break
            raw = raw + out
    return Trees(np.array(feature, np.int64), np.array(threshold, np.float64), np.array(left, np.int64), np.array(value, np.float64), np.array(roots, np.int64), depth, base)


def train(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled rows that are not held out: those with the smallest hash of their id."""
    known = labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col("quality").cast("int").alias("quality")).where("labelled IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("labelled")))
    rows = measured.join(known, measured.doc_id == known.labelled).select(F.xxhash64("doc_id").alias("h"), "doc_id", "x", "quality")
    # the smallest hashes are taken; all but about twice as many as wanted are left out before any reaches the driver
    share = 2 * sample / max(known.count(), 1)
    if share < 1:
        few = rows.where(F.col("h") < F.lit(int(share * (1 << 64)) - (1 << 63)))
        rows = few if few.select("doc_id").count() >= sample else rows
    rows = rows.orderBy("h", "doc_id", "quality").select("x", "quality").limit(sample).toPandas()
    x = np.array(rows.x.tolist(), np.float64).reshape(len(rows), len(STATISTICS))
    return fit(x, rows.quality.to_numpy(np.float64))


def score(measured: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``with_statistics``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))
            s = trees.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_batches(measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "x"), batches, "doc_id long, held_out boolean, score double, predicted int")
