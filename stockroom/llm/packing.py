"""Best-fit packing of tokenized documents into sequences of at most ``capacity`` tokens, by the linear grouping scheme.

Documents are encoded and cut into pieces in one pass that is written once. How many pieces have each length is all
that the packing needs, at most ``capacity`` counts however large the corpus is, so it is worked out on the driver for
counts, not for pieces:

1. Large lengths (over a share of the capacity) stand in descending order and are cut into groups of about equally
   many pieces; each length counts as the longest of its group.
2. The few sizes that are left are packed by configurations (how many of each size a sequence takes). Column
   generation solves the linear programme: simplex over the configurations known so far, and a knapsack over the
   prices of the sizes finds the next one.
3. Real pieces take the places of their group, in order of length, so a configuration breaks into runs of sequences
   that hold the same lengths.
4. Pieces that rounding the solution down left over, and the small ones, go where they fit best, longest first; a run
   of equal sequences is treated at once.

Which share makes a length large, how many groups there are and whether configurations leave the room free that the
small pieces would fill if spread evenly is taken from ``SCHEMES``: they are tried in turn until one meets the lower
bound (all tokens over the capacity), else the one with the fewest sequences counts. Where small pieces are plenty the
first meets it; where they are rare, tight configurations win. The last has one large piece a configuration, so the
result is never worse than best-fit decreasing.

The result is a list of placements: pieces of one length, from a rank on, go to consecutive sequences. It is bounded
by ``capacity`` too and is joined to the pieces by length and rank. A piece's rank among those of its length is its
number within the task that cut it plus the counts of the tasks before, so no length is ranked in one task.

Defined results. Null and empty texts: one piece that holds the end id alone. Every row is a document: repeated rows,
repeated and null ids are packed one by one; pieces of equal length are interchangeable. Texts are encoded whole and
only pieces over ``capacity`` are cut. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .bpe import byte_letters
from .common import map_batches

CAPACITY = 4096
#: Fixed value: the id that ends a document.
END_ID = 1
#: (small, groups, spare): lengths up to capacity / small are small, so fewer than ``small`` large pieces share a
#: sequence; sizes that large lengths are rounded up to, at most; whether configurations leave room for small pieces.
SCHEMES = ((3, 256, True), (4, 256, False), (8, 96, False), (16, 96, False), (2, 96, False))
#: Different words that a worker remembers.
REMEMBERED = 1_200_000
PLACEMENT = "length long, first long, last long, sequence long, each long, at long"


class _Seen(dict):
    """Numbers words in order of appearance; ``new`` are those that are not encoded yet."""

    def __init__(self, words=()) -> None:
        super().__init__(words)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Words:
    """Encodes texts as a tokenizers file does.

    Where its pattern drops white space, words between blanks and line feeds are encoded on their own and remembered.
    If the file only composes, folds white space and case and marks word ends, words of printable Latin-1 letters
    (which composing leaves alone) are lowered and split here, and the library merges many of them in one call: the
    marked ends tell them apart. Other words, and other files' texts, go through the library whole.
    """

    def __init__(self, source: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task a core already
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        data = json.loads(source)
        self.apart, plain = drops_space(data), folds_case(data)
        self.added = [t["content"] for t in data.get("added_tokens") or []]
        if self.apart and plain:
            pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            self.pattern = regex.compile(pattern)
            bare = {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
            self.merger = Tokenizer.from_str(json.dumps(data | bare))
            self.letters = {b: c for c, b in byte_letters().items()} | {32: " "}
            vocab = data["model"]["vocab"]
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(data["model"]["end_of_word_suffix"])]] = True
        else:
            self.pattern = None
        self.seen, self.ids = _Seen({"": 0}), [b""]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def simple(self, text: str) -> bool:
        """Whether the words of a text may be lowered and split here."""
        return self.pattern is not None and text.isprintable() and (text.isascii() or max(text) < "\u0100") and not any(t in text for t in self.added)

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of different words."""
        found: list[bytes | None] = [None] * len(words)
        places = range(len(words)) if self.simple("".join(words)) else [k for k, w in enumerate(words) if self.simple(w)]
        lowered = " ".join([words[k] for k in places]).lower().split(" ") if places else []
        counts = [1] * len(places)
        for i, word in enumerate(lowered):
            if not word.isalpha():
                parts = self.pattern.findall(word)
                lowered[i], counts[i] = " ".join(parts), len(parts)
        for s in range(0, len(lowered), 1000):
            block = " ".join(lowered[s : s + 1000])
            if not block.isascii():
                block = block.encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.merger.encode_batch_fast([block], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1]) * 4
            until = np.cumsum([0, *counts[s : s + 1000]])
            if len(cuts) == until[-1] + 1:  # as many ends as there are parts
                raw, at = ids.tobytes(), cuts[until].tolist()
                for k, a, b in zip(places[s : s + 1000], at[:-1], at[1:], strict=True):
                    found[k] = raw[a:b]
        rest = [k for k, x in enumerate(found) if x is None]
        for k, x in zip(rest, self.whole([words[k] for k in rest]), strict=True):
            found[k] = x
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (null: none) as little-endian unsigned 32-bit integers."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.apart:
            return self.whole(texts.to_pylist())
        if len(self.ids) > REMEMBERED:  # the words met first are the common ones
            self.seen, self.ids = _Seen(list(self.seen.items())[: REMEMBERED // 4]), self.ids[: REMEMBERED // 4]
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        numbers = list(map(self.seen.__getitem__, words.dictionary.to_numpy(zero_copy_only=False).tolist()))
        self.ids += self.learn(self.seen.new)
        self.seen.new = []
        own = [self.ids[n] for n in numbers]
        flat, size = np.frombuffer(b"".join(own), "<u4"), np.array([len(x) // 4 for x in own], np.int64)
        word = words.indices.to_numpy()
        long = size[word]
        until = np.concatenate([[0], np.cumsum(long)])
        ids = flat[np.repeat((np.cumsum(size) - size)[word] - until[:-1], long) + np.arange(until[-1])]
        cuts = until[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def folds_case(data: dict) -> bool:
    """Whether all that the file does to a printable Latin-1 word is to lower it, to split it by the pattern and to
    merge its bytes up to a marked end."""
    normalizer, model = data.get("normalizer") or {}, data["model"]
    steps = (data.get("pre_tokenizer") or {}).get("pretokenizers") or []
    composed = [(n["type"], (n.get("pattern") or {}).get("Regex"), n.get("content")) for n in normalizer.get("normalizers") or []]
    bytes_ = [{k: s.get(k) for k in ("type", "add_prefix_space", "use_regex")} for s in steps[1:]]
    return (
        composed == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]
        and bytes_ == [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
        and model["type"] == "BPE" and bool(model.get("end_of_word_suffix")) and not model.get("dropout") and not model.get("ignore_merges")
    )


def drops_space(data: dict) -> bool:
    """Whether the file keeps only what a pattern without white space matches, so that no token reaches over a blank."""
    steps = (data.get("pre_tokenizer") or {}).get("pretokenizers") or [data.get("pre_tokenizer") or {}]
    first = steps[0]
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    import regex

    return regex.search(first["pattern"].get("Regex", " "), "  \n \n\n") is None and not any(regex.search(r"\s", t["content"]) for t in data.get("added_tokens") or [])


_words: dict[str, Words] = {}


def words_of(source: str) -> Words:
    """The encoder of a file's content, made once in each Python process."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _words:
        _words[key] = Words(source)
    return _words[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and with ``ids`` the piece's ids; ``part`` is the task that cut the
    piece and ``nth`` its number (from 0) among the task's pieces of its length. Write the result before use: ``part``
    and ``nth`` belong together."""
    with open(path or default_path(), encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, taken = words_of(source.value), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in it:
            rows: list[tuple] = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text")), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    piece = raw[at : at + 4 * capacity]
                    n = len(piece) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(piece), part, taken[n], piece))
                    taken[n] += 1
            doc, k, at, n, crc, where, nth, raw = zip(*rows, strict=True) if rows else [()] * 8
            out = [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (at, n, crc)), pa.array(where, pa.int32()), pa.array(nth, pa.int64())]
            if ids:
                ends = np.concatenate([[0], np.cumsum(np.array(n, np.int64))])
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * ids)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * ids
    return map_batches(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), batches, schema)


def best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Knapsack: how many of each size fill ``capacity`` at the highest sum of (integer) prices, and that sum."""
    best = np.zeros(capacity + 1, np.int64)
    stages = [best]
    for s, p in zip(sizes.tolist(), prices.tolist(), strict=True):
        if p > 0:
            for _ in range(capacity // s):
                better = np.maximum(best[s:], best[:-s] + p)
                if np.array_equal(better, best[s:]):
                    break
                best = np.concatenate([best[:s], better])
        stages.append(best)
    left, take = capacity, np.zeros(len(sizes), np.int64)
    for i in range(len(sizes) - 1, -1, -1):
        while stages[i + 1][left] != stages[i][left]:
            take[i] += 1
            left -= sizes[i]
            if stages[i][left] + prices[i] * take[i] == stages[i + 1][left + sizes[i] * take[i]]:
                break
    return take, int(best[capacity])


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Optimal basic solution of the configuration programme: columns (sizes x configurations) and how often each is
    used (fractions). Each size starts with a configuration of its own kind only."""
    k, scale = len(sizes), 10**9
    columns = np.diag(capacity // sizes).astype(float)
    used = np.linalg.solve(columns, demand.astype(float))
    stalled = 0
    while k and stalled < 4 * k:  # a degenerate corner is left or kept: the sum of sequences is then the optimum to 1e-9
        prices = np.floor(np.linalg.solve(columns.T, np.ones(k)) * scale).astype(np.int64)
        take, worth = best_configuration(sizes, np.maximum(prices, 0), capacity)
        if worth <= scale * (1 + 1e-7):
            break
        change = np.linalg.solve(columns, take.astype(float))
        ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        stalled = stalled + 1 if ratio[out] <= 1e-9 else 0
        columns[:, out] = take
        used = np.maximum(np.linalg.solve(columns, demand.astype(float)), 0)
    return columns.astype(np.int64), used


class Sequences:
    """Sequences under construction, as runs (first sequence, how many) by the room that is left in each."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.count = capacity, 0
        self.room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.placed: list[tuple[int, int, int, int, int, int]] = []

    def open(self, many: int) -> int:
        self.count += many
        return self.count - many

    def put(self, length: int, rank: int, many: int, sequence: int, each: int, at: int) -> None:
        self.placed.append((length, rank, rank + many, sequence, each, at))

    def best_fit(self, length: int, rank: int, many: int) -> None:
        """Place ``many`` pieces: the fullest sequences that have room come first, and of a run each takes all it can."""
        for room in range(length, self.capacity + 1):
            if not many:
                return
            fits, runs = room // length, self.room[room]
            while runs and many:
                first, n = runs.pop()
                full = min(n, many // fits)
                rank, many = self._fill(length, rank, many, first, full, fits, room)
                if full < n and many:
                    rank, many = self._fill(length, rank, many, first + full, 1, many, room)
                    full += 1
                if full < n:
                    runs.append((first + full, n - full))
        fits = self.capacity // length
        if full := many // fits:
            rank, many = self._fill(length, rank, many, self.open(full), full, fits, self.capacity)
        if many:
            self._fill(length, rank, many, self.open(1), 1, many, self.capacity)

    def _fill(self, length: int, rank: int, many: int, first: int, n: int, each: int, room: int) -> tuple[int, int]:
        if n:
            self.put(length, rank, n * each, first, each, self.capacity - room)
            self.room[room - each * length].append((first, n))
        return rank + n * each, many - n * each


def group(counts: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Cut (length, count) in descending order of length into groups of about equally many pieces. A length is not
    divided: one that has a group's share or more is a group of its own, and so are all if they are few."""
    total, few = sum(n for _, n in counts), len(counts) <= groups
    out: list[list[tuple[int, int]]] = []
    seen = 0
    for length, n in counts:
        if not out or few or n * groups >= total or seen * groups >= total:
            out.append([])
            seen = 0
        out[-1].append((length, n))
        seen += n
    return out


Placements = list[tuple[int, int, int, int, int, int]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[Placements, int]:
    """Placements for ``counts`` pieces of each length, and the number of sequences. A placement (length, first, last,
    sequence, each, at) says that pieces of a length with ranks from ``first`` to before ``last`` go ``each`` to a
    sequence, from ``sequence`` on, at offset ``at``."""
    least = -(-sum(length * n for length, n in counts.items()) // capacity)
    best: tuple[Placements, int] = ([], 0)
    for scheme in SCHEMES:
        found = grouped(counts, capacity, *scheme)
        if not best[0] or found[1] < best[1]:
            best = found
        if best[1] <= least:
            break
    return best


def grouped(counts: dict[int, int], capacity: int, small: int, groups: int, spare: bool) -> tuple[Placements, int]:
    """The linear grouping scheme with one setting."""
    made = Sequences(capacity)
    lengths = sorted((n for n in counts.items() if n[1]), reverse=True)
    if lengths and lengths[0][0] == capacity:
        n = lengths.pop(0)[1]
        made.put(capacity, 0, n, made.open(n), 1, 0)
    large = group([x for x in lengths if x[0] > capacity // small], groups)
    sizes = np.array([g[0][0] for g in large], np.int64)
    demand = np.array([sum(n for _, n in g) for g in large], np.int64)
    room = capacity
    if spare and lengths:
        filled = sum(length * n for length, n in lengths if length <= capacity // small)
        room -= filled * capacity // sum(length * n for length, n in lengths)  # its share of each sequence
    alone = int((sizes > room).sum())  # these have a configuration each
    columns, used = configurations(sizes[alone:], demand[alone:], room)
    columns = np.block([[np.eye(alone, dtype=np.int64), np.zeros((alone, len(used)), np.int64)], [np.zeros((len(used), alone), np.int64), columns]])
    used = np.concatenate([demand[:alone], used])
    waiting = [[(length, 0, n) for length, n in reversed(g)] for g in large]  # the longest last

    def take(g: int, many: int) -> list[tuple[int, int, int]]:
        out = []
        while many and waiting[g]:
            length, rank, n = waiting[g].pop()
            out.append((length, rank, min(n, many)))
            if n > many:
                waiting[g].append((length, rank + many, n - many))
            many -= out[-1][2]
        return out

    for j in np.argsort(-used, kind="stable").tolist():
        many = int(used[j] + 1e-6)
        if not many:
            continue
        first = made.open(many)
        places = [take(g, many) for g in np.flatnonzero(columns[:, j]).tolist() for _ in range(columns[g, j])]
        ends = [np.cumsum([n for _, _, n in p]) for p in places]
        cuts = sorted({0, many, *(int(e) for x in ends for e in x)})
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = 0
            for runs, end in zip(places, ends, strict=True):
                r = int(np.searchsorted(end, a, side="right"))
                if r < len(runs):
                    length, rank, n = runs[r]
                    made.put(length, rank + a - int(end[r] - n), b - a, first + a, 1, at)
                    at += length
            made.room[capacity - at].append((first + a, b - a))
    rest = sorted((r for g in waiting for r in g), key=lambda r: (-r[0], r[1]))
    for length, rank, n in rest + [(length, 0, n) for length, n in lengths if length <= capacity // small]:
        made.best_fit(length, rank, n)
    return made.placed, made.count


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with ``ids`` its ids."""
    cut = materialize(pieces(docs, path, capacity, end_id, ids), "pieces")
    tasks = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    tasks = materialize(tasks, "piece-counts")
    counts = {r.length: r.n for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    placed, _ = plan(counts, capacity)
    spark = docs.sparkSession
    where = F.broadcast(spark.createDataFrame(placed, PLACEMENT))  # bounded by ``capacity``, not by the pieces
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(tasks.select("part", "length", before.alias("before")), ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    found = ranked.join(where, "length").where("rank >= first AND rank < last")
    nth = F.col("rank") - F.col("first")
    sequence = F.col("sequence") + F.expr("(rank - first) DIV each")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), (F.col("at") + nth % F.col("each") * F.col("length")).alias("offset"), *["ids"] * ids)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids, starts: the packed sequences themselves, from ``pack(..., ids=True)``; ``starts`` are
    the offsets at which documents begin, as attention masks need them."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("starts"))
