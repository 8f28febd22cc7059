"""Alignment of two tokenizers' tokens over the same bytes, by merge-path partitioning.

The ends of A's and B's tokens are two sorted lists over the bytes of a batch of documents. To merge them, the merge
path is cut at equal steps: a binary search on each diagonal finds how many ends of either list lie before it, for all
diagonals at once. The pieces are independent of each other and of equal work, however long a document is. Each piece
merges its ends; what lies between two neighbouring ends is covered by one token of A and one of B, so each end stands
for one overlap, and one where both lists end closes a group. A group that reaches over a piece's border goes on: groups
are numbered through by adding up what the pieces before have closed.

How often ids are linked is a count over the corpus. A task counts pairs for its *block* of documents first: a block
has its own numbers for the different pairs in it, and a document keeps only (number, times). Counts are summed by
pair, the best of each B id is marked, and a block gets back what it needs to know of its own pairs; a pair that all
documents hold is one row a block. Blocks are bounded by their pairs, so neither side of the last step is unbounded.

Defined results. Texts that are null or empty, or whose joined token bytes differ from space + text, have no tokens:
zeros and an empty ``groups_sha256``. Texts are aligned whole. Every row is a document: repeated rows and ids count one
by one, null ids stay. Equal counts of a B id are all best. Other columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .bpe import byte_letters
from .common import importable, map_batches

#: Ends that a piece of the merge path holds.
STEP = 1 << 16
#: A block ends with so many different pairs, or so many (document, pair) entries.
BLOCK_PAIRS, BLOCK_ENTRIES = 1 << 19, 1 << 22
#: Different chunks that a worker remembers.
REMEMBERED = 800_000
#: A blank between a character that is no blank and one that is no white space.
BORDER = re.compile(r"(?<! ) (?=\S)")
#: Texts that cannot be cut at every blank: white space after a blank, at the start, or a blank at the end. The first is
#: for Arrow, whose \\s knows ASCII only; it names all that Python takes for white space.
ODD = "( |^)([\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}])| $"
IRREGULAR = re.compile(r"(?: |\A)\s| \Z|\A\Z")
ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs binary, times binary, number int, a int, b int, n long"


class Encoders:
    """Both tokenizers, and what each token's bytes are. If neither can have a token across it, texts are cut at
    ``BORDER`` and each different chunk is encoded once."""

    def __init__(self, a_source: str, b_source: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task a core already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_source)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_source)
        letters = byte_letters()
        data = json.loads(a_source)
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_len, self.b_len = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        before = data.get("pre_tokenizer") or {}
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not data.get("normalizer")
        self.apart = bool(byte_level) and not any(re.search("[^▁]▁", p) for p in names)
        self.seen: dict[str, int] = {}
        self.ids_a: list[bytes] = []
        self.ids_b: list[bytes] = []
        self.unequal: list[bool] = []
        # a token's text in the groups: A followed by "," or "|", B by ",", ";" or nothing
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        self.written = [f"{i}{end}" for end in ",|" for i in range(n_a)] + [f"{i}{end}" for end in (",", ";", "") for i in range(n_b)]

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks (given without their first blank). Regular ones are encoded many at a time: the bytes of
        the tokens tell where each chunk ends."""
        for s in range(0, len(chunks), 500):
            own = chunks[s : s + 500]
            raw = [(" " + c).encode() for c in own]
            if not self.apart or IRREGULAR.search(" ".join(own)) or not self._learn_together(own, raw):
                self._learn_each(own, raw)

    def _learn_together(self, chunks: list[str], raw: list[bytes]) -> bool:
        text, joined = " ".join(chunks), b"".join(raw)
        until = np.cumsum([len(r) for r in raw])
        for encode, lengths, known, kept in (
            (lambda: self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.a_len, self.a_bytes, self.ids_a),
            (lambda: self.b.encode(text), self.b_len, self.b_bytes, self.ids_b),
        ):
            ids = np.array(encode(), "<u4")
            ends = np.cumsum(lengths[ids])
            at = np.searchsorted(ends, until)
            if not len(ids) or ends[-1] != until[-1] or (ends[at] != until).any() or b"".join(map(known.__getitem__, ids.tolist())) != joined:
                del self.ids_a[len(self.ids_b) :]
                return False
            cuts, flat = (4 * np.concatenate([[0], at + 1])).tolist(), ids.tobytes()
            kept += [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.unequal += [False] * len(chunks)
        return True

    def _learn_each(self, chunks: list[str], raw: list[bytes]) -> None:
        for r, a, b in zip(raw, self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False), self.b.encode(chunks, num_threads=1), strict=True):
            self.ids_a.append(np.array(a.ids, "<u4").tobytes())
            self.ids_b.append(np.array(b, "<u4").tobytes())
            self.unequal.append(b"".join([self.a_bytes[i] for i in a.ids]) != r or b"".join([self.b_bytes[i] for i in b]) != r)

    def chunks(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different chunks of the texts, each chunk's place among them, and where each text's chunks begin."""
        empty = pc.equal(pc.binary_length(texts), 0)
        if self.apart:
            odd = pc.match_substring_regex(texts, ODD)
            own = pc.split_pattern(pc.if_else(pc.or_(odd, empty), None, texts), " ")
        else:
            odd = pc.invert(empty)
            own = pc.split_pattern(pc.if_else(pc.is_valid(texts), None, texts), " ")
        words = own.flatten().dictionary_encode()
        size = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        found, place = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy().astype(np.int64)
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(rows):
            return found, place, np.concatenate([[0], np.cumsum(size)])
        starts = np.cumsum(size) - size
        numbers, places, at = {c: i for i, c in enumerate(found)}, [], 0
        for row in rows.tolist():
            text = texts[row].as_py()
            cut = [c for c in BORDER.split(" " + text)] if self.apart else [" " + text]
            cut = ([cut[0][1:]] if cut[0] else []) + cut[1:]  # each without its first blank
            places += [place[at : starts[row]], np.array([numbers.setdefault(c, len(numbers)) for c in cut], np.int64)]
            at, size[row] = starts[row], len(cut)
        return list(numbers), np.concatenate([*places, place[at:]]), np.concatenate([[0], np.cumsum(size)])

    def encode(self, texts: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """For A and for B: the ids of all texts, and how many each text has; none where the bytes differ."""
        if len(self.ids_a) > REMEMBERED:  # the chunks met first are the common ones
            keep = REMEMBERED // 4
            self.seen = dict(list(self.seen.items())[:keep])
            self.ids_a, self.ids_b, self.unequal = self.ids_a[:keep], self.ids_b[:keep], self.unequal[:keep]
        chunks, place, first = self.chunks(pc.fill_null(texts.cast(pa.string()), ""))
        new = [c for c in chunks if c not in self.seen]
        self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new)), strict=True))
        self.learn(new)
        numbers = [self.seen[c] for c in chunks]
        unequal = np.array([self.unequal[n] for n in numbers], bool)[place]
        bad = np.concatenate([[0], np.cumsum(unequal)])[first]
        good = np.repeat(bad[1:] == bad[:-1], np.diff(first))
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        out = []
        for ids in (self.ids_a, self.ids_b):
            own = [ids[n] for n in numbers]
            flat, size = np.frombuffer(b"".join(own), "<u4").astype(np.int64), np.array([len(x) // 4 for x in own], np.int64)
            size_of = size[place] * good
            until = np.concatenate([[0], np.cumsum(size_of)])
            take = np.repeat((np.cumsum(size) - size)[place] - until[:-1], size_of) + np.arange(until[-1])
            out.append((flat[take], np.bincount(text, size_of, len(first) - 1).astype(np.int64)))
        return out[0], out[1]


_encoders: dict[str, Encoders] = {}


def encoders_of(a_source: str, b_source: bytes) -> Encoders:
    """The encoders of two files' contents, made once in each Python process."""
    key = hashlib.sha256(a_source.encode() + b_source).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoders(a_source, b_source)
    return _encoders[key]


def diagonals(a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut the merge of two sorted lists every ``step`` ends: how many of ``a`` and of ``b`` lie before each cut, from
    (0, 0) to the whole lists. An end that both lists hold is not parted."""
    total = len(a) + len(b)
    d = np.unique(np.append(np.arange(0, total, step), total))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        first = np.zeros(len(d), bool)
        first[open_] = a[mid[open_]] <= b[d[open_] - mid[open_] - 1]
        low, high = np.where(open_ & first, mid + 1, low), np.where(open_ & ~first, mid, high)
    i, j = low, d - low
    tied = np.flatnonzero((i > 0) & (j < len(b)))
    tied = tied[a[i[tied] - 1] == b[j[tied]]]
    j[tied] += 1
    return i, j


def merge(a: np.ndarray, b: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps of two lists of token ends over the same bytes, as indexes (of A, of B), and each token's group."""
    x, y, group_a, group_b = ([np.empty(0, np.int64)] for _ in range(4))
    i, j = diagonals(a, b, step)
    closed = 0
    for i0, i1, j0, j1 in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True):
        own_a, own_b = a[i0:i1], b[j0:j1]
        ends = np.union1d(own_a, own_b)
        at_a, at_b = i0 + np.searchsorted(own_a, ends), j0 + np.searchsorted(own_b, ends)
        common = ends[(a[at_a] == ends) & (b[at_b] == ends)]
        x.append(at_a)
        y.append(at_b)
        group_a.append(closed + np.searchsorted(common, own_a))
        group_b.append(closed + np.searchsorted(common, own_b))
        closed += len(common)
    return tuple(np.concatenate(v) for v in (x, y, group_a, group_b))


def written_groups(model: Encoders, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, last_b: np.ndarray) -> np.ndarray:
    """For each token in the order in which groups are written: its place in ``model.written``."""
    n_a, n_b = len(model.a_bytes), len(model.b_bytes)
    out = np.empty(len(a) + len(b), np.int64)
    ends_a, ends_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (group_a, group_b))
    out[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + n_a * ends_a
    out[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = 2 * n_a + b + n_b * np.where(last_b, 2, ends_b)
    return out


class Block:
    """Numbers the different pairs of a block in order of appearance and counts them."""

    def __init__(self) -> None:
        self.keys, self.numbers = np.empty(0, np.int64), np.empty(0, np.int64)
        self.counts = np.empty(0, np.int64)
        self.entries = 0

    def add(self, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Count different keys; their numbers."""
        at = np.searchsorted(self.keys, keys)
        known = np.append(self.keys, -1)[at] == keys
        numbers = np.append(self.numbers, 0)[at]
        new = len(self.counts) + np.arange(int((~known).sum()))
        numbers[~known] = new
        merged = np.concatenate([self.keys, keys[~known]])
        order = np.argsort(merged, kind="stable")
        self.keys, self.numbers = merged[order], np.concatenate([self.numbers, new])[order]
        self.counts = np.concatenate([self.counts, np.zeros(len(new), np.int64)])
        self.counts[numbers] += times
        return numbers

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        key = np.empty(len(self.keys), np.int64)
        key[self.numbers] = self.keys
        for s in range(0, len(key), 1 << 16):
            k = key[s : s + (1 << 16)]
            yield _rows(len(k), block=np.full(len(k), block), number=np.arange(s, s + len(k)), a=k >> 32, b=k & 0xFFFFFFFF, n=self.counts[s : s + len(k)])


_FIELDS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("groups", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()), *((c, pa.int32()) for c in ("number", "a", "b")), ("n", pa.int64())])


def _rows(size: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _FIELDS]
    return pa.RecordBatch.from_arrays(arrays, schema=_FIELDS)


def _small(x: np.ndarray) -> bytes:
    """Numbers as bytes, in the narrowest of 1, 2 and 4 bytes; the first byte says which."""
    top = int(x.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def aligned(docs: DataFrame, a_path: str, b_path: str, groups: bool, step: int = STEP, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Rows of documents (with ``pairs``: the numbers of its pairs, ascending, as differences; ``times``), and rows of
    the blocks' pairs (``number`` is not null)."""
    sc = docs.sparkSession.sparkContext
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        sources = sc.broadcast((f.read(), g.read()))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoders_of(*sources.value)
        number, block = TaskContext.get().partitionId() << 32, Block()
        for batch in it:
            (a, size_a), (b, size_b) = model.encode(batch.column("text"))
            x, y, group_a, group_b = merge(np.cumsum(model.a_len[a]), np.cumsum(model.b_len[b]), step)
            until_a, until_b = np.cumsum(size_a), np.cumsum(size_b)
            link_doc = np.searchsorted(until_a, x, side="right")
            n_links = np.bincount(link_doc, minlength=len(size_a))
            some = size_a > 0
            last_b = np.zeros(len(b), bool)
            last_b[until_b[some] - 1] = True
            closed = np.zeros(len(size_a), np.int64)  # groups closed up to a document's end
            closed[some] = group_a[until_a[some] - 1] + 1
            n_groups = np.diff(np.maximum.accumulate(closed), prepend=0)
            codes = written_groups(model, a, b, group_a, group_b, last_b).tolist()
            texts = ["".join(map(model.written.__getitem__, codes[e - n : e])) for e, n in zip((until_a + until_b).tolist(), (size_a + size_b).tolist(), strict=True)]
            keys, inverse, times = np.unique(a[x] << 32 | b[y], return_inverse=True, return_counts=True)
            pair = block.add(keys, times)[inverse]
            width = len(block.counts) + 1
            entry, times = np.unique(link_doc * width + pair, return_counts=True)
            entry_doc, entry = entry // width, entry % width
            cuts = np.searchsorted(entry_doc, np.arange(len(size_a) + 1)).tolist()
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            block.entries += len(entry)
            columns = {
                "block": np.full(len(size_a), number),
                "doc_id": batch.column("doc_id"),
                "n_a": size_a,
                "n_b": size_b,
                "n_groups": n_groups,
                "n_links": n_links,
                "groups_sha256": [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts],
                "pairs": [_small(np.diff(entry[s:e], prepend=0)) for s, e in spans],
                "times": [_small(times[s:e]) for s, e in spans],
            }
            yield _rows(len(size_a), **columns, **({"groups": texts} if groups else {}))
            if len(block.counts) >= block_pairs or block.entries >= BLOCK_ENTRIES:
                yield from block.rows(number)
                number, block = number + 1, Block()
        yield from block.rows(number)

    return map_batches(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), batches, ALIGNED)


def _sums(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """n_best and count_sum of a block's documents, from the counts of the block's pairs."""
    count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
    number = pairs.column("number").to_numpy()
    count[number], best[number] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for pair, times in zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist(), strict=True):
        pair, times = np.cumsum(_wide(pair)), _wide(times)
        n_best.append(int((best[pair] * times).sum()))
        count_sum.append(int((count[pair] * times).sum()))
    docs = docs.drop_columns(["block", "pairs", "times"])
    docs = docs.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
    return docs


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def pair_counts(table: DataFrame) -> DataFrame:
    """a, b, count, best: how many links of the corpus hold each pair of ids, and whether no A id has more with this B."""
    total = table.where("number IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("count"))
    # a B id has as many rows as A has ids at most
    return total.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, groups: bool = False, step: int = STEP, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with ``groups``
    the groups themselves (``a1,a2|b1;a3|b2,b3``)."""
    importable(docs.sparkSession)
    paths = default_paths()
    table = materialize(aligned(docs, a_path or paths[0], b_path or paths[1], groups, step, block_pairs), "aligned")
    known = table.where("number IS NOT NULL").join(pair_counts(table), ["a", "b"]).select(F.col("block").alias("of_block"), "number", "count", "best")
    shown = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * groups, "pairs", "times"]
    rows = table.where("number IS NULL").select(*shown)
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string" + ", groups string" * groups + ", n_best long, count_sum long"
    return rows.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(_sums, schema)
