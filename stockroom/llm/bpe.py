"""Byte-level BPE encoding and decoding: speculate and verify.

Words get tokens by greedy longest match. That is the true encoding exactly if every token is what its own bytes
merge to and no merge would have crossed the border of two neighbours, which is checked for all different pairs of a
batch at once on arrays; only words with a failing pair are merged exactly, pair by pair.

The border check walks back in time. The last pieces beside the border are the tokens themselves; the one that was
merged later is taken apart first, which leaves its part beside the border. A merge of the two pieces that stand
there together would have come first if its rank is lower than that of the merge that ended the left piece, and not
higher than that of the merge that ended the right piece (of equal merges the leftmost is made first).

Defined results. Null text: empty, no tokens. Texts are encoded whole, however long. Added tokens of the file are
found in a text like the tokenizers library does by default. Rows are encoded one by one, so ties and repeated rows
need no rule; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_batches

#: Fixed value: how byte-level tokenizers of this family split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Different words that a worker remembers.
REMEMBERED = 800_000
NEVER = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable bytes stand for themselves, others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Model:
    """A byte-level BPE file, as arrays."""

    def __init__(self, source: str) -> None:
        data = json.loads(source)
        letters = byte_letters()
        vocab: dict[str, int] = data["model"]["vocab"]
        added = {t["content"]: t["id"] for t in data.get("added_tokens") or []}
        self.size = n = max([*vocab.values(), *added.values()]) + 1
        text = [b""] * n
        for token, i in vocab.items():
            if token not in added:
                text[i] = bytes(letters[c] for c in token)
        self.by_bytes = {t: i for i, t in enumerate(text) if t}
        for token, i in added.items():
            text[i] = token.encode()
        self.added = added
        self.added_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.pattern = regex.compile(PATTERN)
        self.text = text
        self.lengths = np.array([len(t) for t in text], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(text), np.uint8)
        self.byte_id = [self.by_bytes[bytes([b])] for b in range(256)]
        self.born = np.full(n, -1, np.int64)  # rank of the merge that makes a token; -1: a single byte
        self.left, self.right = np.arange(n), np.arange(n)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.sound = True  # each token comes from one merge
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = self.by_bytes[text[a] + text[b]]
            self.sound &= self.born[made] < 0
            self.born[made], self.left[made], self.right[made] = rank, a, b
            self.merge[a, b] = (rank, made)
        keys = np.array([a * n + b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        self.trie: dict = {}
        for t, i in self.by_bytes.items():
            node = self.trie
            for c in t:
                node = node.setdefault(c, {})
            node[-1] = i
        self.usable = np.zeros(n, bool)  # tokens that their own bytes merge to
        for t, i in self.by_bytes.items():
            self.usable[i] = self.born[i] < 0 or self.exact(t) == [i]
        self.seen: dict[str, bytes] = {}

    def exact(self, word: bytes) -> list[int]:
        """Merge a word pair by pair, lowest rank first, leftmost of equals."""
        ids = [self.byte_id[b] for b in word]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(*self.merge[p], i, p) for i in range(len(ids) - 1) if (p := (ids[i], ids[i + 1])) in self.merge]
        heap = [(rank, i, p, made) for rank, made, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, pair, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j < 0 or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if got := self.merge.get((made, ids[k])):
                    heapq.heappush(heap, (got[0], i, (made, ids[k]), got[1]))
            h = before[i]
            if h >= 0 and (got := self.merge.get((ids[h], made))):
                heapq.heappush(heap, (got[0], h, (ids[h], made), got[1]))
        return [i for i in ids if i >= 0]

    def greedy(self, word: bytes) -> list[int]:
        """Longest token at each place; every byte is a token, so there always is one."""
        out, at, n, trie = [], 0, len(word), self.trie
        while at < n:
            node, i = trie, at
            while i < n and (node := node.get(word[i])) is not None:
                i += 1
                if -1 in node:
                    best, end = node[-1], i
            out.append(best)
            at = end
        return out

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border between tokens a and b, for arrays of them."""
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        end_x, end_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(live):
            rank = self.rank_of(x, y)
            cross = (rank < end_x) & (rank <= end_y) & (rank < NEVER)
            good[live[cross]] = False
            born_x, born_y = self.born[x], self.born[y]
            go = ~cross & ((born_x >= 0) | (born_y >= 0))
            live, x, y, end_x, end_y, born_x, born_y = (v[go] for v in (live, x, y, end_x, end_y, born_x, born_y))
            undo_x = born_x > born_y
            end_x, end_y = np.where(undo_x, born_x, end_x), np.where(undo_x, end_y, born_y)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return good

    def learn(self, words: list[str]) -> None:
        """Encode different words that are not remembered yet."""
        raw = [w.encode() for w in words]
        if not self.sound:
            tokens = [self.exact(w) for w in raw]
        else:
            tokens = [self.greedy(w) for w in raw]
            size = np.fromiter(map(len, tokens), np.int64, len(tokens))
            ids = np.fromiter((t for x in tokens for t in x), np.int64, int(size.sum()))
            word = np.repeat(np.arange(len(tokens)), size)
            inner = np.flatnonzero(word[1:] == word[:-1])
            pairs, back = np.unique(ids[inner] * self.size + ids[inner + 1], return_inverse=True)
            good = self.compatible(pairs // self.size, pairs % self.size)[back]
            wrong = np.zeros(len(tokens), bool)
            wrong[word[inner[~good]]] = True
            wrong[word[~self.usable[ids]]] = True
            for i in np.flatnonzero(wrong).tolist():
                tokens[i] = self.exact(raw[i])
        for w, t in zip(words, tokens, strict=True):
            self.seen[w] = np.array(t, "<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        """Words of a text; an added token is a piece of its own."""
        if self.added_pattern is None or not any(t in text for t in self.added):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in self.added_pattern.finditer(text):
            out += self.pattern.findall(text[at : m.start()])
            out.append(("added", m[0]))
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pieces(t) for t in texts]
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        for token, i in self.added.items():
            self.seen["added", token] = np.array([i], "<u4").tobytes()
        new = {w for words in split for w in words}.difference(self.seen)
        if new:
            self.learn(list(new))
        return [b"".join(map(self.seen.__getitem__, words)) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        size = self.lengths[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.offsets[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at].tobytes().decode("utf-8", "replace")


_models: dict[str, Model] = {}


def model_of(source: str) -> Model:
    """The model of a file's content, parsed once in each Python process."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _models:
        _models[key] = Model(source)
    return _models[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe(docs: DataFrame, path: str | None = None, ids: bool = True, decoded: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and if wanted ids (array) and decoded.

    ``path``: a byte-level BPE file of the tokenizers library, read here and sent to the workers (a vocabulary's
    size bounds it).
    """
    with open(path or default_path(), encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(source.value)
        for batch in it:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            raw = model.encode(texts)
            del texts
            arrays = [np.frombuffer(r, "<u4") for r in raw]
            back = [model.decode(a) for a in arrays]
            out = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(a) for a in arrays], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
            }
            if ids:
                ends = np.cumsum([0] + [len(a) for a in arrays])
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.empty(0, "<u4")]).astype(np.int32)))
            if decoded:
                out["decoded"] = pa.array(back, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    return map_batches(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), batches, schema)
