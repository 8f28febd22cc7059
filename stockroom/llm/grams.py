"""Rolling hashes over symbol sequences, and the anchored runs of windows that repeated text is found by.

A document is a sequence of 64-bit symbols (bytes or words). Every window of ``length`` symbols picks the gram of
``gram`` symbols with the smallest hash inside it. Equal windows pick equal grams wherever they stand, so only
windows whose picked gram occurs more than once can repeat. Consecutive windows that pick the gram at the same
place form a run; runs number about ``2 / (length - gram + 2)`` of the positions, which is what gets shuffled.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_SECOND = 0xC2B2AE3D27D4EB4F
#: Longest stretch hashed at once: it may split a run, windows stay the same.
SEGMENT = 1 << 20
#: Bits of a place in a segment; the others of a gram's hash decide which gram a window picks, the leftmost on ties.
PLACE = U64((1 << 21) - 1)


TOP = U64(1 << 63)


def byte_symbols(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, 256, dtype=U64)


BYTES = byte_symbols()
#: The next symbol's weight and its inverse, for every place of a segment; filled when first needed.
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)

        def run(b: int) -> np.ndarray:
            out = np.full(size, b & _MASK, dtype=U64)
            out[0] = 1
            return np.cumprod(out, dtype=U64)

        have = _powers[base] = (run(base), run(inverse))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a polynomial hash over all 64 bits (its low bits are weak)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def prefix_sums(symbols: np.ndarray, base: int = _BASE) -> np.ndarray:
    out = np.zeros(len(symbols) + 1, dtype=U64)
    np.cumsum(symbols * powers(base, len(symbols) + 1)[0][: len(symbols)], out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of symbols[start:end] for arrays of starts and ends, the same wherever the stretch stands."""
    return mix((sums[ends] - sums[starts]) * powers(base, len(sums))[1][starts])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, in log2(width) passes."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    if done < width:
        rest = width - done
        x = np.minimum(x[:-rest], x[rest:])
    return x


def picked(hashes: np.ndarray) -> int:
    """Place of the gram that a window with these gram hashes picks."""
    return int(np.argmin((hashes & ~PLACE) | np.arange(len(hashes)).astype(U64)))


class Common:
    """Gram hashes that windows pick only if they hold no other: many documents hold them, and a window that also holds
    something of its own meets fewer others by that."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(hashes)
        self.table = np.zeros(1 << 22, bool)
        self.table[self.hashes >> U64(42)] = True

    def ranks(self, own: np.ndarray) -> np.ndarray:
        """The hashes as windows compare them: common ones last."""
        out = own & ~TOP
        if len(self.hashes):
            at = np.flatnonzero(self.table[own >> U64(42)])
            place = np.minimum(np.searchsorted(self.hashes, own[at]), len(self.hashes) - 1)
            out[at[self.hashes[place] == own[at]]] |= TOP
        return out


def word_symbols(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit symbol for each word of a text, with the words' first and past-last byte."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        none = np.empty(0, np.int64)
        return np.empty(0, U64), none, none
    inside = np.empty(len(b) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
    inside[1:-1] &= 1
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(b) <= SEGMENT:
        return stretch_hash(prefix_sums(BYTES[b]), starts, ends), starts, ends
    symbols = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):  # words of a long text, a segment at a time; a word longer than that is a segment of its own
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, "right")))
        lo = int(starts[at])
        sums = prefix_sums(BYTES[b[lo : int(ends[upto - 1])]])
        symbols[at:upto] = stretch_hash(sums, starts[at:upto] - lo, ends[at:upto] - lo)
        at = upto
    return symbols, starts, ends


def runs(symbols: np.ndarray, length: int, gram: int, common: Common | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchored runs of all windows of ``length`` symbols: (gram hash, hash of the whole run, first window, windows).

    The run's hash is over all symbols its windows cover and their number, from another base than the gram's.
    """
    found = []
    n = len(symbols)
    for at in range(0, max(0, n - length + 1), SEGMENT):
        part = symbols[at : at + SEGMENT + length - 1]
        sums = prefix_sums(part)
        starts = np.arange(len(part) - gram + 1)
        own = stretch_hash(sums, starts, starts + gram)
        ranks = own if common is None else common.ranks(own)
        at_least = sliding_min((ranks & ~PLACE) | starts.astype(U64), length - gram + 1)
        cut = np.flatnonzero(np.concatenate([[True], at_least[1:] != at_least[:-1]]))
        size = np.diff(np.append(cut, len(at_least)))
        whole = stretch_hash(prefix_sums(part, _SECOND), cut, cut + size + length - 1, _SECOND) + size.astype(U64)
        found.append((own[at_least[cut] & PLACE], whole, cut + at, size))
    if not found:
        return np.empty(0, U64), np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def covered(starts: np.ndarray, windows: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window: runs of ``windows`` windows of ``length`` from each start. Places past n are cut."""
    edge = np.zeros(n + 1, np.int64)
    starts = np.minimum(starts, n)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + windows + length - 1, n), -1)
    return np.cumsum(edge)[:n] > 0
