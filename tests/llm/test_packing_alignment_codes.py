"""Packing, alignment and vector codes against plain versions on small tables that hold nulls, empty and long texts,
ties, repeated rows, extra columns with clashing names, and no rows at all."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

rnd = random.Random(11)
WORDS = ["alpha", "Beta,", "straße", "CAFÉ", "don't", "naïve.", "日本語", "<|endoftext|>", "</w>", "x y", "▁b", "🙂🙃", "İz", "1234", "é", "</s>"]


def prose(n: int) -> str:
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 30)) for _ in range(n))


TEXTS = [None, "", " \n\t ", "one", "  two  blanks ", "tab\there\r\n next", "a▁b", "\x00 nul \x1c fs", prose(60), prose(4000), "ab" * 3000, " " * 50]
TEXTS += [prose(rnd.randint(1, 400)) for _ in range(30)] + [prose(5)] * 3
TEXTS += ["".join(rnd.choice("aB é'\n1!.,  　\x85") for _ in range(rnd.randint(1, 60))) for _ in range(40)]
ROWS = [(i, t, 1, "x", 2, 3.0) for i, t in enumerate(TEXTS)] + [(3, TEXTS[8], 5, "again", 0, 0.0), (None, TEXTS[9], 0, "null", 0, 0.0), (None, None, None, None, None, None)]


def tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


# ---------------------------------------------------------------- packing


@pytest.fixture(scope="module")
def packed(spark):
    from stockroom.llm.packing import pack

    docs = spark.createDataFrame(ROWS, "doc_id long, text string, length long, part string, rank int, sequence double").repartition(5)
    return pack(docs, ids=True).cache()


def test_pieces_are_the_librarys_tokens_cut_at_the_capacity(packed):
    t = tokenizer("word_bpe_49k.json")
    want = Counter()
    for doc, text, *_ in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            piece = ids[s : s + 4096]
            want[doc, k, s, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), tuple(piece)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in packed.collect()) == want
    assert any(k[1] > 0 for k in want)


def test_sequences_are_gapless_full_and_few(packed):
    from stockroom.llm.packing import sequences

    places = defaultdict(list)
    for r in packed.collect():
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(n for own in places.values() for _, n in own)
    assert len(places) == -(-total // 4096)  # so many small pieces fill every sequence
    made = {r.sequence_id: r for r in sequences(packed).collect()}
    assert set(made) == set(places) and sum(len(r.ids) for r in made.values()) == total
    assert all([o for o, _ in sorted(places[s])] == list(r.starts) for s, r in made.items())


def test_packing_no_rows(spark):
    from stockroom.llm.packing import pack

    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def laid_out(placed):
    bins, ranks = defaultdict(list), defaultdict(list)
    for length, first, last, sequence, each, at in placed:
        ranks[length] += range(first, last)
        for k in range(last - first):
            bins[sequence + k // each].append((at + k % each * length, length))
    return bins, ranks


@pytest.mark.parametrize("draw", ["uniform", "middle", "few lengths", "mostly small", "hot"])
@pytest.mark.parametrize("n", [1, 7, 300, 5000])
def test_plan_places_every_rank_once_and_no_worse_than_best_fit(draw, n):
    from stockroom.llm.packing import Sequences, plan

    rng = np.random.default_rng(n)
    lengths = {
        "uniform": lambda: rng.integers(1, 101, n),
        "middle": lambda: rng.integers(26, 60, n),
        "few lengths": lambda: rng.choice([17, 25, 34, 51, 100], n),
        "mostly small": lambda: np.minimum(rng.geometric(0.08, n), 100),
        "hot": lambda: np.where(rng.random(n) < 0.4, 41, rng.integers(1, 101, n)),
    }[draw]()
    counts = Counter(lengths.tolist())
    placed, used = plan(counts, 100)
    bins, ranks = laid_out(placed)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items()}
    assert sorted(bins) == list(range(used))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 100
    plain = Sequences(100)
    for length, many in sorted(counts.items(), reverse=True):
        plain.best_fit(length, 0, many)
    assert used <= plain.count


def test_grouping_alone_is_near_the_optimum_of_its_programme():
    from stockroom.llm.packing import configurations, grouped

    rng = np.random.default_rng(1)
    counts = Counter(rng.integers(30, 60, 20000).tolist())
    sizes = np.array(sorted(counts, reverse=True))
    columns, used = configurations(sizes, np.array([counts[s] for s in sizes]), 100)
    assert np.allclose(columns @ used, [counts[s] for s in sizes]) and ((columns * sizes[:, None]).sum(axis=0) <= 100).all()
    assert used.sum() <= grouped(counts, 100, 16, 96, False)[1] <= used.sum() + len(sizes)


def test_best_configuration_against_all_of_them():
    from stockroom.llm.packing import best_configuration

    rng = np.random.default_rng(2)
    for _ in range(50):
        sizes = np.sort(rng.choice(np.arange(3, 20), 4, replace=False))[::-1]
        prices = rng.integers(0, 50, 4)
        take, worth = best_configuration(sizes, prices, 20)
        best = max(sum(k * p for k, p in zip(c, prices)) for c in np.ndindex(7, 7, 7, 7) if sum(k * s for k, s in zip(c, sizes)) <= 20)
        assert worth == best == (take * prices).sum() and (take * sizes).sum() <= 20


# ---------------------------------------------------------------- alignment


def by_hand(rows):
    """Per row: (n_a, n_b, n_groups, groups, links) by walking both token lists."""
    from stockroom.llm.alignment import default_paths, encoders_of

    a_path, b_path = default_paths()
    m = encoders_of(open(a_path, encoding="utf-8").read(), open(b_path, "rb").read())
    out = []
    for _, text, *_ in rows:
        raw = (" " + (text or "")).encode()
        a, b = m.a.encode(" " + (text or ""), add_special_tokens=False).ids, m.b.encode(text or "")
        if not text or b"".join(m.a_bytes[i] for i in a) != raw or b"".join(m.b_bytes[i] for i in b) != raw:
            out.append((0, 0, 0, "", []))
            continue
        ends = [np.cumsum([len(of[x]) for x in ids]).tolist() for ids, of in ((a, m.a_bytes), (b, m.b_bytes))]
        sa, sb = ([*zip([0, *e[:-1]], e)] for e in ends)
        links, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            ea, eb = sa[i][1], sb[j][1]
            i, j = i + (ea <= eb), j + (eb <= ea)
        common = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, start = [], 0
        for end in common:
            own = [",".join(str(x) for x, (s, e) in zip(ids, spans) if start <= s and e <= end) for ids, spans in ((a, sa), (b, sb))]
            groups.append("|".join(own))
            start = end
        out.append((len(a), len(b), len(groups), ";".join(groups), links))
    return out


@pytest.mark.parametrize("limits", [{}, {"step": 7, "block_pairs": 1}])
def test_alignment_over_several_blocks_and_pieces(spark, limits):
    from stockroom.llm import alignment

    rows = [r for r in ROWS if len(r[1] or "") < 3000]  # walking by hand is quadratic
    docs = spark.createDataFrame(rows, "doc_id long, text string, block long, number string, a int, pairs double").coalesce(3)
    hand = by_hand(rows)
    counts = Counter(link for *_, links in hand for link in links)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    want = Counter()
    for (doc, *_), (n_a, n_b, n_groups, groups, links) in zip(rows, hand):
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        want[doc, n_a, n_b, n_groups, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), digest, groups] += 1
    got = alignment.align(docs.repartition(2), groups=True, **limits).collect()
    shown = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")
    assert Counter(tuple(r[c] if c != "groups" else r[c] or "" for c in shown) for r in got) == want
    assert sum(n for k, n in want.items() if k[1] == 0) > 3 and sum(n for k, n in want.items() if k[1]) > 40
    assert alignment.align(docs.where("false")).count() == 0


def test_merge_path_pieces_of_any_size():
    from stockroom.llm.alignment import diagonals, merge

    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, 40)), n)) for _ in "ab")
        starts = [np.concatenate([[0], x[:-1]]) for x in (a, b)]
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(starts[0][i], starts[1][j]) < min(a[i], b[j])]
        common = np.intersect1d(a, b)
        for step in (1, 3, 1000):
            x, y, group_a, group_b = merge(a, b, step)
            assert list(zip(x.tolist(), y.tolist())) == want
            assert (group_a == np.searchsorted(common, a)).all() and (group_b == np.searchsorted(common, b)).all()
            i, j = diagonals(a, b, step)
            assert (i[0], j[0], i[-1], j[-1]) == (0, 0, len(a), len(b)) and (np.diff(i + j) <= step + 1).all()


def test_blocks_number_pairs_across_batches():
    from stockroom.llm.alignment import Block

    block, rng, seen = Block(), np.random.default_rng(4), Counter()
    for _ in range(20):
        keys = np.unique(rng.integers(0, 200, 30))
        times = rng.integers(1, 5, len(keys))
        numbers = block.add(keys, times)
        for k, n in zip(keys.tolist(), times.tolist()):
            seen[k] += n
        again = block.add(keys, times * 0)
        assert (again == numbers).all()
    rows = [r for batch in block.rows(7) for r in batch.to_pylist()]
    assert {(r["a"] << 32 | r["b"]): r["n"] for r in rows} == seen and [r["number"] for r in rows] == list(range(len(rows)))


def test_encoders_equal_the_libraries_on_odd_text():
    from stockroom.llm.alignment import default_paths, encoders_of
    from stockroom.llm.packing import default_path, words_of

    letters = "aBé '\n1²!?.,<|>▁s \x85\U0001f600 \x1c　\t  İΣ"
    odd = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(4000)] + [None, ""]
    words = words_of(open(default_path(), encoding="utf-8").read())
    a_path, b_path = default_paths()
    m = encoders_of(open(a_path, encoding="utf-8").read(), open(b_path, "rb").read())
    for s in range(0, len(odd), 64):
        own = odd[s : s + 64]
        assert words.encode(pa.array(own, pa.string())) == words.whole([t or "" for t in own])
        (a, size_a), (b, size_b) = m.encode(pa.array(own, pa.string()))
        for t, end_a, n_a, end_b, n_b in zip(own, np.cumsum(size_a), size_a, np.cumsum(size_b), size_b):
            ids_a, ids_b = m.a.encode(" " + (t or ""), add_special_tokens=False).ids, m.b.encode(t or "")
            raw = (" " + (t or "")).encode()
            if not t or b"".join(m.b_bytes[i] for i in ids_b) != raw:
                assert n_a == n_b == 0
            else:
                assert a[end_a - n_a : end_a].tolist() == ids_a and b[end_b - n_b : end_b].tolist() == ids_b


# ---------------------------------------------------------------- vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Lloyd by plain loops over Python's integers: {(vec_id, vector): (code, error, label_error)} and the digest."""
    import math

    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    starts = [first[i] for i in sorted(first)[:entries]]
    dim = len(starts[0]) if starts else 0
    starts, kept = [s for s in starts if len(s) == dim], [k for k in kept if len(k[1]) == dim]
    size = [dim // parts + (p < dim % parts) for p in range(parts)]
    cut = lambda v, p: v[sum(size[:p]) : sum(size[: p + 1])]
    books = [[cut(s, p) for s in starts] for p in range(parts)]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e))
    nearest = lambda x, book: min(range(len(book)), key=lambda k: (far(x, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(cut(v, p), books[p])].append(cut(v, p))
            for k, own in groups.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out, sums = [], Counter()
    for i, v, lab in kept:
        at = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(far(cut(v, p), books[p][k]) for p, k in enumerate(at))
        sums[lab] += error
        out.append((i, "".join(f"{k:02x}" for k in at), error, lab))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter((i, code, error, sums[lab], digest) for i, code, error, lab in out)


def vectors(n: int, dim: int, scale: float = 1.0) -> list:
    rng = np.random.default_rng(dim)
    return [(int(i), (rng.normal(size=dim) * scale).tolist(), int(rng.integers(0, 4))) for i in rng.permutation(n) * 3 - 7]


CASES = {
    "plain": vectors(120, 16),
    "few ids": vectors(5, 16),
    "one row": vectors(1, 8),
    "all equal": [(i, [0.5] * 8, 1) for i in range(40)],
    "ties": [(i, [float(i % 3 - 1)] * 16, i % 2) for i in range(60)],
    "hot vector and label": vectors(60, 16) + [(1000 + i, [0.25] * 16, 9) for i in range(200)],
    "odd length": vectors(50, 11),
    "large numbers": vectors(24, 16, 4e4),
    "odd rows": vectors(50, 16) + [(None, [0.1] * 16, None), (200, None, 1), (201, [], 1), (202, [None] + [0.0] * 15, 1), (203, [float("nan")] + [0.0] * 15, 1), (204, [float("inf")] + [0.0] * 15, 1), (205, [1.0] * 9, 1), (-7, [0.2] * 16, None), (-7, [0.2] * 16, None)],
    "no ids": [(None, [0.1] * 8, 1)],
}


@pytest.mark.parametrize("case", [c for c in CASES if c != "no ids"])
def test_vector_codes_equal_plain_loops(spark, case):
    from stockroom.llm.vector_codes import vector_codes

    table = spark.createDataFrame([(i, v, lab, 5, "x") for i, v, lab in CASES[case]], "vec_id long, embedding array<double>, label int, rid long, code string").repartition(3)
    got, books = vector_codes(table)
    rows = got.collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in rows) == plain_codes(CASES[case])


def test_vector_codes_without_ids_or_rows_or_in_range(spark):
    from stockroom.llm.vector_codes import vector_codes

    schema = "vec_id long, embedding array<double>, label int"
    (row,) = vector_codes(spark.createDataFrame(CASES["no ids"], schema))[0].collect()
    assert row.code is None and row.error is None
    assert vector_codes(spark.createDataFrame([], schema))[0].count() == 0
    with pytest.raises(Exception, match="too large"):
        vector_codes(spark.createDataFrame([(1, [1e300] * 8, 1)], schema))[0].collect()


def test_salted_owners_and_heavy_labels_change_nothing(spark, monkeypatch):
    from stockroom.llm import vector_codes as vc

    rows = CASES["hot vector and label"]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(vc, "OWNER_ROWS", 20)
    monkeypatch.setattr(vc, "HEAVY", 2)
    got = vc.vector_codes(table)[0].collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(rows)


def test_codes_decode_to_their_entries(spark):
    from stockroom.llm.vector_codes import decode, vector_codes

    table = spark.createDataFrame(CASES["plain"], "vec_id long, embedding array<double>, label int")
    codes, books = vector_codes(table)
    original = {i: v for i, v, _ in CASES["plain"]}
    for r in decode(codes, books).collect():
        near = sum((int(np.floor(4096 * a)) - round(4096 * b)) ** 2 for a, b in zip(original[r.vec_id], r.approx))
        assert near == r.error
