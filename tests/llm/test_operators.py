"""Each operator against a brute-force version on small tables that hold nulls, empty and long texts, ties, repeated
rows, extra columns with clashing names, and no rows at all."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

rnd = random.Random(5)
WORDS = ["alpha", "beta", "Gamma", "delta", "é", "zeta", "eta", "theta", "iota", "kappa", "mu", "nu"]


def prose(n: int) -> str:
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 40)) for _ in range(n))


SHARED, LONG = prose(40), prose(4000)
TEXTS = [None, "", " \n\t ", "one two", "One  two", prose(60), LONG, LONG, "x " * 300, "ab" * 400, "🙂" * 60, "Released under the MIT License."]
TEXTS += [f"{prose(8)} {SHARED} {prose(9)}" for _ in range(6)] + [SHARED, SHARED]
_near = prose(80)
TEXTS += [_near, _near + " tail", "head " + _near, _near.upper(), _near.replace("alpha", "omega")]
ROWS = [(i, t, f"s{i}", -i, "x") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "again", 0, "x"), (None, TEXTS[6], "none", 0, "x"), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, spans string, s long, doc string")


@pytest.fixture(scope="module")
def keyed():
    return {i: (t or "").encode() for i, t in enumerate(TEXTS)}


def test_suffix_dedup(docs, keyed):
    from stockroom.llm.suffix_dedup import suffix_dedup

    out = [r for r in suffix_dedup(docs).collect()]
    assert len(out) == len(ROWS) and suffix_dedup(docs.where("false")).count() == 0
    seen, want = set(), {}
    for i, raw in sorted(keyed.items()):
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        want[i] = (len(raw), sum(gone), hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    for r in out:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.kept_sha256) == want[r.doc_id]


def test_suffix_dedup_with_common_grams(docs, keyed, monkeypatch):
    """Grams of nearly every repeat count as common: anchors move, results stay."""
    from stockroom.llm import suffix_dedup as sd

    monkeypatch.setattr(sd, "SAMPLED", 1)
    monkeypatch.setattr(sd, "COMMON", 2)
    assert len(sd.common_grams(docs, sd.GRAM)) > 500
    test_suffix_dedup(docs, keyed)


def test_substring_dedup(docs, keyed):
    from stockroom.llm.debruijn_dedup import substring_dedup

    out = substring_dedup(docs).collect()
    assert len(out) == len(ROWS) and substring_dedup(docs.where("false")).count() == 0
    first, want = {}, {}
    for i, raw in sorted(keyed.items()):
        words = raw.split()
        gone = [False] * len(words)
        for s in range(len(words) - 12):
            if first.setdefault(tuple(words[s : s + 13]), i) < i:
                gone[s : s + 13] = [True] * 13
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        want[i] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    assert sum(x[1] for x in want.values()) > 0
    for r in out:
        assert (r.doc_id is None and r.n_removed == 0) or (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]


def _shingles(raw: bytes) -> list[tuple]:
    w = raw.lower().split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def test_ngram_join(docs, keyed):
    from stockroom.llm.ngram_join import ngram_join

    sets = {i: frozenset(_shingles(raw)) for i, raw in keyed.items()}
    reach = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                o = len(sets[a] & sets[b])
                if o and 100 * o >= 75 * len(sets[a] | sets[b]):
                    reach[a] = reach[b] = min(reach[a], reach[b])
    out = ngram_join(docs).collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert r.component_id is None if r.doc_id is None else (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), reach[r.doc_id])
    assert any(reach[i] != i for i in reach)


def test_decontaminate(spark, docs, keyed):
    from stockroom.llm.decontaminate import contaminated

    items = {1: " ".join(SHARED.split()[3:33]), 2: "one two", 3: prose(20), 4: " ".join([*SHARED.split()[:28], "new"]), 5: None, 6: " "}
    bench = spark.createDataFrame([*items.items(), (1, items[1]), (None, "one two")], "item_id long, text string").selectExpr("*", "1 AS n", "2 AS k")
    want = {}
    for d, raw in keyed.items():
        w = raw.lower().split()
        for i, t in items.items():
            own = (t or "").lower().encode().split()
            if not own or not w:
                continue
            n, k = len(own), min(5, len(own))
            grams = lambda x, k=k: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
            best = max(((c := grams(w[s : s + n]), sum((c & grams(own)).values()) / max(1, sum((c | grams(own)).values())))[1] for s in range(max(1, len(w) - n + 1))), default=0)
            if best >= 0.75:
                want[d, i] = best
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(docs, bench).collect()}
    assert set(got) == set(want) and want and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert contaminated(docs, bench.where("false")).count() == 0


def test_bpe_like_the_library(docs):
    tokenizers = pytest.importorskip("tokenizers")
    from stockroom.llm.bpe import bpe, default_path, model_of

    whole = tokenizers.Tokenizer.from_file(default_path())
    out = bpe(docs).collect()
    assert len(out) == len(ROWS) and bpe(docs.where("false")).count() == 0
    by_digest = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in out)
    for i, t, *_ in ROWS:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids, "<u4")
        by_digest[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest()] -= 1
    assert not any(by_digest.values())
    assert all(r.decoded == (TEXTS[r.doc_id] or "") for r in out if r.doc_id is not None)
    model = model_of(open(default_path()).read())
    for t in ["aaaaaaaa" * 5, "<|endoftext|> a<|endoftext|>", "  \n\n x", "don't we'll", " ²Ⅷ٣"]:
        assert np.frombuffer(model.encode([t])[0], "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_quality(spark):
    from stockroom.llm.quality import score, train, with_statistics

    rows = [(i, prose(50) + "." if i % 3 else "junk | " * 40, "k") for i in range(400)] + [(1000, None, ""), (1001, "", ""), (None, "x", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, quality int")
    measured = with_statistics(docs)
    out = {r.doc_id: r for r in score(measured, train(measured, labels)).collect()}
    assert len(out) == 403 and all(0 <= r.score <= 1 for r in out.values()) and out[None].held_out
    held = [i for i in range(400) if out[i].held_out]
    assert held and np.mean([out[i].predicted == (1 if i % 3 else 0) for i in held]) > 0.95
    assert all(r.score > 0.999999 for r in score(measured, train(measured, labels.where("false"))).collect())


def test_license_scan(docs):
    from stockroom.llm.license_scan import TEMPLATES, Scanner, has_cue, license_scan

    assert [(r.doc_id, r.license, r.differences) for r in license_scan(docs).collect()] == [(11, "MIT-notice", 0)]
    scan = Scanner(TEMPLATES)
    for name, text in TEMPLATES.items():
        assert has_cue(text.lower().encode()) and list(scan.scan((prose(30) + " " + text + " " + prose(30)).encode())) == [name]
    changed = scan.scan(TEMPLATES["MIT"].replace("deal in", "trade in").encode())["MIT"]
    assert changed[0] == 2 and changed[3] == ["-deal", "+trade"]


def test_nearest(spark):
    from stockroom.llm.nearest import nearest

    odd = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [2.0, 0.0]), (6, []), (None, [1.0, 1.0])]
    table = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest(table, table.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 100, 0.0), (0, 2, 5, 1.0), (100, 1, 0, 0.0), (100, 2, 5, 1.0)]
    assert nearest(table.where("false"), table).count() == 0
    x = np.random.default_rng(3).normal(size=(1500, 32))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    hits = 0
    for r in nearest(table, table.where("vec_id % 100 = 0")).collect():
        d = np.sqrt(((x - x[r.query_id]) ** 2).sum(axis=1))
        assert r.score == d[r.vec_id]
        d[r.query_id] = np.inf
        hits += d[r.vec_id] <= np.sort(d)[9]
    assert hits / 150 >= 0.9


def test_warc_round_trip(spark):
    from stockroom.llm.warc import payload_digest, round_trip

    rows = [(1, "http://a.b/", "x"), (1, "http://a.b/", "x"), (2, None, None), (3, "", ""), (None, "odd url \n", "x"), (5, "http://A.b:80/p?q", "x"), (6, "http://[bad", "y" * 300000), (-4, "http://é.fr/ü", "é\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS path")
    out = sorted(((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in round_trip(pages).collect()), key=str)
    newest = {"x": 5, "": 3}
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        to = newest.get(html or "")
        to = None if to == i else to
        want.append((i is None, i or 0, len(raw), payload_digest(raw), "revisit" if to is not None else "response", to))
    assert out == sorted(want, key=str)
    assert round_trip(pages.where("false")).count() == 0


def test_shards(docs):
    from stockroom.llm.sharding import shard

    out = shard(docs).collect()
    assert len(out) == len(ROWS) and shard(docs.where("false")).count() == 0
    for k in range(8):
        own = [r for r in out if r.shard == k]
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert sum(r.size for r in out) == sum(len((t or "").encode()) + 1 for _, t, *_ in ROWS)


def _shares(out, shards=8):
    """Bytes of each shard; slots are gapless and shards stand in the order of their texts."""
    sums = [0] * shards
    for k in range(shards):
        own = [r for r in out if r.shard == k]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        sums[k] = sum(r.size for r in own)
    return sums


def test_shards_are_near_equal_whatever_repeats(spark):
    """Against the plain rule: each shard within two ranges of its share, with a third of all rows one text, with rows
    that are equal in every column, and all rows once."""
    from stockroom.llm.sharding import RANGES_A_SHARD, shard

    rng = random.Random(4)
    hot = [(None, "same") for _ in range(3000)]
    mixed = [(k, "w" * rng.randint(0, 200)) for k in range(4000)] + [(7, "again and again")] * 2000
    for rows in (hot, mixed, mixed + hot):
        out = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
        assert Counter((r.doc_id, r.size) for r in out) == Counter((i, len(t) + 1) for i, t in rows)
        sums = _shares(out)
        total = sum(sums)
        assert max(abs(x - total / 8) for x in sums) <= 2 * total / (8 * RANGES_A_SHARD) + 201


def test_a_text_larger_than_a_shard(spark):
    from stockroom.llm.sharding import shard

    rows = [(k, f"text {k}") for k in range(200)] + [(999, "x" * 100_000)]
    out = shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sums = _shares(out)
    assert max(sums) >= 100_001 and len(out) == 201 and sum(sums) == sum(len(t) + 1 for _, t in rows)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("spans", docs_extra())
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf)
        assert after.columns == docs.columns
        after.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        before, kept = kept.count(), spark.read.parquet(f"{tmp_path}/{name}")
        assert 0 < kept.count() <= before
    assert corpus_pipeline.STAGES[-1][1](spark, kept, sf).count() == kept.count()


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("x")


def test_bitmaps_never_refute_a_link(spark):
    """The bound of the bitmaps holds for any pair of sets; pairs without a bitmap are allowed."""
    from pyspark.sql import functions as F

    from stockroom.llm.ngram_join import bitmaps_allow, parity_bitmap

    rng = np.random.default_rng(5)
    rows = []
    for size in (1, 4, 40, 400, 6000):
        base = rng.integers(-(2**63), 2**63, size)
        for lost in (0.0, 0.1, 0.14, 0.25, 0.6):
            a, b = (np.unique(base[rng.random(size) >= lost]) for _ in range(2))
            common = len(np.intersect1d(a, b))
            links = 100 * common >= 75 * (len(a) + len(b) - common)
            rows.append((len(a), len(b), parity_bitmap(a).tolist(), parity_bitmap(b).tolist(), bool(links)))
    df = spark.createDataFrame(rows, "n int, m int, bits array<long>, other array<long>, links boolean")
    got = df.select("links", bitmaps_allow(df.n, df.m, df.bits, df.other).alias("allowed"), bitmaps_allow(df.n, df.m, df.bits, F.lit(None).cast("array<long>")).alias("unknown")).collect()
    assert all(r.allowed for r in got if r.links) and any(not r.allowed for r in got)
    assert all(r.unknown for r in got)


def test_ngram_join_beside_crowded_groups(spark, monkeypatch):
    """Near copies that stand half inside a crowded group, with few stars: every link is found by the last step."""
    from stockroom.llm import ngram_join as op

    monkeypatch.setattr(op, "FREQUENT", 3)
    monkeypatch.setattr(op, "STARS", 1)
    rng = random.Random(11)
    words = [f"w{k}" for k in range(4000)]
    shared = rng.sample(words, 12)
    texts = []
    for _ in range(25):
        own = rng.sample(words, 60)
        texts += [" ".join(shared + own), " ".join(shared[: rng.randrange(13)] + own), " ".join(own[rng.randrange(12) :] + rng.sample(words, 3))]
    rng.shuffle(texts)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    top = list(range(len(texts)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                lo, hi = sorted((root(a), root(b)))
                top[hi] = lo
    got = op.ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: root(k) for k in range(len(texts))}
    assert len({root(k) for k in range(len(texts))}) < len(texts)


def test_suffix_dedup_across_buckets(spark):
    """Many grams that share their first eight bytes, dealt to many buckets: equal windows meet across the boundaries."""
    from stockroom.llm.suffix_dedup import suffix_dedup

    own = random.Random(3)

    def bits(n: int) -> str:
        return "".join("b" if own.random() < 0.06 else "a" for _ in range(n))

    shared = [bits(130) for _ in range(12)]
    texts = [f"{bits(20)}{p}{bits(20)}" for p in shared for _ in range(12)]
    own.shuffle(texts)
    seen, want = set(), {}
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(t[s : s + 100])
        want[i] = sum(gone), "".join(c for c, g in zip(t, gone) if not g)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.doc_id: (r.n_removed, bytes(r.kept).decode()) for r in suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want and sum(x[0] for x in want.values()) > 0


def test_license_scan_counts_each_word_once():
    from stockroom.llm.license_scan import TEMPLATES, Scanner

    scan, mit = Scanner(TEMPLATES), TEMPLATES["MIT"]
    for added in ("by the authors", "by the authors listed", "by the authors listed below,", "by all the authors listed below,"):
        got = scan.scan(f"{prose(30)} {mit.replace('free of charge,', 'free of charge, ' + added)} {prose(30)}".encode())
        assert list(got) == ["MIT"] and got["MIT"][0] == len(added.split()) and got["MIT"][1] == 30
        assert sorted(got["MIT"][3]) == sorted("+" + w.strip(",") for w in added.split())
    assert not scan.scan(mit.replace("free of charge,", "free of charge, one two three four five six seven").encode())
    got = scan.scan(f"{prose(30)} {mit.replace('free of charge, to any person', 'free of charge, to every')} {prose(30)}".encode())["MIT"]
    assert got[0] == 3 and sorted(got[3]) == ["+every", "-any", "-person"]
    got = scan.scan(f"{prose(30)} {mit.replace('following conditions:', 'following terms:')} {prose(30)}".encode())["MIT"]
    assert got[0] == 2 and got[3] == ["-conditions", "+terms"]
    # the only cue is the template's first word: words added behind it do not push its end out of the block
    got = scan.scan(f"{prose(30)} {TEMPLATES['BSD'].replace('binary forms', 'all other binary forms')} {prose(30)}".encode())
    assert list(got) == ["BSD"] and got["BSD"][:2] == (2, 30)
    # a word in place of the last one is a word missing and a word added
    assert not scan.scan(f"{prose(30)} {TEMPLATES['LGPL-3.0-notice'].replace('version 3', 'version 2.1')} {prose(30)}".encode())


def test_license_scan_cues_of_a_short_text():
    from stockroom.llm.license_scan import TEMPLATES, Scanner

    got = Scanner(TEMPLATES).scan(f"license {prose(40)} Released under the MIT License.".encode())
    assert list(got) == ["MIT-notice"] and got["MIT-notice"][:2] == (0, 41)


def test_ngram_join_repeated_rows(spark):
    """Rows that repeat a doc_id beside documents that have 40 to 80 % of their shingles in common."""
    from stockroom.llm.ngram_join import ngram_join

    own = random.Random(17)
    words = [f"v{k}" for k in range(9000)]
    rows, at = [], 0
    for share in (0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.74, 0.8, 0.86, 0.9):
        for twice in ((True, False), (False, True), (True, True), (False, False)):
            base, other = own.sample(words, 204), own.sample(words, 204)
            keep = int(204 * share)
            for again, t in zip(twice, (base, base[:keep] + other[keep:]), strict=True):
                rows += [(at, " ".join(t))] * (2 if again else 1)
                at += 1
    # a doc_id with two texts, one of them a copy and the other a near copy; one with a blank text too; both texts new
    a, b, c = (own.sample(words, 100) for _ in range(3))
    rows += [(at, " ".join(a)), (at + 1, " ".join(b)), (at + 2, " ".join(a)), (at + 2, " ".join([*b, "end"]))]
    rows += [(at + 3, " "), (at + 3, " ".join(c)), (at + 4, " ".join([*c, "end"])), (-1, " ".join(own.sample(words, 50))), (-1, " ".join([*a, "more"]))]
    sets = [frozenset(_shingles(t.encode())) for _, t in rows]
    reach = {i: i for i, _ in rows}
    for _ in range(6):
        for (i, _), x in zip(rows, sets, strict=True):
            for (j, _), y in zip(rows, sets, strict=True):
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    reach[i] = reach[j] = min(reach[i], reach[j])
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((i, len(x), reach[i] if x else i) for (i, _), x in zip(rows, sets, strict=True))
    assert {reach[at + k] for k in range(3)} == {-1}


def test_decontaminate_parts_in_another_order(spark):
    """Items whose parts stand in another order inside longer documents, against all windows."""
    from stockroom.llm.decontaminate import contaminated

    own = random.Random(23)

    def fresh(n: int) -> list[str]:
        return [f"u{own.randrange(10**9)}" for _ in range(n)]

    items, docs = {}, {}
    for i, n in enumerate((40, 60, 80, 120, 200)):
        w = fresh(n)
        items[i] = w
        for part in (0.5, 0.3, 0.9):
            cut = int(n * part)
            docs[len(docs)] = [*fresh(30), *w[cut:], *w[:cut], *fresh(25)]
            docs[len(docs)] = [*fresh(30), *w[cut:], *w[:cut]]
            docs[len(docs)] = [*w[cut:], *w[:cut], *fresh(30)]
        docs[len(docs)] = [*fresh(20), *w[: n // 3], *fresh(2), *w[n // 3 :], *fresh(20)]
    grams = lambda w: Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    want = {}
    for d, w in docs.items():
        for i, item in items.items():
            g = grams(item)
            best = max(sum((c & g).values()) / sum((c | g).values()) for c in (grams(w[s : s + len(item)]) for s in range(max(1, len(w) - len(item) + 1))))
            if best >= 0.75:
                want[d, i] = best
    table = lambda x, key: spark.createDataFrame([(k, " ".join(w)) for k, w in x.items()], f"{key} long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(table(docs, "doc_id"), table(items, "item_id")).collect()}
    assert set(got) == set(want) and len(want) > 40 and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_decontaminate_before_equal_words(spark):
    """Items of which the larger part stands before many equal words: weighted similarity 0.75."""
    from stockroom.llm.decontaminate import contaminated

    own = random.Random(29)
    items = [(i, [f"u{own.randrange(10**9)}" for _ in range(200)]) for i in range(12)]
    docs = spark.createDataFrame([(i, " ".join([*w[:172], *["|"] * 40])) for i, w in items], "doc_id long, text string")
    got = contaminated(docs, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.word_start, r.similarity) for r in got) == [(i, i, 0, 0.75) for i in range(12)]


def test_pipeline_edge_rows(spark, tmp_path):
    """Null ids, texts and columns; repeated rows; very long texts; names that clash or hold dots; no rows at all."""
    import shutil

    import corpus_pipeline

    sf = tmp_path / "sf"
    shutil.copytree("/root/testdata/sf0.001", sf)
    base = spark.read.parquet(f"{sf}/documents.parquet")
    good = base.where("length(text) > 1500 AND lang = 'en'").limit(3).collect()
    long = " ".join(r.text for r in good) * 40
    rows = [tuple(r) for r in good] + [tuple(good[0])] * 2 + [(None, good[0].text, None, None, None), (None, "zz zz", "xx", "s", 5), (None, None, None, None, None), (900001, None, "en", "s", 0), (900002, "", "en", "s", 0), (900003, long, "en", "s", len(long))]
    docs = spark.createDataFrame(rows, base.schema).selectExpr("*", "'x' AS leak_id", "1 AS kept_id", "'y' AS `a.b`", "2 AS doc", "'r' AS row")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, str(sf))
        assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted((r.text or "") for r in kept.where("doc_id IS NULL").collect()) == sorted(["", "zz zz", good[0].text])
        assert {r["a.b"] for r in kept.collect()} == {"y"}
    assert corpus_pipeline.STAGES[-1][1](spark, kept, str(sf)).count() == kept.count()
    none = docs.where("false")
    for _name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(sf)).count() == 0


def test_quality_sample_is_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    from stockroom.llm import quality as op

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    measured = op.with_statistics(docs).cache()
    few, more = op.train(measured, labels, sample=20), op.train(measured, labels, sample=20)
    assert op.score(measured, few).orderBy("doc_id").collect() == op.score(measured, more).orderBy("doc_id").collect()
    known = labels.where(~op.held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    assert known.count() > 40  # so that the bound is at work
    small = measured.join(known.select("doc_id"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(20).select("doc_id")
    alone = op.train(measured.join(small, "doc_id"), labels, sample=20)
    assert op.score(measured, alone).orderBy("doc_id").collect() == op.score(measured, few).orderBy("doc_id").collect()


def test_pipeline_stages_keep_the_right_documents(spark, tmp_path):
    """Each stage's doc_ids and texts on planted documents, against a brute-force version of the stage."""
    import corpus_pipeline

    def best(text: str, item: str) -> float:
        w, own = text.lower().split(), item.lower().split()
        grams = lambda x: Counter(tuple(x[j : j + 5]) for j in range(len(x) - 4))
        g = grams(own)
        return max(((c := grams(w[s : s + len(own)])), sum((c & g).values()) / sum((c | g).values()))[1] for s in range(max(1, len(w) - len(own) + 1)))

    item, passage = prose(30), prose(30)
    rows = {i: prose(50) + "." if i % 3 else "junk | " * 40 for i in range(300)}
    for i in (1, 2, 4, 40, 100):
        rows[300 + i] = rows[i] + " tail."
        rows[700 + i] = f"{prose(20)} {passage} {prose(20)}."
        rows[1000 + i] = f"{prose(20)} {item} {prose(20)}."
        rows[1300 + i] = f"{prose(20)} {' '.join(item.split()[:14])} {prose(20)}."  # too little of the item
    labels = {i: int(t[:4] != "junk") for i, t in rows.items()}
    spark.createDataFrame(list(labels.items()), "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t, len(t)) for i, t in rows.items()], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents")

    good = {i: t for i, t in rows.items() if labels[i]}
    sets = {i: set(_shingles(t.encode())) for i, t in good.items()}
    reach = {i: i for i in good}
    near = [(a, b) for a in good for b in good if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in range(4):
        for a, b in near:
            reach[a] = reach[b] = min(reach[a], reach[b])
    single = {i: t for i, t in good.items() if reach[i] == i}
    seen, cut = set(), {}
    for i, t in sorted(single.items()):
        raw = t.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        cut[i] = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    clean = {i: t for i, t in cut.items() if best(t, item) < 0.75}
    assert len(rows) > len(good) > len(single) > len(clean) and cut != single

    kept = spark.read.parquet(f"{tmp_path}/documents")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], (good, single, cut, clean), strict=True):
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        got = kept.collect()
        assert len(got) == len(want) and {r.doc_id: r.text for r in got} == want, name
        assert all(r.n_chars == len(r.text) for r in got), name
