"""Benchmark decontamination with DataFrame functions only: SimHash of item-sized windows, Hamming blocks, exact check.

A window has as many words as an item (or is the whole document, if that is shorter). Looked at are the windows that stand
so that a shingle shared with an item of that length has the same place in both, and those that begin with a shingle of
the item and hold as many of its shingles as similarity 0.75 needs, in whatever order. Passed over are windows that hold
fewer, and windows whose first shingle is not the item's: the next one, one word on, is at least as similar. Equal windows
are one. Each window and item gets a 64-bit SimHash of its shingles; of one that occurs again, each
occurrence counts as a shingle of its own, as in the similarity. Fingerprints are cut into ``radius + 1`` blocks: two within the radius agree in a block at least,
so joining on (length, block, value) finds all of them. Candidates are then held against the exact weighted
similarity: shingles common to both over shingles in either, repeats counted.

The default radius of 20 is three standard deviations above the expected distance of texts at similarity 0.75.

Defined results. Words are lower-cased (A-Z), parted by ASCII white space and known by 64-bit hashes; a shingle has five of them, an item
with fewer is one shingle. Null or blank texts, null ids: never reported. Rows that repeat a ``doc_id`` or an item
are one. Of several windows of a document that hold an item, the most similar is reported, the first of those that
tie of those looked at. Other columns are ignored. An empty table on either side gives an empty result. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD_GAP, lower_ascii

WORDS = 5
BITS = 64
RADIUS = 20
NEAR = (75, 100)
#: Rows that are broadcast at most: the benchmark's shingles, the windows to look at. Beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000

_BLANKS = " \t\n\x0b\x0c\r"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words; a blank text gives that of the empty word, which no other text has."""
    trimmed = F.btrim(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(_BLANKS))
    return F.transform(F.split(trimmed, WORD_GAP), lambda w: F.xxhash64(w))


def placed_grams(texts: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(*keys, n, at, h): hash of each run of n words, with its place. ``texts``: keys and words."""
    names = [f"{i}" for i in range(n)]
    out = texts.select(*keys, "words").withColumn("grams", F.arrays_zip(*(F.slice("words", i + 1, F.greatest(F.size("words") - (n - 1), F.lit(0))) for i in range(n))))
    out = out.select(*keys, F.posexplode("grams").alias("at", "gram"))
    return out.select(*keys, "at", F.xxhash64(*(F.col("gram").getField(x) for x in names)).alias("h"))


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its row count allows it."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("shuffle_merge")


def fingerprints(shingles: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash of each group of (*keys, h): the bits that more than half of the hashes have. Two bits are counted in each sum.

    Occurrences of a shingle beyond the first have hashes of their own: the similarity of sets holds for them, and with
    it the distance that the radius allows for."""
    counts = shingles.groupBy(*keys, "h").agg(F.count("*").cast("int").alias("c"))
    nth = counts.select(*keys, "h", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("nth"))
    shingles = nth.withColumn("h", F.when(F.col("nth") == 1, F.col("h")).otherwise(F.xxhash64("h", "nth")))
    mask = (1 << 32) | 1
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(mask))).alias(f"b{i}") for i in range(32)]
    counted = shingles.groupBy(*keys).agg(F.count("*").alias("m"), *sums)
    print_ = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"b{i}").bitwiseAND(F.lit(2**32 - 1)), F.shiftrightunsigned(f"b{i}", 32)
        for place, n in ((i, low), (i + 32, high)):
            bit = 1 << place
            print_ = print_.bitwiseOR(F.when(n * 2 > F.col("m"), F.lit(bit - 2**64 if bit >> 63 else bit)).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, "m", print_.alias("print"))


def blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 blocks that make up the fingerprint."""
    n = radius + 1
    ends = [BITS * (i + 1) // n for i in range(n)]
    return [(a, b - a) for a, b in zip([0, *ends], ends, strict=False)]


def _blocked(prints: DataFrame, radius: int) -> DataFrame:
    values = F.array(*(F.shiftrightunsigned("print", a).bitwiseAND(F.lit((1 << n) - 1)) for a, n in blocks(radius)))
    return prints.select("*", F.posexplode(values).alias("block", "value"))


def crowded_starts(hits: DataFrame, item_grams: DataFrame) -> DataFrame:
    """(doc_id, n, k, s): places of an item's shingles from which on a window of the item's size holds as many of them as
    similarity 0.75 needs, in any order. Places near the end stand for the last window."""
    own = item_grams.select("k", "h", "n", "of").distinct()
    held = hits.join(own, ["k", "h"]).groupBy("doc_id", "of", "n", "k").agg(F.sort_array(F.collect_list("at")).alias("at"))  # bounded by a document's length
    size = F.col("n") - F.col("k") + 1
    # two sets of ``size`` with c in common are alike from c / (2 size - c) = 0.75 on
    held = held.withColumn("needed", F.ceil(size * (2 * NEAR[0]) / (NEAR[0] + NEAR[1])).cast("int")).where(F.size("at") >= F.col("needed"))
    ahead = F.slice("at", F.col("needed"), F.size("at"))  # the shingle with which a place's window has enough
    near = F.filter(F.arrays_zip(F.col("at").alias("s"), ahead.alias("last")), lambda x: x["last"] - x["s"] < size)
    return held.select("doc_id", "n", "k", F.explode(near).alias("w")).select("doc_id", "n", "k", F.col("w.s").alias("s"))


def contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, word_start, n_words, hamming, similarity): documents that hold an item, with the best window."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_hashes(F.col("text")).alias("words")).where("doc_id IS NOT NULL")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("words"), F.xxhash64("text").alias("of")).where("item_id IS NOT NULL").where(F.element_at("words", 1) != F.xxhash64(F.lit("")))
    items = materialize(items.withColumn("n", F.size("words")).withColumn("k", F.least("n", F.lit(WORDS))).dropDuplicates(["item_id", "words"]), "items")
    sizes = sorted(r.k for r in items.select("k").distinct().collect())  # at most five
    if not sizes:
        sizes = [WORDS]
    item_grams = None
    for k in sizes:
        part = placed_grams(items.where(F.col("k") == k), ["item_id", "of", "n", "k"], k)
        item_grams = part if item_grams is None else item_grams.unionByName(part)
    item_grams = materialize(item_grams, "item-shingles")
    known = item_grams.select("k", "h").distinct()

    hits = None
    for k in sizes:
        own = known.where(F.col("k") == k).select("h")
        part = placed_grams(texts, ["doc_id"], k).join(_small(own), "h", "left_semi").select("doc_id", F.lit(k).alias("k"), "at", "h")
        hits = part if hits is None else hits.unionByName(part)
    hits = materialize(hits, "shared-shingles")
    places = item_grams.select("k", "h", "n", F.col("at").alias("item_at"))
    starts = hits.join(places, ["k", "h"]).select("doc_id", "n", "k", F.greatest(F.col("at") - F.col("item_at"), F.lit(0)).alias("s"))
    starts = materialize(starts.unionByName(crowded_starts(hits, item_grams)).distinct(), "window-starts")

    wanted = starts.groupBy("doc_id").agg(F.collect_set(F.struct("s", "n", "k")).alias("windows"))  # bounded by a document's length
    few = starts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted) if few else wanted.hint("shuffle_merge"), "doc_id")
    found = held.select("doc_id", word_hashes(F.col("text")).alias("words"), "windows").select("doc_id", "words", F.explode("windows").alias("w")).select("doc_id", "words", "w.*")
    start = F.least("s", F.greatest(F.size("words") - F.col("n"), F.lit(0)))  # the last windows move back into the text
    cut = found.select("doc_id", "n", "k", start.alias("s"), F.slice("words", start + 1, F.col("n")).alias("words"))
    cut = cut.withColumn("w1", F.xxhash64("words")).withColumn("w2", F.xxhash64(F.lit(7), "words"))
    windows = materialize(cut, "windows")
    kinds = windows.groupBy("n", "k", "w1", "w2").agg(F.first("words").alias("words"))
    shingles = None
    for k in sizes:
        part = placed_grams(kinds.where(F.col("k") == k), ["n", "w1", "w2"], k)
        shingles = part if shingles is None else shingles.unionByName(part)
    shingles = materialize(shingles.select("n", "w1", "w2", "h"), "window-shingles")

    window_prints = materialize(fingerprints(shingles, ["n", "w1", "w2"]), "window-prints")
    item_prints = materialize(fingerprints(item_grams.select("item_id", "of", "n", "h"), ["item_id", "of", "n"]), "item-prints")
    left = _blocked(window_prints, radius)
    right = _blocked(item_prints.withColumnRenamed("m", "item_m"), radius).withColumnRenamed("print", "item_print")
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    near = left.join(right, ["n", "block", "value"]).withColumn("hamming", distance).where(F.col("hamming") <= radius)
    pairs = materialize(near.select("n", "w1", "w2", "item_id", "of", "m", "item_m", "hamming").distinct(), "near-fingerprints")

    in_window = shingles.groupBy("n", "w1", "w2", "h").agg(F.count("*").alias("c"))
    in_item = item_grams.groupBy("item_id", "of", "h").agg(F.count("*").alias("item_c"))
    both = pairs.join(in_window, ["n", "w1", "w2"]).join(in_item, ["item_id", "of", "h"])
    common = both.groupBy("n", "w1", "w2", "item_id", "of", "m", "item_m", "hamming").agg(F.sum(F.least("c", "item_c")).alias("common"))
    either = F.col("m") + F.col("item_m") - F.col("common")
    alike = common.where(F.col("common") * NEAR[1] >= either * NEAR[0]).select("n", "w1", "w2", "item_id", "hamming", (F.col("common") / either).alias("similarity"))
    placed = windows.select("doc_id", "n", "s", "w1", "w2").join(alike, ["n", "w1", "w2"])
    best = placed.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("s")).alias("before"), (-F.col("hamming")).alias("nearer"), "n")).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.before")).cast("long").alias("word_start"), F.col("best.n").cast("long").alias("n_words"), (-F.col("best.nearer")).cast("int").alias("hamming"), F.col("best.similarity").alias("similarity"))
