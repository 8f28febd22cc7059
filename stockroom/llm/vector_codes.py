"""Vector code compression: each vector becomes a few bytes, the nearest codebook entry of each of its parts.

Codebooks are fitted by member-resident Lloyd. Every part of every vector is a row that lives with its owner, the
codebook entry it is nearest to: rows are partitioned by (position, entry, salt), and the salt cuts an entry that holds
many parts (all vectors may be equal) into owners of bounded size. In a round the owners sum up their residents, the
sums make the new entries (a few numbers, sent to all), residents look for their nearest entry again, and only parts
that change their entry travel in the round's shuffle; all others are written on where they are. The vectors are then
coded in one pass over the table without a shuffle.

All arithmetic is on integers (a component x counts as floor(``SCALE`` * x)), so results do not depend on the order of
sums.

Defined results. Rows whose vector is null, empty or holds null or non-finite components take no part; neither do
vectors of another length than that of the smallest id. A length that ``parts`` does not divide makes the first parts
one longer. Every kept row is coded: repeated rows and ids each, also rows without an id. A codebook starts from the
smallest different ids, of rows that share an id from the smallest vector; with fewer ids it has fewer entries, and
without any id code and errors are null. Ties go to the lower entry. Equal labels are summed, nulls are one label.
Components beyond 2^62 / ``SCALE`` and errors beyond a long raise an error instead of giving a wrong number. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize
from .common import map_batches

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Parts that an owner holds at most, about.
OWNER_ROWS = 1 << 16
#: A label with more than this share of all rows is joined by broadcast: there are fewer such labels than HEAVY.
HEAVY = 64
RESIDENT = "rid long, position int, entry int, salt int, part array<long>"

Books = list[np.ndarray]


def bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    """First and last component of each part."""
    cuts = [dim // parts * i + min(i, dim % parts) for i in range(parts + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of integer rows to entries, exactly."""
    top = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * top * top * max(1, x.shape[1]) >= 1 << 60:  # beyond 64 bits: Python's integers
        x, book = x.astype(object), book.astype(object)
    apart = x[:, None, :] - book[None, :, :]
    return (apart * apart).sum(axis=2)


def kept_vectors(table: DataFrame, id_: str, vector: str, label: str | None) -> DataFrame:
    """(rid, vec_id, label, v) of the rows that take part, v as integers; ``rid`` numbers the written rows."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    near = F.transform("v", lambda x: F.when(F.abs(x) < float(2**62 // SCALE), F.floor(x * SCALE)).otherwise(F.raise_error(F.lit("a component is too large to be coded"))))
    rows = table.select(F.col(id_).cast("long").alias("vec_id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), v.alias("v"))
    rows = rows.where("v IS NOT NULL AND size(v) > 0").where(fine)
    return materialize(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", near.alias("v")), "vectors")


def first_books(kept: DataFrame, parts: int, entries: int) -> tuple[int, Books]:
    """Length of the vectors and the codebooks made of the smallest ids' vectors."""

    def smallest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.empty(0, np.int64)
        for batch in it:
            ids = np.unique(np.concatenate([ids, batch.column(0).to_numpy(zero_copy_only=False)]))[:entries]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["vec_id"])

    some = map_batches(kept.select("vec_id").where("vec_id IS NOT NULL"), smallest, "vec_id long").distinct()
    ids = [r.vec_id for r in some.orderBy("vec_id").limit(entries).collect()]
    if not ids:
        return 0, []
    found = kept.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).collect()  # one row an id
    vectors = [r.v for r in sorted(found, key=lambda r: r.vec_id)]
    dim = len(vectors[0])
    start = np.array([v for v in vectors if len(v) == dim], np.int64)
    return dim, [start[:, a:b] for a, b in bounds(dim, parts)]


def _list(flat: np.ndarray, width: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32()), pa.array(flat))


def placed(kept: DataFrame, books: Books, dim: int, salts: int) -> DataFrame:
    """Every part with the entry it is nearest to."""
    cuts = bounds(dim, len(books))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rid, x = batch.column("rid").to_numpy(), batch.column("v").flatten().to_numpy().reshape(-1, dim)
            for p, (a, b) in enumerate(cuts):
                own, n = x[:, a:b], len(rid)
                entry = np.argmin(distances(own, books[p]), axis=1)
                arrays = [pa.array(rid), *(pa.array(c, pa.int32()) for c in (np.full(n, p), entry, rid % salts)), _list(own.ravel(), np.full(n, b - a))]
                yield pa.RecordBatch.from_arrays(arrays, names=["rid", "position", "entry", "salt", "part"])

    return map_batches(kept.where(F.size("v") == dim).select("rid", "v"), batches, RESIDENT)


def reassigned(resident: DataFrame, books: Books) -> DataFrame:
    """The residents with their nearest entry now; ``moved`` tells those whose entry is another one than before."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            part = batch.column("part")
            position, old = batch.column("position").to_numpy(), batch.column("entry").to_numpy()
            width = np.array([b.shape[1] for b in books])[position]
            flat, start = part.flatten().to_numpy(), np.cumsum(width) - width
            entry = np.empty(len(position), np.int32)
            for p in np.unique(position).tolist():
                rows = np.flatnonzero(position == p)
                entry[rows] = np.argmin(distances(flat[start[rows][:, None] + np.arange(books[p].shape[1])], books[p]), axis=1)
            arrays = [batch.column("rid"), batch.column("position"), pa.array(entry), batch.column("salt"), _list(flat, width), pa.array(entry != old)]
            yield pa.RecordBatch.from_arrays(arrays, names=["rid", "position", "entry", "salt", "part", "moved"])

    return map_batches(resident, batches, RESIDENT + ", moved boolean")


def updated(resident: DataFrame, books: Books) -> Books:
    """New entries: the owners' sums, added up by entry. At most parts x entries rows come to the driver."""
    wide = max(b.shape[1] for b in books)
    sums = [F.sum(F.get("part", F.lit(i))).alias(f"s{i}") for i in range(wide)]
    owners = resident.groupBy("position", "entry", "salt").agg(F.count("*").alias("n"), *sums)
    totals = owners.groupBy("position", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(wide)))
    out = [b.copy() for b in books]
    for r in totals.collect():
        out[r.position][r.entry] = [r[f"s{i}"] // r.n for i in range(out[r.position].shape[1])]
    return out


class _Tables:
    """Tables of one round in the shared folder; those of the round before go when the next are written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.old, self.new = spark, [], []

    def write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        path = os.path.join(ensure_checkpoint_dir(self.spark), "tables", f"{name}-{uuid.uuid4().hex}")
        df.write.partitionBy(*by).parquet(path)
        self.new.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def turn(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.old:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        self.old, self.new = self.new, []


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, Books]:
    """Codebooks of the vectors that ``kept_vectors`` gives, by member-resident Lloyd."""
    dim, books = first_books(kept, parts, entries)
    if not books or not rounds:
        return dim, books
    tables = _Tables(kept.sparkSession)
    owner = ["position", "entry", "salt"]
    resident = tables.write(placed(kept, books, dim, max(1, -(-kept.count() // OWNER_ROWS))).repartition(*owner), "resident")
    for left in range(rounds - 1, -1, -1):
        before, books = books, updated(resident, books)
        if not left or all(np.array_equal(a, b) for a, b in zip(before, books, strict=True)):
            break  # entries that stay as they are attract the same parts for ever
        tables.turn()
        both = tables.write(reassigned(resident, books), "reassigned", "moved")
        stay, leave = (both.where(F.col("moved") == m).drop("moved") for m in (False, True))
        resident = stay.unionByName(tables.write(leave.repartition(*owner), "arrived"))
    tables.turn()
    tables.turn()
    return dim, books


def encode(kept: DataFrame, dim: int, books: Books) -> DataFrame:
    """(rid, vec_id, label, code, error): the nearest entries of each vector, two hex digits a part."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = bounds(dim, len(books)) if books else []
        for batch in it:
            n = batch.num_rows
            code, error = [[""] * n, [0] * n] if books else [[None] * n, [None] * n]
            x = batch.column("v").flatten().to_numpy().reshape(n, -1)
            for (a, b), book in zip(cuts, books, strict=True):
                far = distances(x[:, a:b], book)
                entry = np.argmin(far, axis=1)
                code = [c + f"{e:02x}" for c, e in zip(code, entry.tolist(), strict=True)]
                error = [s + int(far[i, e]) for i, (s, e) in enumerate(zip(error, entry.tolist(), strict=True))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "vec_id", "label")), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["rid", "vec_id", "label", "code", "error"])

    rows = kept.where(F.size("v") == dim) if books else kept
    label = kept.schema["label"].dataType.simpleString()
    return map_batches(rows, batches, f"rid long, vec_id long, label {label}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add the sum of ``error`` over equal labels. Labels that hold a large share of the rows are few and are joined by
    broadcast, the others by a shuffle in which each has a small share."""
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    rows = coded.count()
    heavy = totals.where(F.col("n") * HEAVY > rows).select(F.col("label").alias("l"), F.col("label_error"))
    light = totals.where(F.col("n") * HEAVY <= rows).select(F.col("label").alias("l"), F.col("label_error").alias("light_error"))
    first = coded.join(F.broadcast(heavy.withColumn("found", F.lit(True))), coded.label.eqNullSafe(F.col("l")), "left").drop("l")
    done = first.where("found").drop("found")
    rest = first.where("found IS NULL").drop("found", "label_error")
    rest = rest.join(light.hint("shuffle_merge"), rest.label.eqNullSafe(F.col("l"))).drop("l").withColumnRenamed("light_error", "label_error")
    return done.unionByName(rest)


def vector_codes(table: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """One row per kept vector (vec_id, label, code, error, label_error, codebooks_sha256), and the codebooks."""
    kept = kept_vectors(table, id_, vector, label)
    dim, books = fit(kept, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()
    coded = with_label_error(materialize(encode(kept, dim, books), "codes"))
    return coded.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")), books


def decode(codes: DataFrame, books: Books) -> DataFrame:
    """Add ``approx``: the vector that a code stands for."""
    entries = [F.array(*(F.array(*(F.lit(int(x)) for x in e)) for e in book)) for book in books]
    chosen = [F.get(entries[p], F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")) for p in range(len(books))]
    return codes.withColumn("approx", F.transform(F.flatten(F.array(*chosen)), lambda x: x / F.lit(float(SCALE))))
