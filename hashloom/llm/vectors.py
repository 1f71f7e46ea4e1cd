"""Vector code compression: product codes whose nearest entries are found by segment-mean lower bounds and exact distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import materialize

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Each component is floor(SCALE * x).
SCALE = 256
#: Integer components below this keep every sum and bound exact in 64 bits; larger ones are an error.
LIMIT = 1 << 24
#: Vectors that are compared at a time.
SLICE = 8192
#: A label with more than this share of the rows is joined by broadcast, so at most 1 / HOT labels are.
HOT = 0.001


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    x = vector.cast("array<double>")
    return F.coalesce(~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Rows of floor(SCALE * x), one for each list of ``width`` numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    out = np.floor(flat * SCALE)
    if len(out) and np.abs(out).max() >= LIMIT:
        raise ValueError(f"a vector's component is not below {LIMIT // SCALE}")
    return out.astype(np.int64)


class Blocks:
    """Means and residual norms of vectors, for coarse to fine cuts into blocks.

    With block sizes s, means m and the norm R of what is left of a vector without its
    means, the squared distance of x and y is at least sum s (mx - my)^2 + (Rx - Ry)^2.
    Norms come from exact integers, so that only the last rounding is off.
    """

    def __init__(self, x: np.ndarray):
        width = x.shape[1]
        self.levels = []
        blocks = 1
        while blocks < width:
            cuts = np.arange(blocks) * width // blocks
            sizes = np.diff(cuts, append=width)
            sums, squares = np.add.reduceat(x, cuts, axis=1), np.add.reduceat(x * x, cuts, axis=1)
            self.levels.append((sums / sizes * np.sqrt(sizes), np.sqrt(((sizes * squares - sums * sums) / sizes).sum(axis=1))))
            blocks *= 2
        self.squares = (x * x).sum(axis=1).astype(np.float64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry; the lower index of equals.

    An entry stays while its lower bound does not exceed the exact distance of the entry
    of least coarse bound; finer blocks are tried on those that stayed. The survivors'
    distances are computed in integers. Bounds give way by more than their rounding.
    """
    bx, be = Blocks(x), Blocks(entries)
    slack = 1e-12 * (bx.squares + be.squares.max(initial=0)) + 1e-9
    rows, at = np.divmod(np.arange(len(x) * len(entries)), len(entries))
    most = np.full(len(x), np.inf)
    for level, ((mx, rx), (me, re)) in enumerate(zip(bx.levels, be.levels)):
        if level == 0:
            bound = ((mx[:, None, :] - me[None, :, :]) ** 2).sum(axis=2) + (rx[:, None] - re[None, :]) ** 2
            first = entries[bound.argmin(axis=1)]
            most = ((x - first) ** 2).sum(axis=1)
            rows, at = np.nonzero(bound <= (most + slack)[:, None])
        else:
            bound = ((mx[rows] - me[at]) ** 2).sum(axis=1) + (rx[rows] - re[at]) ** 2
            stay = bound <= (most + slack)[rows]
            rows, at = rows[stay], at[stay]
    exact = ((x[rows] - entries[at]) ** 2).sum(axis=1)
    least = np.minimum.reduceat(exact, np.searchsorted(rows, np.arange(len(x))))
    hit = np.flatnonzero(exact == least[rows])
    return at[hit[np.searchsorted(rows[hit], np.arange(len(x)))]], least


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, squared distances) of vectors by part, for codebooks of shape (parts, entries, width of a part)."""
    cut = x.reshape(len(x), len(books), -1)
    found = [nearest(np.ascontiguousarray(cut[:, p]), books[p]) for p in range(len(books))]
    return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _kept(vectors: DataFrame, key: str, vector: str, label: str | None) -> DataFrame:
    named = [F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), (F.col(label) if label else F.lit(None).cast("int")).alias("label")]
    return vectors.where(usable(F.col(vector))).select(*named)


def learn(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks of integers, (parts, entries, width); without vectors of a length that ``parts`` divides, of no width.

    They start as the parts of the ``entries`` smallest vec_ids (equal ids by their
    vectors, null ids last) among vectors as long as the first. Each round is one pass
    over all vectors: tasks add up what they assigned, and parts x entries x width sums
    reach the driver.
    """
    order = [F.asc_nulls_last("vec_id"), F.asc("v")]
    whole = kept.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    first = whole.orderBy(*order).select(F.size("v")).head()
    if first is None:
        return np.zeros((parts, 0, 0), np.int64)
    size = first[0]
    fitting = whole.where(F.size("v") == size).select("vec_id", "v")
    start = pa.array([r["v"] for r in fitting.orderBy(*order).limit(entries).collect()], pa.list_(pa.float64()))
    x = integers(start, size)
    books = x.reshape(len(x), parts, size // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in _sums(fitting, books).toLocalIterator():
            books[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]  # // is floor
    return books


def _sums(fitting: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, sums): how many vectors' parts each entry won and their componentwise sums."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                x = integers(batch.column(0).slice(at, SLICE), parts * width)
                index, _ = assign(x, books)
                place = (index + np.arange(parts) * entries).ravel()
                counts += np.bincount(place, minlength=len(counts))
                values = x.reshape(-1, width)
                for c in range(width):  # halves of the values, as bincount adds in floating point
                    low, high = values[:, c] & 0xFFF, values[:, c] >> 12
                    sums[:, c] += np.bincount(place, low, len(counts)).astype(np.int64) + (np.bincount(place, high, len(counts)).astype(np.int64) << 12)
        won = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(won // entries, pa.int32()), pa.array(won % entries, pa.int32()), pa.array(counts[won]), pa.array(sums[won].tolist(), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"])

    found = fitting.select("v").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[c]) for c in range(width)]).alias("sums"))


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``kept`` (vec_id, v, label) with ``code`` and ``error`` instead of v; both null for vectors of another length than the codebooks'."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                v = part.column("v")
                fits = np.array(v.value_lengths()) == parts * width if entries else np.zeros(len(v), bool)
                index, error = assign(integers(v.filter(pa.array(fits)), parts * width), books) if fits.any() else (np.zeros((0, parts), int), np.zeros((0, 1), int))
                codes, errors = np.full(len(fits), None, object), np.full(len(fits), None, object)
                codes[fits] = [bytes(row).hex() for row in index.astype(np.uint8).tolist()]
                errors[fits] = error.sum(axis=1).tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    key, label = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    return kept.select("vec_id", "label", "v").mapInArrow(run, f"vec_id {key}, label {label}, code string, error bigint")


def decode(code: Column, books: np.ndarray) -> Column:
    """The vector of numbers that a code stands for (null for a null code): its entries' integers by SCALE."""
    table = F.array(*[F.array(*[F.array(*[F.lit(x / SCALE) for x in entry]) for entry in book]) for book in books.tolist()])
    at = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return F.when(code.isNotNull(), F.concat(*[F.get(F.get(table, F.lit(p)), at(p)) for p in range(len(books))]))


def digest(books: np.ndarray) -> str:
    """The SHA-256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the sum of error over the rows of equal label; nulls are one label.

    Sums are pre-aggregated. Labels of more than HOT of all rows get theirs by broadcast
    (there are at most 1 / HOT), so no key of the other join has more than that share.
    """
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "labels").withColumnRenamed("label", "of")
    total = sums.agg(F.sum("rows")).head()[0] or 0
    hot = F.broadcast(sums.where(F.col("rows") > HOT * total).withColumn("is_hot", F.lit(True)).drop("rows"))  # at most 1 / HOT rows
    same = F.col("label").eqNullSafe(F.col("of"))
    met = coded.join(hot, same, "left").drop("of")
    rest = met.where("is_hot is null").drop("label_error", "is_hot").join(sums.where(F.col("rows") <= HOT * total).drop("rows"), same, "left").drop("of")
    return met.where("is_hot").drop("is_hot").unionByName(rest)


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): vec_id, label, code, error and label_error of every usable vector, and what the codes stand for.

    Rows without a vector, or with a null or non-finite component, go. Codes are two hex
    digits a part (``entries`` at most 256); error is the exact squared distance in
    integers of SCALE. A vector whose length is not that of the first one (by vec_id) that
    ``parts`` divides keeps its row with null code and error. Repeated rows each get a
    row; a null vec_id sorts last and stays; an empty table gives no rows and codebooks
    without entries; other columns are ignored. A component of LIMIT / SCALE or more is an
    error, as its squares would not fit. Three passes over the vectors; nothing but the
    codebooks' sums reaches the driver.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    kept = _kept(vectors, key, vector, label)
    books = learn(kept, parts, entries, rounds)
    return with_label_errors(materialize(encode(kept, books), "codes")), books
