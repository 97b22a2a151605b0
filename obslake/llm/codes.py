"""Product codes of vectors, trained and assigned exactly in whole numbers.

A vector is cut into equal parts, and each part is replaced by the number of the nearest entry in that position's codebook. Parts and entries
are padded with zeros to a power of two and go through the Walsh-Hadamard transform, which is additions only and scales every squared
distance by the padded length P. In order of sequency (sign changes) the first few coefficients hold most of a smooth part's energy, so
squared differences are added up in that order, in doubling stretches: one entry is followed to its end to have a distance to beat, and entries
whose sum so far is beyond it are out. Sums over all P coefficients are P times the squared distance, so nothing is rounded anywhere.

A round is one pass over the vectors: each task assigns its rows and sends one row of sums for each number of its codebooks; the sums are
aggregated by Spark, and only the codebooks (`entries` vectors) reach the driver. Whole numbers are 64-bit where the largest
possible sum fits in them and Python's otherwise; the method is the same.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Whole numbers of a component: floor(SCALE * x). A power of two, so that the product is exact.
SCALE = 4096
#: Numbers of vectors that are worked on at once in a task.
VALUES = 1 << 20
#: Sums travel in digits of this base, so that no sum of them overflows.
_BASE = 10**18
_LONG = (1 << 63) - 1


def sequency(n: int) -> np.ndarray:
    """Positions of the naturally ordered transform of length n, by sign changes. n is a power of two."""
    at = np.arange(n)
    back = np.zeros(n, np.int64)
    for k in range(n.bit_length() - 1):
        back |= ((at >> k) & 1) << (n.bit_length() - 2 - k)
    changes, shift = back.copy(), 1
    while shift < n:
        changes ^= changes >> shift
        shift *= 2
    return np.argsort(changes)


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis, in sequency order, after zeros up to a power of two."""
    size = 1 << max(0, x.shape[-1] - 1).bit_length()
    y = np.zeros((*x.shape[:-1], size), x.dtype)
    y[..., : x.shape[-1]] = x
    half = 1
    while half < size:
        pairs = y.reshape(*x.shape[:-1], size // (2 * half), 2, half)
        a, b = pairs[..., 0, :], pairs[..., 1, :]
        y = np.stack([a + b, a - b], axis=-2).reshape(y.shape)
        half *= 2
    return y[..., sequency(size)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of transformed parts x (n, P) and entries (e, P): the index of the nearest entry (ties to the lower), P times its squared distance, and how many coefficients were compared."""
    n, width = x.shape
    first = (x[:, None, 0] - entries[None, :, 0]) ** 2
    guess = first.argmin(axis=1)
    limit = ((x - entries[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(first <= limit[:, None])
    score, done, looked = first[row, entry], 1, n * len(entries) + n * width
    while done < width:
        upto = min(width, 2 * done)
        score = score + ((x[row, done:upto] - entries[entry, done:upto]) ** 2).sum(axis=1)
        looked += len(row) * (upto - done)
        still = score <= limit[row]
        row, entry, score, done = row[still], entry[still], score[still], upto
    full = np.full(first.shape, score.max(initial=0) + 1, x.dtype)
    full[row, entry] = score
    best = full.argmin(axis=1)
    return best, full[np.arange(n), best], looked


def fits(largest: float, length: int) -> bool:
    """Whether every sum of `nearest` over parts of that length stays in 64 bits if no number is beyond `largest`."""
    return largest + 2 < 2**30 / (1 << max(0, length - 1).bit_length())


def whole(x: np.ndarray, parts: int) -> np.ndarray:
    """floor(SCALE x): 64-bit where all sums fit, else Python's whole numbers."""
    if fits(SCALE * float(np.abs(x).max(initial=0)), x.shape[1] // parts):
        return np.floor(x * SCALE).astype(np.int64)
    exact = [math.floor(v * SCALE) if abs(v) < 1e300 else int(v) * SCALE for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def _dense(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of doubles, zeros at the end of short ones."""
    values, lengths = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().to_numpy()
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


class Coder:
    """Codebooks (parts, entries, length) of whole numbers."""

    def __init__(self, books: np.ndarray) -> None:
        self.books = books
        self.width = books.shape[0] * books.shape[2]
        self.kind = np.dtype(np.int64 if fits(max((abs(int(v)) for v in books.ravel()), default=0), books.shape[2]) else object)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x (n, width) as doubles: its parts in whole numbers (n, parts, length), codes (n, parts), squared distances (n, parts)."""
        w = whole(x, len(self.books))
        kind = self.kind if w.dtype == self.kind else np.dtype(object)
        w = w.astype(kind).reshape(len(x), len(self.books), -1)
        if not w.shape[2]:  # vectors without components
            zero = np.zeros(w.shape[:2], np.int64)
            return w, zero, zero
        found = [nearest(transform(w[:, p]), transform(self.books[p].astype(kind))) for p in range(len(self.books))]
        size = 1 << (w.shape[2] - 1).bit_length()
        return w, np.stack([f[0] for f in found], axis=1), np.stack([f[1] // size for f in found], axis=1)

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        step = max(1, VALUES // max(1, self.width))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                yield piece, *self.assign(_dense(piece.column("embedding"), self.width))

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a task's rows: sum and count for each number of the codebooks that any part was assigned to."""
        total, count = np.zeros(self.books.shape, object), np.zeros(self.books.shape[:2], np.int64)
        for _, w, code, _ in self.blocks(batches):
            for p in range(len(self.books)):
                for e in np.unique(code[:, p]):
                    mine = w[code[:, p] == e, p]
                    total[p, e] += mine.sum(axis=0).astype(object)
                    count[p, e] += len(mine)
        out: list[tuple[int, ...]] = []
        for p, e in np.argwhere(count):
            for i, v in enumerate(total[p, e]):
                digit, rest = 0, int(v)
                while digit == 0 or rest not in (0, -1):  # the last digit has the sign
                    rest, low = divmod(rest, _BASE)
                    out.append((p, e, i, digit, low, count[p, e]))
                    digit += 1
                out.append((p, e, i, digit, rest, count[p, e]))
        columns = zip(*out) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["part", "entry", "position", "digit", "value", "n"])

    def encoded(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, _, code, distance in self.blocks(batches):
            text = [bytes(c).hex() if max(c, default=0) < 256 else "".join(f"{v:02x}" for v in c) for c in code.tolist()]
            error = [min(sum(d), _LONG) for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays([piece.column("vec_id"), piece.column("label"), pa.array(text, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])


def fit(kept: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> Coder | None:
    """Codebooks of usable(vectors); None where there are no rows. The first `entries` rows by id are the codebooks to begin with."""
    longest = kept.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return None
    width = -(-longest // parts) * parts
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    first = np.array([list(r.embedding) + [0.0] * (width - len(r.embedding)) for r in seeds], np.float64)
    books = whole(first, parts).astype(object).reshape(len(seeds), parts, -1).swapaxes(0, 1).copy()
    for _ in range(rounds):
        digits = kept.mapInArrow(Coder(books).sums, "part long, entry long, position long, digit long, value long, n long")
        totals: dict[tuple[int, int, int], int] = defaultdict(int)
        counts: dict[tuple[int, int, int], int] = {}
        # as many rows as the codebooks have numbers and those have digits
        for r in digits.groupBy("part", "entry", "position", "digit").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"), F.sum("n").alias("n")).collect():
            at = (r.part, r.entry, r.position)
            totals[at] += int(r.value) * _BASE**r.digit
            counts[at] = max(counts.get(at, 0), r.n)
        for at, total in totals.items():
            books[at] = total // counts[at]
    return Coder(books)


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, embedding, label) of rows whose vector is there and has finite components only, stored for the passes over it."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    return stored(rows.filter(x.isNotNull() & ~bad), "vectors")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, code string, error long, label_error long, codebooks_sha256 string), a row for each usable vector.

    code: an entry's index for each part, two hex digits each. error: squared distance of the vector to its entries. label_error: the sum of
    error over equal labels, nulls together. Vectors that are null or hold null or non-finite components are left out. The codebooks
    begin with the `entries` smallest ids (fewer rows: fewer entries; null ids last, equal ids by their vectors). Where lengths differ, or aren't a
    multiple of `parts`, zeros follow up to the next multiple of the longest. Repeated rows and ids count as that many. Errors beyond a long become
    the largest one. No usable rows: an empty result. Other columns are ignored.
    """
    kept = usable(vectors, vec_id, vector, label)
    ids, labels = kept.schema["vec_id"].dataType, kept.schema["label"].dataType
    schema = T.StructType([T.StructField("vec_id", ids), T.StructField("label", labels), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coder = fit(kept, parts, entries, rounds)
    if coder is None:
        return vectors.sparkSession.createDataFrame([], schema.add("label_error", "long").add("codebooks_sha256", "string"))
    digest = hashlib.sha256(",".join(str(v) for v in coder.books.ravel()).encode()).hexdigest()
    encoded = stored(kept.mapInArrow(coder.encoded, schema), "codes")
    top = F.lit(_LONG).cast("decimal(38,0)")
    sums = encoded.groupBy(F.col("label").alias("of_label")).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), top).cast("long").alias("label_error"))
    return encoded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
