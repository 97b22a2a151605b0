"""Embedding near-duplicates with randomised-rotation binary codes.

Unit vectors are turned by a seeded random rotation and reduced to the signs of their coordinates, with a stored
correction factor f = <code, vector>. For two vectors the product of one's code with the other's coordinates, held in
4 bits a coordinate, over f, is an unbiased estimate of their inner product, and its error is bounded with the
confidence that EPSILON sets. Codes and factors are computed and stored once for each class of equal vectors; candidates meet as codes
alone. Only of rows with a pair whose upper bound reaches the threshold the whole vectors are fetched, and such pairs are recomputed
exactly, in double precision.

Candidates share a band: BANDS groups of BITS signs, each from a rotation of its own, under the same label. At the threshold
cosine of 0.98 one sign differs with probability 0.064, so a linked pair misses all bands with probability below 2e-5.
Exact copies are reduced to one representative with a count first, so a vector that a third of the rows hold is one row. Large
buckets are dealt into blocks that meet pair by pair of blocks; a pair is counted in the first band that it shares, and
a bucket returns links a vector and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, contract, releasing, stored

BANDS, BITS = 48, 24
#: Rows of a bucket that one task compares at a time with as many others.
BLOCK = 512
#: Rows a task works on at a time.
STEP = 8192
#: Half-width of the confidence bound in standard errors.
EPSILON = 5.0
SEED = 20_240_601
_QUERY_BITS = 4


@lru_cache(64)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def band_codes(unit: np.ndarray) -> np.ndarray:
    """(rows, BANDS) of BITS signs each, from as many rotations as it takes."""
    dim = unit.shape[1]
    turns = -(-BANDS * BITS // dim)
    signs = np.concatenate([unit @ rotation(dim, SEED + 1 + k) for k in range(turns)], axis=1)[:, : BANDS * BITS] > 0
    return (signs.reshape(len(unit), BANDS, BITS) * (1 << np.arange(BITS))).sum(axis=2).astype(np.int32)


class Codes:
    """Binary codes of unit vectors and what the estimate needs."""

    def __init__(self, dim: int, code: np.ndarray, planes: list[np.ndarray], factor: np.ndarray, low: np.ndarray, width: np.ndarray) -> None:
        self.dim, self.code, self.planes, self.factor, self.low, self.width = dim, code, planes, factor, low, width
        count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        self.ones, self.level_sum = count(code), sum(count(p) << k for k, p in enumerate(planes))

    @staticmethod
    def made(unit: np.ndarray) -> Codes:
        dim = unit.shape[1]
        turned = unit @ rotation(dim, SEED)
        low, high = turned.min(axis=1), turned.max(axis=1)
        width = np.maximum((high - low) / ((1 << _QUERY_BITS) - 1), 1e-300)
        noise = np.random.default_rng(SEED).random(turned.shape)
        level = np.clip(np.floor((turned - low[:, None]) / width[:, None] + noise), 0, (1 << _QUERY_BITS) - 1).astype(np.uint8)
        packed = lambda b: np.packbits(np.pad(b, ((0, 0), (0, -dim % 64))), axis=1).view(np.uint64)
        return Codes(dim, packed(turned > 0), [packed((level >> k & 1).astype(bool)) for k in range(_QUERY_BITS)], np.abs(turned).sum(axis=1) / np.sqrt(dim), low, width)

    def marks(self) -> list[bytes]:
        """Code and coordinates of each row, as they are stored."""
        return [x.tobytes() for x in np.concatenate([self.code, *self.planes], axis=1)]

    @staticmethod
    def stored(rows: pa.Table) -> Codes:
        """From columns size (one for all), marks, factor, low, width."""
        dim = int(rows.column("size")[0].as_py())
        words = -(-dim // 64)
        marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), np.uint64).reshape(rows.num_rows, -1)
        parts = [marks[:, k * words : (k + 1) * words] for k in range(1 + _QUERY_BITS)]
        return Codes(dim, parts[0], parts[1:], *(rows.column(n).to_numpy() for n in ("factor", "low", "width")))

    def upper(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper confidence bounds of the inner products of rows i (codes) and j (coordinates)."""
        dot = np.zeros(len(i), np.int64)
        for k, plane in enumerate(self.planes):
            dot += np.bitwise_count(self.code[i] & plane[j]).sum(axis=1, dtype=np.int64) << k
        root = np.sqrt(self.dim)
        total = self.width[j] * (2 * dot - self.level_sum[j]) + self.low[j] * (2 * self.ones[i] - self.dim)
        f = self.factor[i]
        spread = np.sqrt(np.maximum(1 - f * f, 0)) / (f * np.sqrt(max(self.dim - 1, 1)))
        rounding = self.width[j] * root / (2 * f * root)
        return total / root / f + EPSILON * (spread + rounding / 2)


_CODED = {"size": pa.int32(), "bands": pa.list_(pa.int32()), "marks": pa.binary(), "factor": pa.float64(), "low": pa.float64(), "width": pa.float64()}


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with `vector`, and the columns of _CODED behind them."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes):
            rows = batch.take(pa.array(np.flatnonzero(sizes == dim)))
            unit = _unit(_matrix(rows.column("vector"), dim))
            codes, bands = Codes.made(unit), band_codes(unit)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
            made = [pa.array(np.full(rows.num_rows, dim, np.int32)), lists, pa.array(codes.marks(), pa.binary()), *map(pa.array, (codes.factor, codes.low, codes.width))]
            yield pa.RecordBatch.from_arrays([*rows.columns, *made], [*rows.schema.names, *_CODED])


def _matrix(lists: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = pc.list_flatten(lists)
    return np.asarray(flat.to_numpy() if isinstance(flat, pa.ChunkedArray) else flat.to_numpy(zero_copy_only=False)).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _pairs(group: np.ndarray, first: np.ndarray, second: np.ndarray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one group, by their distance in the sorted rows; of two blocks, one row from each."""
    for step in range(1, len(group)):
        i = np.flatnonzero(group[step:] == group[:-step])
        if not len(i):
            return
        j = i + step
        ok = (first[i] == second[i]) | (block[i] != block[j])
        yield i[ok], j[ok]


def _open_pairs(rows: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of some whole groups whose bound reaches the threshold."""
    number = lambda name: rows.column(name).to_numpy()
    codes = Codes.stored(rows)
    for i, j in _pairs(number("group"), number("first"), number("second"), number("block")):
        near = codes.upper(i, j) >= threshold
        yield i[near], j[near]


def _open_rows(rows: pa.Table, threshold: float) -> list[pa.RecordBatch]:
    """The rows with a pair that the bounds leave open."""
    some = np.unique(np.concatenate([np.empty(0, np.int64), *(x for pair in _open_pairs(rows, threshold) for x in pair)]))
    return rows.select(_MET).take(pa.array(some)).combine_chunks().to_batches()


def _links(rows: pa.Table, threshold: float) -> list[pa.RecordBatch]:
    """Links that each row of some whole groups has, and a forest of them."""
    number = lambda name: rows.column(name).to_numpy()
    ids, copies, band = number("id"), number("copies"), number("band")
    raw = _matrix(rows.column("vector"), int(number("size")[0]))
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    bands, a, b = _matrix(rows.column("bands"), BANDS), [], []
    for i, j in _open_pairs(rows, threshold):
        near = _cosine(raw[i], raw[j]) >= threshold
        i, j = i[near], j[near]
        # counted in the first band that the two share
        near = (bands[i] == bands[j]).argmax(axis=1) == band[i]
        a.append(i[near])
        b.append(j[near])
    i, j = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (a, b))
    n = (np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))).astype(np.int64)
    node, root = contract(ids[i], ids[j]) if len(i) else (ids[:0], ids[:0])
    some = np.flatnonzero(n)
    return [pa.RecordBatch.from_arrays([pa.array(np.r_[ids[some], node]), pa.array(np.r_[n[some], np.zeros(len(node), np.int64)]), pa.array([None] * len(some) + root.tolist(), pa.int64())], ["id", "n", "root"])]


_KEY = ("size", "label", "band", "code", "first", "second")
_MET = [*_KEY, "id", "block"]


def _grouped(work: Callable[[pa.Table, float], list[pa.RecordBatch]], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by _KEY; whole groups of one size are worked on, about STEP rows at a time."""
        held: list[pa.Table] = []

        def numbered(table: pa.Table) -> pa.Table:
            fresh = np.zeros(table.num_rows, bool)
            for name in _KEY:
                x = table.column(name).combine_chunks()
                fresh[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
            return table.append_column("group", pa.array(np.cumsum(fresh)))

        def cut(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            table = numbered(table)
            size, group = table.column("size").to_numpy(), table.column("group").to_numpy()
            end = len(group) if last else int(np.searchsorted(group, group[-1]))
            held[:] = [table.slice(end).drop_columns(["group"])] if end < len(group) else []
            for at in np.split(np.arange(end), np.flatnonzero(np.diff(size[:end])) + 1):
                if len(at):
                    yield from work(table.slice(at[0], len(at)), threshold)

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) >= STEP:
                yield from cut(pa.concat_tables(held), False)
        if held:
            yield from cut(pa.concat_tables(held), True)

    return releasing(run)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_KEY).sortWithinPartitions(*_KEY)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id long, n_links long, component_id long, kept boolean), one row for each row of vectors.

    Rows link when their labels are equal and not null, their lengths are equal and their cosine is at least threshold.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Rows with equal vectors and
    label are one class and link with each other. Rows without vec_id form components of null. An empty table
    gives an empty result.
    """
    x = F.col("vector")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    every = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))
    # -0.0 and 0.0 are the same number
    every = every.select("vec_id", "label", F.when(usable, F.transform(x, lambda v: v + F.lit(0.0))).alias("vector"))
    keyed = every.withColumn("key", F.when(x.isNotNull(), F.sha2(F.to_json(F.struct("label", "vector")), 256)))
    one = keyed.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.first("label").alias("label"))
    made = T.StructType([*one.schema.fields]).add("size", T.IntegerType()).add("bands", T.ArrayType(T.IntegerType())).add("marks", "binary").add("factor", "double").add("low", "double").add("width", "double")
    classes = stored(one.mapInArrow(releasing(_coded), made), "classes")
    bucket, marks = ["size", "label", "band", "code"], ["marks", "factor", "low", "width"]
    banded = classes.select("id", "size", "label", F.posexplode("bands").alias("band", "code"))
    sizes = banded.groupBy(*bucket).agg(F.count("*").alias("members")).filter("members > 1").withColumn("blocks", F.ceil(F.col("members") / F.lit(BLOCK)))
    dealt = banded.join(sizes, bucket).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # every two blocks of a bucket meet in a group of their own
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("first"), F.greatest(o, F.col("block")).alias("second")))
    met = dealt.select("id", "block", *bucket, F.explode(meets).alias("meet")).select("id", "block", *bucket, "meet.first", "meet.second")
    # codes meet first; vectors are fetched for what the bounds leave open
    left = _dealt(met.join(classes.select("id", *marks), "id")).mapInArrow(_grouped(_open_rows, threshold), T.StructType([met.schema[c] for c in _MET]))
    full = _dealt(left.join(classes.select("id", "copies", "vector", "bands", *marks), "id"))
    found = stored(full.mapInArrow(_grouped(_links, threshold), "id long, n long, root long"), "links")
    n = found.groupBy("id").agg(F.sum("n").alias("n"))
    parts = connected_components(found.filter("root is not null").select(F.col("id").alias("u"), F.col("root").alias("v")))
    named = classes.select("key", "id", "copies").join(n, "id", "left").join(parts, F.col("id") == F.col("node"), "left")
    named = named.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = keyed.join(named, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
