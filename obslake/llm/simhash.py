"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing.

A fingerprint takes, for each of its 64 bits, the majority over the XXH64 hashes (seed 42) of the document's 3-word
shingles. Two fingerprints link when they differ in at most RADIUS bits. The links are found without comparing all
pairs: the 64 positions fall into three zones, and of three differing bits at most two lie outside some zone. So, for each
zone, the fingerprint with that zone blanked has its partner within two bits, and both reach a common word by
flipping at most one bit each. Every distinct fingerprint therefore emits, per zone, all variants within half of that radius
(itself and each single flip: 64 x 2 + 3 = 131 keys in all), the keys are shuffled, and fingerprints that meet are verified
by their true distance. Emitting full-width variants instead needs flips of two bits on one side, 2081 keys for a
fingerprint, for the same links.

A bucket is never expanded into all pairs for the next step: it returns a spanning forest of its links. The members of a
bucket are compared with each other; where that would be more work than look-ups of the neighbours within reach, which
are linear in the members, the look-ups are taken. Both verify true distances and span the same links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, contract, drop_stored, mix, releasing, small_batches, stored, text_bytes

RADIUS = 3
SEED = 42
#: Bit positions of the zones: (first, width).
ZONES = ((0, 21), (21, 21), (42, 22))
#: Keys that one reducing step sorts at a time, and parts that a task gets (about).
KEYS_A_PART, PARTS_A_TASK = 500_000, 8
#: Members up to which a bucket's pairs are fewer than its look-ups. It changes no result.
SMALL = 32
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(data: bytes | None, shingle: int = 3, step: int = 1 << 16) -> int:
    """64-bit SimHash of a UTF-8 text. No word, or null: 0."""
    words = (data or b"").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    starts = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(line)]
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for k in range(0, len(starts), step):
        raw = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[k : k + step], ends[k : k + step])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(x) for x in text_bytes(batch.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, fp long) of every row, and the string columns carried along."""
    return small_batches(docs).select("doc_id", "text", *carried).mapInArrow(releasing(_fingerprints), ", ".join(["doc_id long", "fp long", *(f"{c} string" for c in carried)]))


def _masks() -> list[tuple[np.uint64, np.ndarray]]:
    """Per zone: what to keep, and what to flip (0 first)."""
    out = []
    for first, width in ZONES:
        zone = ((1 << width) - 1) << first
        flips = [0, *(1 << k for k in range(64) if not zone >> k & 1)]
        out.append((np.uint64(~zone & (1 << 64) - 1), np.array(flips, np.uint64)))
    return out


def _variants(n_parts: int):
    """Rows of (part, (key, fingerprint) pairs). A part holds keys of one zone: part modulo three names it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(all_fps), 4096):
                fps = all_fps[k : k + 4096]
                for z, (keep, flips) in enumerate(_masks()):
                    keys = ((fps & keep)[:, None] ^ flips[None, :]).ravel()
                    owners = np.repeat(fps, len(flips))
                    part = (mix(keys) % np.uint64(n_parts)).astype(np.int64) * len(ZONES) + z
                    order = np.argsort(part, kind="stable")
                    part, rows = part[order], np.stack([keys[order], owners[order]], axis=1)
                    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                    yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array([rows[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["part", "keys"])

    return emit


def _by_lookups(zone: int, key: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs among the members of one bucket that span all links which this bucket has to find, and maybe others.

    All members lie within two bits of each other outside the blanked zone, so equal zone bits, or zone bits one apart,
    are looked up for all. Zone bits two or three apart need members that (nearly) agree outside it, and such pairs meet in
    the bucket of their own, unflipped key: there one of them is a centre.
    """
    first, width = ZONES[zone]
    inside = (fps >> np.uint64(first)) & np.uint64((1 << width) - 1)
    keep = _masks()[zone][0]
    values, where, at = np.unique(inside, return_index=True, return_inverse=True)
    a, b = [fps], [fps[where][at]]

    def look(src: np.ndarray, src_in: np.ndarray, mask: int, pool: np.ndarray, pool_fps: np.ndarray) -> None:
        want = src_in ^ np.uint64(mask)
        spot = np.minimum(np.searchsorted(pool, want), len(pool) - 1)
        hit = pool[spot] == want
        a.append(src[hit])
        b.append(pool_fps[spot[hit]])

    for k in range(width):
        look(fps[where], values, 1 << k, values, fps[where])
    centre = (fps & keep) == np.uint64(key) & keep
    if centre.any():
        mid, mid_in = fps[centre], inside[centre]
        order = np.argsort(mid_in)
        for k in combinations(range(width), 2):
            look(mid, mid_in, sum(1 << x for x in k), values, fps[where])
        for k in combinations(range(width), 3):
            look(mid, mid_in, sum(1 << x for x in k), mid_in[order], mid[order])
    return np.concatenate(a), np.concatenate(b)


def meet(zone: int, keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fp, smaller fp) links that span the verified links of fingerprints sharing a key of one zone."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])
    keys, fps = keys[fresh], fps[fresh]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b = [], []

    def verified(x: np.ndarray, y: np.ndarray) -> None:
        ok = np.bitwise_count(x ^ y) <= RADIUS
        a.append(x[ok])
        b.append(y[ok])

    for k in np.flatnonzero(sizes > SMALL):
        verified(*_by_lookups(zone, int(keys[starts[k]]), fps[starts[k] : starts[k] + sizes[k]]))
    few = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    keys, fps = keys[few], fps[few]
    for step in range(1, SMALL):
        near = np.flatnonzero(keys[step:] == keys[:-step]) if len(keys) > step else np.empty(0, int)
        if not len(near):
            break
        verified(fps[near], fps[near + step])
    if not a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return contract(np.concatenate(a), np.concatenate(b))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part; one part is held at a time."""

    def links(part: int, chunks: list[bytes]) -> pa.RecordBatch:
        rows = np.frombuffer(b"".join(chunks), np.uint64).reshape(-1, 2)
        a, b = meet(part % len(ZONES), rows[:, 0], rows[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

    part, held = None, []
    for batch in batches:
        for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if p != part and held:
                yield links(part, held)
                held = []
            part = p
            held.append(x)
    if held:
        yield links(part, held)


def links(fps: DataFrame, n_fps: int) -> DataFrame:
    """(u, v) spanning the links of the distinct fingerprints in fps (fp long)."""
    n_parts = max(1, -(-n_fps * 131 // (len(ZONES) * KEYS_A_PART)))
    keys = fps.select("fp").mapInArrow(_variants(n_parts), "part long, keys binary")
    # the number of tasks grows with the keys, so that no task does
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(ZONES) * n_parts // PARTS_A_TASK)
    dealt = keys.repartition(tasks, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(releasing(_meet), "u long, v long")


def _rooted(marked: DataFrame, first: Column | str) -> DataFrame:
    """(fp, first, root) of the distinct fingerprints in marked: the least `first` of each, and its component."""
    unique = stored(marked.groupBy("fp").agg(F.min(first).alias("first")), "unique")
    root = connected_components(links(unique, unique.count()))
    return unique.join(root, unique.fp == root.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id long, fp long, component_id long) of every row of docs (doc_id, text).

    component_id is the smallest doc_id that can be reached over links. Null or wordless text: fingerprint 0, linked like
    any other. Rows with the same doc_id and text are returned as often as they come; null doc_ids take part in linking,
    but are no component's name unless nothing else is there. An empty table gives an empty result.
    """
    marked = stored(fingerprints(docs), "fingerprints")
    named = _rooted(marked, "doc_id")
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(named.join(lowest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest doc_id, null coming last, and of those the smallest digest of the row.

    Rows are told apart by all their columns, so rows that aren't linked stay, whatever their doc_ids. Columns of any name are kept
    as they are. An empty table gives an empty result.
    """
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    at = {c.lower(): F.col(f"c{k}") for k, c in enumerate(docs.columns)}
    keyed = plain.select("*", F.md5(F.to_json(F.struct(*plain.columns))).alias("key"))
    marked = stored(fingerprints(keyed.select(at["doc_id"].alias("doc_id"), at["text"].alias("text"), "key"), "key"), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    kept = stored(_rooted(marked, order).groupBy("root").agg(F.min("first").alias("first")).select("first.key"), "kept")
    drop_stored(marked)
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select(*plain.columns).toDF(*docs.columns)
