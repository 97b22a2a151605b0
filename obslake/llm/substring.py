"""Substring deduplication: passages that stand earlier in the corpus are removed.

A window is `width` consecutive words of one document; every word covered by a window whose word sequence also starts
earlier (smaller doc_id, or same document and earlier start) is removed. Windows are judged on the input.

Documents whose doc_id is null or repeated are first sorted by doc_id and text and numbered, so that (doc_id, number) orders
all documents and no two rows have to share a block. Then three passes over documents dealt into blocks of about
BLOCK_BYTES by a hash of that order:

1. Count-min prefilter. Each block counts its windows in ROWS rows of cells, whose number grows with the corpus, and sends the
   counters in slices of cells. The slices of all blocks are merged by adding; a window's estimate is the least of its
   counters. Different windows can share cells, so estimates are only ever too high and no repeated window is lost.
2. Windows estimated to be repeated are grouped exactly, by their words. Those repeated inside a block are found there, and the block
   sends each of its distinct candidates once, so a passage that a third of all documents share is one row a block and not
   one a document. Neighbouring windows share words: a block sends them as stretches of text, dealt by an anchor, the
   least hash of a run of GRAM words inside the window. Equal windows have equal anchors, so they meet, and are compared word for word.
3. Each block learns which of its windows stand earlier, marks the words that they cover and cuts them.

The sketch is never gathered in one place: its slices are merged in parallel, and a block is told only of its own cells.
All three passes read the same shuffle of the texts. Hashes of words and windows come from prefix sums over a block's bytes; they only
propose, a comparison of the words decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, pack, pack_sorted, release, small_batches, stored, text_bytes, unpack, unpack_sorted

WIDTH, GRAM = 20, 8
BLOCK_BYTES = 2_500_000
#: Bytes that a word takes with the space after it, about: it sets the size of the sketch, not its results.
WORD_BYTES = 6
#: Rows of the sketch; windows a slice; cells a window in each row, as a power of two.
ROWS, SLICE_WINDOWS, SPARE_BITS = 2, 1 << 20, 4
_NULL_ID = -(1 << 63)
_STEP = 1 << 16


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(_STEP - 1, base, np.uint64)], dtype=np.uint64)


#: An odd number and its inverse modulo 2^64, and their first powers.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


class Text:
    """Words joined by single spaces, and hashes of runs of them."""

    def __init__(self, line: bytes) -> None:
        self.line, buffer = line, np.frombuffer(line, np.uint8)
        gaps = np.flatnonzero(buffer == 32)
        self.starts = np.r_[0, gaps + 1] if len(line) else np.empty(0, np.int64)
        self.ends = np.r_[gaps, len(line)] if len(line) else np.empty(0, np.int64)
        self._before, self._after = self._prefix(buffer)
        steps = -(-len(line) // _STEP)
        turns = np.array([pow(_INVERSE, _STEP * k, 1 << 64) for k in range(steps)], np.uint64)
        self._back = _DOWN[self.starts % _STEP] * turns[self.starts // _STEP]

    def _prefix(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum of byte times power up to the start, and up to the end, of each word."""
        before, after, total = np.empty(len(self.starts), np.uint64), np.empty(len(self.ends), np.uint64), np.uint64(0)
        for k in range(0, len(buffer), _STEP):
            part = buffer[k : k + _STEP]
            sums = np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[: len(part)], dtype=np.uint64)
            sums = np.r_[np.uint64(0), sums] * np.uint64(pow(_BASE, k, 1 << 64)) + total
            a, b = np.searchsorted(self.starts, (k, k + len(part)))
            before[a:b] = sums[self.starts[a:b] - k]
            a, b = np.searchsorted(self.ends, (k, k + len(part)), "right")
            after[a:b] = sums[self.ends[a:b] - k]
            total = sums[-1]
        return before, after

    def hashes(self, n: int) -> np.ndarray:
        """Hash of the n words that start at each word but the last n - 1."""
        if len(self.starts) < n:
            return np.empty(0, np.uint64)
        return mix((self._after[n - 1 :] - self._before[: len(self.starts) - n + 1]) * self._back[: len(self.starts) - n + 1])

    def words(self, at: int, n: int) -> bytes:
        return self.line[self.starts[at] : self.ends[at + n - 1]]

    def repeated(self, at: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
        """Whether each of the windows starting at words `at` (ascending) has an earlier equal one among them, by their words."""
        if not len(at):
            return np.empty(0, bool)
        order = np.argsort(hashes, kind="stable")
        fresh = np.r_[True, hashes[order][1:] != hashes[order][:-1]]
        first = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        out, pos = np.zeros(len(at), bool), np.sort(order[~fresh])
        partner = np.empty(len(at), np.int64)
        partner[order] = first
        x, y = at[pos], at[partner[pos]]
        # neighbours whose firsts are neighbours too are compared at once
        cut = np.r_[0, np.flatnonzero((np.diff(x) != 1) | (np.diff(y) != 1)) + 1, len(x)] if len(x) else np.zeros(1, int)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if self.words(x[a], b - a + width - 1) == self.words(y[a], b - a + width - 1):
                out[pos[a:b]] = True
            else:
                out[pos[a:b]] = [self.words(i, width) == self.words(j, width) for i, j in zip(x[a:b], y[a:b])]
        for h in np.unique(hashes[pos[~out[pos]]]):  # different words under one hash
            seen: set[bytes] = set()
            for k in np.flatnonzero(hashes == h).tolist():
                w = self.words(at[k], width)
                out[k] = w in seen
                seen.add(w)
        return out


class _Block:
    """The documents of one block, in order, and their words."""

    def __init__(self, rows: pa.Table) -> None:
        ids = np.array([_NULL_ID if x is None else x for x in rows.column("doc_id").to_pylist()], np.int64)
        texts, ranks = text_bytes(rows.column("text")), rows.column("rank").to_numpy()
        order = np.lexsort((ranks, ids))
        self.order, self.ids, self.ranks, self.texts = order, ids[order], ranks[order], [texts[k] for k in order]
        words = [(t or b"").split() for t in self.texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.first = np.r_[0, np.cumsum(self.sizes)].astype(np.int64)
        self.lines = [b" ".join(w) for w in words if w]

    def text(self) -> Text:
        return Text(b" ".join(self.lines))

    def windows(self, width: int) -> np.ndarray:
        """First word of every window."""
        return np.concatenate([np.empty(0, np.int64), *(np.arange(a, a + n - width + 1) for a, n in zip(self.first, self.sizes) if n >= width)])

    def doc_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, "right") - 1


class _Plan:
    def __init__(self, n_bytes: int, width: int) -> None:
        n = max(1, n_bytes // WORD_BYTES)
        self.width, self.gram = width, max(1, min(GRAM, width * 2 // 5))
        self.slices = max(1, -(-n // SLICE_WINDOWS))
        self.shift = np.uint64(64 - min(63, max(8, n.bit_length() + SPARE_BITS)))
        self.step = np.uint64(-(-(1 << (64 - int(self.shift))) // self.slices))

    def cells(self, hashes: np.ndarray, row: int) -> np.ndarray:
        return (mix(hashes + np.uint64(row)) if row else hashes) >> self.shift

    def cut(self, cells: np.ndarray) -> np.ndarray:
        """Bounds of each slice in sorted cells."""
        return np.searchsorted(cells, np.arange(self.slices + 1, dtype=np.uint64) * self.step)

    def anchors(self, text: Text) -> np.ndarray:
        """For the window at each word, the least hash of the runs of words inside it."""
        least, span, covers = text.hashes(self.gram), 1, self.width - self.gram + 1
        while span < covers and len(least):
            step = min(span, covers - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        return least


def _table(schema: dict[str, pa.DataType], *columns) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values())], list(schema))


_SKETCH = {"slice": pa.int64(), "row": pa.int64(), "block": pa.int64(), "cells": pa.binary(), "counts": pa.binary()}
_TOLD = {"block": pa.int64(), "row": pa.int64(), "cells": pa.binary()}
_STRETCHES = {"slice": pa.int64(), "block": pa.int64(), "at": pa.binary(), "n": pa.binary(), "ids": pa.binary(), "ranks": pa.binary(), "text": pa.binary(), "late": pa.binary()}


def _sketch(plan: _Plan):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        block, out = _Block(rows), []
        hashes = block.text().hashes(plan.width)[block.windows(plan.width)]
        for row in range(ROWS):
            cells, counts = np.unique(plan.cells(hashes, row), return_counts=True)
            counts, cut = np.minimum(counts, 255).astype(np.uint8), plan.cut(cells)
            out += [(k, row, key[0].as_py(), pack_sorted(cells[cut[k] : cut[k + 1]]), pack(counts[cut[k] : cut[k + 1]])) for k in np.flatnonzero(np.diff(cut)).tolist()]
        return _table(_SKETCH, *(zip(*out) if out else [[]] * len(_SKETCH)))

    return run


def _merged(key: tuple, rows: pa.Table) -> pa.Table:
    """For each block, its cells of this slice whose merged counter is above its own: others count there too."""
    own = [unpack_sorted(x) for x in rows.column("cells").to_pylist()]
    counts = [unpack(x).view(np.int64) for x in rows.column("counts").to_pylist()]
    every, total = np.concatenate(own), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, total = every[order], total[order]
    start = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    every, total = every[start], np.add.reduceat(total, start)
    out = []
    for block, x, n in zip(rows.column("block").to_pylist(), own, counts):
        found = x[total[np.searchsorted(every, x)] > n]
        if len(found):
            out.append((block, key[1].as_py(), pack_sorted(found)))
    return _table(_TOLD, *(zip(*out) if out else [[]] * len(_TOLD)))


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each x is in the sorted array."""
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x if len(of) else np.zeros(len(x), bool)


def _stretches(plan: _Plan):
    """The candidates of a block: stretches of words dealt by anchor, and which of its windows stand earlier inside the block."""

    def run(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        block, number = _Block(rows), key[0].as_py()
        text, at = block.text(), block.windows(plan.width)
        hashes = text.hashes(plan.width)[at]
        outside = np.ones(len(at), bool)
        for row in range(ROWS):
            cells = [unpack_sorted(c) for r, c in zip(told.column("row").to_pylist(), told.column("cells").to_pylist()) if r == row]
            some = np.flatnonzero(outside)
            outside[some] = _member(plan.cells(hashes[some], row), np.sort(np.concatenate([np.empty(0, np.uint64), *cells])))
        ordered = np.sort(hashes)
        twice = _member(hashes, ordered[1:][ordered[1:] == ordered[:-1]])
        some = np.flatnonzero(outside | twice)
        late = text.repeated(at[some], hashes[some], plan.width)
        sent = at[some[~late & outside[some]]]
        anchor, doc = plan.anchors(text)[sent], block.doc_of(sent)
        start = np.flatnonzero(np.r_[True, (np.diff(sent) != 1) | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]) if len(sent) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[start, len(sent)]) if len(sent) else start
        slices = (anchor[start] % np.uint64(plan.slices)).astype(np.int64)
        order = np.argsort(slices, kind="stable")
        out = []
        for part in np.split(order, np.flatnonzero(np.diff(slices[order])) + 1):
            if len(part):
                first, n, docs = sent[start[part]], sizes[part], doc[start[part]]
                line = b" ".join(text.words(a, k + plan.width - 1) for a, k in zip(first.tolist(), n.tolist()))
                out.append((int(slices[part[0]]), number, pack(first), pack(n), pack(block.ids[docs]), pack(block.ranks[docs]), len(line).to_bytes(4, "little") + pa.compress(line, "zstd", asbytes=True), b""))
        if late.any():
            out.append((number % plan.slices, number, b"", b"", b"", b"", b"", pack_sorted(at[some[late]].astype(np.uint64))))
        release()
        return _table(_STRETCHES, *(zip(*out) if out else [[]] * len(_STRETCHES)))

    return run


def _earlier(plan: _Plan):
    """For each block, which of its windows stand earlier: those of this slice, and those that it found itself."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        column = lambda name: [unpack(x).view(np.int64) for x in rows.column(name).to_pylist()]
        at, n, ids, ranks = ([np.empty(0, np.int64), *column(name)] for name in ("at", "n", "ids", "ranks"))
        blocks = np.repeat(rows.column("block").to_numpy(), [len(x) for x in at[1:]])
        at, n, ids, ranks = map(np.concatenate, (at, n, ids, ranks))
        out = [(b, x) for b, x in zip(rows.column("block").to_pylist(), rows.column("late").to_pylist()) if x]
        lines = [pa.decompress(x[4:], int.from_bytes(x[:4], "little"), "zstd", asbytes=True) for x in rows.column("text").to_pylist() if x]
        sizes = n + plan.width - 1
        text = Text(b" ".join(lines))
        # the stretches in the order of the corpus: then so are the windows
        order, first = np.lexsort((at, ranks, ids)), np.r_[0, np.cumsum(sizes)]
        text = Text(b" ".join(text.words(first[k], sizes[k]) for k in order.tolist()))
        n, at, blocks, first = n[order], at[order], blocks[order], np.r_[0, np.cumsum(sizes[order])][:-1]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        window = np.repeat(first, n) + inner
        late = text.repeated(window, text.hashes(plan.width)[window], plan.width)
        blocks, words = np.repeat(blocks, n)[late], (np.repeat(at, n) + inner)[late]
        for b in np.unique(blocks):
            out.append((int(b), pack_sorted(np.sort(words[blocks == b]).astype(np.uint64))))
        release()
        return _table({"block": pa.int64(), "late": pa.binary()}, *(zip(*out) if out else [[], []]))

    return run


def _cut_texts(plan: _Plan):
    def run(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        block, edge = _Block(rows), None
        edge = np.zeros(block.first[-1] + 1, np.int32)
        for x in told.column("late").to_pylist():
            at = unpack_sorted(x).astype(np.int64)
            edge[at] += 1  # a window is named once
            edge[at + plan.width] -= 1
        covered = np.cumsum(edge[:-1]) > 0
        removed = np.diff(np.r_[0, np.cumsum(covered)][block.first])
        kept = []
        for k, text in enumerate(block.texts):
            kept.append(_without(text, covered[block.first[k] : block.first[k + 1]]) if removed[k] else text)
        back = np.empty(len(block.order), np.int64)
        back[block.order] = np.arange(len(block.order))
        out = rows.drop_columns(["block", "rank", "text"]).append_column("text", pa.array([kept[k] for k in back], pa.binary()).cast(pa.string()))
        for name, counts in (("n_words", block.sizes), ("n_removed", removed)):
            out = out.append_column(name, pa.array(np.asarray(counts, np.int64)[back]))
        release()
        return out

    return run


def _without(text: bytes, mask: np.ndarray) -> bytes:
    """text without the words that mask marks: the white space after a kept word stays unless nothing follows."""
    raw = np.frombuffer(text, np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    start = ~blank & np.r_[True, blank[:-1]]
    word = np.cumsum(start) - 1
    keep = np.where(word >= 0, ~mask[np.maximum(word, 0)], True)
    return raw[keep].tobytes().strip(b" \t\n\v\f\r") if mask.any() else text


def dedup_substrings(docs: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text, ...) with text cut, and n_words, n_removed (long) added.

    Text without a removal is returned as it came (null: null, no words); else the kept words with the white space that
    followed them. Rows with null doc_id come before all others; of rows with the same doc_id the one with the smaller
    text counts as earlier. Other columns are carried along; columns n_words and n_removed of the input are replaced.
    An empty table gives an empty result. block_bytes: text of a block; smaller blocks need less memory and shuffle more.
    """
    rest = [c for c in docs.columns if c.lower() not in ("doc_id", "text", "n_words", "n_removed")]
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, plan = max(1, -(-total // block_bytes)), _Plan(total, width)
    rows = _ranked(small_batches(docs).select(F.col("doc_id").cast("long"), "text", *(F.col(f"`{c}`").alias(f"x{k}") for k, c in enumerate(rest))))
    block = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(_NULL_ID)), "rank"), F.lit(n_blocks))
    kept = _passes(rows.withColumn("block", block), plan)
    names = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col(f"x{k}") for k, c in enumerate(rest)}
    return kept.select(*(names[c].alias(c) for c in docs.columns if c in names), "n_words", "n_removed")


def _ranked(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, ...) with rank: (doc_id, rank) is a row's own and orders the rows by doc_id and text, nulls first."""
    unnamed = F.col("doc_id").isNull() | (F.col("doc_id") == _NULL_ID)
    counts = rows.filter(~unnamed).groupBy("doc_id").agg(F.count("*").alias("n"))
    repeated = stored(counts.filter("n > 1").select("doc_id"), "repeated")
    tied, free = rows.filter(unnamed), rows.filter(~unnamed)
    if not repeated.isEmpty():
        tied, free = tied.unionByName(free.join(repeated, "doc_id", "left_semi")), free.join(repeated, "doc_id", "left_anti")
    elif tied.isEmpty():
        return rows.withColumn("rank", F.lit(0).cast("long"))
    # the number before sorting only parts equal rows, so that many of them don't fall into one range
    ordered = tied.withColumn("at", F.monotonically_increasing_id()).orderBy("doc_id", "text", "at").drop("at")
    return free.withColumn("rank", F.lit(0).cast("long")).unionByName(stored(ordered.withColumn("rank", F.monotonically_increasing_id()), "ranked"))


def _passes(rows: DataFrame, plan: _Plan) -> DataFrame:
    blocks = rows.groupBy("block")
    sketch = blocks.applyInArrow(_sketch(plan), "slice long, row long, block long, cells binary, counts binary")
    told = sketch.groupBy("slice", "row").applyInArrow(_merged, "block long, row long, cells binary")
    stretches = blocks.cogroup(told.groupBy("block")).applyInArrow(_stretches(plan), "slice long, block long, at binary, n binary, ids binary, ranks binary, text binary, late binary")
    late = stretches.groupBy("slice").applyInArrow(_earlier(plan), "block long, late binary")
    out = T.StructType([f for f in rows.schema if f.name not in ("block", "rank", "text")]).add("text", "string").add("n_words", "long").add("n_removed", "long")
    return blocks.cogroup(late.groupBy("block")).applyInArrow(_cut_texts(plan), out)
