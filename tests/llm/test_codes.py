"""Product codes against a plain evaluation."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from obslake.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string"


def _plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error) and codebooks by definition, over Python's whole numbers."""
    rows = [(i, [math.floor(4096 * v) if abs(v) < 1e300 else int(v) * 4096 for v in x]) for i, x in rows]
    width = -(-max(len(x) for _, x in rows) // parts) * parts
    length = width // parts
    cut = [(i, [(x + [0] * (width - len(x)))[p * length : (p + 1) * length] for p in range(parts)]) for i, x in rows]
    first = sorted(cut, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p] for r in first] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, x in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(first)):
                mine = [x[p] for (_, x), f in zip(cut, found) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    out = [(i, "".join(f"{k:02x}" for _, k in f), min(sum(d for d, _ in f), 2**63 - 1)) for (i, _), f in zip(cut, assign())]
    return out, hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def _key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def _vectors(n, dims, scale=1.0, seed=3):
    return [[float(v) * scale for v in x] for x in np.random.default_rng(seed).normal(size=(n, dims))]


@pytest.mark.parametrize("case", ["plain", "few", "ragged", "odd", "repeated", "huge", "mixed"])
def test_codes_are_those_of_a_plain_evaluation(spark, case):
    x = _vectors(60, {"odd": 21, "ragged": 24}.get(case, 16), 1e30 if case == "huge" else 1.0)
    rows = [(None if k == 5 else k, v) for k, v in enumerate(x)]
    if case == "few":
        rows = rows[:7]
    if case == "ragged":
        rows = [(i, v[: 24 - (k % 5)]) for k, (i, v) in enumerate(rows)] + [(99, [])]
    if case == "repeated":
        rows = rows + [(k % 3, x[0]) for k in range(40)] + [(7, x[9])] * 2
    if case == "mixed":
        rows += [(100, [1e38] * 16), (101, [1.5e308] + [0.0] * 15)]
    bad = [(200, None), (201, [None] * 16), (202, [float("nan")] * 16), (203, [1.0] * 15 + [float("-inf")])]
    frame = spark.createDataFrame([(i, v, None if k % 4 == 0 else k % 3, "x") for k, (i, v) in enumerate(rows + bad)], SCHEMA).repartition(3)
    want, digest = _plain(rows)
    got = codes.compress(frame).collect()
    assert sorted([(r.vec_id, r.code, r.error) for r in got], key=_key) == sorted(want, key=_key)
    assert {r.codebooks_sha256 for r in got} == {digest}
    by_label = {}
    for r in got:
        by_label[r.label] = by_label.get(r.label, 0) + r.error
    assert {(r.label, r.label_error) for r in got} == {(k, min(v, 2**63 - 1)) for k, v in by_label.items()}


def test_no_rows(spark):
    none = spark.createDataFrame([(1, None, 1, "x")], SCHEMA)
    assert codes.compress(none).count() == 0 == codes.compress(none.limit(0)).count()
    assert codes.compress(none).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def test_the_transform_scales_distances_and_orders_by_sign_changes():
    h = codes.transform(np.eye(8, dtype=np.int64)).T
    assert [int((np.diff(r) != 0).sum()) for r in h] == list(range(8)) and (h @ h.T == 8 * np.eye(8)).all()
    a, b = np.random.default_rng(0).integers(-50, 50, (2, 4, 5))
    assert (((codes.transform(a) - codes.transform(b)) ** 2).sum(axis=1) == 8 * ((a - b) ** 2).sum(axis=1)).all()


def test_smooth_parts_are_told_by_a_few_coefficients():
    base = np.arange(16)[:, None] * 100 + np.random.default_rng(1).integers(-3, 4, (16, 32))
    x = np.repeat(base, 20, axis=0) + np.random.default_rng(2).integers(-3, 4, (320, 32))
    code, distance, looked = codes.nearest(codes.transform(x), codes.transform(base))
    assert (code == np.repeat(np.arange(16), 20)).all() and (distance == 32 * ((x - base[code]) ** 2).sum(axis=1)).all()
    assert looked < 320 * 16 * 32 / 4
    tie = codes.nearest(codes.transform(np.zeros((1, 4), np.int64)), codes.transform(np.array([[2, 0, 0, 0], [0, 1, 0, 0], [-1, 0, 0, 0]])))
    assert tie[0][0] == 1 and tie[1][0] == 4
