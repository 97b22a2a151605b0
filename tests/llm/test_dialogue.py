"""Conversation repair against a plain fold that carries whole audits and texts."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from obslake.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def _fold(rows):
    """(cost, audit, lines) of the cheapest edits; rows: (role, text, has to go, truncated)."""
    put = {"": ("u", "user"), "s": ("u", "user"), "a": ("u", "user"), "u": ("a", "assistant")}
    best = {"": (0, "", ())}
    for role, text, gone, late in rows:
        found = {}
        for state, (cost, audit, lines) in best.items():
            for _ in range(3):
                options = [(state, 3, "D", ())]
                if not gone:
                    options.append((put[state][0], 2 + late, "R", (f"{put[state][1]}:{text}",)))
                    if (state, role[:1]) in AFTER:
                        options.append((AFTER[state, role[:1]], late, "K", (f"{role}:{text}",)))
                for end, more, letter, line in options:
                    new = (cost + more, audit + letter, lines + line)
                    found[end] = min(found.get(end, new), new)
                state, cost, audit, lines = put[state][0], cost + 2, audit + "I", (*lines, put[state][1] + ":")
        best = found
    ends = []
    for state, (cost, audit, lines) in best.items():
        more = {"": (), "a": (), "u": ("assistant:",), "s": ("user:", "assistant:")}[state]
        ends.append((cost + 2 * len(more), audit + "I" * len(more), lines + more))
    return min(ends)


def _plain(rows):
    """The report of one conversation's rows (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, out, blank, duplicate, truncated = set(), [], 0, 0, 0
    for _, role, text in rows:
        kept = text.rstrip(SPACE)
        late = not kept.endswith((".", "!", "?"))
        gone = not kept or (role, text) in seen
        blank, duplicate, truncated = blank + (not kept), duplicate + bool(kept and gone), truncated + (late and not gone)
        seen.add((role, text))
        out.append((role, text, gone, late))
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum((a[1][:1], b[1][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(rows, rows[1:]))
    cost, audit, lines = _fold(out)
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _by_conversation(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(tuple(rest))
    return out


def _made(n, seed, conv):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \n", "Why? ", "é!\n", "x" * 50 + ".", "Well ", None]
    return [(conv, rng.choice([None, 3, k, k]), rng.choice(["user", "assistant", "system", "tool", None, "", "u", "user", "assistant"]), rng.choice(texts + [f"t{k}.", f"t{k}", f"t{k}!"] * 3)) for k in range(n)]


@pytest.mark.parametrize("most_rows,most_bytes,fan", [(256, 1 << 16, 64), (3, 1 << 16, 2), (50, 40, 1 << 20)])
def test_reports_are_those_of_a_plain_fold(spark, monkeypatch, most_rows, most_bytes, fan):
    monkeypatch.setattr(dialogue, "FAN", fan)
    rows = list(itertools.chain(_made(400, 1, 7), *(_made(k % 9, k, 100 + k) for k in range(40)), _made(20, 99, None), [(8, 1, "user", "Hi.")] * 90, [(9, 0, "user", "one two. " * 20_000)]))
    random.Random(0).shuffle(rows)
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", part string").repartition(5)
    every = frame.select("conv_id").unionByName(spark.createDataFrame([(5555,), (7,)], "conv_id long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {r[0]: tuple(r)[1:] for r in dialogue.report(frame, every, most_rows, most_bytes).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {c: _plain(r) for c, r in _by_conversation(rows).items()} | {5555: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got == want


def test_divide_and_conquer_finds_what_a_fold_finds():
    rng = random.Random(5)
    for _ in range(400):
        codes = bytes(rng.choice(range(9)) for _ in range(rng.randrange(1, 40)))
        rows = [(("suax"[(c - 1) // 2] if c else "u"), "", not c, (c - 1) % 2 if c else 0) for c in codes]
        found = dialogue.edits(codes, dialogue.NOTHING, dialogue.CLOSING)
        end = dialogue.row_states(codes, dialogue.NOTHING, dialogue.CLOSING)[-1]
        assert "".join(f[0] for f in found) + dialogue.closing(end)[0] == _fold(rows)[1]
        # stretches combine to the same states as their rows
        cut = [codes[i : i + 5] for i in range(0, len(codes), 5)]
        states = dialogue.node_states([dialogue.stretch(c) for c in cut], dialogue.NOTHING, dialogue.CLOSING)
        assert states == [s for k, s in enumerate(dialogue.row_states(codes, dialogue.NOTHING, dialogue.CLOSING)) if k % 5 == 4 or k == len(codes) - 1]
        assert dialogue.joined(dialogue.stretch(c) for c in cut) == dialogue.stretch(codes)


def test_repaired_rows_have_the_shape_and_the_digest(spark):
    frame = spark.createDataFrame(_made(60, 3, 1) + _made(5, 4, 2), SCHEMA)
    rows = {}
    for r in sorted(dialogue.repaired(frame, 7).collect(), key=lambda r: (r.conv_id, r.part, r.seq, r["at"])):
        rows.setdefault(r.conv_id, []).append(r)
    for r in dialogue.report(frame, None, 7).collect():
        kept = [x for x in rows[r.conv_id] if x.edit != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[:1] for x in kept))
        assert "".join(x.edit for x in rows[r.conv_id]) == r.audit
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in kept).encode()).hexdigest() == r.repaired_sha256


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in (1, 2, None) for t in [*range(60), None]]
    got = sorted(map(tuple, dialogue.damage(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want += {0: [], 1: [(c, t, role, "")], 2: [(c, t, role, "One Two")], 3: [(c, t, role, text)] * 2, 4: [(c, t, "user", text)]}.get(kind, [(c, t, role, text)])
    assert got == sorted(want, key=str)
    null = dialogue.damage(spark.createDataFrame([(1, 5, None, None)], SCHEMA)).collect()
    assert zlib.crc32(b"1:5") % 20 > 4 and tuple(null[0]) == (1, 5, " ", " ")


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert dialogue.report(none).count() == dialogue.repaired(none).count() == 0
    assert dialogue.report(none, spark.createDataFrame([(3,)], "conv_id long")).select("cost", F.length("audit")).first() == (0, 0)
