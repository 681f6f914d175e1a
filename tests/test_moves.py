"""Moved lines against comparing every window with every other, and the shapes of the reference."""

from __future__ import annotations

import difflib
import random
from collections import defaultdict
from itertools import pairwise

import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from palimpsest.catalog import bind
from palimpsest.operators import moves
from palimpsest.queries.lineage import QUERIES, REPOSITORIES, versions


def plain(rows, commit):
    files = defaultdict(list)
    for file, position, lines in rows:
        files[file].append((position, list(lines)))
    gone, come = defaultdict(list), defaultdict(list)
    for file, past in files.items():
        for (_, old), (position, new) in pairwise(sorted(past)):
            for tag, i, j, k, m in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
                if tag != "equal":
                    gone[commit(file, position)] += [(file, position, old, x) for x in range(i, j)]
                    come[commit(file, position)] += [(file, new, x) for x in range(k, m)]
    filled = lambda xs: sum(bool(x.strip()) for x in xs)
    out = []
    for c, lines in gone.items():
        for file, position, old, at in lines:
            low, high = max(0, at - 3), min(len(old), at + 4)
            window, off = old[low:high], at - low
            if not old[at].strip() or filled(window) < 3:
                continue
            around = lambda w, off=off: [x.lstrip(" \t") for x in w[:off] + w[off + 1 :]]
            same, near = [], 0
            for to, new, x in come[c]:
                other = new[x - off : x - off + len(window)] if x >= off else []
                if other == window:
                    same.append((to, x + 1))
                elif len(other) == len(window) and filled(around(window)) >= 3 and around(other) == around(window):
                    near += 1
            status = "unique" if len(same) == 1 else "ambiguous" if same else "unverified" if near else "none"
            out.append((file, position, at + 1, status, *(same[0] if len(same) == 1 else (None, None))))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame(rows, "file string, position long, lines array<string>")
    return sorted(map(tuple, moves.moved_lines(df, F.col("position")).collect()), key=repr)


BLOCK = ["fn alpha() {", "    one();", "    two();", "    three();", "}"]


def test_a_block_that_moves_to_another_file(spark):
    rows = [("a", 1, ["top", *BLOCK, "end"]), ("a", 2, ["top", "end"]), ("b", 1, ["x"]), ("b", 2, ["x", "top", *BLOCK, "end"])]
    got = found(spark, rows)
    assert got == plain(rows, lambda _, p: p) and {(r[2], r[4], r[5]) for r in got if r[3] == "unique"} >= {(4, "b", 5)}
    twice = [*rows, ("c", 1, ["y"]), ("c", 2, ["y", "top", *BLOCK, "end"])]
    assert {r[3] for r in found(spark, twice) if r[2] == 4} == {"ambiguous"}
    changed = [*rows[:3], ("b", 2, ["x", "top", *BLOCK[:2], "        2();", *BLOCK[3:], "end"])]
    assert {r[2]: r[3] for r in found(spark, changed)}[4] == "unverified"
    apart = [(f, p + (f == "b") * 5, x) for f, p, x in rows]
    assert {r[3] for r in found(spark, apart)} == {"none"}


@pytest.mark.parametrize("seed", range(2))
def test_random_moves(spark, seed):
    r = random.Random(seed)
    files = {f: [r.choice(["alpha", "beta", "gamma", "", "  delta", "\tdelta"]) + str(r.randrange(3)) * r.randrange(2) for _ in range(14)] for f in "abcd"}
    rows = [(f, 0, list(x)) for f, x in files.items()]
    for position in range(1, 6):
        f, g = r.choices("abcd", k=2)
        at, n = r.randrange(max(1, len(files[f]) - 6)), r.randrange(1, 8)
        piece = files[f][at : at + n]
        del files[f][at : at + n]
        for to in {g, r.choice("abcd")}:
            k = r.randrange(len(files[to]) + 1)
            files[to][k:k] = [x if r.random() < 0.9 else "  " + x for x in piece]
        rows += [(x, position, list(files[x])) for x in "abcd"]
    assert found(spark, rows) == plain(rows, lambda _, p: p)


def test_query_equals_plain_code(spark):
    rows = [(x.file, x.position, x.lines) for x in versions(bind(spark, SMALL)).collect()]
    got = sorted(map(tuple, QUERIES["moved_lines"](spark, SMALL).select("file", "position", "line", "status", "to_file", "to_line").collect()), key=repr)
    assert got == plain(rows, lambda f, p: (int(f) % REPOSITORIES, p)) and len(got) > 100


def test_no_versions(spark):
    assert found(spark, []) == []


def test_windows_are_not_taken_for_as_small_as_their_texts(spark):
    # Two megabytes of texts, which Spark would broadcast, has more than a million windows, which it must not.
    texts = [[f"{f} {p} {k % 997}" for k in range(900)] for f in range(60) for p in range(3)]
    df = spark.createDataFrame([(str(n // 3), n % 3, x) for n, x in enumerate(texts)], "file string, position long, lines array<string>")
    plan = moves.moved_lines(df, F.col("position"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_an_added_line_is_not_written_with_every_window(spark, monkeypatch):
    # Thirteen or so for each of 4,000 lines, of which no other version has anything, took most of the time.
    written = []
    monkeypatch.setattr(moves, "checkpointed", lambda df, f=moves.checkpointed: written.append(f(df)) or written[-1])
    rows = [(str(f), p, [f"{f} {p} {k}" for k in range(100)]) for f in range(20) for p in range(3)]
    assert {r[3] for r in found(spark, rows)} == {"none"}
    assert sum(df.count() for df in written) < 2.5 * 4000


def test_versions_in_batches(spark):
    r = random.Random(7)
    files = [(f, p, [r.choice(["a", "b", "", " a"]) for _ in range(r.choice([0, 1, 3, 5, 9, 30]))]) for f in "stuvwxyz" for p in range(12)]
    key, want = "spark.sql.execution.arrow.maxRecordsPerBatch", plain(files, lambda _, p: p // 3)
    before = spark.conf.get(key)
    try:
        for most in ("1", "2", "5"):
            spark.conf.set(key, most)
            df = spark.createDataFrame(files, "file string, position long, lines array<string>")
            assert sorted(map(tuple, moves.moved_lines(df, F.floor(F.col("position") / 3)).collect()), key=repr) == want
    finally:
        spark.conf.set(key, before)
    assert {x[3] for x in want} == {"unique", "ambiguous", "unverified", "none"}
