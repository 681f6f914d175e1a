"""Lineage in blocks against folds over whole histories in plain code, and maps of lines against single steps."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import pairwise

import pytest
from oracle import SMALL

from palimpsest.catalog import bind
from palimpsest.functions import linemaps
from palimpsest.functions.lines import back, diff, forward, track
from palimpsest.operators import lineage
from palimpsest.queries.lineage import QUERIES, versions


def blamed(past):
    owners = [past[0][0]] * len(past[0][1])
    for (_, old), (position, new) in pairwise(past):
        hunks = diff(old, new, 0)
        moved = [back(hunks, k, old == new) for k in range(1, len(new) + 1)]
        owners = [owners[b - 1] if r == "unchanged" else position for r, b in moved]
    return list(enumerate(owners, 1))


def traced(past, line):
    if line > len(past[-1][1]):
        return []
    out, at = [], line
    for (_, old), (position, new) in zip(past[-2::-1], past[:0:-1], strict=True):
        relation, before = back(diff(old, new), at, old == new)
        out.append((position, at, relation))
        if before is None:
            return out
        at = before
    return [*out, (past[0][0], at, "introduced")]


def fated(past, line):
    out, at = [], line
    if line <= len(past[0][1]):
        for (_, old), (position, new) in pairwise(past):
            event, after = forward(diff(old, new), at, old == new)
            if event == "deleted" and len(old[at - 1].strip()) > 2 and new.count(old[at - 1]) == 1 and old.count(old[at - 1]) == 1:
                event, after = "moved", new.index(old[at - 1]) + 1
            if event == "kept" and after == at:
                continue
            out.append((position, after or at, {"kept": "shifted"}.get(event, event)))
            if event not in ("kept", "moved"):
                break
            at = after
    return out


def followed(past):
    out, regions = [], []
    if len(past) > 2:
        for k in range(1, len(past[1][1]) + 1):
            if back(diff(past[0][1], past[1][1], 0), k, past[0][1] == past[1][1])[0] != "unchanged":
                regions = [*regions[:-1], (regions[-1][0], k)] if regions and regions[-1][1] == k - 1 else [*regions, (k, k)]
        for (_, old), (position, new) in zip(past[1:], past[2:], strict=False):
            found = track(regions, diff(old, new, 0))
            if found is None or not regions:
                break
            regions, met = found
            out += [(past[1][0], position, *m) for m in met]
    return out


def fixed(past):
    if len(past) < 2:
        return []
    old, new = past[-2][1], past[-1][1]
    owners = dict(blamed(past[:-1]))
    gone = [k for k in range(1, len(old) + 1) if forward(diff(old, new, 0), k, old == new)[0] in ("deleted", "rewritten")]
    n, first = Counter(owners[k] for k in gone), {}
    for k in gone:
        first.setdefault(owners[k], k)
    return [(past[-1][0], p, n[p], first[p]) for p in n]


PLAIN = {"lineage_blame": blamed, "lineage_backward": lambda p: traced(p, 3), "lineage_forward": lambda p: fated(p, 3), "regions_followups": followed, "trace_fix": fixed}


def expected(rows, name):
    files = defaultdict(list)
    for file, position, lines in rows:
        files[file].append((position, list(lines)))
    return sorted((f, *x) for f, past in files.items() for x in PLAIN[name](sorted(past)))


def histories(r):
    """A long history, short ones, one of a single version and one that is emptied."""
    out = []
    for file, n in (("long", 60), ("short", 3), ("two", 2), ("single", 1)):
        lines = [f"line {k}" for k in range(12)]
        for position in range(n):
            out.append((file, position * 10, list(lines)))
            for _ in range(r.randrange(3)):
                k, kind = r.randrange(len(lines) + 1), r.random()
                if kind < 0.5:
                    lines[k:k] = [f"new {r.randrange(999)}"] * r.choice([1, 1, 2])
                elif kind < 0.7 and len(lines) > 6:
                    del lines[k : k + 1]
                elif kind < 0.85 and k < len(lines):
                    lines[k] = f"edit {r.randrange(999)}"
                elif k < len(lines):
                    lines.insert(r.randrange(len(lines)), lines.pop(k))
    return [*out, ("emptied", 0, ["a", "b", "c"]), ("emptied", 1, ["a", "b", "c", "d"]), ("emptied", 2, [""]), ("emptied", 3, ["c", "d"])]


@pytest.mark.parametrize("seed", range(2))
def test_blocks_equal_whole_histories(spark, seed):
    rows = histories(random.Random(seed))
    df = spark.createDataFrame(rows, "file string, position long, lines array<string>")
    got = {
        "lineage_blame": lineage.blame(df), "lineage_backward": lineage.backward(df, 3), "lineage_forward": lineage.fate(df, 3), "regions_followups": lineage.followups(df),
        "trace_fix": lineage.introducing(df).select("file", "fixed", "position", "lines", "first_line"),
    }
    for name, found in got.items():
        assert sorted(map(tuple, found.collect())) == expected(rows, name), name
    assert lineage.blocks(df).groupBy("file").agg({"block": "max"}).where("file = 'long'").first()[1] >= 2


@pytest.mark.parametrize("name", PLAIN)
def test_queries_equal_whole_histories(spark, name):
    rows = [(x.file, x.position, x.lines) for x in versions(bind(spark, SMALL)).collect()]
    order = {"lineage_blame": ["line", "position"], "trace_fix": ["fixed", "position", "lines", "first_line"]}
    got = QUERIES[name](spark, SMALL)
    columns = ["file", *order.get(name, [c for c in got.columns if c != "file"])]
    assert sorted(map(tuple, got.select(*columns).collect())) == expected(rows, name)


def test_no_versions(spark):
    none = spark.createDataFrame([], "file string, position long, lines array<string>")
    for found in (lineage.blame(none), lineage.backward(none, 1), lineage.fate(none, 1), lineage.followups(none), lineage.introducing(none)):
        assert found.count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_maps_compose_in_any_grouping(seed):
    past = [lines for file, _, lines in histories(random.Random(seed)) if file == "long"][:9]
    for one, ahead in ((linemaps.origin_map, False), (linemaps.fate_map, True)):
        steps = [one(old, new) for old, new in pairwise(past)]
        steps = steps if ahead else steps[::-1]
        left = steps[0]
        for s in steps[1:]:
            left = linemaps.compose(left, s)
        right = steps[-1]
        for s in steps[-2::-1]:
            right = linemaps.compose(s, right)
        for line in range(1, 40):
            at = line
            for s in steps:
                found = linemaps.at(s, at) if at else None
                at = found and found[0]
            for whole in (left, right):
                found = linemaps.at(whole, line)
                assert (found and found[0]) == at
