"""Follow-ons by distance in the graph against plain code."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from palimpsest.operators import followon

DAY = 86_400


def plain(history, times, touched, origins, days, steps, sample, one_in, excluded=()):
    down, up = defaultdict(list), dict(history)
    for c, ps in history:
        for p in ps:
            down[p].append(c)
    eligible = [c for c, ps in history if len(ps) < 2]
    last = max(times.values())

    def later(origin):
        seen, todo = {origin: 0}, [origin]
        for x in todo:
            for y in down[x] if seen[x] < steps else ():
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        return {y for y in seen if y != origin and len(up[y]) < 2 and 0 <= times[y] - times[origin] <= days * DAY}

    full = [c for c in eligible if times[c] + days * DAY <= last]
    own = [c for c in full if c in origins]
    out = set()
    for path in {p for ps in touched.values() for p in ps} - set(excluded):
        changes = {c for c in eligible if path in touched.get(c, ())}
        mine = [o for o in own if o not in changes]
        edges = {(o, x) for o in mine for x in later(o) & changes}
        supporting = len({o for o, _ in edges})
        if supporting < 2 or len({x for _, x in edges}) < 2 or one_in * supporting < len(mine):
            continue
        pool = [c for c in full if c not in changes]
        k = min(len(pool), sample)
        picked = [pool[(2 * i + 1) * len(pool) // (2 * k)] for i in range(k)]
        hits = sum(bool(later(c) & changes) for c in picked)
        if picked and supporting * k >= 2 * hits * len(mine):
            out.add((path, supporting, len(mine), hits, k))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_random_histories(spark, seed):
    r = random.Random(seed)
    history = [(0, [])] + [(c, r.sample(range(max(0, c - 5), c), min(c, r.choice([1, 1, 1, 1, 2])))) for c in range(1, 120)]
    times = {c: c * DAY + r.randrange(DAY) for c, _ in history}
    touched = {c: {p for p in "abcdefgh" if r.random() < 0.08} for c, _ in history}
    origins = {c for c, _ in history if r.random() < 0.05} | {20, 60}
    for c, ps in history:  # what follows origins more often than others
        if c not in origins and origins & set(ps):
            touched[c].add("z")
    sample, steps, one_in = (7, 20, 2) if seed % 2 else (100, 3, 4)
    commits = spark.createDataFrame(list(times.items()), "commit_id long, commit_time long")
    parents = spark.createDataFrame([(c, k, p) for c, ps in history for k, p in enumerate(ps)], "commit_id long, position int, parent_id long")
    eligible = spark.createDataFrame([(c,) for c, ps in history if len(ps) < 2], "commit_id long")
    paths = spark.createDataFrame([(c, p) for c, ps in touched.items() for p in ps], "commit_id long, path string")
    ranks = spark.createDataFrame([(c, c) for c, _ in history], "commit_id long, rank long")
    got = followon.observations(spark.createDataFrame([(o,) for o in origins], "origin_id long"), parents, commits, eligible, paths, ranks, days=4, steps=steps, sample=sample, one_in=one_in, excluded=spark.createDataFrame([("a",)], "path string"))
    want = plain(history, times, touched, origins, 4, steps, sample, one_in, "a")
    assert {tuple(x)[:5] for x in got.collect()} == want
    assert "z" in {p for p, *_ in want}


def test_nearest_distances_within_steps_and_time(spark):
    parents = spark.createDataFrame([(2, 0, 1), (3, 0, 2), (3, 1, 1), (4, 0, 3), (5, 0, 4)], "commit_id long, position int, parent_id long")
    commits = spark.createDataFrame([(k, 100 * k) for k in range(1, 6)], "commit_id long, commit_time long")
    every = commits.select("commit_id")
    got = followon.later_descendants(spark.createDataFrame([(1,), (3,)], "origin_id long"), parents, commits, every, seconds=350, steps=2)
    assert sorted(map(tuple, got.collect())) == [(1, 2, 1, 100), (1, 3, 1, 200), (1, 4, 2, 300), (3, 4, 1, 100), (3, 5, 2, 200)]
