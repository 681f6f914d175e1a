"""Merge bases and sides against sets of ancestors: random graphs, criss-cross merges, long trunks."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_graph import jobs_of, merged_trunk, walk

from palimpsest.operators import bases
from palimpsest.plans import graph


def plain(rows, pairs):
    up = defaultdict(list)
    for c, _, p in rows:
        up[c].append(p)
    found, only = set(), set()
    for k, a, b in pairs:
        left, right = set(walk(up, [a])), set(walk(up, [b]))
        common = left & right
        found |= {(k, c) for c in common if not any(c in up[d] for d in common)}
        only |= {(k, "left", c) for c in left - right} | {(k, "right", c) for c in right - left}
    return found, only


def asked(spark, rows, pairs):
    parents = spark.createDataFrame(rows, "commit_id long, position int, parent_id long")
    layout = graph.chains(parents)
    ranks = layout.members.selectExpr("commit_id", "commit_id AS rank")
    got = bases.sides(spark.createDataFrame(pairs, "pair long, left long, right long"), layout, ranks)
    return {tuple(r) for r in got.bases.collect()}, {tuple(r) for r in got.only.collect()}, got, layout


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed, monkeypatch):
    """Merges of up to three parents, several roots, pairs without a base, of one commit, and of ancestors."""
    monkeypatch.setattr(bases, "WINDOW", [1, 4, 64][seed])
    r = random.Random(seed)
    rows = [(c, k, p) for c in range(1, 90) for k, p in enumerate(r.sample(range(max(0, c - 12), c), min(c, r.choice([0, 1, 1, 1, 2, 3]))))]
    known = sorted({x for c, _, p in rows for x in (c, p)})
    pairs = [(k, *r.choices(known, k=2)) for k in range(60)] + [(100, 89, 89)]
    found, only, _, _ = asked(spark, rows, pairs)
    want_bases, want_only = plain(rows, pairs)
    assert (found, only) == (want_bases, want_only)


def test_a_criss_cross_has_two_bases(spark):
    rows = [(1, 0, 0), (2, 0, 0), (3, 0, 1), (3, 1, 2), (4, 0, 2), (4, 1, 1), (5, 0, 3), (6, 0, 4)]
    found, only, got, layout = asked(spark, rows, [(7, 5, 6)])
    assert found == {(7, 1), (7, 2)} and only == {(7, "left", 3), (7, "left", 5), (7, "right", 4), (7, "right", 6)}
    paths = spark.createDataFrame([(0, "a"), (1, "a"), (0, "b"), (5, "a"), (6, "a"), (3, "b"), (6, "c"), (4, "a")], "commit_id long, path string")
    disputed = bases.contested(got.only, paths)
    assert [tuple(r) for r in disputed.collect()] == [(7, "a", 1, 2)]
    assert {tuple(r) for r in bases.shared_history(disputed, got.bases, paths, layout).collect()} == {(7, "a", 1, 1), (7, "a", 2, 0)}


def test_no_pairs(spark):
    found, only, _, _ = asked(spark, [(1, 0, 0)], [])
    assert found == set() and only == set()


def test_all_merges_of_a_long_trunk(spark):
    """Each merge of a trunk has its own base, just below it: no pair walks the whole trunk, and rounds don't grow with it."""
    took = {}
    for n in (300, 6000):
        parents = merged_trunk(spark, n)
        layout = graph.chains(parents)
        pairs = parents.where("position = 1").selectExpr("commit_id AS pair", "commit_id - 2 AS left", "commit_id - 1 AS right")

        def every(n=n, layout=layout, pairs=pairs):
            got = bases.sides(pairs, layout, layout.members.selectExpr("commit_id", "commit_id AS rank"))
            assert got.bases.count() == n - 1 and got.bases.where("base <> pair - 2").isEmpty()
            assert got.only.count() == n - 1 and got.only.where("side <> 'right' OR commit_id <> pair - 1").isEmpty()

        _, took[n] = jobs_of(spark, f"bases {n}", every)
    assert took[6000] < 2 * took[300], took


def test_branches_beside_do_not_widen_windows(spark, monkeypatch):
    """Histories of branches are ranked on their own, so that one window does however many orders there are."""
    from oracle import SMALL

    from palimpsest.queries.bases import QUERIES

    walks, spread = [], bases._Walk.spread
    monkeypatch.setattr(bases._Walk, "spread", lambda self, starts: walks.append(1) or spread(self, starts))
    assert QUERIES["merge_bases"](spark, SMALL).count() > 0
    assert len(walks) == 2  # one window, and tops that lead to others


def test_short_ranges_share_one_level(spark):
    ranges = spark.createDataFrame([(1, 0, n) for n in (0, 1, 3, 7, 15, 40)], "chain long, low long, high long")
    points = spark.createDataFrame([(1, k) for k in range(60)], "chain long, at long")
    met = bases.in_ranges(ranges, points)
    assert sorted((r.high, r.at) for r in met.collect()) == sorted((n, k) for n in (0, 1, 3, 7, 15, 40) for k in range(n + 1))
    assert "array(4, 6)" in met._jdf.queryExecution().analyzed().toString()


def test_contested_and_shared_history_move_rows_once(spark):
    """Commits of sides are counted without an expansion for each side; what is known is looked through once, however many chains there are."""
    from palimpsest.operators import identity

    rows = [(1, 0, 0), (2, 0, 1), (3, 0, 1), (4, 0, 2), (5, 0, 2), (6, 0, 4), (7, 0, 4), (8, 0, 6), (9, 0, 6), (9, 1, 7), (10, 0, 5)]
    layout = graph.chains(spark.createDataFrame(rows, "commit_id long, position int, parent_id long"))
    known = spark.createDataFrame([(0, "a"), (2, "b"), (2, "b"), (6, "c"), (3, "a"), (77, "a")], "commit_id long, path string").distinct().withColumn("hit", F.struct("commit_id"))
    probes = spark.createDataFrame([(k, c, p) for k, (c, p) in enumerate((c, p) for c in [0, 1, 3, 5, 7, 8, 9, 10, 77, 78] for p in "abc")], "probe long, commit_id long, path string")
    want = {(r.probe, r.hit.commit_id) for r in identity.states(probes, known, layout).collect()}
    passes, last = [], identity._last
    identity._last = lambda *a: passes.append(1) or last(*a)
    try:
        assert {(r.probe, r.hit.commit_id) for r in identity.states_at_once(probes, known, layout).collect()} == want and len(want) > 10
    finally:
        identity._last = last
    assert len(passes) == 1
    only = spark.createDataFrame([(1, "left", 2), (1, "left", 3), (1, "right", 6), (2, "left", 2)], "pair long, side string, commit_id long")
    met = bases.contested(only, spark.createDataFrame([(2, "b"), (2, "b"), (3, "b"), (6, "b"), (6, "c")], "commit_id long, path string"))
    assert [tuple(r) for r in met.collect()] == [(1, "b", 2, 1)]
    assert "Expand" not in met._jdf.queryExecution().optimizedPlan().toString()
