"""Closures against a walk in Python: random graphs, long chains, and the bound tables from all branches."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from oracle import SMALL

from palimpsest.catalog import bind
from palimpsest.plans import graph
from palimpsest.queries.history import QUERIES


def walk(edges, start):
    seen, todo = dict.fromkeys(start, 0), list(start)
    for x in todo:
        for y in edges[x]:
            if y not in seen:
                seen[y] = seen[x] + 1
                todo.append(y)
    return seen


def edges_of(rows):
    up, down = defaultdict(list), defaultdict(list)
    for child, _, parent in rows:
        up[child].append(parent)
        down[parent].append(child)
    return up, down


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    """Branches, merges of up to three parents, several roots, and starts that are nowhere."""
    r = random.Random(seed)
    rows = []
    for child in range(1, 60):
        for position, parent in enumerate(r.sample(range(child), min(child, r.choice([0, 1, 1, 1, 2, 3])))):
            rows.append((child, position, parent))
    up, down = edges_of(rows)
    parents = spark.createDataFrame(rows, "commit_id long, position int, parent_id long")
    laid = graph.chains(parents)
    starts = [*r.sample(range(60), 3), 1000]
    got = lambda df: sorted(x.commit_id for x in df.collect())
    assert got(laid.ancestors(starts)) == sorted(walk(up, starts))
    assert got(laid.descendants(starts)) == sorted(walk(down, starts))
    assert got(graph.reachable(parents, starts)) == sorted(walk(up, starts))
    assert got(laid.ancestors([])) == []


def test_a_long_history_takes_few_jobs(spark):
    n = 100_000
    parents = spark.range(1, n).selectExpr("id AS commit_id", "0 AS position", "id - 1 AS parent_id")
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("long history", "")
    try:
        assert graph.reachable(parents, [n - 1]).count() == n
        assert graph.chains(parents).descendants([n - 10]).count() == 10
        jobs = len(status.getJobIdsForGroup("long history"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 400, jobs  # two layouts of 17 doublings for sizes and 17 for places each, a few jobs a doubling; levels would be 100,000


def test_bound_tables(spark):
    c = bind(spark, SMALL)
    up, down, first, last, least = defaultdict(list), defaultdict(list), defaultdict(list), {}, {}
    for p in c.parents.collect():
        up[p.commit_id].append(p.parent_id)
        down[p.parent_id].append(p.commit_id)
        if p.position == 0:
            first[p.commit_id].append(p.parent_id)
    for x in sorted(c.commits.collect(), key=lambda x: x.position):
        last[x.branch] = x.commit_id
        least.setdefault(x.branch, x.commit_id)
    ids = lambda name: sorted(r.commit_id for r in QUERIES[name](spark, SMALL).collect())
    reached = walk(up, last.values())
    assert len(last) > 20 and ids("graph_ancestors") == sorted(reached)
    assert ids("graph_descendants") == sorted(walk(down, least.values()))
    good = walk(up, [x for x in last.values() if x % 2 == 0])
    assert ids("set_good_bad_difference") == sorted(set(reached) - set(good))


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, "")
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def merged_trunk(spark, n):
    """A trunk of ``n`` merges, 2k + 1 the merge of branch commit 2k into the merge before it, ids not in order of time."""
    feature = spark.range(1, n).selectExpr("2 * id AS commit_id", "0 AS position", "2 * id - 1 AS parent_id")
    trunk = spark.range(1, n).selectExpr("2 * id + 1 AS commit_id", "explode(array(0, 1)) AS position").selectExpr("commit_id", "position", "IF(position = 0, commit_id - 2, commit_id - 1) AS parent_id")
    return feature.unionByName(trunk)


def test_a_trunk_of_merges_takes_few_jobs(spark):
    """Branch commits have lesser ids than the merges beside them, so that the least id would begin a chain at each merge."""
    took = {}
    for n in (500, 20_000):
        parents = merged_trunk(spark, n)

        def all_ways(n=n, parents=parents):
            laid = graph.chains(parents)
            assert laid.members.where("chain = 1").count() == n
            assert laid.ancestors([2 * n - 1]).count() == 2 * n - 1
            assert laid.descendants([2 * n - 7]).count() == 7
            far = laid.first_parents([2 * n - 1, 100])
            assert far.count() == n + 1 and far.where("commit_id = 1").first().distance == 50
            assert laid.segments(spark.createDataFrame([(100,)], "revision long")).count() == 2

        _, took[n] = jobs_of(spark, f"trunk {n}", all_ways)
    assert took[20_000] < 2 * took[500], took  # 40 times the merges


@pytest.mark.parametrize("seed", range(2))
def test_first_parent_distances(spark, seed, tmp_path, monkeypatch):
    """Trees of first parents with places beyond a block, against a walk; kept layouts answer alike."""
    monkeypatch.setattr(graph, "BLOCK", 3)
    r = random.Random(seed)
    rows = [(child, 0, max(0, child - r.choice([1, 1, 1, 2, 9]))) for child in range(1, 80)] + [(200, 0, 199), (50, 1, 3)]
    up, _ = edges_of([x for x in rows if x[1] == 0])
    parents = spark.createDataFrame(rows, "commit_id long, position int, parent_id long")
    laid = graph.chains(parents)
    laid.save(f"{tmp_path}/layout")
    for starts in ([79, 40, 33], [200, 500], [0]):
        want = sorted(walk(up, starts).items())
        for known in (laid, graph.Chains.load(spark, f"{tmp_path}/layout")):
            assert sorted((x.commit_id, x.distance) for x in known.first_parents(starts).collect()) == want
    members = {(x.chain, x.place): x.commit_id for x in laid.members.collect()}
    ways = laid.segments(spark.createDataFrame([(79,), (33,)], "revision long")).collect()
    for start in (79, 33):
        mine = sorted((x.hop, x.chain, x.place) for x in ways if x.revision == start)
        assert [members[chain, k] for _, chain, top in mine for k in range(top, -1, -1)] == list(walk(up, [start]))


def test_nodes_that_know_their_root_are_not_written_again(spark, monkeypatch):
    """A long chain beside many short ones: rounds write what still asks."""
    written, keep = [], graph.checkpointed

    def counted(df):
        out = keep(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "checkpointed", counted)
    rows = [(c, 0, c - 1) for c in range(1, 65)] + [(1000 + c, 0, 0) for c in range(1000)]
    got = {r.commit_id: (r.root, r.depth) for r in graph.roots(spark.createDataFrame(rows, "commit_id long, position int, parent_id long")).collect()}
    assert got == {0: (0, 0)} | {c: (0, c) for c in range(1, 65)} | {1000 + c: (0, 1) for c in range(1000)}
    assert sum(written) < 3 * len(got), written
