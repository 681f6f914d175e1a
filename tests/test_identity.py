"""Identity of files against a walk commit by commit: the reference's shapes, random histories, long chains in small blocks."""

from __future__ import annotations

import random

import pytest
from oracle import SMALL, compare

from palimpsest.operators import identity
from palimpsest.plans import graph
from palimpsest.queries.identity import ORACLES, QUERIES

MOVES = "commit_id long, ordinal int, status string, path string, old_path string, additions long, deletions long"
COMMITS = "commit_id long, position long, commit_time long"


def tables(spark, history, changes):
    """``history``: (commit, parents) in order; ``changes``: (commit, status, path, old path, additions, deletions)."""
    edges = [(c, k, p) for c, ps in history for k, p in enumerate(ps)]
    moves = [(c, k, *x) for k, (c, *x) in enumerate(changes)]
    commits = spark.createDataFrame([(c, c, 1000 + c) for c, _ in history], COMMITS)
    return commits, spark.createDataFrame(edges, "commit_id long, position int, parent_id long"), spark.createDataFrame(moves, MOVES)


def hot(spark, history, changes, targets, **options):
    commits, parents, moves = tables(spark, history, changes)
    layout = graph.chains(parents)
    told = identity.origins(moves, parents, layout)
    files = identity.files_at(spark.createDataFrame([(t,) for t in targets], "revision long"), told, moves, layout)
    found = identity.hotspots(files, told, commits, graph.merges(parents), layout.ancestors(targets), **options)
    return {r.path: (r.touches, r.additions, r.deletions) for r in found.collect()}


def line(n):
    return [(k, [k - 1] if k > 1 else []) for k in range(1, n + 1)]


def test_renames_are_followed_but_not_copies_or_recreated_paths(spark):
    changes = [
        (1, "A", "old", None, 3, 0), (2, "M", "old", None, 1, 0), (3, "R100", "middle", "old", 0, 0), (4, "R100", "new", "middle", 0, 0), (5, "C100", "copy", "new", 4, 0), (6, "A", "reused", None, 1, 0),
        (7, "M", "reused", None, 1, 1), (8, "D", "reused", None, 0, 1), (9, "A", "reused", None, 1, 0), (10, "A", "removed", None, 1, 0), (11, "D", "removed", None, 0, 1),
    ]
    assert hot(spark, line(11), changes, [11]) == {"new": (4, 4, 0), "copy": (1, 4, 0), "reused": (1, 1, 0)}
    assert hot(spark, line(11), changes, [7]) == {"new": (4, 4, 0), "copy": (1, 4, 0), "reused": (2, 2, 1)}
    assert hot(spark, line(11), changes, [11], prefix="new") == {"new": (4, 4, 0)}


def test_merges_keep_the_branch_lineage(spark):
    """The merge adds src/new, which is what its other parent has there; merge commits are no touches themselves."""
    history = [(1, []), (2, [1]), (3, [2]), (4, [1]), (5, [4, 3])]
    changes = [(1, "A", "old", None, 3, 0), (2, "M", "old", None, 1, 0), (3, "R090", "src/new", "old", 0, 0), (4, "A", "src/main-only", None, 1, 0), (5, "A", "src/new", None, 1, 4), (5, "D", "old", None, 0, 3), (5, "A", "merge-only", None, 1, 0)]
    assert hot(spark, history, changes, [5]) == {"src/new": (3, 4, 0), "src/main-only": (1, 1, 0)}


def test_a_timeline_goes_over_renames(spark):
    changes = [(1, "A", "a", None, 1, 0), (2, "R100", "b", "a", 0, 0), (3, "A", "a", None, 1, 0), (4, "M", "b", None, 1, 1), (5, "M", "a", None, 1, 1), (6, "D", "b", None, 0, 1)]
    commits, parents, moves = tables(spark, line(6), changes)
    told = identity.origins(moves, parents, graph.chains(parents))
    page = lambda origin: [tuple(r) for r in identity.history_of(told, moves, commits, spark.createDataFrame([origin], "origin_commit long, origin_path string")).select("number", "commit_id", "change").orderBy("number").collect()]
    assert page((1, "a")) == [(1, 1, "added"), (2, 2, "renamed"), (3, 4, "modified")]
    assert page((3, "a")) == [(1, 3, "added"), (2, 5, "modified")]


def walked(history, changes):
    """Origins by climbing commit by commit."""
    up = dict(history)
    there, gone = {}, set()
    for c, status, path, old, *_ in changes:
        if status != "D":
            there.setdefault((c, path), (status, old))
        if status in "DR":
            gone.add((c, path if status == "D" else old))

    def state(c, path):
        while c is not None:
            if (c, path) in there:
                return c, path
            if (c, path) in gone:
                return None
            c = up[c][0] if up.get(c) else None
        return None

    def origin(c, path):
        status, old = there[c, path]
        if status == "C":
            return c, path
        asks = up.get(c, [])[1:] if status == "A" else up.get(c, [])[:1]
        found = next((s for p in asks if (s := state(p, old if status == "R" else path))), None)
        return origin(*found) if found else (c, path)

    return {n: origin(*n) for n in there}, state


@pytest.mark.parametrize("seed", range(2))
def test_random_histories(spark, seed, monkeypatch):
    monkeypatch.setattr(identity, "BLOCK", 2)
    r = random.Random(seed)
    history, changes = [(0, [])], []
    for c in range(1, 70):
        history.append((c, r.sample(range(max(0, c - 6), c), min(c, r.choice([1, 1, 1, 2, 3])))))
    for c, _ in history:
        for _ in range(r.randrange(4)):
            status, path, old = r.choice("AMMMDRRC"), r.choice("abcde"), r.choice("abcde")
            if status not in "RC" or old != path:
                changes.append((c, status, path, old if status in "RC" else None, 1, 0))
    commits, parents, moves = tables(spark, history, changes)
    layout = graph.chains(parents)
    told = identity.origins(moves, parents, layout)
    want, state = walked(history, changes)
    assert {(x.commit_id, x.path): (x.origin_commit, x.origin_path) for x in told.collect()} == want
    files = identity.files_at(spark.createDataFrame([(69,), (40,)], "revision long"), told, moves, layout)
    got = sorted((x.revision, x.path, x.origin_commit, x.origin_path) for x in files.collect())
    assert got == sorted((t, p, *want[s]) for t in (69, 40) for p in "abcde" if (s := state(t, p)))


def test_no_rows(spark):
    assert hot(spark, line(3), [(1, "A", "x", None, 1, 0)], []) == {}
    commits, parents, moves = tables(spark, line(3), [(1, "A", "x", None, 1, 0)])
    assert identity.origins(moves.limit(0), parents, graph.chains(parents)).count() == 0
    alone = spark.createDataFrame([(7, 1, "A", "x", None, 1, 0), (8, 2, "M", "x", None, 1, 0)], MOVES)
    layout = graph.chains(parents.limit(0))
    files = identity.files_at(spark.createDataFrame([(8,), (9,)], "revision long"), identity.origins(alone, parents.limit(0), layout), alone, layout)
    assert [tuple(x) for x in files.collect()] == [(8, "x", 8, "x")]
    assert sorted(tuple(x)[-2:] for x in identity.origins(alone, parents.limit(0), graph.chains(parents.limit(0))).collect()) == [(7, "x"), (8, "x")]


def test_paths_are_kept_once_and_settled_nodes_not_written_again(spark, monkeypatch):
    """A file changed 64 times, one renamed, beside 500 that are added once."""
    written, hits = [], []
    for module in (identity, graph):
        def counted(df, keep=module.checkpointed):
            out = keep(df)
            hits.extend(f.dataType for f in out.schema if f.name == "hit")
            if out.columns in (["commit_id", "root", "depth", "open"], ["node", "origin"], ["node", "origin", "moved"]) and "struct" in out.dtypes[0][1]:
                written.append(out.count())
            return out

        monkeypatch.setattr(module, "checkpointed", counted)
    history = {c: [c - 1] if c else [] for c in range(64)}
    changes = [(c, 0, "A" if c == 0 else "R" if c == 30 else "M", "b" if c >= 30 else "a", "a" if c == 30 else None, 1, 0) for c in range(64)] + [(0, 1 + k, "A", f"x{k}", None, 1, 0) for k in range(500)]
    parents = spark.createDataFrame([(c, 0, p) for c, ps in history.items() for p in ps], "commit_id long, position int, parent_id long")
    moves = spark.createDataFrame(changes, "commit_id long, ordinal int, status string, path string, old_path string, additions long, deletions long")
    told = identity.origins(moves, parents, graph.chains(parents)).collect()
    assert len(told) == 564 and {(r.origin_commit, r.origin_path) for r in told if r.path in "ab"} == {(0, "a")}
    assert written and sum(written) < 2 * len(told), written
    assert hits and not any("path" in t.fieldNames() for t in hits)


def test_hotspots_make_events_once_and_of_numbers(spark, monkeypatch):
    made = []
    monkeypatch.setattr(identity, "events", lambda moves, f=identity.events: made.append(moves.schema["path"].dataType.typeName()) or f(moves))
    assert compare(spark, SMALL, QUERIES["identity_hotspots"], ORACLES["identity_hotspots"]) == 20
    assert made == ["long"]
