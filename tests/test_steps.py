"""Steps that several queries share are made once, and move numbers instead of long paths."""

from __future__ import annotations

import pytest
from oracle import SMALL, compare

from palimpsest.catalog import bind
from palimpsest.operators import followon, lineage, relations, reverts
from palimpsest.registry import ORACLES, QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_descendants_read_parents_once(spark, monkeypatch):
    """F7, F16: however many steps there are, the given parents are read by one table's making."""
    made = []
    monkeypatch.setattr(followon, "checkpointed", lambda df, old=followon.checkpointed: made.append(plan(df).count("LogicalRDD")) or old(df))
    parents = spark.createDataFrame([(k + 1, 0, k) for k in range(6)], "commit_id long, position int, parent_id long")
    commits = spark.createDataFrame([(k, 10 * k) for k in range(7)], "commit_id long, commit_time long")
    origins = spark.createDataFrame([(0,), (3,)], "origin_id long")
    got = followon.later_descendants(origins, parents, commits, commits.select("commit_id"), seconds=35, steps=5)
    assert {tuple(r) for r in got.collect()} == {(0, 1, 1, 10), (0, 2, 2, 20), (0, 3, 3, 30), (3, 4, 1, 10), (3, 5, 2, 20), (3, 6, 3, 30)}
    assert sum(n > 0 for n in made) <= 2 and len(made) > 3, made


def test_notes_move_no_object_ids(spark):
    """F16: object ids of notes are made after the window."""
    below = plan(bind(spark, SMALL).notes).split("Window", 1)[1]
    assert "sha2" not in below


@pytest.mark.parametrize("name", ["paths", "named_tests"])
def test_paths_are_told_apart_by_number(spark, name):
    """no aggregate has both a commit and a path in its keys."""
    c = bind(spark, SMALL)
    got = getattr(c, name)
    assert not [x for x in plan(got).splitlines() if "Aggregate" in x and "commit_id" in x and "path" in x]
    assert got.count() == got.distinct().count() == c.changes.select("commit_id", "path").distinct().count() == c.numbers.count()


def test_related_files_read_paths_twice_at_most(spark):
    """what follows the eligible commits reads tables, not the given paths again."""
    paths = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "c")], "commit_id long, path string")
    merges, seeds = paths.select("commit_id").where("commit_id = 9"), spark.createDataFrame([("a",)], "seed string")
    got = relations.related_files(paths, merges, seeds)
    assert [(r.path, r.support) for r in got.collect()] == [("b", 2), ("c", 1)]
    assert "LogicalRDD" not in plan(got)


def test_failures_resolve_messages_once(spark, monkeypatch):
    """F16: prefixes are looked up once for targets and for reverts."""
    asked = []
    monkeypatch.setattr(reverts, "unique_ids", lambda *a, old=reverts.unique_ids: asked.append(1) or old(*a))
    compare(spark, SMALL, QUERIES["failures"], ORACLES["failures"])
    assert len(asked) == 1


def test_closed_patterns_up_to_a_limit(spark):
    """the first sets are the same with a limit, those of equal support included."""
    sets = ["sabcdefg"] * 2 + ["sab"] * 3 + ["sac"] * 3 + ["sde"] * 3 + ["sa", "sd"]
    paths = spark.createDataFrame([(k, p) for k, s in enumerate(sets) for p in s], "commit_id long, path string")
    none, seed = spark.createDataFrame([], "commit_id long"), spark.createDataFrame([("s",)], "seed string")
    whole = [tuple(r) for r in relations.closed_patterns(paths, none, seed, least=2).collect()]
    for limit in (1, 2, 3, 4, 9):
        assert [tuple(r) for r in relations.closed_patterns(paths, none, seed, least=2, limit=limit).collect()] == whole[:limit]
    assert whole[:3] == [("a,b,s", 3, 5), ("a,c,s", 3, 5), ("d,e,s", 3, 5)] and whole[3] == ("a,b,c,d,e,f,g,s", 8, 2)


def test_closed_patterns_try_fewer_sets(spark, monkeypatch):
    """with a limit fewer commits are held by sets than without."""
    held = []
    monkeypatch.setattr(relations, "checkpointed", lambda df, old=relations.checkpointed: (lambda t: held.append(t.count() if t.columns == ["set", "commit_id"] else 0) or t)(old(df)))
    sets = ["sabcdef"] * 3 + ["sab"] * 9 + ["sabc"] * 3 + ["sade", "sbdf", "scdef", "sbef"]
    paths = spark.createDataFrame([(k, p) for k, s in enumerate(sets) for p in s], "commit_id long, path string")
    none, seed = spark.createDataFrame([], "commit_id long"), spark.createDataFrame([("s",)], "seed string")
    whole, all_held = [tuple(r) for r in relations.closed_patterns(paths, none, seed, least=2).collect()], sum(held)
    held.clear()
    assert [tuple(r) for r in relations.closed_patterns(paths, none, seed, least=2, limit=1).collect()] == whole[:1]
    assert sum(held) < all_held


def test_brands_are_the_first_parts_of_paths(spark):
    """made from numbers, without the paths before them."""
    c = bind(spark, SMALL)
    want = {(r.commit_id, r.path.split("/")[0]) for r in c.paths.collect()}
    got = [tuple(r) for r in c.brands.collect()]
    assert set(got) == want and len(got) == len(want)
    assert plan(c.brands).count("Aggregate") == 1


def test_a_fix_is_traced_with_versions_read_once(spark, monkeypatch):
    """given texts are taken apart by one table's making, and blocks are folded in a stream, not a group for each."""
    made = []
    monkeypatch.setattr(lineage, "checkpointed", lambda df, old=lineage.checkpointed: made.append(plan(df)) or old(df))
    rows = spark.createDataFrame([("f", 0, "a b c"), ("f", 1, "a x c"), ("f", 2, "x c d"), ("g", 0, "a")], "file string, at long, text string")
    got = lineage.introducing(lineage.versions(rows, "file", "at", "text", " "))
    assert [tuple(r) for r in got.select("file", "fixed", "position", "lines", "first_line").collect()] == [("f", 2, 0, 1, 1)]
    assert "split(" not in plan(got) and sum("split(" in p for p in made) == 1
    assert not [p for p in [*made, plan(got)] if "FlatMapGroupsIn" in p]


def test_blame_stops_where_no_line_is_left(spark, monkeypatch):
    """versions before the one that made all lines anew are not compared."""
    compared = []
    monkeypatch.setattr(lineage.linemaps, "blame_map", lambda old, new, position, real=lineage.linemaps.blame_map: compared.append(position) or real(old, new, position))
    texts = ["a b", "a b c", "p q", "p q r"]
    past = [(k, t.split()) for k, t in enumerate(texts)]
    monkeypatch.setattr(lineage, "_maps", lambda dealt, one: one)
    monkeypatch.setattr(lineage, "blocks", lambda rows: rows)
    caught = []
    monkeypatch.setattr(lineage, "_scanned", lambda one, back: caught.append(one) or spark.createDataFrame([], f"file string, block int, map {lineage.PIECES}"))
    lineage.blame(spark.createDataFrame([], "file string"))
    assert caught[0](past, False) == [(1, 2, 2, lineage.linemaps.OWNED), (3, 1, 3, lineage.linemaps.OWNED)]
    assert compared == [3, 2]


def test_hotspots_move_numbers(spark, monkeypatch):
    """changes are dealt by commit to as many tasks as their number asks for, and no path is with them."""
    from palimpsest.queries import history

    monkeypatch.setattr(history, "CHANGES", 500)
    made = history.QUERIES["agg_hotspots"](spark, SMALL)._jdf.queryExecution()
    lines = made.optimizedPlan().toString().splitlines()
    assert any("RepartitionByExpression [commit_id" in x and int(x.rsplit(",", 1)[1]) > 4 for x in lines)
    assert not [x for x in lines if "Aggregate [commit_id" in x and "concat_ws" in x] and sum("concat_ws" in x for x in lines) == 1
    compare(spark, SMALL, history.QUERIES["agg_hotspots"], history.ORACLES["agg_hotspots"])
    compare(spark, SMALL, history.QUERIES["agg_churn"], history.ORACLES["agg_churn"])
