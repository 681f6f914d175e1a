"""Documents that share telling words: texts are taken apart once, and only the words asked for are counted."""

from __future__ import annotations

from oracle import SMALL, compare

from palimpsest.operators import context
from palimpsest.queries.lineage import ORACLES, QUERIES


def test_texts_are_taken_apart_once(spark):
    """the words of a text are made at one place of the plan, and none is shuffled to meet the few that are asked for."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = QUERIES["context_content"](spark, SMALL)
        made = got._jdf.queryExecution()
        assert made.optimizedPlan().toString().count("text#") and sum("regexp_extract_all(" in x or "split(" in x for x in made.optimizedPlan().toString().splitlines()) == 1
        assert "hashpartitioning(s#" not in made.executedPlan().toString()
        compare(spark, SMALL, QUERIES["context_content"], ORACLES["context_content"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_words_at_the_bounds(spark, tmp_path):
    """words of 8 to 96 characters, whatever lies between them; null and empty texts share nothing."""
    low, high, short, long = "a" * 8, "b_" * 48, "c" * 7, "d" * 97
    rows = [(0, None, "en"), (1, f"{short} {long}", "en"), (2, f"{low}é{high}\n{short}-{long}", "en"), (3, f"{high}.{low}.{low}", "en"), (4, f"{low} {low} {short} {long}", "en"), (5, "", "en"), (6, f"{low}{high} {short} {long}", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "source AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in QUERIES["context_content"](spark, str(tmp_path)).collect()] == [(3, 2)]


def test_many_signals(spark, monkeypatch):
    """beyond the bound nothing is broadcast, with the same rows."""
    monkeypatch.setattr(context, "FEW", 1)
    local = spark.createDataFrame([(0, ["x", "y", "x"]), (9, None), (8, [])], "doc_id long, signals array<string>")
    there = spark.createDataFrame([(1, ["x", "x"]), (2, ["y", "z", "x"]), (3, None)], "doc_id long, signals array<string>")
    assert [tuple(r) for r in context.shared_signals(local, there).collect()] == [(2, 2)]
