"""Tokens, provenance, scopes, line maps and ordered operators on small values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import lines, provenance, scoring, text
from palimpsest.operators import context, history, patches, relations
from palimpsest.plans.scope import Scope, ScopeError, directory_prefix, safe_path, time_bound


def values(spark, given, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(given)], "k int, v string")
    return [r.x for r in rows.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_tokens(spark):
    given = ["HTTPServer2xx fooBar", "snake_case and kebab-case", "src/db/Index.rs", "日本語 text", "ABC", "", None]
    assert values(spark, given, text.logical_terms) == [
        ["http", "server", "2", "xx", "foo", "bar"], ["snake", "case", "and", "kebab"], ["src", "db", "index", "rs"], ["日本語", "text"], ["abc"], [], [],
    ]
    assert values(spark, ["日本語"], text.tokens)[0][0] == "日本語" and {"日", "日本", "本語"} <= set(values(spark, ["日本語"], text.tokens)[0])
    assert values(spark, ["日本語 ab"], text.query_alternatives) == [["日本語", "日本", "本語", "ab"]]


def test_signals_and_paths(spark):
    code = 'let retry_count = parseHTTPHeader(value); to_string "connect-timeout" \'error\' short'
    assert values(spark, [code], text.distinctive_signals) == [['"connect-timeout"', "parseHTTPHeader", "retry_count"]]
    assert values(spark, [".\\Src\\A.rs/", "././x//"], text.normalize_path) == ["src/a.rs", "x"]
    paths = ["tests/a.py", "src/a_test.go", "src/a.spec.ts", "test_a.py", "src/contest.py", "lib/spec/x", "src/attest/a.c"]
    assert values(spark, paths, text.is_test_path) == [True, True, True, True, False, True, False]


def test_provenance(spark):
    messages = [
        'Revert "x"\n\nThis reverts commit abcdef1234567.\nReason: provider normalization caused a regression in legacy callers.\nRetry: restore normalization after callers migrate.',
        "Reverted abcdef12 because it broke", "We will not revert. this is fine", "Reverted abcdef12.", "does not say: this reverts commit abcdef12345", None,
    ]
    found = values(spark, messages, provenance.revert_targets)
    assert found == [["abcdef1234567"], ["abcdef12"], [], [], [], []]
    assert "caused a regression" in values(spark, messages, provenance.stated_reason)[0]
    assert values(spark, ["revertible thing", "Fix it", " roll back", "add"], provenance.is_revert_subject) == [True, False, True, False]
    assert values(spark, ["revertible thing", "Fix it", " roll back", "add"], provenance.is_corrective_subject) == [True, True, True, False]
    assert values(spark, ["see #12, (#7) and x#9 #12"], provenance.references) == [["#12", "#7"]]


def test_scope_bounds():
    assert time_bound("1970-01-02") == 86400 and time_bound("1970-01-02", until=True) == 2 * 86400 - 1
    assert time_bound("1970-01-01T00:00:01.5Z") == 2 and time_bound("1970-01-01T00:00:01.5Z", until=True) == 1
    assert time_bound("1970-01-01T01:00:00+01:00") == 0
    for bad in ("1970-1-1", "1970-01-01T00:00:00", "soon"):
        with pytest.raises(ScopeError):
            time_bound(bad)
    with pytest.raises(ScopeError):
        Scope(since="2001-01-01", until="2000-01-01")
    for bad in ("/etc", "a/../b", "C:/x"):
        with pytest.raises(ScopeError):
            safe_path(bad)
    for bad in ("", ".", "./a", "a/./b", "a//b", "a/..", "/a", "C:/a", "a\0b", "/"):
        with pytest.raises(ScopeError):
            directory_prefix(bad)
    assert directory_prefix("a\\b//") == "a/b"


def test_line_maps_against_difflib():
    r = random.Random(1)
    for _ in range(200):
        old = [r.choice("abcdefgh") + str(k) for k in range(r.randrange(1, 12))]
        new = list(old)
        for _ in range(r.randrange(4)):
            at = r.randrange(len(new) + 1)
            new[at : at + r.randrange(2)] = [f"n{r.random()}" for _ in range(r.randrange(3))]
        hunks = lines.diff(old, new, r.randrange(4))
        assert all(h.sound for h in hunks)
        for k, x in enumerate(old, 1):
            event, at = lines.forward(hunks, k, old == new)
            assert (event == "kept") == (x in new) and (event != "kept" or new[at - 1] == x)
        for k, x in enumerate(new, 1):
            relation, at = lines.back(hunks, k, old == new)
            assert (relation == "unchanged") == (x in old) and (relation != "unchanged" or old[at - 1] == x)


def test_regions_follow_edits():
    old, new = list("abcdefg"), list("abXcdeYfg")
    assert lines.track([(3, 5)], lines.diff(old, new, 0)) == ([(4, 6)], [])
    assert lines.track([(2, 4)], lines.diff(old, new, 0)) == ([(2, 5)], [(2, 4, 3, 3)])
    assert lines.track([(3, 3)], lines.diff(old, list("abdefg"), 0)) == ([], [(3, 3, 3, 2)])
    assert lines.parse_hunk("@@ -1 +2,0 @@\n-x\n").old_lines == 1 and lines.parse_hunk("nothing") is None


def test_ordered_operators(spark):
    ids = spark.createDataFrame([("abcd1",), ("abcd2",), ("abce9",), ("zz000",)], "oid string")
    assert {r.oid: r.prefix for r in history.unique_prefixes(ids, least=2).collect()} == {"abcd1": "abcd1", "abcd2": "abcd2", "abce9": "abce", "zz000": "zz"}
    many = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("v"))
    got = sorted(r.v for r in history.systematic_sample(many, "k", "v", 100).collect())
    assert got == [(2 * j + 1) * 1000 // 200 for j in range(100)]


def test_patches(spark):
    mode = "100644"
    rows = [("a", 0, "M", "x", "x", mode, mode), ("b", 0, "M", "x", "x", mode, mode), ("c", 0, "M", "x", "x", mode, mode), ("d", 0, "M", "x", "x", "120000", mode)]
    changes = spark.createDataFrame(rows, "oid string, ordinal long, status string, old_path string, new_path string, old_mode string, new_mode string")
    hunks = spark.createDataFrame(
        [("a", 0, 0, "@@ -1,2 +1,2 @@\n k\n-p\n+q"), ("b", 0, 0, "@@ -9,3 +9,3 @@\n m\n-p\n+q\n n"), ("c", 0, 0, "@@ -1 +1 @@\n-q\n+p"), ("d", 0, 0, "@@ -1 +1 @@\n-p\n+q")],
        "oid string, ordinal long, hunk long, text string",
    )
    found = patches.file_patches(changes, hunks)
    assert [r.oid for r in patches.equivalents(found, "a").collect()] == ["b"]
    assert [r.oid for r in patches.equivalents(found, "a", "inverse").collect()] == ["c"]
    assert {(r.a, r.b) for r in patches.inverse_pairs(found).collect()} == {("a", "c"), ("b", "c")}


def test_region_matches(spark):
    rows = lambda x: spark.createDataFrame(x, "id long, file string, before string, after string, content string")
    own = rows([(1, "f", "b1", "a1", "c"), (2, "f", "same", "", "d"), (3, "f", "", "", "e"), (4, "f", "zz", "", "none")])
    past = rows([(11, "f", "b1", "x", "q"), (12, "f", "same", "", "r"), (13, "f", "same", "", "s"), (14, "f", "", "", "e")])
    assert {r.id: (r.status, r.match) for r in context.match_regions(own, past).collect()} == {1: ("unique", 11), 2: ("ambiguous", None), 3: ("unique", 14), 4: ("none", None)}


@pytest.mark.parametrize("seed", range(2))
def test_closed_patterns_by_every_set(spark, seed):
    """Against the closures of all sets of commits that random ones have in common."""
    import random

    r = random.Random(seed)
    rows = {c: {"s"} | {f for f in "abcdefg" if r.random() < 0.5} - ({"s"} if r.random() < 0.2 else set()) for c in range(14)}
    rows = {c: fs - ({"s"} if c % 5 == 0 else set()) for c, fs in rows.items()}
    paths = spark.createDataFrame([(c, f) for c, fs in rows.items() for f in fs], "commit_id long, path string")
    none = spark.createDataFrame([], "commit_id long")
    seen = {c: fs for c, fs in rows.items() if "s" in fs and len(fs) > 1}
    want, todo = set(), [frozenset(seen)]
    tried = set(todo)
    while todo:
        ids = todo.pop()
        members = frozenset.intersection(*(frozenset(seen[c]) for c in ids))
        if len(members) >= 3:
            want.add((",".join(sorted(members)), len(members), sum(members <= fs for fs in seen.values())))
        for f in "abcdefg":
            both = frozenset(c for c in ids if f in seen[c])
            if len(both) >= 2 and both not in tried:
                tried.add(both)
                todo.append(both)
    got = relations.closed_patterns(paths, none, spark.createDataFrame([("s",)], "seed string"), least=2).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 5


def test_closed_patterns(spark):
    sets = ["abc", "abcd", "abc", "ab", "bcd", "abd"]
    paths = spark.createDataFrame([(k, p) for k, s in enumerate(sets) for p in s], "commit_id long, path string")
    none = spark.createDataFrame([], "commit_id long")
    found = relations.closed_patterns(paths, none, spark.createDataFrame([("a",)], "seed string"), least=2)
    assert [(r.members, r.support) for r in found.collect()] == [("a,b,c", 3), ("a,b,d", 2)]


def test_cosine(spark):
    r = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>").select(scoring.cosine(F.col("a"), F.col("b")).alias("x")).first()
    assert r.x == pytest.approx(0.5**0.5)


def test_inverse_of_two_edit_blocks_in_one_hunk(spark):
    mode = "100644"
    changes = spark.createDataFrame([(o, 0, "M", "x", "x", mode, mode) for o in "abc"], "oid string, ordinal long, status string, old_path string, new_path string, old_mode string, new_mode string")
    texts = ["@@ -1,3 +1,3 @@\n-p\n+q\n k\n-r\n+t", "@@ -1,3 +1,3 @@\n-q\n+p\n k\n-t\n+r", "@@ -1,3 +1,3 @@\n k\n-q\n-t\n+p\n+r"]
    hunks = spark.createDataFrame([(o, 0, 0, t) for o, t in zip("abc", texts, strict=True)], "oid string, ordinal long, hunk long, text string")
    found = patches.file_patches(changes, hunks)
    assert [r.oid for r in patches.equivalents(found, "a", "inverse").collect()] == ["b"]
    assert {(r.a, r.b) for r in patches.inverse_pairs(found).collect()} == {("a", "b")}


def test_search_scores(spark, tmp_path):
    """BM25 of a written index equals that of the texts; whole spaceless terms add their bonus, their pairs count as partial; equal scores go by time and id."""
    from palimpsest.operators import search

    rows = [(1, "fix parser", "the parseError of HTTPServer", "src/a.rs", 10, "b"), (2, "数据库 fix", "", "src/数据.rs", 10, "a"), (3, "other", "parser parser", "doc", 20, "c"), (4, "none", "", "x", 5, "d"), (5, "none", "", "x", 5, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, subject string, body string, path string, commit_time long, oid string")
    near = {r.doc_id: r.bm25 for r in search.bm25(docs, ["parser", "fix"]).collect()}
    search.write_index(docs, str(tmp_path / "index"))
    far = {r.doc_id: r.bm25 for r in search.bm25_indexed(spark, str(tmp_path / "index"), ["fix", "parser"]).collect()}
    assert near.keys() == far.keys() == {1, 2, 3}
    assert near == pytest.approx(far)
    got = {r.doc_id: r for r in search.signals(docs, ["数据库", "error"]).collect()}
    assert set(got) == {1, 2} and got[2].subject_matches == 1 and got[1].covered == 1
    plain = {r.doc_id: r.score for r in search.signals(docs, ["fix", "error"]).collect()}
    assert got[2].score > plain[2]
    assert [r.doc_id for r in search.search(docs.withColumn("body", F.lit("fix")).withColumn("subject", F.lit("s")).withColumn("path", F.lit("p")), ["fix"]).orderBy("doc_id").collect()] == [1, 2, 3, 4, 5]
    order = search.signals(docs.withColumn("body", F.lit("fix")).withColumn("subject", F.lit("s")).withColumn("path", F.lit("p")), ["fix"]).orderBy(*search.ranked()).collect()
    assert [r.doc_id for r in order] == [3, 2, 1, 4, 5]


def test_coherent_changes(spark):
    from palimpsest.operators import search

    own = {1: "ab", 2: "abc", 3: "ac", 4: "x", 5: [f"p{i}" for i in range(20)] + ["a", "b"], 6: "yz", 7: [f"q{i}" for i in range(13)] + ["y", "z"], 8: "st"}
    paths = spark.createDataFrame([(d, p) for d, ps in own.items() for p in ps], "doc_id long, path string")
    pool = spark.createDataFrame([(d,) for d in own], "doc_id long")
    sets = {d: set(ps) for d, ps in own.items()}
    want = sorted(d for d, s in sets.items() if 2 <= len(s) <= 12 and any(len(s & t) >= 2 for e, t in sets.items() if e != d))
    assert sorted(r.doc_id for r in search.coherent(pool, paths).collect()) == want == [1, 2, 3, 6]


def test_mirrored_tests_gain_nothing(spark):
    from palimpsest.operators import relations

    names = ["src/parser.rs", "tests/test_parser.rs", "a/test-parser.rs", "tests/parser_test.rs", "tests/other_test.rs", "tests/test_parser_test.rs"]
    paths = spark.createDataFrame([(c, p) for c in range(4) for p in names], "commit_id long, path string")
    assert [r.n for r in paths.where("commit_id = 0").select(relations.tested_name(F.col("path")).alias("n")).collect()] == ["parser", "parser", "parser", "parser", "other", "parser_test"]
    none = spark.createDataFrame([], "commit_id long")
    found = relations.related_files(paths, none, spark.createDataFrame([("src/parser.rs",)], "seed string"), tests_only=True).collect()
    score = {r.path: r.score for r in found}
    assert score["tests/other_test.rs"] == pytest.approx(1.25 * score["tests/test_parser.rs"]) and score["tests/parser_test.rs"] == score["a/test-parser.rs"] == score["tests/test_parser.rs"]
    assert score["tests/test_parser_test.rs"] == score["tests/other_test.rs"]
