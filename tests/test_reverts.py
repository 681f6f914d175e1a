from __future__ import annotations

from palimpsest.operators import reverts

NOTES = "commit_id long, oid string, position long, subject string, body string"


def test_links_need_one_unique_target(spark):
    oid = lambda x: (x * 40)[:40]
    rows = [
        (1, "1234567aaaa" + "0" * 29, 1, "First", ""), (2, "1234567bbbb" + "0" * 29, 2, "Second", ""), (3, oid("c"), 3, "Third", ""), (4, oid("d"), 4, "Undo", "\nThis reverts commit 1234567."), (5, oid("e"), 5, "Undo", "\nThis reverts commit 1234567A."),
        (6, oid("f"), 6, "Undo again", "\nThis reverts commit 1234567aaaa.\nThis reverts commit 1234567aaaa0."), (7, oid("0"), 7, "Both", "\nThis reverts commit 1234567aaaa.\nThis reverts commit 1234567bbbb."), (8, oid("9"), 8, "One is none", "\nThis reverts commit ccccccc.\nThis reverts commit 7777777."),
        (9, oid("8"), 9, "Short", "\nThis reverts commit cccccc."),
    ]
    notes = spark.createDataFrame(rows, NOTES)
    assert sorted((r.target, r.revert) for r in reverts.links(notes).collect()) == [(1, 5), (3, 8)]
    assert sorted(map(tuple, reverts.resolved(notes).collect())) == [(5, 1), (6, 1), (8, 3)]
    scoped = reverts.links(notes.where("commit_id <> 1"), known=notes)
    assert [(r.target, r.revert) for r in scoped.collect()] == [(3, 8)]


def test_the_golden_history(spark):
    """A change, its revert with a reason and a retry, and the fix that followed."""
    ids = [k * 10 for k in "abcd"]
    rows = [
        (1, ids[0] * 4, 1, "Add provider normalization path", "\nKeep provider values available to callers."),
        (2, ids[1] * 4, 2, "Retire legacy provider safely", "\nNormalize provider values so that stale input does not leak to callers."),
        (3, ids[2] * 4, 3, 'Revert "Retire legacy provider safely"', f"\nThis reverts commit {ids[1] * 4}.\n\nReason: provider normalization caused a regression in legacy callers.\n\nRetry: restore normalization after callers migrate."),
        (4, ids[3] * 4, 4, "Fix provider regression after revert", "\nFix provider regression by restoring normalization after callers migrate."),
    ]
    notes = spark.createDataFrame(rows, NOTES)
    parents = spark.createDataFrame([(k, 0, k - 1) for k in (2, 3, 4)], "commit_id long, position int, parent_id long")
    commits = spark.createDataFrame([(k, 100 * k) for k in range(1, 5)], "commit_id long, commit_time long")
    paths = spark.createDataFrame([(k, "src/lib.rs") for k in range(1, 5)], "commit_id long, path string")
    candidates = notes.selectExpr("commit_id", "1.0D AS score")
    (row,) = reverts.failures(candidates, notes, paths, parents, commits).collect()
    assert (row.commit_id, row.score, row.revert, row.follow_up, row.confidence) == (2, 10.0, 3, 4, "high")
    assert row.reason == "Reason: provider normalization caused a regression in legacy callers." and row.retry.startswith("restore normalization after callers migrate")
    (alone,) = reverts.failures(candidates.where("commit_id = 3"), notes, paths, parents, commits).collect()
    assert (alone.commit_id, alone.revert, alone.follow_up, alone.score) == (3, None, 4, 4.0)
    assert reverts.failures(candidates.where("commit_id IN (1, 4)"), notes, paths, parents, commits).count() == 0
