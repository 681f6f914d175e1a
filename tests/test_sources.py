"""A small Git repository read as tables, cached in generations, and streams against their batch forms."""

from __future__ import annotations

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import patches
from palimpsest.sources import generations, git
from palimpsest.streaming import refresh


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    at = tmp_path_factory.mktemp("repo")
    clock = iter(range(10))

    def run(*args):
        when = f"2000-01-0{1 + next(clock)}T00:00:00Z" if args[0] in ("commit", "merge") else "2000-01-01T00:00:00Z"
        env = {**os.environ, "GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "GIT_CONFIG_GLOBAL": os.devnull, "HOME": str(at)}
        who = ["-c", "user.name=A", "-c", "user.email=a@example.com", "-c", "init.defaultBranch=main"]
        subprocess.run(["git", *who, *args], cwd=at, env=env, check=True, capture_output=True)

    def put(name, body):
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_text(body)
        run("add", "-A")

    run("init")
    put("src/lib.rs", "a\n    value\nz\n")
    run("commit", "-m", "Add provider normalization path\n\nKeep provider values.")
    put("src/lib.rs", "a\n    value.trim()\nz\n")
    run("commit", "-m", "Retire legacy provider safely")
    put("src/lib.rs", "a\n    value\nz\n")
    run("commit", "-m", "Revert it")
    run("mv", "src/lib.rs", "src/main.rs")
    put("tests/provider.rs", "test\n")
    run("commit", "-m", "Move the library")
    return str(at), run, put


def test_tables(spark, repo):
    at, _, _ = repo
    git.register(spark)
    read = lambda t: spark.read.format("githistory").option("path", at).option("table", t).option("slice", 2).load()
    commits = read("commits").orderBy("position").collect()
    assert [c.subject for c in commits] == ["Add provider normalization path", "Retire legacy provider safely", "Revert it", "Move the library"]
    assert commits[0].body.strip() == "Keep provider values." and commits[0].commit_time == 946684800
    assert read("parents").count() == 3
    changes = {(r.oid, r.status[0]): bytes(r.new_path) for r in read("changes").collect()}
    assert changes[commits[3].oid, "R"] == b"src/main.rs" and changes[commits[3].oid, "A"] == b"tests/provider.rs"
    hunks = read("hunks")
    assert hunks.where(F.col("text").cast("string").startswith("@@ -1,3 +1,3 @@")).count() == 2
    text = read("changes").select("oid", "ordinal", "status", F.col("old_path").cast("string").alias("old_path"), F.col("new_path").cast("string").alias("new_path"), "old_mode", "new_mode")
    prints = patches.file_patches(text, hunks.select("oid", "ordinal", "hunk", F.regexp_replace(F.col("text").cast("string"), "\n$", "").alias("text")))
    assert [r.oid for r in patches.equivalents(prints, commits[1].oid, "inverse").collect()] == [commits[2].oid]
    assert read("tree").where(F.col("path").cast("string") == "src/main.rs").count() == 1


def test_generations(spark, repo, tmp_path):
    at, run, put = repo
    root = f"{tmp_path}/store"
    first = generations.index(spark, at, root)
    assert generations.index(spark, at, root) == first
    put("new.txt", "x\n")
    run("commit", "-m", "Add a file")
    second = generations.index(spark, at, root)
    store = generations.Store(spark, root)
    assert second["generation"] != first["generation"] and store.table("commits").count() == 5 and store.check() == []
    last = store.table("commits").orderBy(F.desc("position")).limit(1)
    assert store.prune(last, dry_run=True)["commits"] == 1 and store.table("commits").count() == 5
    store.prune(last)
    assert store.table("commits").count() == 4 and store.table("hunks").join(last, "oid", "left_semi").count() == 0
    assert store.clear(dry_run=True) > 0 and store.clear() > 0 and store.manifest() is None


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = f"{tmp_path}/in"
    events.repartition(3).write.parquet(source)
    seen = []
    refresh.refresh(spark, source, events.schema, f"{tmp_path}/c1", lambda df, _: seen.append(df.count()))
    assert sum(seen) == events.count()
    stream = spark.readStream.schema(events.schema).parquet(source)
    for name, make, mode in (("counts", refresh.usage_counts, "complete"), ("pairs", lambda e: refresh.followups(e, "error", "purchase"), "append")):
        q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        got, want = spark.table(name).collect(), make(events).collect()
        key = (lambda r: (str(r.start), r.command, r.calls)) if name == "counts" else tuple
        assert sorted(map(key, got)) == sorted(map(key, want))


def test_manifests_are_never_replaced(spark, tmp_path):
    """A writer lost while publishing leaves the last generation; of two writers from one manifest the second fails."""
    root = tmp_path / "store"
    store = generations.Store(spark, str(root))
    rows = lambda *oids: {"commits": spark.createDataFrame([(o,) for o in oids], "oid string")}
    store.build(rows("a"))
    (root / "MANIFEST-000000000002.json").write_text('{"schema": 1, "tab')
    assert [r.oid for r in store.table("commits").collect()] == ["a"]
    store.append(rows("a", "b"))
    assert sorted(r.oid for r in store.table("commits").collect()) == ["a", "b"] and (root / "MANIFEST-000000000003.json").exists()
    late = generations.Store(spark, str(root))
    number = late._next()
    store.append(rows("c"))
    with pytest.raises(FileExistsError):
        late._publish(number, {"commits": []}, {})
    assert sorted(r.oid for r in store.table("commits").collect()) == ["a", "b", "c"]
