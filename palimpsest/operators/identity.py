"""The identity of files over renames, copies, deletions and merges.

A change that leaves a file at a path is a node (commit, path); each node points to the
one that it continues: the last node of the same path before it along first parents, of the old
path after a rename. An addition or a copy begins an incarnation, and so does a node with
nothing before it; an addition by a merge continues what its other parents have at the
path. The pointers are contracted by doubling, so that each node knows the node that began its
incarnation, its origin.

What lies before a place along first parents is looked up on the chains of the graph's
layout: in the probe's own chain, then in the chain below, log2(n) times at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.history import timeline
from palimpsest.plans.durable import checkpointed
from palimpsest.plans.graph import Chains, doubled
from palimpsest.plans.scope import directory_prefix, under_any

#: Places of a chain that are looked through together.
BLOCK = 1 << 14


def events(moves: DataFrame) -> DataFrame:
    """``commit_id, path, present, status, old_path, additions, deletions``: one for each commit and path, of ``moves(commit_id, ordinal, status, path, old_path, additions, deletions)``.

    A change with the path as its new one stands for it, the first by ordinal; else the path was
    deleted or renamed away.
    """
    gone = F.col("status").startswith("D")
    there = F.struct("path", F.lit(True).alias("present"), "ordinal", "status", "old_path", "additions", "deletions")
    left = F.struct(F.when(gone, F.col("path")).otherwise(F.col("old_path")).alias("path"), F.lit(False).alias("present"), "ordinal", F.lit("D").alias("status"), F.lit(None).cast(moves.schema["path"].dataType).alias("old_path"), "additions", "deletions")
    rest = ["present", "ordinal", "status", "old_path", "additions", "deletions"]
    # Both from one row, which stays where it is: changes dealt by commit are not dealt again.
    both = moves.select("commit_id", F.explode(F.array(F.when(~gone, there), F.when(gone | F.col("status").startswith("R"), left))).alias("x"))
    one = both.where("x IS NOT NULL").select("commit_id", "x.*").where("path IS NOT NULL").groupBy("commit_id", "path").agg(F.min_by(F.struct(*rest), F.struct((~F.col("present")).alias("late"), *rest[1:])).alias("e"))
    return one.select("commit_id", "path", *[f"e.{f}" for f in rest if f != "ordinal"])


def _last(probes: DataFrame, known: DataFrame) -> DataFrame:
    """``probes(probe, path, chain, place, ...)`` with ``hit``, the last of ``known(path, chain, place, hit)`` at or before the place in the chain.

    In the block of places first; where that has nothing, the last of an earlier block.
    """
    block = lambda df: df.withColumn("block", F.floor(F.col("place") / BLOCK))
    asks, has = block(probes), block(known)
    none = F.lit(None).cast(known.schema["hit"].dataType)
    both = has.select("path", "chain", "block", "place", "hit", F.lit(0).alias("ask"), F.lit(None).cast(asks.schema["probe"].dataType).alias("probe")).unionByName(asks.select("path", "chain", "block", "place", none.alias("hit"), F.lit(1).alias("ask"), "probe"))
    order = Window.partitionBy("path", "chain", "block").orderBy("place", "ask").rowsBetween(Window.unboundedPreceding, 0)
    near = checkpointed(both.withColumn("hit", F.last("hit", ignorenulls=True).over(order)).where("ask = 1").select("path", "chain", "block", "probe", "hit"))  # read twice below
    # Before the first block there is nothing.
    wanted = near.where("hit IS NULL AND block > 0").select("path", "chain", "block").distinct()
    if wanted.isEmpty():
        return near.select("probe", "hit")
    blocks = has.groupBy("path", "chain", "block").agg(F.max_by("hit", "place").alias("far"))
    earlier = Window.partitionBy("path", "chain").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = blocks.join(wanted.withColumn("asked", F.lit(True)), ["path", "chain", "block"], "full").withColumn("far", F.last("far", ignorenulls=True).over(earlier)).where("asked").select("path", "chain", "block", "far")
    return near.join(found, ["path", "chain", "block"], "left").select("probe", F.coalesce("hit", "far").alias("hit"))


def _placed(df: DataFrame, layout: Chains) -> DataFrame:
    """``df(commit_id, ...)`` with ``chain`` and ``place``; a commit outside the layout, without parents and children, is a chain of its own."""
    met = df.join(layout.members.select("commit_id", "chain", "place"), "commit_id", "left")
    return met.withColumn("chain", F.coalesce("chain", -1 - F.col("commit_id"))).fillna(0, "place")


def states(probes: DataFrame, known: DataFrame, layout: Chains) -> DataFrame:
    """As-of join along first parents: ``probe, hit``, for each of ``probes(probe, commit_id, path)`` the last of ``known(commit_id, path, hit)`` for the path at the commit or before it.

    Without a row where the path is not known. Commits outside the layout (without parents
    and children) know what they have themselves.
    """
    has = checkpointed(_placed(known, layout).select("path", "chain", "place", "hit"))
    asks = checkpointed(_placed(probes, layout).select("probe", "path", "chain", "place"))
    met = checkpointed(_last(asks, has))
    done = met.where("hit IS NOT NULL")
    while True:
        rest = asks.join(met.where("hit IS NULL").select("probe"), "probe", "left_semi")
        asks = checkpointed(rest.join(layout.heads, "chain").select("probe", "path", F.col("to_chain").alias("chain"), F.col("to_place").alias("place")))
        if asks.isEmpty():
            return done
        met = checkpointed(_last(asks, has))
        done = done.unionByName(met.where("hit IS NOT NULL"))


def states_at_once(probes: DataFrame, known: DataFrame, layout: Chains) -> DataFrame:
    """What ``states`` gives, for probes that are few beside what is known: they go to all chains of their ways, log2(n) at most each, so that what is known moves once."""
    ways = checkpointed(_ways(probes.select(F.col("commit_id").alias("revision")).distinct(), layout))
    asks = checkpointed(probes.join(ways.withColumnRenamed("revision", "commit_id"), "commit_id").select(F.struct("probe", "hop").alias("probe"), "path", "chain", "place"))
    found = _last(asks, _placed(known, layout).select("path", "chain", "place", "hit")).where("hit IS NOT NULL")
    return found.groupBy("probe.probe").agg(F.min_by("hit", "probe.hop").alias("hit"))


def _ways(revisions: DataFrame, layout: Chains) -> DataFrame:
    """Segments of ``revisions(revision)``; one outside the layout is a chain of its own."""
    alone = revisions.select(F.col("revision").alias("commit_id")).distinct().join(layout.members, "commit_id", "left_anti")
    return layout.segments(revisions).unionByName(_placed(alone, layout).select(F.col("commit_id").alias("revision"), "chain", "place", F.lit(0).alias("hop")))


def origins(moves: DataFrame, parents: DataFrame, layout: Chains, made: DataFrame | None = None) -> DataFrame:
    """``commit_id, path, status, additions, deletions, origin_commit, origin_path`` of every change that leaves a file at its path.

    Deletions have no row; they end what stands before them, as a rename does for its old path. ``made``:
    what ``events`` gave of the moves, as a table, where it is there.
    """
    every = checkpointed(events(moves)) if made is None else made
    nodes = every.where("present")
    node = F.struct("commit_id", "path")
    known = every.select("commit_id", "path", F.struct("commit_id", "present").alias("hit"))
    # What a node asks for, and of which parent; an addition asks the other parents of a merge.
    begun = F.col("status").startswith("A") | F.col("status").startswith("C")
    asked = F.when(F.col("status").startswith("R"), F.col("old_path")).otherwise(F.col("path"))
    edges = nodes.select(node.alias("node"), "commit_id", "status", asked.alias("asked"), begun.alias("begun")).join(parents.select("commit_id", "position", "parent_id"), "commit_id")
    asks = edges.where(F.when(F.col("begun"), F.col("status").startswith("A") & (F.col("position") > 0)).otherwise(F.col("position") == 0))
    # A hit is at the path that was asked for: the probe keeps it where it is not the node's own.
    probes = asks.select(F.struct("node", "position", F.when(F.col("asked") != F.col("node.path"), F.col("asked")).alias("old")).alias("probe"), F.col("parent_id").alias("commit_id"), F.col("asked").alias("path"))
    found = states(probes, known, layout).where("hit.present")
    hit = F.struct("hit.commit_id", F.coalesce("probe.old", "probe.node.path").alias("path"))
    first = found.groupBy("probe.node").agg(F.min_by(hit, "probe.position").alias("hit"))
    pointers = first.select(F.col("node").alias("commit_id"), F.struct("hit.commit_id", "hit.path").alias("parent_id"))
    jump = doubled(nodes.select(node.alias("commit_id")), pointers).select(F.col("commit_id").alias("node"), F.col("root").alias("origin"))
    return nodes.drop("present", "old_path").join(jump.select("node.*", F.col("origin.commit_id").alias("origin_commit"), F.col("origin.path").alias("origin_path")), ["commit_id", "path"])


def files_at(revisions: DataFrame, told: DataFrame, moves: DataFrame, layout: Chains, made: DataFrame | None = None) -> DataFrame:
    """``revision, path, origin_commit, origin_path`` of the files that each of ``revisions(revision)`` has, from changes along first parents; ``told``: what ``origins`` gave, ``made`` as there."""
    ways = _ways(revisions, layout)
    own = _placed((events(moves) if made is None else made).select("commit_id", "path", "present"), layout).withColumnRenamed("place", "at")
    seen = own.join(ways, "chain").where("at <= place")
    last = seen.groupBy("revision", "path").agg(F.max_by(F.struct("commit_id", "present"), F.struct(-F.col("hop"), "at")).alias("last"))
    there = last.where("last.present").select("revision", "path", F.col("last.commit_id").alias("commit_id"))
    return there.join(told.select("commit_id", "path", "origin_commit", "origin_path"), ["commit_id", "path"]).select("revision", "path", "origin_commit", "origin_path")


def hotspots(files: DataFrame, told: DataFrame, commits: DataFrame, merges: DataFrame, reached: DataFrame, *, prefix: str | None = None, limit: int | None = 20) -> DataFrame:
    """``path, touches, last_changed, additions, deletions`` of the files that the given revisions have: non-merge commits, among those ``reached``, that changed a file of the same identity under whatever path.

    ``files``: what ``files_at`` gave. A path with different identities in several revisions
    counts the changes of them all. Work on a branch counts even where the branch deleted the file before it was merged.
    """
    mine = files.where(F.lit(True) if prefix is None else under_any(F.col("path"), (directory_prefix(prefix),))).select("path", "origin_commit", "origin_path").distinct()
    touched = told.join(merges, "commit_id", "left_anti").join(reached, "commit_id", "left_semi").join(commits.select("commit_id", "commit_time"), "commit_id")
    # A commit may touch one identity at two paths at most where a rename and its source meet; changes are counted once.
    by_identity = touched.select("origin_commit", "origin_path", "commit_id", "commit_time", "additions", "deletions")
    found = mine.join(by_identity, ["origin_commit", "origin_path"]).groupBy("path").agg(
        F.count_distinct("commit_id").alias("touches"), F.max("commit_time").alias("last_changed"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"),
    )
    return found if limit is None else found.orderBy(F.desc("touches"), "path").limit(limit)


def history_of(told: DataFrame, moves: DataFrame, commits: DataFrame, origin: DataFrame, **page) -> DataFrame:
    """A page of the timeline of one incarnation, ``origin(origin_commit, origin_path)`` of one row, under all its paths."""
    mine = told.join(F.broadcast(origin), ["origin_commit", "origin_path"], "left_semi").select("commit_id", "path")
    changes = moves.join(mine, ["commit_id", "path"], "left_semi").withColumn("path", F.lit("."))
    return timeline(changes, commits, ".", **page)
