"""Closures of the commit graph, never by path enumeration.

A history is as deep as it is long, so what can be reached is not found level by level:
commits are laid out in chains of first parents by pointer doubling. Of the commits with
one first parent, the one that most commits have above them stays in its chain (heavy
paths), so that a way along first parents changes chains log2(n) times at most: a trunk is
one chain, however many branches were merged into it. A closure moves from chain to chain,
and distances along first parents are differences of places. Distances over all parents,
which are asked for within a bound, are found by a frontier.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.plans.durable import checkpointed, forget


def _closure(edges: DataFrame, start: DataFrame, bound: int | None) -> DataFrame:
    """``id, distance`` of all nodes reached over ``edges(src, dst)`` from ``start(id)``, at the least distance.

    Each round joins only the new frontier and drops what was seen; rounds are
    checkpointed, so that the plan stays short. Ends with an empty frontier.
    """
    seen = checkpointed(start.select("id").distinct().withColumn("distance", F.lit(0)))
    frontier, k = seen, 0
    while (bound is None or k < bound) and not frontier.isEmpty():
        k += 1
        step = frontier.join(edges, frontier["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = checkpointed(step.join(seen, "id", "left_anti").withColumn("distance", F.lit(k)))
        seen = checkpointed(seen.unionByName(frontier)) if k % 8 == 0 else seen.unionByName(frontier)
    return seen


def _starts(like: DataFrame, ids: Iterable[int] | DataFrame) -> DataFrame:
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).alias("id"))
    return like.sparkSession.createDataFrame([(int(i),) for i in ids], "id long")


def ancestors(parents: DataFrame, ids: Iterable[int] | DataFrame, bound: int | None = None) -> DataFrame:
    """``commit_id, distance`` of commits reachable from ``ids``, themselves included."""
    edges = parents.select(F.col("commit_id").alias("src"), F.col("parent_id").alias("dst"))
    return _closure(edges, _starts(parents, ids), bound).withColumnRenamed("id", "commit_id")


def descendants(parents: DataFrame, ids: Iterable[int] | DataFrame, bound: int | None = None) -> DataFrame:
    """``commit_id, distance`` of commits from which ``ids`` are reachable, themselves included."""
    edges = parents.select(F.col("parent_id").alias("src"), F.col("commit_id").alias("dst"))
    return _closure(edges, _starts(parents, ids), bound).withColumnRenamed("id", "commit_id")


#: Places of a chain that are put in order together.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Chains:
    """A commit graph in chains: ``members(commit_id, chain, place, depth)``, places counted from the oldest commit of the chain on, depths from the root of the first-parent tree; the edges between chains, ``links(chain, place, to_chain, to_place)``; and ``heads(chain, to_chain, to_place)``, the first parent of the oldest commit of each chain that has one."""

    members: DataFrame
    links: DataFrame
    heads: DataFrame

    TABLES = ("members", "links", "heads")

    def save(self, path: str) -> None:
        """Keep the layout as tables, for further queries."""
        for name in self.TABLES:
            getattr(self, name).write.parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Chains:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in cls.TABLES))

    def ancestors(self, ids: Iterable[int] | DataFrame) -> DataFrame:
        """``commit_id`` of what can be reached from ``ids`` over parents, themselves included."""
        return self._closure(ids, self.links, up=True)

    def descendants(self, ids: Iterable[int] | DataFrame) -> DataFrame:
        """``commit_id`` of what reaches ``ids``, themselves included."""
        back = self.links.select(F.col("to_chain").alias("chain"), F.col("to_place").alias("place"), F.col("chain").alias("to_chain"), F.col("place").alias("to_place"))
        return self._closure(ids, back, up=False)

    def _closure(self, ids: Iterable[int] | DataFrame, links: DataFrame, up: bool) -> DataFrame:
        # Of a chain all places on one side of the farthest one are reached; only that one is kept.
        far = (lambda c: F.max(c)) if up else (lambda c: F.min(c))
        beyond = (lambda x, y: x > y) if up else (lambda x, y: x < y)
        starts = _starts(self.members, ids).select(F.col("id").alias("commit_id")).distinct()
        seen = checkpointed(self.members.join(starts, "commit_id", "left_semi").groupBy("chain").agg(far("place").alias("place")))
        fresh = seen
        while not fresh.isEmpty():
            edges = links.alias("l").join(fresh.alias("f"), "chain").where(~beyond(F.col("l.place"), F.col("f.place")))
            step = edges.groupBy(F.col("to_chain").alias("chain")).agg(far("to_place").alias("place"))
            met = step.join(seen.withColumnRenamed("place", "old"), "chain", "left")
            fresh = checkpointed(met.where(F.col("old").isNull() | beyond(F.col("place"), F.col("old"))).select("chain", "place"))
            seen = checkpointed(seen.unionByName(fresh).groupBy("chain").agg(far("place").alias("place")))
        inside = self.members.alias("m").join(seen.alias("s"), "chain").where(~beyond(F.col("m.place"), F.col("s.place"))).select("commit_id")
        # Commits without any edge are in no chain.
        return inside.union(starts.join(self.members, "commit_id", "left_anti"))


    def first_parents(self, ids: Iterable[int] | DataFrame) -> DataFrame:
        """``commit_id, distance`` along first parents from the nearest of ``ids``, themselves included.

        Of the starts above a commit the least deep one is the nearest. The least depth of
        starts moves from chain to chain, log2(n) times at most; within a chain it is a running
        minimum from the newest place on, by blocks of places first, then within each block.
        """
        starts = _starts(self.members, ids).select(F.col("id").alias("commit_id")).distinct()
        entered = checkpointed(self.members.join(starts, "commit_id", "left_semi").groupBy("chain", "place").agg(F.min("depth").alias("start")))
        seen = fresh = entered.groupBy("chain").agg(F.min("start").alias("start"))
        while not fresh.isEmpty():
            step = fresh.join(self.heads, "chain").select(F.col("to_chain").alias("chain"), F.col("to_place").alias("place"), "start")
            entered = checkpointed(entered.unionByName(step).groupBy("chain", "place").agg(F.min("start").alias("start")))
            least = entered.groupBy("chain").agg(F.min("start").alias("start"))
            fresh = checkpointed(least.join(seen.withColumnRenamed("start", "old"), "chain", "left").where(F.col("old").isNull() | (F.col("start") < F.col("old"))).select("chain", "start"))
            seen = least
        block = lambda df: df.withColumn("block", F.floor(F.col("place") / BLOCK))
        inside = block(self.members.join(entered.select("chain").distinct(), "chain", "left_semi"))
        blocks = inside.select("chain", "block").distinct().join(block(entered).groupBy("chain", "block").agg(F.min("start").alias("start")), ["chain", "block"], "left")
        newer = Window.partitionBy("chain").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
        later = blocks.select("chain", "block", F.min("start").over(newer).alias("later"))
        from_here = Window.partitionBy("chain", "block").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
        met = inside.join(entered, ["chain", "place"], "left").withColumn("here", F.min("start").over(from_here)).join(later, ["chain", "block"])
        found = met.select("commit_id", (F.least("here", "later") - F.col("depth")).alias("distance")).where("distance IS NOT NULL")
        return found.union(starts.join(self.members, "commit_id", "left_anti").withColumn("distance", F.lit(0).cast("long")))

    def segments(self, revisions: DataFrame) -> DataFrame:
        """``revision, chain, place, hop``: the first-parent history of each of ``revisions(revision)`` as the chains it goes down, from ``place`` on, in order of ``hop``."""
        found = self.members.join(revisions.select(F.col("revision").alias("commit_id")).distinct(), "commit_id", "left_semi").select(F.col("commit_id").alias("revision"), "chain", "place", F.lit(0).alias("hop"))
        found = checkpointed(found)
        fresh, k = found, 0
        while not fresh.isEmpty():
            k += 1
            fresh = checkpointed(fresh.join(self.heads, "chain").select("revision", F.col("to_chain").alias("chain"), F.col("to_place").alias("place"), F.lit(k).alias("hop")))
            found = found.unionByName(fresh)
        return found


def chains(parents: DataFrame) -> Chains:
    """Lay out a graph: of the commits with one first parent, that of the largest subtree stays in its chain (of equals the least id), the others begin chains of their own."""
    edges = checkpointed(parents.select("commit_id", "position", "parent_id"))
    nodes = edges.select("commit_id").union(edges.select("parent_id")).distinct()
    one = first_parents(edges)
    # Only children stay in any case. What they form is laid out first, so that only forks are compared.
    alone = one.groupBy("parent_id").agg(F.count("*").alias("n"), F.min("commit_id").alias("commit_id")).where("n = 1").select("commit_id", "parent_id")
    parts = doubled(nodes, alone).select("commit_id", F.col("root").alias("part"), F.col("depth").alias("own"))
    forks = checkpointed(one.join(alone.select("commit_id"), "commit_id", "left_anti"))
    if forks.isEmpty():
        members = parts.select("commit_id", F.col("part").alias("chain"), F.col("own").alias("place"), F.col("own").alias("depth"))
    else:
        sized = checkpointed(parts.groupBy("part").agg(F.count("*").alias("size")).withColumnRenamed("part", "commit_id"))
        below = parts.select(F.col("commit_id").alias("parent_id"), F.col("part").alias("to"))
        length = sized.select(F.col("commit_id").alias("to"), F.col("size").alias("step"))
        tree = checkpointed(forks.join(below, "parent_id").join(length, "to").select("commit_id", F.col("to").alias("parent_id"), "step"))
        summed = _subtrees(sized, tree)
        kept = tree.join(summed.select("commit_id", "size"), "commit_id").groupBy("parent_id").agg(F.max_by(F.struct("commit_id", "step"), F.struct("size", -F.col("commit_id"))).alias("k")).select("k.*", "parent_id")
        placed = doubled(sized.select("commit_id"), kept).select(F.col("commit_id").alias("part"), F.col("root").alias("chain"), F.col("depth").alias("before"))
        members = parts.join(placed, "part").join(summed.select(F.col("commit_id").alias("part"), F.col("depth").alias("under")), "part")
        members = checkpointed(members.select("commit_id", "chain", (F.col("before") + F.col("own")).alias("place"), (F.col("under") + F.col("own")).alias("depth")))
    end = lambda c, to: members.select(F.col("commit_id").alias(c), F.col("chain").alias(f"{to}chain"), F.col("place").alias(f"{to}place"))
    # Within a chain the place alone tells what is reached.
    between = checkpointed(edges.join(end("commit_id", ""), "commit_id").join(end("parent_id", "to_"), "parent_id").where("chain <> to_chain").select("position", "chain", "place", "to_chain", "to_place"))
    return Chains(members, between.drop("position").distinct(), between.where("position = 0").drop("position", "place").distinct())


def _subtrees(nodes: DataFrame, one: DataFrame) -> DataFrame:
    """``commit_id, size, depth``: the sizes at and above each of ``nodes(commit_id, size)`` of a forest ``one(commit_id, parent_id, step)``, and the steps below it, by doubling.

    After k rounds ``up`` is the node 2^k below, ``size`` counts nodes less than 2^k above, ``depth`` steps up to 2^k below.
    """
    held = checkpointed(nodes.join(one, "commit_id", "left").select("commit_id", F.col("parent_id").alias("up"), "size", F.coalesce("step", F.lit(0)).cast("long").alias("depth")))
    while not held.where("up IS NOT NULL").isEmpty():
        gained = held.where("up IS NOT NULL").groupBy("up").agg(F.sum("size").alias("more")).withColumnRenamed("up", "commit_id")
        grown = held.join(gained, "commit_id", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0)))
        below = held.select(F.col("commit_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("deeper"))
        before, held = held, checkpointed(grown.join(below, "up", "left").select("commit_id", F.col("next").alias("up"), "size", (F.col("depth") + F.coalesce("deeper", F.lit(0))).alias("depth")))
        forget(before)
    return held.select("commit_id", "size", "depth")


def reachable(parents: DataFrame, ids: Iterable[int] | DataFrame) -> DataFrame:
    """``commit_id`` of what can be reached from ``ids``, themselves included."""
    return chains(parents).ancestors(ids)


def first_parents(parents: DataFrame) -> DataFrame:
    return parents.where("position = 0").select("commit_id", "parent_id")


def first_parent_chain(parents: DataFrame, ids: Iterable[int] | DataFrame) -> DataFrame:
    """``commit_id, distance`` along first parents."""
    return chains(parents).first_parents(ids)


def merges(parents: DataFrame) -> DataFrame:
    """Commits with a second parent."""
    return parents.where("position > 0").select("commit_id").distinct()


def roots(parents: DataFrame, rounds: int = 40) -> DataFrame:
    """``commit_id, root, depth`` on the first-parent forest, by pointer doubling: log2(depth) rounds."""
    one = first_parents(parents)
    return doubled(one.select("commit_id").union(one.select("parent_id")).distinct(), one, rounds)


def doubled(nodes: DataFrame, one: DataFrame, rounds: int = 60) -> DataFrame:
    """``commit_id, root, depth`` of ``nodes(commit_id)`` on a forest ``one(commit_id, parent_id)``; with a column ``step`` that is how far apart the two lie.

    Nodes that have met one which knows its root ask no more and are not written again.
    """
    step = F.col("step") if "step" in one.columns else F.lit(1)
    asks = F.col("parent_id").isNotNull()
    going = nodes.join(one, "commit_id", "left").select("commit_id", F.coalesce("parent_id", "commit_id").alias("root"), F.when(asks, step).otherwise(0).cast("long").alias("depth"), asks.alias("open"))
    going, done = checkpointed(going), None
    for _ in range(rounds):
        asking = going.where("open")
        if asking.isEmpty():
            break
        known = going if done is None else done.unionByName(going)
        up = known.select(F.col("commit_id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), F.col("open").alias("on"))
        closed = going.where("NOT open")
        done = closed if done is None else done.unionByName(closed)
        going = checkpointed(asking.join(up, "root").select("commit_id", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("on").alias("open")))
    return (going if done is None else done.unionByName(going)).select("commit_id", "root", "depth")
