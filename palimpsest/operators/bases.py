"""Merge bases, sides and shared history of many pairs of revisions at once.

Both sides of every pair walk down the chains of the graph's layout together, each reached
chain held as its highest place. A walk is cut off below a rank, which grows from parents to
children, and the window is widened sixteenfold for those pairs only in which what one side
alone has reached goes on below it; so a pair costs what lies between its revisions and their
bases, not its whole history. Ranges of places meet their commits and links in blocks of a
power of four near their length (16 at least), two blocks for each range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.identity import states_at_once
from palimpsest.plans.durable import checkpointed
from palimpsest.plans.graph import Chains
from palimpsest.plans.ranks import numbered

#: Ranks below both revisions that the first window takes in, and how it grows.
WINDOW, WIDER = 256, 16
#: Ranges of 2 to the power of this or fewer meet points in blocks of that size.
LEAST = 4


def dense_ranks(commits: DataFrame, position: str = "position", shift: int = 40) -> DataFrame:
    """``commit_id, rank``: commits numbered from 0 by position, in groups of its leading bits."""
    return numbered(commits.select("commit_id", position), [], position, shift).select("commit_id", "rank")


def in_ranges(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """``ranges(chain, low, high, ...)`` joined with the ``points(chain, at, ...)`` in them."""
    # Points are copied for each level in use, so short ranges share one and the longer ones every second.
    near = F.ceil(F.log2(F.col("high") - F.col("low") + 1))
    sized = ranges.where("high >= low").withColumn("level", F.greatest(F.lit(LEAST), F.ceil(near / 2) * 2).cast("int"))
    sized = checkpointed(sized.withColumn("block", F.explode(F.expr("sequence(shiftright(low, level), shiftright(high, level))"))))
    levels = [r.level for r in sized.select("level").distinct().collect()]  # 63 at most
    keyed = points.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("block", F.expr("shiftright(at, level)"))
    return sized.join(keyed, ["chain", "level", "block"]).where("at BETWEEN low AND high").drop("level", "block")


@dataclass(frozen=True)
class Sides:
    """``bases(pair, base)`` and ``only(pair, side, commit_id)``, what can be reached from one side alone, ``left`` or ``right``."""

    bases: DataFrame
    only: DataFrame


class _Walk:
    def __init__(self, layout: Chains, ranks: DataFrame) -> None:
        self.members = checkpointed(layout.members.join(ranks, "commit_id").select("commit_id", "chain", "place", "rank"))
        at = lambda to: self.members.select(F.col("chain").alias(f"{to}chain"), F.col("place").alias(f"{to}place"), F.col("rank").alias(f"{to}rank"))
        self.links = checkpointed(layout.links.join(at(""), ["chain", "place"]).join(at("to_"), ["to_chain", "to_place"]).withColumnRenamed("rank", "at").drop("place"))

    def arrivals(self, fresh: DataFrame) -> DataFrame:
        """``pair, side, floor, chain, place, rank``: the highest places to which links lead from ``fresh(pair, side, floor, chain, rank, below)``, from ranks over ``below`` and not under the floor."""
        asks = fresh.select("pair", "side", "floor", "chain", F.greatest("floor", F.col("below") + 1).alias("low"), F.col("rank").alias("high"))
        met = in_ranges(asks, self.links)
        return met.groupBy("pair", "side", "floor", F.col("to_chain").alias("chain")).agg(F.max("to_place").alias("place"), F.max("to_rank").alias("rank"))

    def spread(self, starts: DataFrame) -> DataFrame:
        """``starts(pair, side, floor, chain, place, rank)`` with all that can be reached from them without going on from ranks under the floor, the highest place of each chain."""
        top = [F.max("place").alias("place"), F.max("rank").alias("rank")]
        seen = checkpointed(starts.groupBy("pair", "side", "floor", "chain").agg(*top))
        fresh = seen.withColumn("below", F.lit(-1).cast("long"))
        while not fresh.isEmpty():
            old = seen.select("pair", "side", "chain", F.col("rank").alias("below"))
            met = self.arrivals(fresh).join(old, ["pair", "side", "chain"], "left").fillna(-1, "below")
            fresh = checkpointed(met.where("rank > below").select("pair", "side", "floor", "chain", "place", "rank", "below"))
            seen = checkpointed(seen.unionByName(fresh.drop("below")).groupBy("pair", "side", "floor", "chain").agg(*top))
        return seen


def sides(pairs: DataFrame, layout: Chains, ranks: DataFrame) -> Sides:
    """Bases and sides of ``pairs(pair, left, right)`` of commits of the layout.

    A base can be reached from both, and from no other such commit; there may be several, or
    none. ``ranks(commit_id, rank)``: whole numbers from 0, a child's above its parents'.
    """
    walk = _Walk(layout, ranks)
    ends = pairs.select("pair", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left").alias("commit_id")), F.struct(F.lit("right").alias("side"), F.col("right").alias("commit_id")))).alias("e")).select("pair", "e.*")
    ends = checkpointed(ends.join(walk.members, "commit_id").select("pair", "side", "chain", "place", "rank"))
    spans = ends.groupBy("pair").agg(F.min("rank").alias("low"))
    window, done = WINDOW, None
    while not spans.isEmpty():
        starts = ends.join(spans.select("pair", F.greatest(F.col("low") - window, F.lit(0)).alias("floor")), "pair")
        of = lambda side: F.max(F.when(F.col("side") == side, F.col("place"))).alias(side)
        both = checkpointed(walk.spread(starts).groupBy("pair", "floor", "chain").agg(of("left"), of("right")))
        # The lowest place of a chain that one side alone has reached; the walk went on from it if it is not under the floor.
        alone = both.where("NOT left <=> right").select("pair", "floor", "chain", (F.when(F.col("left").isNull() | F.col("right").isNull(), -1).otherwise(F.least("left", "right")) + 1).alias("place"))
        undecided = checkpointed(alone.join(walk.members, ["chain", "place"]).where("floor > 0 AND rank < floor").select("pair").distinct())
        settled = both.join(undecided, "pair", "left_anti").select("pair", "chain", "left", "right")
        done = settled if done is None else done.unionByName(settled)
        spans = checkpointed(spans.join(undecided, "pair", "left_semi"))
        window *= WIDER
    if done is None:
        done = checkpointed(ends.select("pair", "chain", F.col("place").alias("left"), F.col("place").alias("right")).limit(0))
    lone = F.col("left").isNull() | F.col("right").isNull()
    ranges = done.where("NOT left <=> right").select(
        "pair", "chain", F.when(lone, 0).otherwise(F.least("left", "right") + 1).alias("low"), F.greatest("left", "right").alias("high"),
        F.when(F.coalesce("left", F.lit(-1)) > F.coalesce("right", F.lit(-1)), "left").otherwise("right").alias("side"),
    )
    only = in_ranges(ranges, walk.members.select("chain", F.col("place").alias("at"), "commit_id")).select("pair", "side", "commit_id")
    tops = checkpointed(done.where(~lone).select("pair", "chain", F.least("left", "right").alias("place")).join(walk.members, ["chain", "place"]).select("pair", F.lit("both").alias("side"), "chain", "place", "rank", "commit_id"))
    # Tops of chains that another top leads to are no bases.
    several = tops.groupBy("pair").agg(F.min("rank").alias("floor"), F.count("*").alias("n")).where("n > 1").drop("n")
    spread = walk.spread(tops.join(several, "pair").drop("commit_id"))
    reached = walk.arrivals(spread.withColumn("below", F.lit(-1).cast("long"))).select("pair", "chain", F.col("place").alias("reached"))
    bases = tops.join(reached, ["pair", "chain"], "left").where("reached IS NULL OR reached < place").select("pair", F.col("commit_id").alias("base"))
    return Sides(bases, only)


def contested(only: DataFrame, paths: DataFrame) -> DataFrame:
    """``pair, path, left_commits, right_commits`` of the paths that both sides of a pair changed; ``paths(commit_id, path)``."""
    # A pair has a commit once and a commit a path once, so that rows are counted, not told apart again.
    each = paths.groupBy("commit_id").agg(F.collect_set("path").alias("paths"))
    n = lambda side: F.count(F.when(F.col("side") == side, 1)).alias(f"{side}_commits")
    met = only.join(each, "commit_id").select("pair", "side", F.explode("paths").alias("path"))
    return met.groupBy("pair", "path").agg(n("left"), n("right")).where("left_commits > 0 AND right_commits > 0")


def shared_history(disputed: DataFrame, bases: DataFrame, paths: DataFrame, layout: Chains) -> DataFrame:
    """``pair, path, base, commit_id``: for each ``disputed(pair, path)`` the last change of the path at or before each base, along first parents."""
    probes = checkpointed(disputed.select("pair", "path").join(bases, "pair").select("pair", "path", "base"))
    found = states_at_once(probes.select(F.struct("pair", "path", "base").alias("probe"), F.col("base").alias("commit_id"), "path"), paths.select("commit_id", "path", F.struct("commit_id").alias("hit")), layout)
    return found.select("probe.*", "hit.commit_id")
