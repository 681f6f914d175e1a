"""Suggestions around current work: shared identifiers, limited and merged categories, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.durable import checkpointed

#: Signals that may be broadcast.
FEW = 100_000


def shared_signals(local: DataFrame, historical: DataFrame, least: int = 2) -> DataFrame:
    """``doc_id, shared``: historical rows that share ``least`` signals or more with the local ones, through an inverted index."""
    wanted = checkpointed(local.select(F.explode_outer("signals").alias("s")).where("s IS NOT NULL").distinct())
    few = wanted.limit(FEW + 1).count() <= FEW  # else both sides would be shuffled, for the few signals that are shared
    # Outer, as the filter on the array's size that comes with the other makes the array twice.
    there = historical.select("doc_id", F.explode_outer(F.array_distinct("signals")).alias("s"))
    return there.join(F.broadcast(wanted) if few else wanted, "s").groupBy("doc_id").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def suggestions(ranked: DataFrame, *, limit: int = 8, per_category: int = 3) -> DataFrame:
    """The strongest of each category, at most ``per_category``, within ``limit`` over all.

    ``ranked(category, path, strength, citation)``; order: strength, category, path, citation.
    """
    order = [F.desc("strength"), "category", "path", "citation"]
    top = ranked.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy(*order))).where(F.col("k") <= per_category).drop("k")
    return top.orderBy(*order).limit(limit)


def side_leads(sides: DataFrame, base: DataFrame, touched: DataFrame, files: DataFrame, per_side: int = 5) -> DataFrame:
    """Commits of each side of a merge since their base that touch the conflicted files.

    ``sides(side, commit_id, position)`` holds each side's reachable commits, ``base``
    those of the merge base; the newest ``per_side`` of each side stay.
    """
    own = sides.join(base.select("commit_id"), "commit_id", "left_anti")
    hits = own.join(touched.join(F.broadcast(files), "path").groupBy("commit_id").agg(F.sort_array(F.collect_set("path")).alias("paths")), "commit_id")
    return hits.withColumn("k", F.row_number().over(Window.partitionBy("side").orderBy(F.desc("position")))).where(F.col("k") <= per_side).drop("k")


def match_regions(regions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Which candidate region corresponds to each region: ``unique``, ``ambiguous`` or ``none``.

    Both hold ``id, file, before, after, content``. Context that is equal, not empty and
    occurs once on both sides matches; equal context that occurs more often makes it
    ambiguous; without equal context, equal content that occurs once matches.
    """
    def by(column: str) -> DataFrame:
        one = lambda d, n: d.where(F.length(column) > 0).groupBy("file", F.col(column).alias("k")).agg(F.count("*").alias(n), F.first("id").alias(f"{n}_id"))
        met = one(regions, "a").join(one(candidates, "b"), ["file", "k"])
        unique = (F.col("a") == 1) & (F.col("b") == 1)
        return regions.select("id", "file", F.col(column).alias("k")).join(met, ["file", "k"]).select("id", F.when(unique, F.col("b_id")).alias("match"), (~unique).alias("vague"))

    context = by("before").unionByName(by("after")).groupBy("id").agg(F.collect_set("match").alias("m"), F.bool_or("vague").alias("vague"))
    content = by("content").groupBy("id").agg(F.collect_set("match").alias("c"), F.bool_or("vague").alias("vague_content"))
    met = regions.select("id").join(context, "id", "left").join(content, "id", "left")
    known = F.size(F.coalesce("m", F.array().cast("array<long>")))
    plain = F.size(F.coalesce("c", F.array().cast("array<long>")))
    vague = F.coalesce("vague", F.lit(False)) | ((known == 0) & F.coalesce("vague_content", F.lit(False))) | (known > 1)
    status = F.when(vague, "ambiguous").when((known == 1) | (plain == 1), "unique").otherwise("none")
    return met.select("id", status.alias("status"), F.when(status == "unique", F.coalesce(F.get("m", F.lit(0)), F.get("c", F.lit(0)))).alias("match"))
