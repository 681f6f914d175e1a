"""Reports over the history of files: hotspots, timelines, regressions, propagation and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring
from palimpsest.plans.durable import checkpointed
from palimpsest.plans.scope import directory_prefix, under_any


def hotspots(changes: DataFrame, commits: DataFrame, merges: DataFrame, *, prefix: str | None = None, limit: int | None = 20, parts: int | None = None) -> DataFrame:
    """Files by number of non-merge commits that touch them, with the last one's time and the churn.

    ``parts``: partitions that changes are dealt to by commit, so that the memory of a task has a bound where it goes with the number of changes.
    """
    dealt = changes if parts is None else changes.repartition(parts, "commit_id")
    there = dealt.where(F.lit(True) if prefix is None else under_any(F.col("path"), (directory_prefix(prefix),))).join(merges, "commit_id", "left_anti").join(commits.select("commit_id", "commit_time"), "commit_id")
    # A row for each commit of a file, made where the joins by commit left them.
    one = there.groupBy("commit_id", "path").agg(F.max("commit_time").alias("commit_time"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    found = one.groupBy("path").agg(F.count("*").alias("touches"), F.max("commit_time").alias("last_changed"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    return found if limit is None else found.orderBy(F.desc("touches"), "path").limit(limit)


def incarnations(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Each change with the incarnation of its file: a number that goes up with each addition after a deletion.

    ``started`` is the position of the addition that began it. Files known from changes
    alone begin with their first one.
    """
    order = Window.partitionBy("path").orderBy("position", "ordinal", "status", "additions", "deletions")
    c = changes.join(commits.select("commit_id", "position"), "commit_id")
    begun = (F.col("status") == "A") & (F.coalesce(F.lag("status").over(order), F.lit("D")) == "D") | F.lag("status").over(order).isNull()
    numbered = c.withColumn("incarnation", F.sum(begun.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("started", F.min("position").over(Window.partitionBy("path", "incarnation")))


def timeline(changes: DataFrame, commits: DataFrame, path: str, *, offset: int = 0, limit: int = 10, last: bool = False) -> DataFrame:
    """A page of the commits that changed ``path``, oldest first, numbered from 1, with the total and whether more follow.

    A commit's first change stands for it. ``last`` takes the final page.
    """
    label = F.when(F.col("status") == "A", "added").when(F.col("status") == "D", "removed").when(F.col("status").startswith("R"), "renamed").when(F.col("status").startswith("C"), "copied").otherwise("modified")
    one = changes.where(F.col("path") == path).withColumn("k", F.row_number().over(Window.partitionBy("commit_id").orderBy("ordinal"))).where("k = 1")
    there = one.join(commits.select("commit_id", "position", "commit_time"), "commit_id").select("commit_id", "position", "commit_time", label.alias("change"))
    w = Window.partitionBy().orderBy("position")  # the commits of one file
    numbered = there.withColumn("number", F.row_number().over(w)).withColumn("total", F.count("*").over(Window.partitionBy()))
    low = F.greatest(F.col("total") - limit, F.lit(0)) if last else F.lit(offset)
    return numbered.where((F.col("number") > low) & (F.col("number") <= low + limit)).select("number", "commit_id", "commit_time", "change", "total", (low + limit < F.col("total")).alias("has_more"))


def path_state(changes: DataFrame, commits: DataFrame, at: DataFrame) -> DataFrame:
    """As-of join: for each ``at(path, when)`` the status of the latest change of the path at or before ``when``.

    Probes and changes are put in one order by time and the last status is carried
    forward, one shuffle by path. ``exists`` is null where nothing is known.
    """
    history = changes.join(commits.select("commit_id", "commit_time"), "commit_id").select("path", F.col("commit_time").alias("when"), F.struct("commit_id", "ordinal", "status").alias("last"), F.lit(0).alias("probe"))
    probes = at.select("path", "when", F.lit(None).cast(history.schema["last"].dataType).alias("last"), F.lit(1).alias("probe"))
    order = Window.partitionBy("path").orderBy("when", "probe", F.col("last.commit_id"), F.col("last.ordinal")).rowsBetween(Window.unboundedPreceding, 0)
    carried = history.unionByName(probes).withColumn("seen", F.last("last", ignorenulls=True).over(order)).where("probe = 1")
    return carried.select("path", "when", F.col("seen.status").alias("status"), (F.col("seen.status") != "D").alias("exists"))


def regression(suspects: DataFrame, limit: int = 10) -> DataFrame:
    """Suspects ranked by ``lexical, tests, position``: older ones of equal words first.

    ``temporal`` is (i + 1) / (n + 1) over the suspects counted newest first.
    """
    # Numbers by position: within a day in its own group, after what newer days hold together.
    held = checkpointed(suspects.withColumn("day", F.shiftright("position", 40)))
    days = held.groupBy("day").agg(F.count("*").alias("c"))
    newer = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each day of the history
    before = days.select("day", F.coalesce(F.sum("c").over(newer), F.lit(0)).alias("before"))
    total = days.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    own = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("position")))
    suspects = held.join(F.broadcast(before), "day").join(F.broadcast(total)).withColumn("i", F.col("before") + own)
    temporal = F.col("i") / (F.col("n") + 1)
    scored = suspects.withColumn("temporal", temporal).withColumn("score", scoring.regression_score(F.col("lexical"), F.lit(False), F.lit(False), F.col("tests"), F.col("temporal")))
    return scored.select("commit_id", F.round("temporal", 6).alias("temporal"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "commit_id").limit(limit)


def propagation(sources: DataFrame, contained: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """For each ``sources(commit_id, fingerprint)``: contained in the target, equivalent to a commit there, or not found; indeterminate without a fingerprint."""
    inside = contained.select("commit_id").distinct().withColumn("inside", F.lit(True))
    alike = fingerprints.join(contained, "commit_id", "left_semi").select("fingerprint").where("fingerprint IS NOT NULL").distinct().withColumn("alike", F.lit(True))
    met = sources.join(inside, "commit_id", "left").join(alike, "fingerprint", "left")
    status = F.when(F.col("inside"), "contained").when(F.col("fingerprint").isNull(), "indeterminate").when(F.col("alike"), "equivalent").otherwise("not_found")
    return met.select("commit_id", status.alias("status"))


def usage_trend(usage: DataFrame, group: str = "day") -> DataFrame:
    """Calls, mean time and users by bucket and command; weeks begin on Mondays."""
    return usage.groupBy(F.date_trunc(group, "ts").cast("date").alias("bucket"), "command").agg(
        F.count("*").alias("calls"), F.round(F.avg("elapsed"), 6).alias("mean_elapsed"), F.count_distinct("user_id").alias("users"),
    )


def earliest_links(links: DataFrame, by: str = "target", order: str = "position") -> DataFrame:
    """Of several links to one target the earliest in history order."""
    return links.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(order))).where("k = 1").drop("k")


def islands(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Runs of consecutive numbers as ``key, first, last, size``."""
    w = Window.partitionBy(key).orderBy(number)
    return rows.withColumn("g", F.col(number) - F.row_number().over(w)).groupBy(key, "g").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("size")).drop("g")


def within_budget(rows: DataFrame, key: str, order: list[str], size: Column, budget: int) -> DataFrame:
    """The rows of each key, in order, whose sizes add up to ``budget`` at most, and the running sum."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(size).over(w)).where(F.col("spent") <= budget)


def systematic_sample(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """Of each key ``most`` rows at most, evenly spread: the indices floor((2i + 1) n / 2k)."""
    w = Window.partitionBy(key)
    numbered = rows.withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    k = F.least(F.col("n"), F.lit(most))
    # i is an index floor((2j + 1) n / 2k) of some j in 0 .. k-1
    j = F.ceil((2 * k * F.col("i") - F.col("n")) / (2 * F.col("n")))
    hit = lambda x: (x >= 0) & (x < k) & (F.floor((2 * x + 1) * F.col("n") / (2 * k)) == F.col("i"))
    return numbered.where(hit(j) | hit(j + 1)).drop("i", "n")


def unique_prefixes(ids: DataFrame, column: str = "oid", least: int = 12) -> DataFrame:
    """Each id with its shortest prefix of ``least`` characters or more that no other id shares: a look at both neighbours in order.

    Ids are ordered within their leading ``least`` characters; others cannot share a prefix of that length.
    """
    w = Window.partitionBy(F.substring(column, 1, least)).orderBy(column)
    size = F.length(column)

    def shared(other: Column) -> Column:
        same = F.array_position(F.transform(F.sequence(F.lit(1), size), lambda i: (F.substr(F.col(column), F.lit(1), i) == F.substr(other, F.lit(1), i)).cast("int")), 0)
        return F.when(other.isNull(), 0).when(same == 0, size).otherwise(same - 1)

    most = F.greatest(shared(F.lag(column).over(w)), shared(F.lead(column).over(w)))
    return ids.withColumn("prefix", F.substr(F.col(column), F.lit(1), F.least(F.greatest(most + 1, F.lit(least)), size).cast("int")))
