"""Files that change together: co-change, modules, tests and closed patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring
from palimpsest.functions.text import is_test_path, normalize_path
from palimpsest.plans.durable import checkpointed
from palimpsest.plans.scope import under_any

#: Commits that touch more files than this say nothing about relations; paths that may be broadcast.
MASS, FEW = 50, 100_000


def eligible_commits(paths: DataFrame, merges: DataFrame, mass: int = MASS, least: int = 2) -> DataFrame:
    """Non-merge commits that touch ``least`` to ``mass`` files."""
    sized = paths.groupBy("commit_id").agg(F.count("*").alias("files"))
    return sized.where(F.col("files").between(least, mass)).join(merges, "commit_id", "left_anti").select("commit_id")


def seed_matches(paths: DataFrame, seeds: DataFrame) -> DataFrame:
    """``path, seed`` of the paths that each ``seeds(seed)`` names.

    A seed with a slash matches its exact bytes, or its normalised form where no exact
    path exists; one without a slash matches the last part of a path. Three equi-joins
    stand for the disjunction.
    """
    from palimpsest.functions.text import basename

    known = paths.select("path").distinct()
    keyed = checkpointed(known.select("path", normalize_path(F.col("path")).alias("key"), basename(normalize_path(F.col("path"))).alias("name")))  # read by three joins
    exact = keyed.join(seeds, F.col("path") == F.col("seed")).select("path", "seed")
    loose = seeds.join(exact.select("seed").distinct(), "seed", "left_anti").withColumn("wanted", normalize_path(F.col("seed")))
    whole = keyed.join(loose.where(F.contains("seed", F.lit("/"))), F.col("key") == F.col("wanted")).select("path", "seed")
    named = keyed.join(loose.where(~F.contains("seed", F.lit("/"))), F.col("name") == F.col("wanted")).select("path", "seed")
    return exact.unionByName(whole).unionByName(named)


def _stem(path: Column) -> Column:
    """The last part of a path up to its last dot."""
    return F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"\.[^.]*$", "")


def tested_name(path: Column) -> Column:
    """What a test's file name says it tests: its stem less one mark of a test before it, else after it."""
    stem = _stem(normalize_path(path))
    before = F.regexp_replace(stem, "^test[_-]", "")
    return F.when(before != stem, before).otherwise(F.regexp_replace(stem, "_test$", ""))


def related_files(paths: DataFrame, merges: DataFrame, seeds: DataFrame, *, mass: int = MASS, limit: int | None = 10, tests_only: bool = False) -> DataFrame:
    """Files changed in the same commits as ``seeds(seed)``, ranked.

    The seeds' commits are found first, and only their files are joined; the number of
    all touches of a candidate comes from an aggregate over the eligible commits.
    """
    # Each is read several times below.
    eligible = checkpointed(eligible_commits(paths, merges, mass))
    there = checkpointed(paths.join(eligible, "commit_id", "left_semi"))
    seeds = checkpointed(seeds)
    matched = checkpointed(seed_matches(paths, seeds))
    # One base name may match very many paths, so these are counted, not the seeds.
    few = matched.limit(FEW + 1).count() <= FEW
    touched = there.join(F.broadcast(matched) if few else matched, "path").groupBy("commit_id").agg(F.count_distinct("seed").alias("seeds_here"), F.collect_set("seed").alias("seeds"))
    others = there.join(touched, "commit_id").join(matched.select("path").distinct(), "path", "left_anti")
    support = others.groupBy("path").agg(F.count("*").alias("support"), F.size(F.array_distinct(F.flatten(F.collect_set("seeds")))).alias("seed_coverage"), F.max("commit_id").alias("latest"))
    total = there.groupBy("path").agg(F.count("*").alias("touches"))
    counts = touched.agg(F.count("*").alias("seed_commits")).join(eligible.agg(F.count("*").alias("commits"))).join(seeds.agg(F.count_distinct("seed").alias("n_seeds")))
    scored = (
        support.join(total, "path")
        .join(F.broadcast(counts))
        .withColumn("proportion", F.col("support") / F.col("seed_commits"))
        .withColumn("ubiquity", F.col("touches") / F.col("commits"))
        .withColumn("score", scoring.relation_score(F.col("support"), F.col("proportion"), F.col("seed_coverage"), F.col("n_seeds"), F.col("ubiquity")))
        .withColumn("confidence", scoring.relation_confidence(F.col("support"), F.col("proportion")))
    )
    if tests_only:
        # A test that is only named like a seed is no news; support for another one is.
        names = seeds.select(_stem(F.lower("seed")).alias("stem"), F.lit(True).alias("mirror")).distinct()
        tests = scored.where(is_test_path(F.col("path"))).withColumn("stem", tested_name(F.col("path"))).join(names, "stem", "left")
        scored = tests.withColumn("score", F.col("score") * F.when(F.col("mirror"), 1.0).otherwise(1.25))
    ranked = scored.select("path", "support", F.round("proportion", 6).alias("proportion"), F.round("ubiquity", 6).alias("ubiquity"), "seed_coverage", F.round("score", 6).alias("score"), "confidence")
    return ranked if limit is None else ranked.orderBy(F.desc("score"), "path").limit(limit)


def related_directories(paths: DataFrame, merges: DataFrame, roots: tuple[str, ...], *, mass: int = MASS, limit: int = 10) -> DataFrame:
    """Files outside ``roots`` that change with files below them: support, and how many inner files took part."""
    there = paths.join(eligible_commits(paths, merges, mass), "commit_id", "left_semi").withColumn("inside", under_any(F.col("path"), roots))
    inner = there.where("inside").groupBy("commit_id").agg(F.count("*").alias("inner_files"))
    met = there.where("NOT inside").join(inner, "commit_id")
    return met.groupBy("path").agg(F.count("*").alias("support"), F.sum("inner_files").alias("inner_touches")).orderBy(F.desc("support"), F.desc("inner_touches"), "path").limit(limit)


def closed_patterns(paths: DataFrame, merges: DataFrame, seeds: DataFrame, *, least: int = 3, mass: int = MASS, limit: int | None = None) -> DataFrame:
    """``members, size, support``: closed sets of three files or more, all seeds and another file among them, in ``least`` commits or more.

    Only commits with every seed count. A set is closed if no other file is in all of its
    commits. All sets of a level grow together: each by every later file, to the closure of both, which
    stays if it has no earlier file that the set had not (prefix-preserving extension). So every
    closed set is made once, from one other, and a level is a few joins by set and commit. A set has
    no more commits than the one it was made from: once ``limit`` sets are found, those with fewer
    commits than all of them are neither among the first ``limit`` nor are any made from them.
    """
    seeds = checkpointed(seeds.where("seed IS NOT NULL").select("seed").distinct())
    n = seeds.count()
    full = paths.join(seeds, F.col("path") == F.col("seed")).groupBy("commit_id").agg(F.count_distinct("seed").alias("k")).where(F.col("k") == n).select("commit_id")
    touched = checkpointed(paths.join(full, "commit_id", "left_semi").select("commit_id", "path"))
    observed = checkpointed(touched.join(eligible_commits(touched, merges, mass), "commit_id", "left_semi").select("commit_id", F.col("path").alias("file")).distinct())
    wanted = lambda sets: sets.where((F.size("members") >= 3) & (F.size("members") > n))
    # Sets of a level are numbered as they are written; a set's core is the file by which it was made.
    commits = observed.agg(F.count_distinct("commit_id").alias("all")).where(F.col("all") >= least)
    common = observed.groupBy("file").agg(F.count("*").alias("n")).join(F.broadcast(commits)).where("n = all")
    root = commits.join(common.agg(F.array_sort(F.collect_list("file")).alias("members"))).select(F.lit(0).cast("long").alias("set"), "members", F.lit("").alias("core"), F.col("all").alias("support"))
    fresh = checkpointed(root)
    held = checkpointed(observed.select("commit_id").distinct().join(F.broadcast(fresh.select("set"))))
    found = fresh
    while not fresh.isEmpty():
        tried = held.join(observed, "commit_id").join(fresh.select("set", "members", "core"), "set").where("file > core AND NOT array_contains(members, file)").select("set", "commit_id", F.col("file").alias("by"))
        often = tried.groupBy("set", "by").agg(F.count("*").alias("support")).where(F.col("support") >= least)
        grown = checkpointed(tried.join(often, ["set", "by"]))
        shared = grown.join(observed, "commit_id").groupBy("set", "by", "file").agg(F.count("*").alias("n"), F.max("support").alias("support")).where("n = support")
        closures = shared.groupBy("set", "by").agg(F.array_sort(F.collect_list("file")).alias("members"), F.max("support").alias("support"))
        before = lambda members: F.filter(members, lambda x: x < F.col("by"))
        kept = closures.join(fresh.select("set", F.col("members").alias("old")), "set").where(before("members") == before("old"))
        made = checkpointed(kept.select("set", "by", F.monotonically_increasing_id().alias("next"), "members", "support"))
        found = found.unionByName(made.select(F.col("next").alias("set"), "members", F.col("by").alias("core"), "support"))
        if limit:
            best = wanted(found).orderBy(F.desc("support")).limit(limit).agg(F.count("*"), F.min("support")).first()
            least = max(least, best[1]) if best[0] == limit else least
        made = made.where(F.col("support") >= least)
        held = checkpointed(grown.select("set", "by", "commit_id").join(made.select("set", "by", "next"), ["set", "by"]).select(F.col("next").alias("set"), "commit_id"))
        fresh = made.select(F.col("next").alias("set"), "members", F.col("by").alias("core"), "support")
    ordered = wanted(found).select(F.array_join("members", ",").alias("members"), F.size("members").cast("long").alias("size"), "support").orderBy(F.desc("support"), "members")
    return ordered if limit is None else ordered.limit(limit)


def total_touches(paths: DataFrame, merges: DataFrame) -> DataFrame:
    """Each path's touches by non-merge commits, and its first row by commit."""
    w = Window.partitionBy("path")
    there = paths.join(merges, "commit_id", "left_anti")
    return there.withColumn("touches", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("commit_id"))).where("k = 1").select("path", "touches", F.col("commit_id").alias("first_commit"))
