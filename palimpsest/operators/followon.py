"""Follow-on mining: what tends to come after a change, within steps and time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.durable import checkpointed
from palimpsest.plans.ranks import numbered


def chains(events: DataFrame, origin: str, follower: str, *, steps: int = 20, seconds: int = 86_400) -> DataFrame:
    """``origin_id, follower_id, distance, elapsed`` within a user's sequence of events.

    Steps bound the join: an origin is exploded over the ``steps`` places after it and
    joined by (user, place), so that no pair beyond the window is made.
    """
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    placed = events.select("user_id", "event_id", "ts", "command", F.row_number().over(w).alias("place"))
    starts = placed.where(F.col("command") == origin).select("user_id", F.col("event_id").alias("origin_id"), F.col("ts").alias("t0"), "place", F.explode(F.sequence(F.col("place") + 1, F.col("place") + steps)).alias("at"))
    later = placed.where(F.col("command") == follower).select("user_id", F.col("event_id").alias("follower_id"), "ts", F.col("place").alias("at"))
    met = starts.join(later, ["user_id", "at"]).withColumn("elapsed", F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("t0").cast("timestamp")))
    return met.where(F.col("elapsed") <= seconds).select("user_id", "origin_id", "follower_id", (F.col("at") - F.col("place")).alias("distance"), "elapsed")


def complete_origins(events: DataFrame, origin: str, seconds: int) -> DataFrame:
    """Origins whose whole window lies before the last event seen."""
    end = events.agg(F.max("ts").alias("end"))
    stamp = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    return events.where(F.col("command") == origin).join(F.broadcast(end)).where(stamp("ts") + seconds <= stamp("end")).select("user_id", F.col("event_id").alias("origin_id"))


def independent_chains(pairs: DataFrame, group: str = "user_id") -> DataFrame:
    """Largest number of origin-follower pairs that share neither, for each group: a maximum bipartite matching.

    Augmenting paths in sorted order run within one group, whose pairs ``chains`` bounds by steps.
    """

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        edges: dict[int, list[int]] = {}
        for a, b in sorted(zip(pdf["origin_id"], pdf["follower_id"], strict=True)):
            edges.setdefault(a, []).append(b)
        taken: dict[int, int] = {}

        def place(start: int) -> bool:
            seen: set[int] = set()
            path: list[tuple[int, Iterator[int]]] = [(start, iter(edges[start]))]
            trail: list[int] = []
            while path:
                node, rest = path[-1]
                b = next((x for x in rest if x not in seen), None)
                if b is None:
                    path.pop()
                    if trail:
                        trail.pop()
                    continue
                seen.add(b)
                trail.append(b)
                if b not in taken:
                    for (a, _), at in zip(path, trail, strict=True):
                        taken[at] = a
                    return True
                path.append((taken[b], iter(edges[taken[b]])))
            return False

        n = sum(place(a) for a in sorted(edges))
        return pd.DataFrame({group: [pdf[group].iloc[0]], "chains": [n]})

    return pairs.groupBy(group).applyInPandas(match, f"{group} long, chains long")


def baseline(events: DataFrame, origin: str, follower: str, *, steps: int = 20, seconds: int = 86_400) -> DataFrame:
    """Supporting and complete origins, the same for all other events, and whether the rate is twice the baseline or more."""
    def rate(kind: str, is_origin: bool) -> DataFrame:
        shaped = events.withColumn("command", F.when((F.col("command") == follower), F.lit(follower)).when((F.col("command") == origin) == F.lit(is_origin), F.lit("origin")).otherwise("other"))
        full = complete_origins(shaped, "origin", seconds)
        hit = chains(shaped, "origin", follower, steps=steps, seconds=seconds).select("origin_id").distinct()
        return full.join(hit.withColumn("hit", F.lit(1)), "origin_id", "left").agg(F.count("*").alias(f"{kind}_origins"), F.coalesce(F.sum("hit"), F.lit(0)).alias(f"{kind}_hits"))

    both = rate("own", True).join(rate("other", False))
    return both.withColumn("twice", F.col("own_hits") * F.col("other_origins") >= 2 * F.col("other_hits") * F.col("own_origins"))


def later_descendants(origins: DataFrame, parents: DataFrame, commits: DataFrame, eligible: DataFrame, *, seconds: int, steps: int = 20, slack: int = 0) -> DataFrame:
    """``origin_id, commit_id, distance, elapsed``: the ``eligible(commit_id)`` commits that come after each of ``origins(origin_id)``, within ``steps`` edges and ``seconds``.

    One frontier of (origin, commit) for all origins, each at its least distance. A way ends
    where its commit is more than ``slack`` seconds beyond the window, so that only a commit older than
    its parent by more than that could be missed.
    """
    timed = commits.select("commit_id", "commit_time")
    starts = origins.select("origin_id").distinct().join(timed.select(F.col("commit_id").alias("origin_id"), F.col("commit_time").alias("start")), "origin_id")
    # Read at every step, so made once, with the children's times.
    children = parents.select(F.col("parent_id").alias("commit_id"), F.col("commit_id").alias("child")).distinct()
    children = checkpointed(children.join(timed.select(F.col("commit_id").alias("child"), "commit_time"), "child"))
    seen = frontier = checkpointed(starts.select("origin_id", "start", F.col("origin_id").alias("commit_id"), F.lit(0).alias("distance"), F.lit(0).cast("long").alias("elapsed")))
    for k in range(1, steps + 1):
        next_ones = frontier.join(children, "commit_id").select("origin_id", "start", F.col("child").alias("commit_id"), (F.col("commit_time") - F.col("start")).alias("elapsed"))
        new = next_ones.where(F.col("elapsed") <= seconds + slack).distinct().join(seen.select("origin_id", "commit_id"), ["origin_id", "commit_id"], "left_anti")
        frontier = checkpointed(new.select("origin_id", "start", "commit_id", F.lit(k).alias("distance"), "elapsed"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier) if k % 5 else checkpointed(seen.unionByName(frontier))
    inside = seen.where((F.col("distance") > 0) & F.col("elapsed").between(0, seconds))
    return inside.join(eligible, "commit_id", "left_semi").select("origin_id", "commit_id", "distance", "elapsed")


def observations(origins: DataFrame, parents: DataFrame, commits: DataFrame, eligible: DataFrame, touched: DataFrame, ranks: DataFrame, *, days: int = 30, steps: int = 20, sample: int = 100, one_in: int = 2, excluded: DataFrame | None = None) -> DataFrame:
    """Paths that tend to change after the given origins: ``path, supporting, complete, baseline_hits, baseline_size, latest``.

    Of ``origins(origin_id)`` those count that are ``eligible(commit_id)`` and whose window of ``days``
    ends by the last commit; for a path only those that don't change it themselves. A path is kept if
    one in ``one_in`` of them or more is followed by a change of it, in two chains or more that share
    neither origin nor follower, at twice the rate or more of a baseline: ``sample`` evenly spread ones of all
    complete eligible commits that don't change the path, in order of ``ranks(commit_id, rank)``.
    ``touched(commit_id, path)``; ``excluded(path)``: paths that are never candidates.
    """
    seconds = days * 86_400
    last = commits.agg(F.max("commit_time").alias("last"))
    full = checkpointed(eligible.join(commits, "commit_id").join(F.broadcast(last), F.col("commit_time") + seconds <= F.col("last")).select("commit_id", "commit_time"))
    own = checkpointed(origins.select(F.col("origin_id").alias("commit_id")).distinct().join(full, "commit_id").select(F.col("commit_id").alias("origin_id")))
    later = checkpointed(later_descendants(own, parents, commits, eligible, seconds=seconds, steps=steps))
    changes = touched.join(eligible, "commit_id", "left_semi").distinct()
    if excluded is not None:
        changes = changes.join(excluded, "path", "left_anti")
    changes = checkpointed(changes)  # read five times
    edges = later.join(changes, "commit_id").join(changes.select(F.col("commit_id").alias("origin_id"), "path"), ["origin_id", "path"], "left_anti")
    # Two origins and two followers or more are two chains: else all pairs would share one commit.
    found = edges.groupBy("path").agg(F.count_distinct("origin_id").alias("supporting"), F.count_distinct("commit_id").alias("followers"), F.max_by("commit_id", F.struct("elapsed", "commit_id")).alias("latest"))
    selves = changes.join(own.select(F.col("origin_id").alias("commit_id")), "commit_id", "left_semi").groupBy("path").agg(F.count("*").alias("selves"))
    counted = found.join(selves, "path", "left").join(F.broadcast(own.agg(F.count("*").alias("n")))).withColumn("complete", F.col("n") - F.coalesce("selves", F.lit(0)))
    likely = checkpointed(counted.where(f"supporting >= 2 AND followers >= 2 AND {one_in} * supporting >= complete").select("path", "supporting", "complete", "latest"))
    picked = checkpointed(_baseline_sample(likely.select("path"), full, changes, ranks, sample))
    windows = later_descendants(picked.select("origin_id"), parents, commits, eligible, seconds=seconds, steps=steps)
    hits = picked.join(windows.select("origin_id", "commit_id"), "origin_id").join(changes, ["commit_id", "path"], "left_semi").select("path", "origin_id").distinct().withColumn("hit", F.lit(1))
    base = picked.join(hits, ["path", "origin_id"], "left").groupBy("path").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("baseline_hits"), F.count("*").alias("baseline_size"))
    return likely.join(base, "path").where("supporting * baseline_size >= 2 * baseline_hits * complete").select("path", "supporting", "complete", "baseline_hits", "baseline_size", "latest")


def _baseline_sample(paths: DataFrame, full: DataFrame, changes: DataFrame, ranks: DataFrame, sample: int) -> DataFrame:
    """``path, origin_id``: for each path ``sample`` evenly spread ones of the complete commits that don't change it, at floor((2i + 1) n / 2k) of n in order.

    With b(j) the number of other commits before the j-th change of the path (from 0), the one at index x
    is the commit at x + (changes with b <= x); changes are counted by the index that they come before.
    """
    pool = checkpointed(numbered(full.join(ranks, "commit_id").select("commit_id", F.col("rank").alias("r")), [], "r", 16).select("commit_id", "rank"))
    mine = changes.join(paths, "path", "left_semi").join(pool, "commit_id").select("path", F.col("rank").alias("a"))
    before = numbered(mine, ["path"], "a", 16, "k").select("path", (F.col("a") - F.col("k")).alias("b"))
    sizes = paths.join(before.groupBy("path").agg(F.count("*").alias("own")), "path", "left").join(F.broadcast(pool.agg(F.count("*").alias("all"))))
    sizes = checkpointed(sizes.select("path", (F.col("all") - F.coalesce("own", F.lit(0))).alias("n")).where("n > 0").withColumn("k", F.least("n", F.lit(sample))))
    index = lambda i: F.expr(f"((2 * {i} + 1) * n) div (2 * k)")
    wanted = sizes.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).select("path", "i", index("i").alias("x"))
    # The first index that is b or more: (2i + 1) n >= 2 k b.
    first = F.greatest(F.expr("(2 * k * b - n + 2 * n - 1) div (2 * n)"), F.lit(0))
    placed = before.join(sizes, "path").withColumn("i", first).where("i < k").groupBy("path", "i").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as are sampled
    shifted = wanted.join(placed, ["path", "i"], "left").withColumn("rank", F.col("x") + F.coalesce(F.sum("c").over(upto), F.lit(0)))
    return shifted.join(pool, "rank").select("path", F.col("commit_id").alias("origin_id"))
