"""Reverts by what messages declare, and failed approaches with the reasons that were recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import provenance
from palimpsest.operators.followon import later_descendants
from palimpsest.plans.durable import checkpointed

#: Digits that a prefix of an object id has at least; all ids that share so many meet.
LEAST = 7
#: What a recorded revert and a later correction add to a score.
REVERTED, CORRECTED = 6.0, 3.0


def unique_ids(prefixes: DataFrame, known: DataFrame) -> DataFrame:
    """``hex, commit_id``: the commits of ``known(commit_id, oid)`` that ``prefixes(hex)`` name, where just one begins so."""
    key = lambda c: F.substring(c, 1, LEAST)
    asked = prefixes.select("hex").distinct().where(F.length("hex") >= LEAST).withColumn("key", key("hex"))
    met = asked.join(known.select("commit_id", "oid", key("oid").alias("key")), "key").where(F.startswith("oid", F.col("hex")))
    return met.groupBy("hex").agg(F.count_distinct("oid").alias("n"), F.min("commit_id").alias("commit_id")).where("n = 1").drop("n")


def links(notes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``target, revert, position``: each commit that ``notes(commit_id, oid, position, subject, body)`` say was reverted, with the earliest revert of it.

    A message whose declarations name different commits links none. Prefixes have to be unique among
    ``known(commit_id, oid)``, the notes' commits if it is not given; targets are among the notes' commits.
    """
    return _earliest(_single(notes, known), notes)


def _earliest(single: DataFrame, notes: DataFrame) -> DataFrame:
    first = single.groupBy("target").agg(F.min_by(F.struct("revert", "position"), F.struct("position", "revert")).alias("r"))
    return first.join(notes.select(F.col("commit_id").alias("target")), "target", "left_semi").select("target", "r.revert", "r.position")


def _single(notes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``revert, position, target`` of every revert that names one commit."""
    message = F.concat_ws("\n", "subject", "body")
    declared = notes.select(F.col("commit_id").alias("revert"), "position", F.explode(provenance.revert_targets(message)).alias("hex"))
    named = declared.join(unique_ids(declared, notes if known is None else known).withColumnRenamed("commit_id", "target"), "hex")
    return named.groupBy("revert", "position").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")


def resolved(notes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``revert, target`` of every revert that names one commit, the earliest or not."""
    return _single(notes, known).select("revert", "target")


def corrective_followups(recordings: DataFrame, notes: DataFrame, paths: DataFrame, parents: DataFrame, commits: DataFrame, *, steps: int = 20, seconds: int = 10 * 365 * 86_400) -> DataFrame:
    """``commit_id, follow_up``: for each ``recordings(commit_id, recording)`` the first commit after the recording one, within ``steps`` edges, whose subject corrects and that changes a path of ``commit_id``."""
    corrective = notes.where(provenance.is_corrective_subject(F.col("subject"))).select("commit_id", "position")
    after = later_descendants(recordings.select(F.col("recording").alias("origin_id")), parents, commits, corrective.select("commit_id"), seconds=seconds, steps=steps)
    later = recordings.join(after.select(F.col("origin_id").alias("recording"), F.col("commit_id").alias("follow_up")), "recording")
    own = paths.select("commit_id", "path")
    shared = later.join(own, "commit_id").join(own.select(F.col("commit_id").alias("follow_up"), "path"), ["follow_up", "path"]).select("commit_id", "follow_up").distinct()
    placed = shared.join(corrective.select(F.col("commit_id").alias("follow_up"), "position"), "follow_up")
    return placed.groupBy("commit_id").agg(F.min_by("follow_up", F.struct("position", "follow_up")).alias("follow_up"))


def failures(candidates: DataFrame, notes: DataFrame, paths: DataFrame, parents: DataFrame, commits: DataFrame) -> DataFrame:
    """``commit_id, score, revert, follow_up, reason, retry, confidence`` of the ``candidates(commit_id, score)`` that are failed approaches.

    Those are commits that a revert names, and reverts that name a commit; a revert told by the candidate that it
    undid is left out. Reason and retry come from the message of the revert alone (for the
    retry, that of a later correction goes first), never from what was abandoned.
    """
    notes, paths = checkpointed(notes), checkpointed(paths.select("commit_id", "path"))
    single = checkpointed(_single(notes))
    named = _earliest(single, notes).select(F.col("target").alias("commit_id"), "revert")
    told = checkpointed(candidates.join(named, "commit_id", "left").join(single.select(F.col("revert").alias("commit_id"), F.col("target").alias("undoes")), "commit_id", "left").where("revert IS NOT NULL OR undoes IS NOT NULL"))
    known = told.select(F.col("revert").alias("commit_id")).where("commit_id IS NOT NULL").distinct()
    # A candidate that reverts another candidate, whose own earliest revert it is, is told by that one.
    kept = checkpointed(told.join(known, "commit_id", "left_anti").withColumn("recording", F.coalesce("revert", "commit_id")))
    follow = corrective_followups(kept.select("commit_id", "recording"), notes, paths, parents, commits)
    text = notes.select("commit_id", F.concat_ws("\n", "subject", "body").alias("message"), "body")
    recorded = text.select(F.col("commit_id").alias("recording"), provenance.stated_reason(F.col("message")).alias("reason"), provenance.stated_retry(F.col("body")).alias("own_retry"))
    later = text.select(F.col("commit_id").alias("follow_up"), provenance.stated_retry(F.col("message")).alias("later_retry"))
    met = kept.join(recorded, "recording").join(follow, "commit_id", "left").join(later, "follow_up", "left")
    score = F.col("score") + F.when(F.col("revert").isNotNull(), REVERTED).otherwise(0.0) + F.when(F.col("follow_up").isNotNull(), CORRECTED).otherwise(0.0)
    confidence = F.when(F.col("reason").isNull(), "low").when(F.col("follow_up").isNotNull(), "high").otherwise("medium")
    return met.select("commit_id", score.alias("score"), "revert", "follow_up", "reason", F.coalesce("later_retry", "own_retry").alias("retry"), confidence.alias("confidence"))
