"""Lineage queries: the turns of a conversation stand for versions of a file, its words for lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.catalog import Catalog, bind
from palimpsest.operators import context, lineage, moves
from palimpsest.plans.durable import checkpointed

QUERIES, ORACLES = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(bind(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def versions(c: Catalog) -> DataFrame:
    return lineage.versions(c.turns.where("text IS NOT NULL"), "conv_id", "turn", "text", "[ \n]+")


@query()
def lineage_backward(c: Catalog) -> DataFrame:
    return lineage.backward(versions(c), 3)


@query()
def lineage_forward(c: Catalog) -> DataFrame:
    return lineage.fate(versions(c), 3)


@query()
def lineage_blame(c: Catalog) -> DataFrame:
    return lineage.blame(versions(c))


@query()
def regions_followups(c: Catalog) -> DataFrame:
    return lineage.followups(versions(c))


#: Conversations whose numbers leave the same rest are files of one repository, turns of one number its commits.
REPOSITORIES = 10


@query()
def moved_lines(c: Catalog) -> DataFrame:
    """Removed words that stand, with those around them, among the added ones of the same commit."""
    return moves.moved_lines(versions(c), F.struct(F.col("file").cast("long") % REPOSITORIES, "position"))


@query()
def trace_fix(c: Catalog) -> DataFrame:
    return lineage.introducing(versions(c))


#: Words of 8 to 96 letters, digits and underscores, found where they are: a split at what lies between them takes far longer.
TELLING = "(?<![A-Za-z0-9_])[A-Za-z0-9_]{8,96}(?![A-Za-z0-9_])"


@query(
    """WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda x: length(x) BETWEEN 8 AND 96))) AS s FROM documents),
l AS (SELECT s FROM w WHERE doc_id = (SELECT min(doc_id) FROM w)), m AS (SELECT w.doc_id, count(*) AS shared FROM w JOIN l USING (s) WHERE doc_id <> (SELECT min(doc_id) FROM w) GROUP BY w.doc_id)
SELECT doc_id, shared FROM m WHERE shared >= 2"""
)
def context_content(c: Catalog) -> DataFrame:
    """Documents that share two telling identifiers or more with the first one."""
    texts, signals = c.documents.select("doc_id", "text"), F.regexp_extract_all("text", F.lit(TELLING), F.lit(0)).alias("signals")
    first = F.broadcast(checkpointed(texts.where(F.col("text").rlike(TELLING)).agg(F.min("doc_id").alias("doc_id"))))  # one row, read twice
    # Signals are made behind the joins, which nothing is moved over.
    there = lambda how: texts.join(first, "doc_id", how).select("doc_id", signals)
    return context.shared_signals(there("left_semi"), there("left_anti"))


@query()
def context_suggestions(c: Catalog) -> DataFrame:
    ranked = c.usage.where("command <> 'view'").groupBy("command", "user_id").agg(F.count("*").alias("strength"), F.max("event_id").alias("citation"))
    return context.suggestions(ranked.select(F.col("command").alias("category"), F.col("user_id").cast("string").alias("path"), "strength", "citation"), limit=8, per_category=3)
