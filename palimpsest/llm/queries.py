"""Registered queries of the training-data operators: ``QUERIES`` and their ``ORACLES``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import alignment, backoff, classifier, decontaminate, licenses, lines, mixing, private, rules, runs, simhash, tokens, urls
from palimpsest.llm.common import read, words
from palimpsest.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES", "tokenizer_file"]

#: Rules of op12 by host and path, and words in hosts that no rule knows.
RULES = [urls.Rule("com", "/", "allow"), urls.Rule("example.com", "/en/", "block"), urls.Rule("www.example.com", "/en/", "allow"), urls.Rule("net", "/es/", "block"), urls.Rule("net", "/fr/", "block")]
GLOBS = [(f"*{word}**", "block") for word in ("casino", "pills", "-bets", "adult-", "spam-", "ads-")]


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where this machine and the executors keep a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(read(spark, sf_dir, "documents"), tokenizer_file(), end_id=1)


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.pseudonymize(read(spark, sf_dir, "documents").select("doc_id", "text"), key="palimpsest")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff.score(read(spark, sf_dir, "documents"), order=2, cutoff=2)
    return found.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.duplicates(read(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents"), weights=(5, 2, 1), epochs=1.5, most=2.0).drop("text_hash")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), licenses.known(spark))


def op9_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.3)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, digest = read(spark, sf_dir, "documents"), lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256))
    found = alignment.align(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"), describe=digest)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages").select("page_id", "url"), RULES, GLOBS).drop("url")


def looped(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)``; in one document of ten, by crc32 of doc_id, the words from some place on repeat themselves."""
    h = F.crc32(F.col("doc_id").cast("string"))
    hashed = docs.select("doc_id", "text", F.when(h % 10 == 0, words(F.col("text").cast("string"))).alias("w"), F.floor(h / 10).alias("g"))
    n, g = F.size("w").cast("long"), F.col("g")
    placed = hashed.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    rest = F.col("n") - F.col("a")
    looping = placed.withColumn("p", 1 + F.floor(rest / (3 + g % 8)))
    whole = lambda c: c.cast("int")
    loop = F.array_repeat(F.slice("w", whole(F.col("a") + 1), whole(F.col("p"))), whole(F.ceil(rest / F.col("p"))))
    made = F.array_join(F.concat(F.slice("w", 1, whole(F.col("a"))), F.slice(F.flatten(loop), 1, whole(rest))), " ")
    return looping.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse(looped(read(spark, sf_dir, "documents").select("doc_id", "text")), least=24, times=3)
    best = F.col("strongest")
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_token_shards, op3_pseudonyms, op4_simhash, op5_backoff, op6_fuzzy_lines, op7_source_mix, op8_licenses, op9_risk_rules, op10_quality,
        op11_alignment, op12_url_rules, op13_periodic_runs,
    )
}
