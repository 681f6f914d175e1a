"""The logical tables that every operator works on, and their binding to ordinary Parquet tables.

``Catalog`` holds lazy DataFrames. ``bind`` derives them from the order, part and
document tables: an order is a change set, its customer a branch, a part a file.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.plans.durable import checkpointed

#: Positions put days first and ids after them, a total order without a global sort.
DAY = 1 << 40


@dataclass(frozen=True)
class Catalog:
    """Tables by name; a property is read only by the operators that use it.

    commits(commit_id, oid, position, commit_time, branch); parents(commit_id, position,
    parent_id); changes(commit_id, ordinal, status, path, additions, deletions);
    paths(commit_id, path); documents(doc_id, subject, body, path, text,
    commit_time, oid), whose paths are those of the commit of the same number;
    lines(doc_id, line_no, content); vectors(vec_id, embedding); usage(day, command,
    user_id, ts, elapsed); turns(conv_id, turn, role, text).
    """

    spark: SparkSession
    root: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def commits(self) -> DataFrame:
        seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
        return self.table("orders").select(
            F.col("o_orderkey").alias("commit_id"),
            _oid("o_orderkey").alias("oid"),
            (F.floor(seconds / 86400) * DAY + F.col("o_orderkey")).alias("position"),
            seconds.alias("commit_time"),
            F.col("o_custkey").alias("branch"),
            F.col("o_orderpriority").alias("priority"),
        )

    @cached_property
    def parents(self) -> DataFrame:
        """First parents: the branch's previous commit; every fifth commit also merges the previous one of its priority."""
        c = self.commits
        branch = Window.partitionBy("branch").orderBy("position")
        level = Window.partitionBy("branch", "priority").orderBy("position")
        two = c.select("commit_id", F.lag("commit_id").over(branch).alias("p0"), F.lag("commit_id").over(level).alias("p1"))
        second = (F.col("commit_id") % 5 == 0) & F.col("p1").isNotNull() & (F.col("p1") != F.col("p0"))
        edges = two.select("commit_id", F.posexplode(F.array("p0", F.when(second, F.col("p1")))).alias("position", "parent_id"))
        return edges.where("parent_id IS NOT NULL")

    @cached_property
    def forked(self) -> DataFrame:
        """``commit_id, p0, p1, rank``: both parents of each commit of a history that forks and merges, and its number in its branch. A commit follows the last of its branch and priority, else forks from the last of its branch; every third also merges the last of its branch."""
        c = self.commits
        branch = Window.partitionBy("branch").orderBy("position")
        lane = Window.partitionBy("branch", "priority").orderBy("position")
        number = (F.row_number().over(branch) - 1).cast("long").alias("rank")
        two = c.select("commit_id", number, F.lag("commit_id").over(branch).alias("last"), F.lag("commit_id").over(lane).alias("own")).withColumn("p0", F.coalesce("own", "last"))
        merged = (F.col("commit_id") % 3 == 0) & (F.col("last") != F.col("p0"))
        return two.select("commit_id", "p0", F.when(merged, F.col("last")).alias("p1"), "rank")

    @cached_property
    def lanes(self) -> DataFrame:
        """Parents of the forked history."""
        return edges(self.forked)

    @cached_property
    def notes(self) -> DataFrame:
        """Commits with messages: of seven one reverts the last of its branch, by a prefix of its id of any length from 7 on, one corrects, and one names a commit that is none."""
        w = Window.partitionBy("branch").orderBy("position")
        # Object ids come from the numbers, after these were moved.
        c = self.commits.select("commit_id", "position", F.lag("commit_id").over(w).alias("prior")).select("commit_id", _oid("commit_id").alias("oid"), "position", _oid("prior").alias("last"), F.col("prior").cast("string").alias("prior"))
        kind, own = F.col("commit_id") % 7, F.col("commit_id").cast("string")
        prefix = F.substr("last", F.lit(1), (7 + F.col("commit_id") % 34).cast("int"))
        reverts = (kind == 0) & F.col("last").isNotNull()
        subject = F.when(reverts, F.concat(F.lit("Revert change "), "prior")).when(kind == 1, F.concat(F.lit("Fix totals of order "), own)).otherwise(F.concat(F.lit("Change order "), own))
        undone = F.concat(F.lit("\nThis reverts commit "), prefix, F.lit(".\nReason: change "), "prior", F.lit(" broke the totals of its customer."))
        body = F.when(reverts, undone).when(kind == 1, F.lit("\nRetry: once the totals are right.")).when(kind == 2, F.lit("\nThis reverts commit 0000000deadbee.")).otherwise("")
        return c.select("commit_id", "oid", "position", subject.alias("subject"), body.alias("body"))

    @cached_property
    def files(self) -> DataFrame:
        p = self.table("part")
        return p.select("p_partkey", F.concat_ws("/", "p_brand", "p_type", F.concat_ws("#", "p_name", F.col("p_partkey").cast("string"))).alias("path"))

    @cached_property
    def changes(self) -> DataFrame:
        line = self.table("lineitem")
        return line.join(self.files, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("commit_id"),
            F.col("l_linenumber").alias("ordinal"),
            F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "R", "D").otherwise("M").alias("status"),
            "path",
            *_churn(),
        )

    @cached_property
    def churn(self) -> DataFrame:
        """``commit_id, path, additions, deletions`` of each change with the part's number for the path, of parts without a file too."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("path"), *_churn())

    @cached_property
    def moves(self) -> DataFrame:
        """Changes with renames, of brands' types as files: one that an order removes and one that it adds from the same supplier, the first of each by line, are one file that moves."""
        return self._moved(self._kinds)

    @cached_property
    def kind_numbers(self) -> DataFrame:
        """``number, path``: numbers of the paths of ``moves`` that are in the same order as they are."""
        return checkpointed(self._kinds.select("path").distinct().orderBy("path").select(F.monotonically_increasing_id().alias("number"), "path"))

    @cached_property
    def numbered_moves(self) -> DataFrame:
        """``moves`` with numbers for the paths."""
        return self._moved(self._kinds.join(self.kind_numbers, "path").select("p_partkey", F.col("number").alias("path")))

    @cached_property
    def _kinds(self) -> DataFrame:
        return self.table("part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("path"))

    def _moved(self, kinds: DataFrame) -> DataFrame:
        quantity = F.col("l_quantity").cast("long")
        # Dealt by commit for all that asks for lines or paths of one commit.
        line = self.table("lineitem").join(kinds, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("commit_id"), "l_suppkey", F.col("l_linenumber").alias("ordinal"), F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "R", "D").otherwise("M").alias("status"), "path",
            F.when(F.col("l_linestatus") == "F", quantity).otherwise(0).alias("additions"), F.when(F.col("l_linestatus") == "F", F.lit(0)).otherwise(quantity).alias("deletions"),
        ).repartition("commit_id")
        one = F.struct("ordinal", "path", "additions", "deletions")
        together = Window.partitionBy("commit_id", "l_suppkey")  # lines of one order
        least = lambda s: F.min(F.when(F.col("status") == s, one)).over(together)
        paired = line.withColumn("gone", least("D")).withColumn("come", least("A")).withColumn("moved", F.col("gone.path") != F.col("come.path"))
        kept = paired.where(~F.coalesce(F.col("moved") & (F.col("status") == "D") & (F.col("gone") == one), F.lit(False)))
        here = F.coalesce(F.col("moved") & (F.col("status") == "A") & (F.col("come") == one), F.lit(False))
        return kept.select("commit_id", "ordinal", F.when(here, "R").otherwise(F.col("status")).alias("status"), "path", F.when(here, F.col("gone.path")).alias("old_path"), "additions", "deletions")

    @cached_property
    def paths(self) -> DataFrame:
        return self._touched(self.files)

    @cached_property
    def named_tests(self) -> DataFrame:
        """The paths with every third part's file named as a test."""
        third = F.regexp_extract("path", "#([0-9]+)$", 1).cast("long") % 3 == 0
        return self._touched(self.files.withColumn("path", F.when(third, F.regexp_replace("path", "([^/]+)$", "test_$1")).otherwise(F.col("path"))))

    @cached_property
    def numbers(self) -> DataFrame:
        """``paths`` with the part's number for the path, for those who only ask whether paths are the same."""
        return self._pairs.join(self.files, "p_partkey", "left_semi").select("commit_id", F.col("p_partkey").alias("path"))

    @cached_property
    def brands(self) -> DataFrame:
        """``commit_id, path``: the first parts of the paths that a commit touches, each once; parts are told apart by it before the join, not by their paths."""
        first = self.files.select("p_partkey", F.substring_index("path", "/", 1).alias("path"))
        line = self.table("lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("p_partkey"))
        return line.join(first, "p_partkey").select("commit_id", "path").distinct()

    @cached_property
    def _pairs(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("p_partkey")).distinct()

    def _touched(self, files: DataFrame) -> DataFrame:
        """``commit_id, path``, each once: paths end with their part's number, so numbers are told apart, not the long paths."""
        return self._pairs.join(files.distinct(), "p_partkey").select("commit_id", "path")

    @cached_property
    def documents(self) -> DataFrame:
        d = self.table("documents")
        at = F.instr("text", "\n")
        subject = F.when(at > 0, F.substring(F.col("text"), F.lit(1), at - 1)).otherwise(F.col("text"))
        body = F.when(at > 0, F.substring(F.col("text"), at + 1, F.length("text"))).otherwise("")
        return d.select("doc_id", subject.alias("subject"), body.alias("body"), F.concat_ws("/", "source", "lang").alias("path"), "text", (1_600_000_000 + F.floor(F.col("doc_id") / 10) * 60).alias("commit_time"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 40).alias("oid"))

    @cached_property
    def lines(self) -> DataFrame:
        return self.table("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "content"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "embedding", "label")

    @cached_property
    def usage(self) -> DataFrame:
        e = self.table("events")
        return e.select("event_id", "ts", F.to_date("ts").alias("day"), F.col("event_type").alias("command"), "user_id", F.col("value").alias("elapsed"))

    @cached_property
    def turns(self) -> DataFrame:
        return self.table("conversations")


def _churn() -> list[Column]:
    quantity, added = F.col("l_quantity").cast("long"), F.col("l_linestatus") == "F"
    return [F.when(added, quantity).otherwise(0).alias("additions"), F.when(added, F.lit(0)).otherwise(quantity).alias("deletions")]


def _oid(number: str) -> Column:
    return F.substring(F.sha2(F.col(number).cast("string"), 256), 1, 40)


def edges(forked: DataFrame) -> DataFrame:
    """``commit_id, position, parent_id`` of ``forked(commit_id, p0, p1)``."""
    return forked.select("commit_id", F.posexplode(F.array("p0", "p1")).alias("position", "parent_id")).where("parent_id IS NOT NULL")


def bind(spark: SparkSession, root: str) -> Catalog:
    return Catalog(spark, root)


#: The same tables as DuckDB SQL, for oracles.
VIEWS: dict[str, str] = {
    "commits": """commits AS (SELECT o_orderkey AS commit_id, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 40) AS oid,
      (CAST(epoch(o_orderdate) AS BIGINT) // 86400) * 1099511627776 + o_orderkey AS position, CAST(epoch(o_orderdate) AS BIGINT) AS commit_time,
      o_custkey AS branch, o_orderpriority AS priority FROM orders)""",
    "parents": """linked AS (SELECT commit_id, lag(commit_id) OVER (PARTITION BY branch ORDER BY position) AS p0,
      lag(commit_id) OVER (PARTITION BY branch, priority ORDER BY position) AS p1 FROM commits),
    parents AS (SELECT commit_id, 0 AS position, p0 AS parent_id FROM linked WHERE p0 IS NOT NULL
      UNION ALL SELECT commit_id, 1, p1 FROM linked WHERE commit_id % 5 = 0 AND p1 IS NOT NULL AND p1 <> p0)""",
    "lanes": """forked AS (SELECT commit_id, coalesce(lag(commit_id) OVER (PARTITION BY branch, priority ORDER BY position), lag(commit_id) OVER b) AS p0, lag(commit_id) OVER b AS p1
      FROM commits WINDOW b AS (PARTITION BY branch ORDER BY position)),
    lanes AS (SELECT commit_id, 0 AS position, p0 AS parent_id FROM forked WHERE p0 IS NOT NULL
      UNION ALL SELECT commit_id, 1, p1 FROM forked WHERE commit_id % 3 = 0 AND p1 <> p0)""",
    "notes": """recent AS (SELECT commit_id, oid, position, lag(oid) OVER b AS last, lag(commit_id) OVER b AS prior FROM commits WINDOW b AS (PARTITION BY branch ORDER BY position)),
    notes AS (SELECT commit_id, oid, position, CASE WHEN commit_id % 7 = 0 AND last IS NOT NULL THEN 'Revert change ' || prior WHEN commit_id % 7 = 1 THEN 'Fix totals of order ' || commit_id ELSE 'Change order ' || commit_id END AS subject,
      CASE WHEN commit_id % 7 = 0 AND last IS NOT NULL THEN 'This reverts commit ' || substr(last, 1, 7 + commit_id % 34) || '.' WHEN commit_id % 7 = 2 THEN 'This reverts commit 0000000deadbee.' ELSE '' END AS body FROM recent)""",
    "changes": """changes AS (SELECT l_orderkey AS commit_id, l_linenumber AS ordinal, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'D' ELSE 'M' END AS status,
      p_brand || '/' || p_type || '/' || p_name || '#' || p_partkey AS path,
      CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS additions, CASE WHEN l_linestatus = 'F' THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS deletions
      FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "moves": """lined AS (SELECT l_orderkey AS commit_id, l_suppkey, l_linenumber AS ordinal, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'D' ELSE 'M' END AS status,
      p_brand || '/' || p_type AS path,
      CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS additions, CASE WHEN l_linestatus = 'F' THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS deletions
      FROM lineitem JOIN part ON l_partkey = p_partkey),
    ranked AS (SELECT *, {'o': ordinal, 'p': path, 'a': additions, 'd': deletions} AS one FROM lined),
    firsts_of AS (SELECT commit_id, l_suppkey, min(one) FILTER (status = 'D') AS gone, min(one) FILTER (status = 'A') AS come FROM ranked GROUP BY ALL),
    moving AS (SELECT * FROM firsts_of WHERE gone.p <> come.p),
    moves AS (SELECT r.commit_id, ordinal, CASE WHEN status = 'A' AND one = come THEN 'R' ELSE status END AS status, path, CASE WHEN status = 'A' AND one = come THEN gone.p END AS old_path, additions, deletions
      FROM ranked r LEFT JOIN moving m ON r.commit_id = m.commit_id AND r.l_suppkey = m.l_suppkey WHERE NOT coalesce(status = 'D' AND one = gone, false))""",
    "paths": "paths AS (SELECT DISTINCT commit_id, path FROM changes)",
    "named_tests": r"""paths AS (SELECT DISTINCT commit_id, CASE WHEN CAST(regexp_extract(path, '#([0-9]+)$', 1) AS BIGINT) % 3 = 0 THEN regexp_replace(path, '([^/]+)$', 'test_\1') ELSE path END AS path FROM changes)""",
    "docs": r"""docs AS (SELECT doc_id, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END AS subject,
      CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS body, source || '/' || lang AS path, text,
      1600000000 + (doc_id // 10) * 60 AS commit_time, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 40) AS oid FROM documents)""",
    "lines": """lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS content
      FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS t(i))""",
    "usage": "usage AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, event_type AS command, user_id, value AS elapsed FROM events)",
}


def with_views(names: str, body: str) -> str:
    """``body`` under the named views, later ones using earlier ones."""
    return "WITH RECURSIVE " + ",\n".join(VIEWS[n] for n in names.split()) + (",\n" if body.lstrip().startswith("--,") else "\n") + body.replace("--,", "", 1)
