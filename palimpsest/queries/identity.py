"""Files by identity: incarnations, hotspots and timelines over renames and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.catalog import Catalog, bind, with_views
from palimpsest.operators import identity
from palimpsest.plans import graph
from palimpsest.plans.durable import checkpointed
from palimpsest.queries.history import TIPS, UP, tips
from palimpsest.queries.relations import MERGES

QUERIES, ORACLES = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(bind(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


BASE = "commits parents moves"
#: Origins by climbing commit by commit.
ORIGINS = """every AS (SELECT commit_id, path, true AS present, ordinal, status, old_path, additions, deletions FROM moves WHERE status <> 'D'
  UNION ALL SELECT commit_id, CASE status WHEN 'D' THEN path ELSE old_path END, false, ordinal, 'D', NULL, additions, deletions FROM moves WHERE status IN ('D', 'R')),
ev AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY commit_id, path ORDER BY present DESC, ordinal, status, old_path NULLS FIRST, additions, deletions) AS k FROM every) WHERE k = 1),
asks AS (SELECT ev.commit_id AS c, ev.path AS p, position, parent_id AS spot, CASE status WHEN 'R' THEN old_path ELSE path END AS asked FROM ev JOIN parents USING (commit_id)
  WHERE present AND CASE WHEN status = 'A' THEN position > 0 ELSE position = 0 END),
climb(c, p, position, spot, asked) AS (SELECT * FROM asks
  UNION ALL SELECT c, p, climb.position, parents.parent_id, asked FROM climb JOIN parents ON parents.commit_id = spot AND parents.position = 0 LEFT JOIN ev ON ev.commit_id = spot AND ev.path = asked WHERE ev.path IS NULL),
nexts AS (SELECT c, p, arg_min(spot, climb.position) AS nc, arg_min(asked, climb.position) AS np FROM climb JOIN ev ON ev.commit_id = spot AND ev.path = asked WHERE present GROUP BY c, p),
chase(commit_id, path, oc, op) AS (SELECT commit_id, path, commit_id, path FROM ev WHERE present UNION ALL SELECT commit_id, path, nc, np FROM chase JOIN nexts ON c = oc AND p = op),
told AS (SELECT commit_id, path, status, additions, deletions, oc AS origin_commit, op AS origin_path FROM chase JOIN ev USING (commit_id, path) WHERE NOT EXISTS (SELECT 1 FROM nexts WHERE c = oc AND p = op))"""
#: What each tip has at its paths, by its first-parent history.
FILES = """down_from(tip, spot, k) AS (SELECT id, id, 0 FROM tips UNION ALL SELECT tip, parent_id, k + 1 FROM down_from JOIN parents ON commit_id = spot AND position = 0),
latest AS (SELECT tip, path, arg_min(commit_id, k) AS commit_id, arg_min(present, k) AS present FROM down_from JOIN ev ON commit_id = spot GROUP BY tip, path),
files AS (SELECT tip AS revision, path, origin_commit, origin_path FROM latest JOIN told USING (commit_id, path) WHERE present)"""


def laid(c: Catalog, moves: DataFrame | None = None) -> tuple[graph.Chains, DataFrame, DataFrame]:
    """The layout, the origins and what they were made of, which others read as well."""
    layout, moves = graph.chains(c.parents), c.moves if moves is None else moves
    made = checkpointed(identity.events(moves))
    return layout, identity.origins(moves, c.parents, layout, made), made


@query(with_views(BASE, f"--, {ORIGINS} SELECT commit_id, path, status, origin_commit, origin_path FROM told"))
def identity_origins(c: Catalog) -> DataFrame:
    """The incarnation of every change, over renames and merges."""
    return laid(c)[1].select("commit_id", "path", "status", "origin_commit", "origin_path")


@query(with_views(BASE, f"--, {ORIGINS} SELECT origin_commit, origin_path, count(*) AS changes, count(DISTINCT path) AS paths, count(*) FILTER (status = 'R') AS renames FROM told GROUP BY ALL"))
def identity_incarnations(c: Catalog) -> DataFrame:
    renames = F.count(F.when(F.col("status") == "R", 1))
    return laid(c)[1].groupBy("origin_commit", "origin_path").agg(F.count("*").alias("changes"), F.count_distinct("path").alias("paths"), renames.alias("renames"))


@query(with_views(BASE, f"--, {TIPS}, {ORIGINS}, {FILES} SELECT * FROM files"))
def identity_files(c: Catalog) -> DataFrame:
    """The files of the last commit of each branch, by identity."""
    layout, told, made = laid(c)
    return identity.files_at(tips(c).select(F.col("id").alias("revision")), told, c.moves, layout, made)


@query(
    with_views(
        BASE,
        f"""--, {TIPS}, {UP}, {MERGES}, {ORIGINS}, {FILES}, mine AS (SELECT DISTINCT path, origin_commit, origin_path FROM files)
SELECT mine.path, count(DISTINCT commit_id) AS touches, max(commit_time) AS last_changed, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions
FROM mine JOIN told USING (origin_commit, origin_path) JOIN commits USING (commit_id) WHERE commit_id NOT IN (SELECT commit_id FROM merges) AND commit_id IN (SELECT id FROM up)
GROUP BY mine.path ORDER BY touches DESC, mine.path LIMIT 20""",
    )
)
def identity_hotspots(c: Catalog) -> DataFrame:
    # By numbers, which move in less room than paths and are in their order.
    layout, told, made = laid(c, c.numbered_moves)
    told = checkpointed(told.drop("status"))  # read twice
    files = identity.files_at(tips(c).select(F.col("id").alias("revision")), told, c.numbered_moves, layout, made)
    top = identity.hotspots(files, told, c.commits, graph.merges(c.parents), layout.ancestors(tips(c)))
    named = c.kind_numbers.join(F.broadcast(top.withColumnRenamed("path", "number")), "number")  # twenty rows
    return named.select("path", "touches", "last_changed", "additions", "deletions").orderBy(F.desc("touches"), "path")


BUSY = "busy AS (SELECT origin_commit, origin_path FROM told GROUP BY ALL ORDER BY count(*) FILTER (status = 'R') DESC, count(*) DESC, origin_commit, origin_path LIMIT 1)"


@query(
    with_views(
        BASE,
        f"""--, {ORIGINS}, {BUSY}, mine AS (SELECT commit_id, arg_min(m.status, m.ordinal) AS status FROM moves m WHERE (m.commit_id, m.path) IN (SELECT (commit_id, path) FROM told JOIN busy USING (origin_commit, origin_path)) GROUP BY commit_id),
numbered AS (SELECT row_number() OVER (ORDER BY position) AS number, commit_id, commit_time, CASE status WHEN 'A' THEN 'added' WHEN 'D' THEN 'removed' WHEN 'R' THEN 'renamed' ELSE 'modified' END AS change, count(*) OVER () AS total FROM mine JOIN commits USING (commit_id))
SELECT CAST(number AS INTEGER) AS number, commit_id, commit_time, change, total, 10 < total AS has_more FROM numbered WHERE number <= 10""",
    )
)
def identity_timeline(c: Catalog) -> DataFrame:
    """The first page of the most renamed file's changes, under all its paths."""
    told = laid(c)[1]
    n = told.groupBy("origin_commit", "origin_path").agg(F.count(F.when(F.col("status") == "R", 1)).alias("r"), F.count("*").alias("n"))
    busy = n.orderBy(F.desc("r"), F.desc("n"), "origin_commit", "origin_path").limit(1).select("origin_commit", "origin_path")
    return identity.history_of(told, c.moves, c.commits, busy)
