"""Scans, filters, joins and aggregates around files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.catalog import Catalog, bind, with_views
from palimpsest.functions.text import basename, is_test_path, normalize_path
from palimpsest.operators import followon, relations
from palimpsest.operators.bases import dense_ranks
from palimpsest.plans.durable import checkpointed
from palimpsest.plans.graph import merges

QUERIES, ORACLES = {}, {}
MASS = 8


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(bind(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def seeds(c: Catalog, n: int = 3, paths: DataFrame | None = None) -> DataFrame:
    """The busiest files."""
    return (c.paths if paths is None else paths).groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(n).select(F.col("path").alias("seed"))


SEEDS = "seeds AS (SELECT path AS seed FROM paths GROUP BY path ORDER BY count(*) DESC, path LIMIT 3)"
MERGES = "merges AS (SELECT DISTINCT commit_id FROM parents WHERE position > 0)"
ELIGIBLE = f"""eligible AS (SELECT commit_id FROM paths WHERE commit_id NOT IN (SELECT commit_id FROM merges)
  GROUP BY commit_id HAVING count(*) BETWEEN 2 AND {MASS})"""
BASE = "commits parents changes paths"


@query("SELECT o_orderkey AS commit_id, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 40) AS oid, CAST(epoch(o_orderdate) AS BIGINT) AS commit_time, o_custkey AS branch FROM orders")
def scan_commits(c: Catalog) -> DataFrame:
    return c.commits.select("commit_id", "oid", "commit_time", "branch")


@query(with_views("commits parents", "SELECT * FROM parents"))
def scan_parents(c: Catalog) -> DataFrame:
    return c.parents


@query(with_views("changes", "SELECT commit_id, ordinal, status, path, CAST(additions AS BIGINT) AS additions, CAST(deletions AS BIGINT) AS deletions FROM changes"))
def scan_changes(c: Catalog) -> DataFrame:
    return c.changes


@query(with_views("changes paths", "SELECT commit_id, path FROM paths"))
def scan_paths(c: Catalog) -> DataFrame:
    return c.paths


@query(with_views("changes paths", "SELECT commit_id, count(*) AS path_count FROM paths GROUP BY commit_id"))
def agg_path_counts(c: Catalog) -> DataFrame:
    return c.paths.groupBy("commit_id").agg(F.count("*").alias("path_count"))


@query(with_views("changes paths", r"SELECT DISTINCT path, lower(path) AS path_key, regexp_extract(lower(path), '[^/]*$') AS name FROM paths"))
def project_path_keys(c: Catalog) -> DataFrame:
    return c.paths.select("path", normalize_path(F.col("path")).alias("path_key"), basename(normalize_path(F.col("path"))).alias("name")).distinct()


@query(with_views("docs", "SELECT doc_id, subject, length(subject) AS subject_chars, length(body) AS body_chars FROM docs"))
def project_message_parts(c: Catalog) -> DataFrame:
    return c.documents.select("doc_id", "subject", F.length("subject").cast("long").alias("subject_chars"), F.length("body").cast("long").alias("body_chars"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(lower(regexp_replace(url, '^[a-zA-Z]+://', '')), '^(\./)+', ''), '^/+|/+$', '', 'g') AS path_key FROM pages")
def project_page_paths(c: Catalog) -> DataFrame:
    return c.table("pages").select("page_id", normalize_path(F.regexp_replace("url", "^[a-zA-Z]+://", "")).alias("path_key"))


@query(with_views("changes", "SELECT commit_id, string_agg(DISTINCT CASE status WHEN 'D' THEN 'removed' WHEN 'A' THEN 'added' ELSE 'modified' END, ',' ORDER BY CASE status WHEN 'D' THEN 'removed' WHEN 'A' THEN 'added' ELSE 'modified' END) AS steps FROM changes GROUP BY commit_id"))
def project_change_steps(c: Catalog) -> DataFrame:
    step = F.when(F.col("status") == "D", "removed").when(F.col("status") == "A", "added").otherwise("modified")
    return c.changes.groupBy("commit_id").agg(F.array_join(F.array_sort(F.collect_set(step)), ",").alias("steps"))


@query(with_views("changes paths", "SELECT commit_id, path FROM paths WHERE path = 'Brand#11' OR starts_with(path, 'Brand#11/')"))
def filter_changed_path_exact_or_subtree(c: Catalog) -> DataFrame:
    from palimpsest.plans.scope import under_any

    return c.paths.where(under_any(F.col("path"), ("Brand#11",)))


@query(with_views("changes paths", "SELECT DISTINCT path FROM paths WHERE regexp_extract(lower(path), '[^/]*$') IN (SELECT regexp_extract(lower(path), '[^/]*$') FROM paths ORDER BY path LIMIT 1)"))
def filter_basename(c: Catalog) -> DataFrame:
    least = c.paths.agg(F.min("path").alias("path")).select(basename(normalize_path(F.col("path"))).alias("name"))
    named = c.paths.select("path", basename(normalize_path(F.col("path"))).alias("name")).distinct()
    return named.join(F.broadcast(least), "name", "left_semi").select("path")


@query(
    r"""WITH shaped AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Tests/' || p_name || '.py' WHEN 1 THEN p_type || '/test_' || p_name || '.py' WHEN 2 THEN p_type || '/' || p_name || '_test.go'
  WHEN 3 THEN p_type || '/' || p_name || '.spec.ts' WHEN 4 THEN p_type || '/testing/' || p_name WHEN 5 THEN p_type || '/latest_' || p_name ELSE p_type || '/' || p_name END AS path FROM part)
SELECT p_partkey, path FROM shaped WHERE regexp_matches(lower(path), '(^|/)(test|tests|__tests__|spec)/|(^|/)test[_-][^/]*$|(^|/)[^/]*(_test|_spec)(\.[^./]*)?$|(^|/)[^/]*\.(test|spec)\.[^/]*$')"""
)
def filter_test_like_path(c: Catalog) -> DataFrame:
    """Parts' files under names of which some are tests."""
    k, kind, name = F.col("p_partkey") % 7, F.col("p_type"), F.col("p_name")
    shapes = [F.concat(F.lit("Tests/"), name, F.lit(".py")), F.concat(kind, F.lit("/test_"), name, F.lit(".py")), F.concat(kind, F.lit("/"), name, F.lit("_test.go")), F.concat(kind, F.lit("/"), name, F.lit(".spec.ts")), F.concat(kind, F.lit("/testing/"), name), F.concat(kind, F.lit("/latest_"), name), F.concat(kind, F.lit("/"), name)]
    path = F.get(F.array(*shapes), k.cast("int"))
    return c.table("part").select("p_partkey", path.alias("path")).where(is_test_path(F.col("path")))


@query(with_views(BASE, f"--, {MERGES}, {ELIGIBLE} SELECT commit_id FROM eligible"))
def filter_mass_change(c: Catalog) -> DataFrame:
    return relations.eligible_commits(c.paths, merges(c.parents), MASS)


@query(with_views(BASE, f"--, {SEEDS} SELECT DISTINCT commit_id FROM paths JOIN seeds ON path = seed"))
def join_semi_paths(c: Catalog) -> DataFrame:
    return c.paths.join(F.broadcast(seeds(c)), F.col("path") == F.col("seed"), "left_semi").select("commit_id").distinct()


@query(with_views("commits parents", f"--, {MERGES} SELECT commit_id FROM commits WHERE commit_id NOT IN (SELECT commit_id FROM merges)"))
def join_anti_merges(c: Catalog) -> DataFrame:
    return c.commits.select("commit_id").join(merges(c.parents), "commit_id", "left_anti")


@query(with_views("commits parents", "SELECT c.commit_id, p.parent_id, coalesce(q.oid, 'none') AS parent_oid FROM commits c LEFT JOIN parents p ON c.commit_id = p.commit_id AND p.position = 0 LEFT JOIN commits q ON q.commit_id = p.parent_id"))
def join_left_parents(c: Catalog) -> DataFrame:
    first = c.parents.where("position = 0").select("commit_id", "parent_id")
    named = c.commits.select(F.col("commit_id").alias("parent_id"), F.col("oid").alias("parent_oid"))
    return c.commits.select("commit_id").join(first, "commit_id", "left").join(named, "parent_id", "left").select("commit_id", "parent_id", F.coalesce("parent_oid", F.lit("none")).alias("parent_oid"))


RELATED = f"""--, {SEEDS}, {MERGES}, {ELIGIBLE},
there AS (SELECT * FROM paths WHERE commit_id IN (SELECT commit_id FROM eligible)),
touched AS (SELECT commit_id, path AS seed FROM there WHERE path IN (SELECT seed FROM seeds)),
n AS (SELECT (SELECT count(DISTINCT commit_id) FROM touched) AS seed_commits, (SELECT count(*) FROM eligible) AS commits, (SELECT count(*) FROM seeds) AS n_seeds),
cand AS (SELECT t.path, count(DISTINCT t.commit_id) AS support, count(DISTINCT touched.seed) AS seed_coverage
  FROM there t JOIN touched USING (commit_id) WHERE t.path NOT IN (SELECT seed FROM seeds) GROUP BY t.path),
total AS (SELECT path, count(*) AS touches FROM there GROUP BY path),
scored AS (SELECT cand.path, support, support / seed_commits AS proportion, touches / commits AS ubiquity, seed_coverage, n_seeds FROM cand JOIN total USING (path), n)
"""
_STEM = r"regexp_replace(regexp_extract({}, '[^/]*$'), '\.[^.]*$', '')"
MIRROR = f"regexp_replace({_STEM.format('lower(path)')}, '^test[_-]|_test$', '') IN (SELECT {_STEM.format('lower(seed)')} FROM seeds)"
SCORE = "support * proportion * (1 + 0.5 * seed_coverage / n_seeds) / (1 + ubiquity)"


@query(
    with_views(
        BASE,
        RELATED
        + f"""SELECT path, support, round(proportion, 6) AS proportion, round(ubiquity, 6) AS ubiquity, CAST(seed_coverage AS INTEGER) AS seed_coverage, round({SCORE}, 6) AS score,
  CASE WHEN support >= 4 AND proportion >= 0.3 THEN 'high' WHEN support >= 2 OR proportion >= 0.1 THEN 'medium' ELSE 'low' END AS confidence
FROM scored ORDER BY score DESC, path LIMIT 10""",
    )
)
def related_files(c: Catalog) -> DataFrame:
    paths = checkpointed(c.paths)
    return relations.related_files(paths, merges(c.parents), seeds(c, paths=paths), mass=MASS)


@query(with_views(BASE, RELATED + "SELECT path, support, CAST(seed_coverage AS INTEGER) AS seed_coverage FROM scored"))
def join_cochange_self(c: Catalog) -> DataFrame:
    paths = checkpointed(c.paths)
    return relations.related_files(paths, merges(c.parents), seeds(c, paths=paths), mass=MASS, limit=None).select("path", "support", "seed_coverage")


@query(with_views(BASE, RELATED + f"SELECT path, round({SCORE}, 6) AS score FROM scored"))
def agg_relation_score(c: Catalog) -> DataFrame:
    paths = checkpointed(c.paths)
    return relations.related_files(paths, merges(c.parents), seeds(c, paths=paths), mass=MASS, limit=None).select("path", "score")


@query(
    with_views(
        BASE,
        f"""--, {MERGES}, {ELIGIBLE}, there AS (SELECT *, starts_with(path, 'Brand#11/') AS inside FROM paths WHERE commit_id IN (SELECT commit_id FROM eligible)),
inner_files AS (SELECT commit_id, count(*) AS k FROM there WHERE inside GROUP BY commit_id)
SELECT path, count(*) AS support, CAST(sum(k) AS BIGINT) AS inner_touches FROM there JOIN inner_files USING (commit_id) WHERE NOT inside GROUP BY path ORDER BY support DESC, inner_touches DESC, path LIMIT 10""",
    )
)
def related_directories(c: Catalog) -> DataFrame:
    return relations.related_directories(c.paths, merges(c.parents), ("Brand#11/",), mass=MASS)


def module(path):
    return F.substring_index(path, "/", 2)


@query(
    with_views(
        BASE,
        f"""--, {MERGES}, {ELIGIBLE}, m AS (SELECT DISTINCT commit_id, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS module FROM paths WHERE commit_id IN (SELECT commit_id FROM eligible))
SELECT a.module AS a, b.module AS b, count(*) AS support FROM m a JOIN m b ON a.commit_id = b.commit_id AND a.module < b.module GROUP BY 1, 2""",
    )
)
def agg_module_cochange(c: Catalog) -> DataFrame:
    # At most MASS modules a commit, so the self-join makes a bounded number of pairs for each.
    m = c.paths.join(relations.eligible_commits(c.paths, merges(c.parents), MASS), "commit_id", "left_semi").select("commit_id", module(F.col("path")).alias("m")).distinct()
    pairs = m.select("commit_id", F.col("m").alias("a")).join(m.select("commit_id", F.col("m").alias("b")), "commit_id").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("support"))


@query(
    with_views(
        BASE,
        f"""--, {MERGES}, p AS (SELECT * FROM paths WHERE commit_id NOT IN (SELECT commit_id FROM merges))
SELECT path, count(*) AS touches, min(commit_id) AS first_commit FROM p GROUP BY path""",
    )
)
def win_total_touches(c: Catalog) -> DataFrame:
    return relations.total_touches(c.paths, merges(c.parents))


@query(
    with_views(
        "commits parents changes named_tests",
        RELATED
        + f"SELECT path, support, round(CASE WHEN {MIRROR} THEN 1.0 ELSE 1.25 END * {SCORE}, 6) AS score FROM scored WHERE regexp_matches(lower(path), '(^|/)(test|tests|__tests__|spec)/|(^|/)test[_-][^/]*$|(^|/)[^/]*(_test|_spec)(\\.[^./]*)?$|(^|/)[^/]*\\.(test|spec)\\.[^/]*$') ORDER BY score DESC, path LIMIT 10",
    )
)
def tests_candidates(c: Catalog) -> DataFrame:
    paths = checkpointed(c.named_tests)
    return relations.related_files(paths, merges(c.parents), seeds(c, paths=paths), mass=MASS, tests_only=True).select("path", "support", "score")


@query()
def patterns_closed_sets(c: Catalog) -> DataFrame:
    """Brands that change together, around the busiest one."""
    brands = checkpointed(c.brands)
    seed = brands.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(1).select(F.col("path").alias("seed"))
    return relations.closed_patterns(brands, merges(c.parents), seed, least=3, limit=50)


@query(
    with_views(
        BASE,
        f"""--, {SEEDS}, known AS (SELECT DISTINCT path FROM paths), wanted AS (
  SELECT seed FROM seeds UNION ALL SELECT upper(seed) FROM seeds UNION ALL SELECT regexp_extract(seed, '[^/]*$') FROM seeds),
exact AS (SELECT path, seed FROM known JOIN wanted ON path = seed)
SELECT path, seed FROM exact
UNION ALL SELECT path, seed FROM known JOIN wanted ON lower(path) = lower(seed) AND contains(seed, '/') AND seed NOT IN (SELECT seed FROM exact)
UNION ALL SELECT path, seed FROM known JOIN wanted ON regexp_extract(lower(path), '[^/]*$') = lower(seed) AND NOT contains(seed, '/') AND seed NOT IN (SELECT seed FROM exact)""",
    )
)
def join_seed_or_theta(c: Catalog) -> DataFrame:
    s = seeds(c)
    wanted = s.unionAll(s.select(F.upper("seed").alias("seed"))).unionAll(s.select(basename(F.col("seed")).alias("seed")))
    return relations.seed_matches(c.paths, wanted)


#: The file that is changed least, and what tends to change in the two years after it. A fifth of its commits has to be followed, as given data are random.
QUIET = "quiet AS (SELECT path FROM paths GROUP BY path ORDER BY count(*), path LIMIT 1)"


def module_paths(c: Catalog) -> DataFrame:
    return c.changes.select("commit_id", module(F.col("path")).alias("path")).distinct()


def after_quiet(c: Catalog) -> DataFrame:
    quiet = checkpointed(c.paths.groupBy("path").agg(F.count("*").alias("n")).orderBy("n", "path").limit(1).select("path"))  # one row, read twice
    origins = c.paths.join(F.broadcast(quiet), "path", "left_semi").select(F.col("commit_id").alias("origin_id"))
    eligible = c.commits.select("commit_id").join(merges(c.parents), "commit_id", "left_anti")
    selected = quiet.select(module(F.col("path")).alias("path")).distinct()
    return followon.observations(origins, c.parents, c.commits, eligible, module_paths(c), dense_ranks(c.commits), days=730, one_in=5, excluded=selected)


AFTER = f"""--, {MERGES}, {QUIET}, eligible AS (SELECT commit_id, commit_time, position FROM commits WHERE commit_id NOT IN (SELECT commit_id FROM merges)),
mods AS (SELECT DISTINCT commit_id, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS path FROM paths WHERE commit_id IN (SELECT commit_id FROM eligible)),
chosen AS (SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS path FROM quiet),
touched AS (SELECT * FROM mods WHERE path NOT IN (SELECT path FROM chosen)),
full_ones AS (SELECT commit_id AS origin_id, commit_time AS t0, row_number() OVER (ORDER BY position) - 1 AS rank FROM eligible WHERE commit_time + 63072000 <= (SELECT max(commit_time) FROM commits)),
down(origin_id, id, k) AS (SELECT origin_id, origin_id, 0 FROM full_ones UNION SELECT origin_id, commit_id, k + 1 FROM down JOIN parents ON parent_id = id WHERE k < 20),
later AS (SELECT DISTINCT origin_id, e.commit_id FROM down JOIN full_ones USING (origin_id) JOIN eligible e ON e.commit_id = id WHERE k > 0 AND e.commit_time - t0 BETWEEN 0 AND 63072000),
own AS (SELECT DISTINCT origin_id FROM full_ones JOIN paths ON commit_id = origin_id WHERE path IN (SELECT path FROM quiet)),
edges AS (SELECT l.origin_id, l.commit_id, t.path FROM later l JOIN touched t USING (commit_id) WHERE NOT EXISTS (SELECT 1 FROM touched x WHERE x.commit_id = l.origin_id AND x.path = t.path)),
found AS (SELECT path, count(DISTINCT origin_id) AS supporting, count(DISTINCT commit_id) AS followers FROM edges WHERE origin_id IN (SELECT origin_id FROM own) GROUP BY path),
counted AS (SELECT f.*, (SELECT count(*) FROM own) - (SELECT count(*) FROM own JOIN touched t ON t.commit_id = origin_id AND t.path = f.path) AS complete FROM found f),
likely AS (SELECT * FROM counted WHERE supporting >= 2 AND followers >= 2 AND 5 * supporting >= complete),
pool AS (SELECT l.path, origin_id, row_number() OVER (PARTITION BY l.path ORDER BY rank) - 1 AS i, count(*) OVER (PARTITION BY l.path) AS n
  FROM likely l, full_ones WHERE NOT EXISTS (SELECT 1 FROM touched x WHERE x.commit_id = origin_id AND x.path = l.path)),
picked AS (SELECT path, origin_id FROM pool WHERE i IN (SELECT ((2 * j + 1) * pool.n) // (2 * least(pool.n, 100)) FROM range(0, 100) AS t(j) WHERE j < least(pool.n, 100))),
base AS (SELECT path, count(*) AS baseline_size, count(*) FILTER (EXISTS (SELECT 1 FROM edges e WHERE e.origin_id = picked.origin_id AND e.path = picked.path)) AS baseline_hits FROM picked GROUP BY path)
"""


@query(with_views(BASE, AFTER + "SELECT path, supporting, complete, baseline_hits, baseline_size FROM likely JOIN base USING (path) WHERE supporting * baseline_size >= 2 * baseline_hits * complete"))
def related_followons(c: Catalog) -> DataFrame:
    """What tends to change within two years and 20 commits after the quietest file, at twice the baseline or more."""
    return after_quiet(c).select("path", "supporting", "complete", "baseline_hits", "baseline_size")
