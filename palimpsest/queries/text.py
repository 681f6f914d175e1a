"""Text, code, vector and patch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.catalog import Catalog, bind, with_views
from palimpsest.functions import provenance, scoring, text
from palimpsest.operators import patches, search

QUERIES, ORACLES = {}, {}
#: Words that the generated prose has.
TERMS = ["the", "ering", "thand", "erble"]
LIST = "['the', 'ering', 'thand', 'erble']"


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(bind(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(with_views("lines", "SELECT doc_id, line_no, content FROM lines"))
def scan_hunk_lines(c: Catalog) -> DataFrame:
    return c.lines


@query(with_views("lines", "SELECT doc_id, line_no FROM lines WHERE contains(content, 'tionnt') ORDER BY doc_id DESC, line_no LIMIT 20"))
def topk_code_literal(c: Catalog) -> DataFrame:
    return search.literal(c.lines, "tionnt").select("doc_id", "line_no")


@query(with_views("lines", r"SELECT doc_id, line_no FROM lines WHERE regexp_matches(content, '[A-Z][a-z]+ble (th|er)[a-z]*\.') ORDER BY doc_id DESC, line_no LIMIT 20"))
def topk_code_regex(c: Catalog) -> DataFrame:
    return search.by_regex(c.lines, r"[A-Z][a-z]+ble (th|er)[a-z]*\.").select("doc_id", "line_no")


COMMON = """pairs AS (SELECT content AS c1, lead(content) OVER w AS c2, doc_id, line_no FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
best AS (SELECT c1, c2 FROM pairs WHERE c2 IS NOT NULL GROUP BY c1, c2 ORDER BY count(*) DESC, c1, c2 LIMIT 1)"""


@query(with_views("lines", f"--, {COMMON} SELECT doc_id, line_no AS first_line, line_no + 1 AS last_line FROM pairs WHERE (c1, c2) IN (SELECT c1, c2 FROM best)"))
def topk_fragment(c: Catalog) -> DataFrame:
    """The commonest pair of consecutive lines, found as a fragment."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("line_no")
    two = c.lines.select(F.col("content").alias("c1"), F.lead("content").over(w).alias("c2")).where("c2 IS NOT NULL")
    best = two.groupBy("c1", "c2").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c1", "c2").first()
    return search.fragment(c.lines, [best.c1, best.c2])


@query(
    with_views(
        "lines",
        """--, e AS (SELECT doc_id, count(*) AS lines, min(line_no) AS first_line FROM lines WHERE contains(content, 'ingth') GROUP BY doc_id)
SELECT *, (SELECT count(*) FROM e) AS matched_count FROM e ORDER BY lines DESC, doc_id LIMIT 10""",
    )
)
def topk_removed_events(c: Catalog) -> DataFrame:
    return search.removed_events(c.lines, "ingth")


@query(with_views("lines", "SELECT doc_id, count(*) AS lines, min(line_no) AS first_line FROM lines WHERE contains(content, 'ingth') GROUP BY doc_id"))
def agg_deletion_events(c: Catalog) -> DataFrame:
    return search.literal(c.lines, "ingth", None).groupBy("doc_id").agg(F.count("*").alias("lines"), F.min("line_no").alias("first_line"))


WORDS = r"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
#: Different terms: words split where case changes and between letters and digits as well.
TERMS_OF = r"list_filter(list_distinct(string_split(lower({split}), ' ')), lambda x: x <> '')"


def _terms(c: str) -> str:
    split = rf"regexp_replace({c}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
    for left, right in ((r"\p{Lu}{2}", r"\p{Lu}\p{Ll}"), (r"\p{Ll}", r"\p{Lu}"), (r"\p{L}", r"\p{N}"), (r"\p{N}", r"\p{L}")):
        split = rf"regexp_replace({split}, '({left})({right})', '\1 \2', 'g')"
    return TERMS_OF.format(split=split)


_F = {"subject": 10, "body": 3, "path": 2}
_freq = " + ".join(f"{w} * (len(list_filter(w_{c}, lambda x: x = q)) + CAST(list_contains(t_{c}, q) AS INTEGER))" for c, w in _F.items())
BM25 = f"""k AS (SELECT *, {", ".join(f"{_terms(c)} AS t_{c}, {WORDS.format(c=c)} AS w_{c}" for c in _F)}, {_terms("regexp_replace(path, '[/._-]', ' ', 'g')")} AS opened FROM docs),
lengths AS (SELECT doc_id, {" + ".join(f"len({x}_{c})" for c in _F for x in "wt")} AS length FROM k),
tf AS (SELECT doc_id, q, {_freq} AS tf FROM k, unnest({LIST}) AS u(q)),
st AS (SELECT count(*) AS docs, avg(length) AS mean FROM lengths),
hits AS (SELECT q, count(*) AS n FROM tf WHERE tf > 0 GROUP BY q),
bm AS (SELECT doc_id, sum(greatest(ln((docs - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS bm25
  FROM tf JOIN hits USING (q) JOIN lengths USING (doc_id), st WHERE tf > 0 GROUP BY doc_id)"""
SIGNALS = f"""--, {BM25}, t AS (SELECT doc_id, subject, commit_time, oid, t_subject AS ts, t_body AS tb, list_concat(opened, t_path) AS tp, {LIST} AS q FROM k),
s AS (SELECT doc_id, subject, commit_time, oid, len(list_filter(q, lambda x: list_contains(ts, x))) AS sm, len(list_filter(q, lambda x: list_contains(tp, x))) AS rm,
  len(list_filter(q, lambda x: list_contains(ts, x) OR list_contains(tb, x))) AS cov, len(list_filter(q, lambda x: list_contains(ts, x) OR list_contains(tb, x) OR list_contains(tp, x))) AS ident FROM t),
scored AS (SELECT s.*, coalesce(bm25, 0) AS lex, round(coalesce(bm25, 0) + 1.5 * sm + cov / 4 * 2.0 + rm, 6) AS score,
  CASE WHEN sm > 0 AND rm > 0 THEN 'high' WHEN sm > 0 OR rm > 0 OR cov > 1 OR ident > 1 THEN 'medium' ELSE 'low' END AS confidence FROM s LEFT JOIN bm USING (doc_id) WHERE ident > 0)
"""
BEST = "score DESC, commit_time DESC, oid"


@query(with_views("docs", SIGNALS + "SELECT doc_id, subject, score, CAST(cov AS INTEGER) AS covered, confidence FROM scored ORDER BY " + BEST + " LIMIT 10"))
def text_search_rank(c: Catalog) -> DataFrame:
    return search.search(c.documents, TERMS)


@query(with_views("docs", SIGNALS + "SELECT count(*) AS matched FROM scored"))
def agg_match_count(c: Catalog) -> DataFrame:
    return search.signals(c.documents, TERMS).agg(F.count("*").alias("matched"))


@query(with_views("docs", f"--, {BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM bm"))
def text_bm25(c: Catalog) -> DataFrame:
    return search.bm25(c.documents, TERMS).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query()
def text_tokenize(c: Catalog) -> DataFrame:
    return c.documents.select("doc_id", text.tokens(F.col("subject")).alias("terms"))


@query()
def text_distinctive_signals(c: Catalog) -> DataFrame:
    return c.documents.select("doc_id", text.distinctive_signals(F.col("text")).alias("signals"))


@query(r"SELECT conv_id, turn, regexp_matches(lower(text), '^\s*(revert|rollback|roll back|back out)') AS is_revert, regexp_matches(lower(text), '^\s*(revert|rollback|roll back|back out|fix|correct|restore|follow-up|followup|re-land|reland|re-landed|un-revert)') AS is_corrective FROM conversations")
def text_revert_declarations(c: Catalog) -> DataFrame:
    return c.turns.select("conv_id", "turn", provenance.is_revert_subject(F.col("text")).alias("is_revert"), provenance.is_corrective_subject(F.col("text")).alias("is_corrective"))


@query(
    r"""WITH told AS (SELECT p_partkey, 'Fix ' || p_name || ', see #' || p_partkey || ', (#' || p_size || ') [#' || p_partkey % 9 || ']. x#' || p_size || ' #' || p_partkey || 'b #' || p_partkey AS message FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(message, ' '), lambda x: regexp_extract(x, '^[(\[]?(#[0-9]+)[)\].,;:!?]*$', 1)), lambda x: x <> ''))), ',') AS refs FROM told"""
)
def text_references(c: Catalog) -> DataFrame:
    """Issue references of messages about parts."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    nine = (F.col("p_partkey") % 9).cast("string")
    message = F.concat(F.lit("Fix "), "p_name", F.lit(", see #"), key, F.lit(", (#"), size, F.lit(") [#"), nine, F.lit("]. x#"), size, F.lit(" #"), key, F.lit("b #"), key)
    return c.table("part").select("p_partkey", F.array_join(provenance.references(message), ",").alias("refs"))


MARKS = " + ".join(f"CAST(contains(lower(subject), '{m.replace(chr(39), chr(39) * 2)}') AS INTEGER)" for m in provenance.CAUSES + provenance.HARMS)


@query(with_views("docs", f"SELECT doc_id, CAST(length(trim(subject)) >= 24 AS INTEGER) + least({MARKS}, 2) AS strength FROM docs"))
def text_explanation_strength(c: Catalog) -> DataFrame:
    return c.documents.select("doc_id", provenance.explanation_strength(F.col("subject")).alias("strength"))


VECTORS = "q AS (SELECT embedding AS e FROM embeddings WHERE vec_id < 3), s AS (SELECT vec_id, round(max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[]))), 6) AS similarity FROM embeddings, q GROUP BY vec_id)"


VECTOR_PAIRS = """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity
  FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"""


def queried(c: Catalog) -> DataFrame:
    return c.vectors.where("vec_id < 3").select("embedding")


@query(
    with_views(
        "docs",
        SIGNALS.rstrip()
        + f""", {VECTORS}, a AS (SELECT doc_id, row_number() OVER (ORDER BY {BEST}) AS lr FROM (SELECT * FROM scored ORDER BY {BEST} LIMIT 100)),
b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS sr FROM (SELECT * FROM s2 ORDER BY similarity DESC, vec_id LIMIT 100))
SELECT doc_id, CAST(lr AS INTEGER) AS lexical_rank, CAST(sr AS INTEGER) AS semantic_rank, round(coalesce(1 / (60 + lr), 0) + coalesce(1 / (60 + sr), 0), 8) AS score
FROM a FULL JOIN b USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10""".replace(", s AS (SELECT vec_id", ", s2 AS (SELECT vec_id"),
    )
)
def hybrid_rrf(c: Catalog) -> DataFrame:
    return search.hybrid(c.documents, c.vectors, TERMS, queried(c))


@query(VECTOR_PAIRS)
def vec_topk_cosine(c: Catalog) -> DataFrame:
    """The ten best for each vector whose id is divisible by 100, itself left out."""
    return search.nearest(c.vectors, c.vectors.where("vec_id % 100 = 0"), 10)


@query("SELECT sha256(text) AS fingerprint, min(doc_id) AS representative, count(*) AS members FROM documents GROUP BY 1 HAVING count(*) > 1")
def agg_patch_groups(c: Catalog) -> DataFrame:
    return c.documents.groupBy(F.sha2("text", 256).alias("fingerprint")).agg(F.min("doc_id").alias("representative"), F.count("*").alias("members")).where("members > 1")


@query("SELECT a.doc_id, min(b.doc_id) AS equivalent FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id <> b.doc_id GROUP BY a.doc_id")
def patch_equivalent(c: Catalog) -> DataFrame:
    """The least other document with the same text: the hash shortlists, the text decides. Groups are reduced to their two least ids, not paired."""
    d = c.documents.select("doc_id", "text", F.sha2("text", 256).alias("h"))
    two = d.groupBy("h").agg(F.min("doc_id").alias("first"), F.slice(F.sort_array(F.collect_set("doc_id")), 1, 2).alias("ids")).where(F.size("ids") > 1)
    return d.join(two, "h").select("doc_id", F.when(F.col("doc_id") == F.col("first"), F.get("ids", F.lit(1))).otherwise(F.col("first")).alias("equivalent"))


UNDONE = r"^\s*(revert|rollback|roll back|back out)"


@query(
    with_views(
        "changes paths docs",
        SIGNALS.rstrip()
        + rf""", own AS (SELECT commit_id AS doc_id, path FROM paths WHERE commit_id IN (SELECT doc_id FROM scored)), sized AS (SELECT doc_id, count(*) AS n FROM own GROUP BY doc_id),
met AS (SELECT DISTINCT doc_id FROM (SELECT a.doc_id, b.doc_id AS other FROM own a JOIN own b ON a.path = b.path AND a.doc_id <> b.doc_id JOIN sized z ON z.doc_id = a.doc_id AND z.n BETWEEN 2 AND 12
  GROUP BY 1, 2 HAVING count(*) >= 2)),
f AS (SELECT s.doc_id, s.commit_time, s.oid, sha256(d.text) AS h, round(round(lex + 1.5 * sm + ident / 4 * 2.0 + rm, 6) + CASE WHEN s.doc_id IN (SELECT doc_id FROM met) THEN 2.0 ELSE 0 END
  - CASE WHEN regexp_matches(lower(s.subject), '{UNDONE}') THEN 8.0 ELSE 0 END, 6) AS sc FROM scored s JOIN docs d USING (doc_id)),
g AS (SELECT h, arg_min(doc_id, (-sc, -commit_time, oid)) AS representative, max(sc) AS score, count(*) AS members FROM f GROUP BY h)
SELECT representative, score, members FROM g JOIN docs ON doc_id = representative ORDER BY score DESC, commit_time DESC, oid LIMIT 10""",
    )
)
def examples_rank(c: Catalog) -> DataFrame:
    """Precedents: the whole pool by identified coverage and its adjustments, grouped by equal patches before the limit."""
    undone = c.documents.where(provenance.is_revert_subject(F.col("subject"))).select("doc_id")
    found = search.precedents(c.documents, TERMS, c.paths.select(F.col("commit_id").alias("doc_id"), "path"), undone)
    ranked = found.join(c.documents.select("doc_id", F.sha2("text", 256).alias("fingerprint")), "doc_id")
    return patches.groups(ranked).orderBy(*search.ranked()).limit(10).select("representative", "score", "members")


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def join_containment(c: Catalog) -> DataFrame:
    """Benchmark texts within documents. Items are few and their count is checked; each document is scanned once for all of them."""
    b = c.table("benchmark").select("item_id", F.col("text").alias("needle"))
    if b.count() > 10_000:
        raise ValueError("too many items to look for in one scan")
    return c.documents.select("doc_id", "text").join(F.broadcast(b), F.contains("text", F.col("needle"))).select("item_id", "doc_id")


@query(
    "WITH e AS (SELECT doc_id, count(*) AS n, max(n_chars) AS m FROM documents GROUP BY doc_id) SELECT d.source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, arg_max(d.doc_id, (n_chars, -d.doc_id)) AS longest FROM documents d GROUP BY d.source".replace(
        "WITH e AS (SELECT doc_id, count(*) AS n, max(n_chars) AS m FROM documents GROUP BY doc_id) ", ""
    )
)
def agg_evidence_by_origin(c: Catalog) -> DataFrame:
    d = c.table("documents")
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("longest"))
