"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item, w, least(len(w), 8) AS n FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM sized, unnest(range(1, len(w) - n + 2)) AS t(i)),
there AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM sized) AS lengths, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT r, i, there.n AS n, item FROM there JOIN windows ON there.n = windows.n AND there.g = windows.g),
found AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS names FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN found USING (r) LEFT JOIN items USING (r)
"""

ORACLES: dict[str, str] = {"op1_decontaminate": OP1}

OP5 = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
one AS (SELECT w, count(*) AS c FROM (SELECT unnest(w) AS w FROM t) GROUP BY w),
n AS (SELECT sum(c) AS n FROM one),
pos AS (SELECT r, i, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS u FROM t, unnest(range(1, len(w) + 1)) AS x(i)),
two AS (SELECT u, w, count(*) AS c FROM pos WHERE u IS NOT NULL GROUP BY u, w HAVING count(*) >= 2),
scored AS (SELECT r, CASE WHEN two.c IS NOT NULL THEN ln(two.c / cu.c) WHEN pos.u IS NULL THEN ln(cw.c / n) ELSE ln(0.4) + ln(cw.c / n) END AS s
  FROM pos JOIN one cw ON cw.w = pos.w LEFT JOIN two ON two.u = pos.u AND two.w = pos.w LEFT JOIN one cu ON cu.w = pos.u, n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(m, 6) AS log_score FROM t LEFT JOIN (SELECT r, avg(s) AS m FROM scored GROUP BY r) USING (r)
"""


def _op8() -> str:
    from palimpsest.llm.license_texts import SPELLINGS, TEXTS

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    low = r"regexp_replace(lower(coalesce(text, '')), '(?m)^[^\p{L}\n©]*(?:\(c\)|©|copyright\b|all rights reserved)[^\n]*$', '', 'g')"
    shaped = rf"' ' || regexp_replace(regexp_replace({low}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), ' ?\n ?', e' \n ', 'g') || ' '"
    for other, usual in SPELLINGS.items():
        shaped = f"replace({shaped}, ' {other} ', ' {usual} ')"
    whole = r"sha256(trim(regexp_replace(c, '[ \n]+', ' ', 'g')))"
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in TEXTS.items())
    return f"""
WITH k AS (SELECT {whole} AS digest, min(license_id) AS license_id FROM (SELECT license_id, {shaped} AS c FROM (VALUES {known}) AS v(license_id, text)) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {shaped} AS c FROM documents),
g AS (SELECT r, doc_id, c, {whole} AS digest FROM d),
p AS (SELECT DISTINCT r, one FROM (SELECT r, digest AS one FROM g UNION ALL SELECT r, sha256(trim(unnest(string_split(c, chr(10))))) FROM g) WHERE one <> sha256('')),
s AS (SELECT r, list_sort(list_distinct(list(license_id))) AS statements FROM p JOIN k ON k.digest = one GROUP BY r)
SELECT doc_id, g.digest, license_id, coalesce(statements, []) AS statements, statements IS NOT NULL AS licensed FROM g LEFT JOIN k ON k.digest = g.digest LEFT JOIN s USING (r)
"""


def _op9() -> str:
    from palimpsest.llm.rules import DELTA, GRIDS, RATE

    grids = ", ".join(f"({i}, {list(g)})" for i, g in enumerate(GRIDS.values()))
    p = RATE / len(GRIDS)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS text,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM t, unnest(range(1, len(w) - 3)) AS x(i)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT p) AS k FROM twice, unnest(range(i, i + 5)) AS x(p) GROUP BY r),
f AS (SELECT r, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(k, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines FROM t LEFT JOIN rep USING (r)),
b AS (SELECT *, coalesce(word_chars, 0) AS wc, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
v AS (SELECT *, [n_symbols / greatest(n_words, 1), n_repeat_words / greatest(n_words, 1), n_dup_lines / greatest(n_lines, 1), wc / greatest(n_words, 1), -(wc / greatest(n_words, 1))] AS vals FROM b),
good AS (SELECT stratum, vals FROM v JOIN labels USING (doc_id) WHERE quality = 1 AND NOT base_failed),
grid AS (SELECT rule, j, g[j] AS cut FROM (VALUES {grids}) AS x(rule, g), unnest(range(1, len(g) + 1)) AS y(j)),
tests AS (SELECT stratum, rule, j, cut, count(*) AS n, count(*) FILTER (vals[rule + 1] > cut) AS k FROM good, grid GROUP BY ALL),
tails AS (SELECT *, CASE WHEN k >= n * {p} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))) FROM range(0, k + 1) AS z(i)) END AS tail FROM tests),
held AS (SELECT *, bool_and(tail <= {DELTA} / ({len(GRIDS)} * (SELECT greatest(count(DISTINCT stratum), 1) FROM good))) OVER (PARTITION BY stratum, rule ORDER BY j) AS ok FROM tails),
cuts AS (SELECT stratum, rule, arg_max(cut, j) AS cut FROM held WHERE ok GROUP BY stratum, rule),
over AS (SELECT DISTINCT r FROM v JOIN cuts USING (stratum) WHERE vals[rule + 1] > cut)
SELECT doc_id, n_words, wc AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM over) AS kept FROM v
"""


ORACLES |= {"op5_backoff": OP5, "op8_licenses": _op8(), "op9_risk_rules": _op9()}


ORACLES["op12_url_rules"] = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
ruled AS (SELECT p.page_id, p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id, p.host, p.path)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, 'casino|pills|-bets|adult-|spam-|ads-') THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
"""
