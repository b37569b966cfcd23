"""SQL for the queries of this subpackage that SQL can express, for DuckDB on the same tables.

The others rest on things that SQL has not: trained classifiers and models, a tokenizer's merges, XXH64 with a seed,
or zstandard. Tests hold those against brute force.
"""

from __future__ import annotations

from pulsegrid.llm.decontamination import WINDOW
from pulsegrid.llm.secret_scan import ASSIGN, ENDPOINT, IDENTIFIER, NAMES, REACH
from pulsegrid.llm.url_filter import RULES, SOFT, SOFT_LIMIT, STRICT

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


URLS = rf"""WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_values([(r.host, r.path, r.verdict) for r in RULES])}),
terms(term, kind) AS (VALUES {_values([(t, "strict") for t in STRICT] + [(t, "soft") for t in SOFT])}),
cut AS (
  SELECT row_number() OVER () AS n, page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS low,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
named AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
best AS (
  SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM named JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n),
places AS (SELECT n, low, unnest(range(1, length(low) + 1)) AS p FROM named),
hits AS (
  SELECT n, term, kind FROM places JOIN terms ON substr(low, p, length(term)) = term
  WHERE (p = 1 OR NOT regexp_matches(substr(low, p - 1, 1), '[\p{{L}}\p{{N}}]')) AND NOT regexp_matches(substr(low, p + length(term), 1), '[\p{{L}}\p{{N}}]')),
counted AS (SELECT n, count(*) FILTER (WHERE kind = 'strict') AS n_strict, count(DISTINCT term) FILTER (WHERE kind = 'soft') AS n_soft FROM hits GROUP BY n)
SELECT page_id, host, path, rule,
  CASE WHEN rule IS NOT NULL THEN rule_verdict WHEN coalesce(n_strict, 0) > 0 OR coalesce(n_soft, 0) >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(n_strict, 0) AS n_strict, coalesce(n_soft, 0) AS n_soft
FROM named LEFT JOIN best USING (n) LEFT JOIN counted USING (n)"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""WITH items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), {WINDOW}) AS size FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS key FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
docs AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT n, size, i, array_to_string(w[i : i + size - 1], ' ') AS key FROM (
  SELECT n, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM sized) WHERE len(w) >= size)),
found AS (SELECT n, size, i, item FROM places JOIN windows USING (size, key)),
covered AS (SELECT n, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT n, unnest(range(i, i + size)) AS j FROM found) GROUP BY n),
listed AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT n, item FROM found WHERE item IS NOT NULL) GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (n) LEFT JOIN listed USING (n)"""

_RUN = "[A-Za-z0-9+/_=-]+"  # DuckDB's patterns can't look around: a token is a whole run of its characters
_SECRET_KINDS = [
    (ASSIGN, "length(regexp_extract(m, pattern, 1)) >= 6"), ("AKIA[A-Z0-9]+", "length(m) >= 20"), ("[0-9a-f]{24,}", "true"), (IDENTIFIER.replace("{4,}+", "{4,}"), "true"),
    (_RUN, "regexp_full_match(m, '[A-Za-z0-9+/_-]{20,}={0,2}') AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')"),
    (ENDPOINT.replace(r"\s", r"\x09-\x0D\x20"), "true"),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _found(kind: int, pattern: str, keep: str) -> str:
    cut = f"SELECT n, regexp_extract_all(t, {_quoted(pattern)}) AS ms, string_split_regex(t, {_quoted(pattern)}) AS gaps FROM docs"
    rows = f"SELECT n, unnest(range(len(ms))) AS nth, unnest(ms) AS m, unnest(gaps[1 : len(ms)]) AS gap FROM ({cut})"
    ends = f"SELECT n, m, sum(length(gap) + length(m)) OVER (PARTITION BY n ORDER BY nth)::BIGINT AS e FROM ({rows})"
    return f"SELECT n, {kind} AS kind, e - length(m) AS s, e FROM (SELECT *, {_quoted(pattern)} AS pattern FROM ({ends})) WHERE {keep}"


def _near(kinds: str, far: int) -> str:
    return f"EXISTS (SELECT 1 FROM {{}} q WHERE q.n = p.n AND q.kind IN ({kinds}) AND (q.kind, q.s, q.e) <> (p.kind, p.s, p.e) AND q.s < p.e + {far} AND q.e > p.s - {far})"


_LABEL = "['" + "','".join(NAMES) + "'][kind + 1] || ':' || s || ':' || e"
SECRETS = f"""WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
parts AS MATERIALIZED ({" UNION ALL ".join(_found(k, *kind) for k, kind in enumerate(_SECRET_KINDS))}),
candidates AS MATERIALIZED (
  SELECT * FROM parts p WHERE NOT (kind IN (3, 4) AND {_near("0, 1, 2, 5", 0).format("parts")}) AND NOT (kind = 4 AND {_near("3", 0).format("parts")})),
reported AS (
  SELECT * FROM candidates p WHERE kind <= 2 OR (kind = 3 AND {_near("0, 2, 4", REACH + 1).format("candidates")})
    OR (kind = 4 AND {_near("1, 3", REACH + 1).format("candidates")})
    OR (kind = 5 AND {_near("0, 2, 4", REACH + 1).format("candidates")} AND {_near("1, 3", REACH + 1).format("candidates")})),
summed AS (
  SELECT n, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    count(*) FILTER (WHERE kind > 2) AS n_linked, string_agg({_LABEL}, ',' ORDER BY s, kind) FILTER (WHERE kind <= 2) AS base, string_agg({_LABEL}, ',' ORDER BY s, kind) AS spans
  FROM reported GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM docs LEFT JOIN summed USING (n)"""

ORACLE_SQL = {"op2_secrets": SECRETS, "op5_urls": URLS, "op6_decontamination": DECONTAMINATION}
