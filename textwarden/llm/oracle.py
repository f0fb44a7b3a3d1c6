"""DuckDB SQL for the queries that SQL can express, over the same whole tables."""

from __future__ import annotations

from .near_dedup import NearDedup
from .quality_rules import BIT, POLICIES, RULES
from .revisits import OP4_SQL

LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def near_dedup_sql(spec: NearDedup) -> str:
    k = spec.shingle
    window = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, {SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, {window} AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM d WHERE len(w) >= {k}) UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {k - 1}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {spec.percent} * (x.n + y.n - i)),
r(id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c ON c.id = d.doc_id LEFT JOIN n USING (doc_id)"""


def quality_rules_sql(policy: str = "v1") -> str:
    bits = " + ".join(f"CASE WHEN {condition} THEN {BIT[name]} ELSE 0 END" for name, condition in RULES.items())
    kept = " OR ".join(f"({RULES[name]})" for name in POLICIES[policy])
    base = " OR ".join(f"({RULES[name]})" for name in POLICIES["base"])
    return rf"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT rid, doc_id, text, regexp_extract_all(text, {SPACED}) AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {SPACED})) AS l FROM t),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS many FROM g), (VALUES (0), (1), (2)) AS ks(k) WHERE many > 1 GROUP BY 1),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
 len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '[A-Za-z]|[^\x00-\x7F]')) AS n_letters, len(l) AS n_lines, len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS n_symbol_words, len(list_filter(w, lambda x: ends_with(x, '!'))) AS n_bang_words FROM d LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed, NOT ({kept}) AS kept, ({bits})::BIGINT AS failures FROM m"""


def decontaminate_sql(window: int = 10) -> str:
    words = lambda column: f"regexp_extract_all({LOWER_SQL.format(f'coalesce({column}, {chr(39) * 2})')}, {ALNUM})"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words('text')} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {words('text')} AS w FROM benchmark),
x AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT item, w, least(len(w), {window}) AS k, unnest(range(1, greatest(len(w) - {window}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT rid, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM x) WHERE len(w) >= k)),
h AS (SELECT rid, i, k, item FROM g JOIN x USING (k, g)),
n AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS j FROM h) GROUP BY 1),
s AS (SELECT rid, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS items FROM h GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (rid) LEFT JOIN s USING (rid)"""


ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": near_dedup_sql(NearDedup(shingle=4)),
    "op4_revisits": OP4_SQL,
    "op5_quality_rules": quality_rules_sql(),
    "op9_decontaminate": decontaminate_sql(),
}
