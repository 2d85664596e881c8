"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from lakeline.llm.common import UPPER
from lakeline.llm.url_rules import RULES, SOFT_TERMS, STRICT_TERMS, Vocabulary

LOWER = f"translate({{}}, '{UPPER}', '{UPPER.lower()}')"

ORACLE: dict[str, str] = {}

ORACLE["op4_exact_dedup"] = f"""
WITH d AS (
    SELECT doc_id, sha256({LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents
)
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def _term(term: str) -> str:
    return f"CAST(regexp_matches(low, '(^|[^a-z0-9]){term}($|[^a-z0-9])') AS INTEGER)"


def _rules() -> str:
    rows = []
    for rule, verdict in RULES.items():
        host, slash, path = rule.partition("/")
        rows.append(f"('{rule}', '{verdict}', '{host}', '{slash}{path}')")
    return ", ".join(rows)


ORACLE["op2_url_filter"] = f"""
WITH u AS (
    SELECT page_id, url, {LOWER.format("coalesce(url, '')")} AS low,
           CASE WHEN strpos(url, '://') > 0
                THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), p AS (
    SELECT page_id, low, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM u
), h AS (
    SELECT *, {" + ".join(map(_term, STRICT_TERMS))} AS strict_hits,
           {" + ".join(map(_term, SOFT_TERMS))} AS soft_hits
    FROM p
), r AS (SELECT * FROM (VALUES {_rules()}) AS t(rule, says, rule_host, rule_path)),
fits AS (
    SELECT h.*, r.rule, r.says,
           row_number() OVER (PARTITION BY page_id, low
                              ORDER BY length(rule) DESC, length(rule_host) DESC) AS place
    FROM h LEFT JOIN r
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule,
       coalesce(says, CASE WHEN strict_hits > 0 OR soft_hits >= {Vocabulary().soft_limit}
                           THEN 'block' ELSE 'allow' END) AS verdict,
       strict_hits, soft_hits
FROM fits WHERE place = 1
"""

ORACLE["op1_exact_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS whole
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_inner_product(q.whole, c.whole) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
