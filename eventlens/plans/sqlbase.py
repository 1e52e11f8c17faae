"""SQL building blocks for the checks: the adapters and rules in DuckDB's dialect.

The archive CTEs restate ``sources.adapters`` relationally; they never build
or parse JSON, so they check the payload round trip as well.
"""

from __future__ import annotations

import re

from eventlens import config
from eventlens.sources import adapters


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def _esc(s: str) -> str:
    """A SQL literal that may hold newlines."""
    return " || chr(10) || ".join(lit(p) for p in s.split("\n"))


def signal_sql(column: str, kind: str, value: str) -> str:
    if kind == "equals":
        return f"{column} = {lit(value)}"
    if kind == "phrase":
        value = r"(?i)\b" + r"[^0-9A-Za-z]+".join(w for w in re.split(r"\W+|_", value) if w) + r"\b"
    return f"regexp_matches({column}, {lit(value)})"


def arm_sql(signals) -> str:
    return "(" + " OR ".join(f"coalesce({signal_sql(*s)}, false)" for s in signals) + ")"


def case_sql(rules, default: str | None = None) -> str:
    arms = " ".join(f"WHEN {arm_sql(sig)} THEN {lit(label)}" for label, sig in rules)
    return f"CASE {arms} ELSE {lit(default) if default else 'NULL'} END"


def tool_sql(tool: str) -> str:
    return arm_sql(dict(config.TOOL_RULES)[tool])


def needle_sql(needles) -> str:
    """Whether any text that went into the payload holds a needle."""
    hay = "concat_ws(chr(1), message, author_name, author_email)"
    return "(" + " OR ".join(f"contains({hay}, {lit(n)})" for n in needles) + ")"


_TRAILERS = "[" + ", ".join(_esc(t) for t in adapters.TRAILERS) + "]"

# one row per document line, before any filter
DOC_LINES = f"""
doc_lines AS (
  SELECT doc_id, lang, source, pos, line, doc_id * 31 + pos * 7 AS k
  FROM (SELECT doc_id, lang, source,
               unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
        FROM documents)
),
doc_commits AS (
  SELECT doc_id, pos, k,
         TIMESTAMP '2025-01-01' + to_hours(CAST((doc_id * 37) % 12000 AS INTEGER)) AS created_at,
         'PushEvent' AS type,
         CASE WHEN doc_id % 37 = 0 THEN 'devin-ai-integration'
              WHEN doc_id % 37 = 1 THEN 'google-labs-jules[bot]'
              ELSE 'dev-' || ((doc_id * 7) % 211) END AS login,
         lang || '/' || source || '-' || (doc_id % 13) AS repo_name,
         doc_id || ':' || pos AS sha,
         CASE WHEN line <> '' THEN
           (CASE WHEN k % 7 = 1 THEN {sql_list(adapters.PREFIXES)}[((k // 7) % {len(adapters.PREFIXES)}) + 1] ELSE '' END)
           || line ||
           (CASE WHEN k % 5 = 0 THEN {_TRAILERS}[((k // 5) % {len(adapters.TRAILERS)}) + 1] ELSE '' END)
         END AS message,
         CASE WHEN k % 89 = 0 THEN 'Devin-AI bot' ELSE 'dev ' || (k % 97) END AS author_name,
         CASE WHEN k % 41 = 0 THEN {sql_list(adapters.EMAILS)}[((k // 41) % {len(adapters.EMAILS)}) + 1]
              WHEN k % 41 <> 1 THEN 'dev' || (k % 97) || '@example.org' END AS author_email
  FROM doc_lines
)"""


def commits_cte(needles=None, push_only: bool = True) -> str:
    """WITH clause ending in ``commits``; ``needles`` applies the payload pre-filter."""
    where = ["type = 'PushEvent'"] if push_only else []
    if needles:
        where.append(f"doc_id IN (SELECT doc_id FROM doc_commits WHERE {needle_sql(needles)})")
    cond = f" WHERE {' AND '.join(where)}" if where else ""
    return f"WITH {DOC_LINES},\ncommits AS (SELECT * FROM doc_commits{cond})\n"


def _repo(cust: str, key: str) -> str:
    return (f"CASE WHEN {key} % 3 = 0 THEN 'hot/repo' ELSE 'team/repo-' || "
            f"(({cust} * {cust} + {key} % 5) % 197) END")


ORDER_REPO = _repo("o_custkey", "o_orderkey")

ORDER_PUSHES = f"""
order_pushes AS (
  SELECT o_orderkey, o_orderdate AS created_at, 'user-' || o_custkey AS login, {ORDER_REPO} AS repo_name
  FROM orders WHERE o_orderstatus <> 'P'
)"""

SIZED_PUSHES = f"""{ORDER_PUSHES},
sized AS (
  SELECT p.*, n_lines AS size
  FROM order_pushes p LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) l
    ON p.o_orderkey = l.l_orderkey
)"""

REPO_LANGUAGES = f"""
repo_language AS (
  SELECT {ORDER_REPO} AS repo_name,
         {sql_list(adapters.LANGUAGES)}[CAST(substr(p_brand, 7) AS INTEGER) % {len(adapters.LANGUAGES)} + 1] AS language,
         sum(CAST(l_quantity AS BIGINT))::BIGINT AS bytes
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  GROUP BY 1, 2
)"""

YM = "CAST(year(created_at) AS INTEGER) AS year, CAST(month(created_at) AS INTEGER) AS month"
YQ = "CAST(year(created_at) AS INTEGER) AS year, CAST(quarter(created_at) AS INTEGER) AS quarter"
