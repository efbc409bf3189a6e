"""Building blocks of the SQL twins, in DuckDB's dialect. Written independently of the column expressions."""

from __future__ import annotations

from ..functions.text import SPACE, STOP_WORDS

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    x = f"regexp_replace({x}, {q('```[a-z]*' + chr(92) + 'n?')}, ' ', 'gi')"
    x = f"regexp_replace({x}, {q('(?s)<!--.*?-->')}, ' ', 'g')"
    x = f"regexp_replace({x}, {q(r'!?\[([^\]]*)\]\([^)]*\)')}, {q(chr(92) + '1')}, 'g')"
    return f"regexp_replace({x}, {q('https?://[^' + SPACE + ']+')}, ' ', 'g')"


def expand(t: str) -> str:
    humps = f"regexp_replace(regexp_replace({t}, '([a-z0-9])([A-Z])', {q(r'\1 \2')}, 'g'), '([A-Z]+)([A-Z][a-z])', {q(r'\1 \2')}, 'g')"
    parts = f"list_filter(regexp_split_to_array({humps}, {q(r'[\s_.\-/]+')}), lambda p: length(p) > 2)"
    return f"CASE WHEN len({parts}) > 1 THEN list_concat([{t}], {parts}) ELSE [{t}] END"


def tokens(x: str) -> str:
    rough = f"regexp_extract_all({strip(f'coalesce({x}, {q(chr(32))})')}, {q(r'([A-Za-z_][A-Za-z0-9_.\-/]*|\d+\.\d+\.\d+)')}, 1)"
    flat = f"flatten(list_transform({rough}, lambda r: {expand('r')}))"
    low = f"list_transform({flat}, lambda t: lower(t))"
    return f"list_filter({low}, lambda t: length(t) BETWEEN 3 AND 40 AND t NOT IN ({STOP}) AND NOT regexp_full_match(t, {q(r'\d+')}))"


def norm_title(x: str) -> str:
    cut = f"regexp_replace({x}, {q(r'^\w+(\([^)]*\))?:[' + SPACE + ']*')}, '')"
    return f"regexp_replace(lower({cut}), {q('^[' + SPACE + ']+|[' + SPACE + ']+$')}, '', 'g')"


def stamp(x: str) -> str:
    return f"(epoch_ms({x}))"


#: Documents as items: first line title, the rest body; files, times and states from orders of the same number.
ITEMS = """
raw_items AS (
  SELECT doc_id AS number, CASE WHEN doc_id % 2 = 0 THEN 'ISSUE' ELSE 'PR' END AS kind,
         split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS body, source AS author
  FROM documents
), order_files AS (
  SELECT l_orderkey AS number, list(DISTINCT p_type || '/' || p_brand || '/' || l_partkey ORDER BY p_type || '/' || p_brand || '/' || l_partkey) AS files
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey
), items AS (
  SELECT r.number, r.kind, r.title, r.body, r.author,
         CASE o.o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN CASE WHEN r.kind = 'PR' THEN 'MERGED' ELSE 'CLOSED' END ELSE 'CLOSED' END AS state,
         CASE WHEN r.kind = 'PR' THEN o.o_orderstatus IS NOT DISTINCT FROM 'F' END AS merged,
         o.o_orderdate AS created, CASE WHEN r.kind = 'PR' THEN coalesce(f.files, []) END AS files
  FROM raw_items r LEFT JOIN orders o ON o.o_orderkey = r.number LEFT JOIN order_files f ON f.number = r.number
)"""

#: Orders as pull requests with sets of changed files.
PRS = """
prs AS (
  SELECT o_orderkey AS number, o_custkey AS author, o_orderdate AS created,
         CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'MERGED' ELSE 'CLOSED' END AS state,
         list(DISTINCT p_type || '/' || p_brand || '/' || l_partkey) FILTER (l_partkey IS NOT NULL) AS files
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey
  GROUP BY o_orderkey, o_custkey, o_orderdate, o_orderstatus
), pr_files AS (
  SELECT number, unnest(files) AS file FROM prs
), pr_sizes AS (
  SELECT number, count(*) AS n FROM pr_files GROUP BY number
)"""


def index(source: str = "raw_items") -> str:
    """CTEs post(number, term, tf), lens(number, len), df(term, df), stats(n, total_len, avg_len)."""
    return f"""
tok AS (SELECT number, {tokens('title')} AS t, {tokens('body')} AS b FROM {source}),
lens AS (SELECT number, CAST(3 * len(t) + len(b) AS BIGINT) AS len FROM tok),
post AS (
  SELECT number, term, CAST(sum(w) AS BIGINT) AS tf
  FROM (SELECT number, unnest(t) AS term, 3 AS w FROM tok UNION ALL SELECT number, unnest(b), 1 FROM tok) GROUP BY number, term
),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
stats AS (SELECT count(*) AS n, CAST(sum(len) AS BIGINT) AS total_len, sum(len)::DOUBLE / greatest(1, count(*)) AS avg_len FROM lens)"""


def bm25(queries: str, k: int) -> str:
    """CTE lexical(qid, number, rnk, raw); ``queries`` has qid, exclude, title, body."""
    return f"""
qterms AS (SELECT DISTINCT qid, exclude, unnest(list_concat({tokens('title')}, {tokens('body')})) AS term FROM {queries}),
lexical AS (
  SELECT * FROM (
    SELECT qid, number, raw, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, number) AS rnk FROM (
      SELECT qid, p.number, round(sum(greatest(0.01::DOUBLE, ln(1 + (s.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)))
             * (p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * l.len / s.avg_len)))), 9) AS raw
      FROM qterms q JOIN post p USING (term) JOIN df d USING (term) JOIN lens l ON l.number = p.number CROSS JOIN stats s
      WHERE p.number IS DISTINCT FROM q.exclude GROUP BY qid, p.number
    ) WHERE raw > 0
  ) WHERE rnk <= {k}
)"""


def files(queries: str, have: str, sizes: str, k: int) -> str:
    """CTE overlap(qid, number, rnk, raw); ``queries`` has qid, exclude, files."""
    return f"""
qfiles AS (SELECT qid, exclude, unnest(list_distinct(files)) AS file FROM {queries}),
qsizes AS (SELECT qid, count(*) AS n FROM qfiles GROUP BY qid),
overlap AS (
  SELECT * FROM (
    SELECT qid, number, raw, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, number) AS rnk FROM (
      SELECT q.qid, h.number, round(count(*)::DOUBLE / (max(z.n) + max(s.n) - count(*)), 9) AS raw
      FROM qfiles q JOIN {have} h USING (file) JOIN qsizes z USING (qid) JOIN {sizes} s ON s.number = h.number
      WHERE h.number IS DISTINCT FROM q.exclude GROUP BY q.qid, h.number
    )
  ) WHERE rnk <= {k}
)"""


def fused(parts: dict[str, str], k: int) -> str:
    """CTE fused(qid, number, fused, rnk, bm25_rank, embed_rank, files_rank) of ranked lists by retriever."""
    order = {"bm25": 0, "embed": 1, "files": 2}
    rows = " UNION ALL ".join(f"SELECT qid, number, '{name}' AS r, rnk, {order[name]} * 1000000 + rnk AS seen FROM {cte}" for name, cte in parts.items())
    ranks = ", ".join(f"max(CASE WHEN r = '{n}' THEN rnk END) AS {n}_rank" for n in order)
    return f"""
fused AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, seen) AS rnk FROM (
      SELECT qid, number, round(sum(1::DOUBLE / (60 + rnk)), 12) AS fused, min(seen) AS seen, {ranks} FROM ({rows}) GROUP BY qid, number
    )
  ) WHERE rnk <= {k}
)"""
