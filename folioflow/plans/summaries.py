"""Tallies, rankings, sets, ordered sequences and incremental diffs."""

from __future__ import annotations

from .dual import Book

B = Book()

# Aggregations
B.dual("source_histogram", "SELECT coalesce(nullif(source, ''), 'unknown') AS source, count(*) AS n FROM {documents} GROUP BY 1", "documents")
B.dual("score_summary", r"""
SELECT count(*) AS n, avg(CAST(quality AS DOUBLE)) AS mean_quality, count(CASE WHEN quality >= 1 THEN 1 END) AS n_good, 100.0 * count(CASE WHEN toxic = 1 THEN 1 END) / count(*) AS toxic_pct FROM {labels}
""", "labels")
B.dual("status_counts", r"""
SELECT o_orderstatus AS status, o_orderpriority AS kind, count(*) AS n, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS n_large FROM {orders} GROUP BY 1, 2
""", "orders")
B.dual("field_coverage", r"""
SELECT source, count(*) AS n, count(nullif(trim(doi), '')) AS with_doi, count(nullif(trim(journal), '')) AS with_journal, count(nullif(trim(abstract), '')) AS with_abstract FROM {works} GROUP BY 1
""")
B.dual("page_metrics", r"""
SELECT page_id, length(html) AS n_chars, (length(html) - length(replace(html, '<table', ''))) / 6 >= 1 AS has_table, (length(html) - length(replace(html, '<img', ''))) / 4 >= 1 AS has_image,
       CASE WHEN length(html) < 50 THEN 'scanned' WHEN html LIKE '%<sup%' THEN 'footnotes' WHEN html LIKE '%<math%' THEN 'formulas' WHEN html LIKE '%<table%' THEN 'tables'
            WHEN length(html) > 500 THEN 'simple' ELSE 'uncertain' END AS class FROM {pages}
""", "pages")
B.dual("html_title", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(html, r'<[^>]*>', ' '/*g*/), r'\s+', ' '/*g*/)) AS stripped, regexp_extract(html, r'<title>([^<]*)</title>', 1) AS title FROM {pages}
""", "pages")
B.dual("marker_counts", r"""
SELECT doc_id, (length(text) - length(replace(text, '$$', ''))) / 2 AS n_math, (length(text) - length(replace(text, '|', ''))) AS n_pipe, (length(text) - length(replace(text, '&', ''))) AS n_amp,
       length(text) - length(replace(text, '{{', '')) - length(text) + length(replace(text, '}}', '')) AS brace_balance FROM {documents}
""", "documents")

# Rankings
B.dual("top_seeds", r"""
SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey % 2 = 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20
""", "orders")
B.dual("score_filter_rank", "SELECT doc_id, score, title FROM {works} WHERE score >= 4")
B.dual("winner_rank", r"""
SELECT doc_id, doi_key, rn FROM (
  SELECT doc_id, doi_key, row_number() OVER (PARTITION BY doi_key ORDER BY tier, abs_len DESC, filled DESC, doc_id) AS rn FROM (
    SELECT doc_id, regexp_replace(lower(trim(regexp_replace(trim(doi), r'^https?://doi[.]org/', ''))), r'[/.]+$', '') AS doi_key, length(abstract) AS abs_len,
           CASE WHEN lower(journal) LIKE '%working paper%' THEN 2 WHEN lower(journal) LIKE '%forthcoming%' THEN 1 ELSE 0 END AS tier,
           CASE WHEN journal <> '' THEN 1 ELSE 0 END + CASE WHEN abstract <> '' THEN 1 ELSE 0 END AS filled FROM {works}) x WHERE doi_key <> '') y WHERE rn = 1
""")
B.dual("batches_of_25", r"""
SELECT lang, doc_id, CAST(floor((row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1) / 25) AS BIGINT) AS batch FROM {documents}
""", "documents")
B.dual("cite_key_suffix", r"""
SELECT doc_id, base, CASE WHEN rn = 1 THEN base WHEN rn <= 26 THEN concat(base, chr(CAST(96 + rn AS INT))) ELSE concat(base, CAST(rn AS STRING)) END AS cite_key FROM (
  SELECT doc_id, base, row_number() OVER (PARTITION BY base ORDER BY score DESC, doc_id) AS rn FROM (
    SELECT doc_id, score, concat('Roe', doc_id % 5, regexp_extract(year, r'(19|20)[0-9]{{2}}', 0), regexp_extract(lower(title), r'[a-z]{{4,}}', 0)) AS base FROM {works} WHERE score >= 4) x) y
""")

# Sets
B.dual("title_dedup_first", r"""
SELECT doc_id, title_key FROM (SELECT doc_id, title_key, row_number() OVER (PARTITION BY title_key ORDER BY doc_id) AS rn FROM (SELECT doc_id, trim(regexp_replace(lower(title), r'\s+', ' '/*g*/)) AS title_key FROM {works}) x) y WHERE rn = 1
""")
B.dual("dangling_keys", "SELECT DISTINCT l_partkey AS part_key FROM {lineitem} l LEFT ANTI JOIN (SELECT p_partkey FROM {part} WHERE p_size > 25) p ON l.l_partkey = p.p_partkey", "lineitem", "part")
B.sql["dangling_keys"] = "SELECT DISTINCT l_partkey AS part_key FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)"
B.dual("incremental_diff", "SELECT doc_id FROM {documents} EXCEPT SELECT doc_id FROM {labels}", "documents", "labels")
B.dual("resume_pending", r"""
SELECT d.doc_id FROM {documents} d LEFT JOIN (SELECT doc_id FROM {labels} WHERE quality > 0 AND toxic = 0) done ON d.doc_id = done.doc_id WHERE done.doc_id IS NULL
""", "documents", "labels")
B.dual("ttl_cache", "SELECT event_id, user_id, value FROM {events} WHERE ts > (SELECT max(ts) - INTERVAL 24 HOURS FROM {events})", "events")
B.dual("outage_guard", r"""
WITH st AS (SELECT doc_id, CASE WHEN doc_id % 10 < 2 THEN 'error' WHEN doc_id % 7 = 0 THEN 'unverified' ELSE 'verified' END AS status FROM {documents})
SELECT doc_id, status FROM st WHERE (SELECT avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END) FROM st) > 0.3 OR status <> 'unverified'
""", "documents")

# Ordered sequences: a user's events stand for a text's footnotes, the event type for the cited work.
_NOTES = "(SELECT user_id, event_id, event_type AS work, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS fn FROM {events})"
B.dual("short_forms", rf"""
SELECT user_id, fn, CASE WHEN fn = first_fn THEN 'full' WHEN prev = work THEN 'Id.' ELSE concat('supra note ', CAST(first_fn AS STRING)) END AS form FROM (
  SELECT user_id, fn, work, min(fn) OVER (PARTITION BY user_id, work) AS first_fn, lag(work) OVER (PARTITION BY user_id ORDER BY fn) AS prev FROM {_NOTES} x) y
""", "events")
B.dual("work_registry", rf"""
SELECT user_id, work, min(fn) AS first_fn, count(*) AS n_cites, count(*) > 1 AS repeated FROM {_NOTES} x GROUP BY user_id, work
""", "events")
B.dual("same_author_conflict", rf"""
SELECT user_id, count(DISTINCT work) AS n_works, count(DISTINCT work) > 1 AS conflict FROM {_NOTES} x GROUP BY user_id
""", "events")
B.dual("adjacent_islands", rf"""
SELECT user_id, work, min(fn) AS first_fn, count(*) AS n FROM (
  SELECT user_id, work, fn, fn - row_number() OVER (PARTITION BY user_id, work ORDER BY fn) AS island FROM {_NOTES} x) y GROUP BY user_id, work, island HAVING count(*) >= 2
""", "events")
B.dual("running_counters", r"""
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ord, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS n_user,
       lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM {conversations}
""", "conversations")

QUERIES, SQL = B.queries, B.sql
