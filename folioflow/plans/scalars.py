"""Scalar normalizers and classification rules over the works projection and over text lines."""

from __future__ import annotations

from .dual import RAW, Book

B = Book()

B.dual("norm_doi", r"""
SELECT doc_id, regexp_replace(lower(trim(regexp_replace(trim(doi), r'^https?://doi[.]org/', ''))), r'[/.]+$', '') AS doi_key,
       regexp_replace(regexp_replace(regexp_replace(lower(trim(doi)), r'^https://doi[.]org/', ''), r'^http://doi[.]org/', ''), r'^doi:', '') AS doi_plain
FROM {works}
""")
B.dual("doi_extract", r"""
SELECT doc_id, lower(regexp_replace(regexp_extract(doi, r'10[.][0-9]{{4,9}}/[^ ]+', 0), r'[).,;]+$', '')) AS doi_found,
       CASE WHEN regexp_extract(doi, r'10[.][0-9]{{4,9}}/[^ ]+', 0) <> '' THEN concat('https://doi.org/', lower(regexp_replace(regexp_extract(doi, r'10[.][0-9]{{4,9}}/[^ ]+', 0), r'[).,;]+$', ''))) ELSE '' END AS doi_url,
       CASE WHEN doi LIKE '%10.%/%' THEN doi ELSE '' END AS cell_doi
FROM {works}
""")
B.dual("norm_title", r"""
SELECT doc_id, trim(regexp_replace(lower(trim(title)), r'\s+', ' '/*g*/)) AS title_ws,
       regexp_replace(lower(title), r'[^a-z0-9 ]', ''/*g*/) AS title_alnum,
       trim(regexp_replace(regexp_replace(lower(title), r'[^a-z0-9]', ' '/*g*/), r' +', ' '/*g*/)) AS title_words
FROM {works}
""")
B.dual("year_extract", r"""
SELECT doc_id, CAST(nullif(regexp_extract(year, r'(19|20)[0-9]{{2}}', 0), '') AS INT) AS year_int FROM {works}
""")
B.dual("author_flip", r"""
SELECT doc_id, CASE WHEN authors LIKE '%,%' THEN concat(trim(split_part(split_part(authors, ' and ', 1), ',', 2)), ' ', trim(split_part(authors, ',', 1))) ELSE authors END AS first_author,
       CASE WHEN authors LIKE '% and %' THEN authors WHEN authors LIKE '%;%' THEN replace(authors, '; ', ' and ') ELSE authors END AS authors_bibtex
FROM {works}
""")
B.dual("escape_fields", r"""
SELECT doc_id, replace(concat(journal, ' & ', source), '&', r'\&') AS bibtex_value, replace(concat(source, '|', lang), '|', r'\|') AS pipe_value,
       replace(replace(concat('[', source, ']'), '[', r'\['), ']', r'\]') AS inline_value, substr(md5(concat(source, '|', CAST(doc_id AS STRING))), 1, 12) AS cache_key
FROM (SELECT w.*, d.lang FROM {works} w JOIN {documents} d USING (doc_id))
""", "documents")
B.dual("citation_text_rules", r"""
SELECT doc_id, regexp_replace(line, r'[.]$', '') AS no_period, regexp_replace(line, r'[(](Jan|Feb|Mar)[a-z.]* ([0-9]{{4}})[)]', '(x)'/*g*/) AS no_month,
       replace(line, ' & ', ' and ') AS ampersand, replace(line, 'et al.', 'and others') AS others, trim(regexp_replace(line, r'\s+', ' '/*g*/)) AS collapsed,
       CASE WHEN lower(line) LIKE 'id.%' THEN CASE WHEN lower(line) LIKE 'id. at%' THEN 'id_at' ELSE 'id' END
            WHEN line LIKE '%supra%' AND line LIKE '%;%' THEN 'multi_with_supra' WHEN line LIKE '%supra%' THEN 'supra' WHEN line LIKE '%@%' THEN 'contact'
            WHEN line LIKE '%;%' THEN 'multi_cite' WHEN regexp_extract(line, r'[0-9]', 0) = '' THEN 'discursive' ELSE 'citation' END AS class
FROM (SELECT doc_id, concat(CASE doc_id % 7 WHEN 0 THEN 'Id.' WHEN 1 THEN 'Id. at 350.' WHEN 2 THEN 'supra note 1; Smith & Doe' WHEN 3 THEN 'Smith, supra note 2, at 5.'
             WHEN 4 THEN 'Smith et al., 12 J. Widgets 3 (Jan. 2020).' WHEN 5 THEN 'See  generally   discussion.' ELSE 'a@b.c' END) AS line FROM {documents})
""", "documents")
B.dual("label_kinds", r"""
SELECT doc_id, CASE split_part(label, ':', 1) WHEN 'fig' THEN 'Figure' WHEN 'tab' THEN 'Table' WHEN 'eq' THEN 'Equation' ELSE 'Section' END AS kind,
       concat('(', split_part(label, ':', 2), ')') AS eqref, chr(CAST(97 + doc_id % 26 AS INT)) AS alpha, concat('??', label, '??') AS missing
FROM (SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN 'fig' WHEN 1 THEN 'tab' WHEN 2 THEN 'eq' ELSE 'sec' END, ':', doc_id) AS label FROM {documents})
""", "documents")
B.dual("entry_types", r"""
SELECT doc_id, CASE WHEN lower(journal) LIKE '%working paper%' THEN 'techreport' WHEN lower(journal) LIKE '%handbook%' THEN 'incollection' WHEN journal <> '' THEN 'article' ELSE 'unpublished' END AS entry_type,
       CASE WHEN lower(journal) LIKE '%working paper%' OR lower(journal) LIKE '%nber%' THEN 2 WHEN lower(journal) LIKE '%forthcoming%' THEN 1 ELSE 0 END AS tier,
       CASE WHEN trim(abstract) = '' THEN 'none' WHEN length(abstract) < 250 THEN 'snippet' ELSE 'abstract' END AS abstract_type,
       CASE WHEN trim(title) <> '' AND (trim(authors) = '' OR trim(doi) = '' OR trim(journal) = '' OR length(abstract) < 250) THEN TRUE ELSE FALSE END AS needs_enrichment,
       length(title) >= 10 AND trim(doi) = '' AS doi_wanted
FROM {works}
""")
B.dual("detect_source", r"""
SELECT doc_id, CASE WHEN score % 4 = 0 THEN 'undermind' WHEN source LIKE '%1' THEN 'undermind' ELSE coalesce(nullif(source, ''), 'stem') END AS detected,
       coalesce(nullif(doi, ''), concat('urn:', doc_id)) AS url FROM {works}
""")
B.dual("score_filter", r"""
SELECT doc_id, title FROM {works} WHERE trim(title) <> '' AND coalesce(score >= 4, TRUE)
""")


def _lines(columns: str) -> None:
    spark = f"SELECT {columns} FROM (SELECT doc_id, pos AS line_no, line FROM {{documents}} LATERAL VIEW posexplode(split(text, chr(10))) t AS pos, line)"
    duck = f"SELECT {columns} FROM (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
    B.queries["line_classes"] = lambda s, d: s.sql(spark.replace("/*g*/", ""), documents=s.read.parquet(f"{d}/documents.parquet"))
    B.sql["line_classes"] = RAW.sub("'", duck).replace("/*g*/", ", 'g'").replace("{{", "{").replace("}}", "}")


_lines(r"""doc_id, CAST(line_no AS BIGINT) AS line_no, trim(line) = '' AS blank, length(line) <= 26 AND length(line) - length(replace(line, ' ', '')) <= 3 AS fragment,
 length(line) <= 50 AND line NOT LIKE '%|%' AND length(regexp_replace(line, r'[^a-zA-Z0-9]', ''/*g*/)) * 10 < length(line) * 4 AS noise,
 length(line) - length(replace(line, ' ', '')) >= 4 AND regexp_extract(line, r'[.!?]$', 0) <> '' AS sentence,
 line LIKE '#%' OR line LIKE '|%' OR line LIKE '![%' OR line LIKE '>%' OR line LIKE '- %' AS boundary, line LIKE '%|%|%' AS table_row""")

QUERIES, SQL = B.queries, B.sql
