"""Record queries over a works projection of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import records as R
from folioflow.operators.graph import bfs, connected_components
from folioflow.shared import cut

from .dual import Book, works

B = Book()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def merge_winner_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup on normalized text: the richest row wins, the group's sources are listed."""
    norm = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    rank = F.struct(F.col("n_chars"), (-F.col("doc_id")).alias("d"))
    return read(spark, sf_dir, "documents").groupBy(F.md5(norm).alias("norm_key")).agg(
        F.max_by("doc_id", rank).alias("winner"), F.count(F.lit(1)).alias("n_records"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")
    )


B.add("merge_winner_sources", merge_winner_sources, r"""
SELECT md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ')) AS norm_key, arg_max(doc_id, n_chars * 1000000000 - doc_id) AS winner,
       count(*) AS n_records, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
FROM documents GROUP BY 1
""")

B.add("doi_dedup", lambda s, d: R.doi_groups(works(s, d)), r"""
WITH k AS (SELECT *, regexp_replace(lower(trim(regexp_replace(trim(doi), '^https?://doi[.]org/', ''))), '[/.]+$', '') AS k0 FROM {works} w),
t AS (SELECT *, CASE WHEN k0 = '' THEN concat('#', doc_id) ELSE k0 END AS doi_key,
      CASE WHEN lower(journal) LIKE '%working paper%' THEN 2 WHEN lower(journal) LIKE '%forthcoming%' THEN 1 ELSE 0 END AS tier FROM k)
SELECT doi_key, first(doc_id ORDER BY tier, length(abstract) DESC, doc_id) AS winner, count(*) AS n_records, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM t GROUP BY 1
""")


def _title_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).select("doc_id", R.words(F.col("title")).alias("ws"))


_WORDS_SQL = "(SELECT doc_id, list_distinct([x for x in string_split(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), ' ') if x <> '']) AS ws FROM {works} w0)"


def _named_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the title and surnames of each work, written once for all that reads them."""
    return cut(works(spark, sf_dir).select(F.col("doc_id").alias("id"), R.words(F.col("title")).alias("words"), R.surnames(F.col("authors")).alias("names")), "works")


def title_pairs(rows: DataFrame) -> DataFrame:
    """Titles of more than 0.4 common words, of rows (id, words): pairs of distinct word sets, each under its smallest id,
    and that id with every other row of its set."""
    classes, members = R.word_classes(rows, "id", "words")
    return R.similar_pairs(classes).unionByName(members.select(F.col("rep").alias("i"), F.col("id").alias("j")))


def surname_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each work with the first one of every surname among its authors."""
    return R.first_links(works(spark, sf_dir).select("doc_id", R.surnames(F.col("authors")).alias("names")), "doc_id", "names").withColumnRenamed("k", "surname")


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be one work: similar titles (under no surname), and works of a surname, linked to its first one."""
    titles = title_pairs(_title_words(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("ws").alias("words")))
    return surname_links(spark, sf_dir).unionByName(titles.withColumn("surname", F.lit("")))


_TITLES_SQL = f"""
WITH w AS {_WORDS_SQL}, s AS (SELECT doc_id, list_sort(ws) AS ws FROM w WHERE len(ws) > 0), c AS (SELECT min(doc_id) AS rep, ws, len(ws) AS n FROM s GROUP BY ws),
q AS (SELECT a.rep AS i, b.rep AS j, len(list_intersect(a.ws, b.ws)) AS nn, a.n AS na, b.n AS nb FROM c a JOIN c b ON a.rep < b.rep AND a.n > 0.4 * b.n AND b.n > 0.4 * a.n)
SELECT i, j FROM q WHERE nn * 1.0 / (na + nb - nn) > 0.4 UNION ALL SELECT c.rep, s.doc_id FROM s JOIN c ON s.ws = c.ws WHERE s.doc_id <> c.rep
"""
_SURNAMES_SQL = r"[y for y in [regexp_replace(lower(regexp_extract(trim(x), '[^ ]+$', 0)), '[^a-z0-9]', '', 'g') for x in regexp_split_to_array(authors, '; *|, *| and ')] if length(y) >= 2]"
_LINKS_SQL = "WITH e AS (SELECT doc_id, unnest(" + _SURNAMES_SQL + ") AS k FROM {works} w), f AS (SELECT k, min(doc_id) AS i FROM e GROUP BY 1) SELECT DISTINCT k AS surname, i, doc_id AS j FROM e JOIN f USING (k) WHERE i < doc_id"

B.add("surname_links", surname_links, _LINKS_SQL)
B.add("candidate_pairs", candidate_pairs, "SELECT surname, i, j FROM (" + _LINKS_SQL + ") UNION ALL SELECT '', i, j FROM (" + _TITLES_SQL + ")")


def either_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works left when each one that shares a DOI or a title with an earlier kept one is dropped."""
    keyed = works(spark, sf_dir).select("doc_id", R.norm_doi(F.col("doi")).alias("k1"), F.trim(F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9 ]", ""), " +", " ")).alias("k2"))
    return R.first_of_either_key(keyed, "doc_id", ["k1", "k2"]).select("doc_id")


B.add("either_key_dedup", either_key_dedup, rf"""
WITH RECURSIVE t AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, [hash(k) for k in [concat('1', k1), concat('2', k2)] if length(k) > 1] AS ks
  FROM (SELECT w.doc_id, regexp_replace(lower(trim(regexp_replace(trim(doi), '^https?://doi[.]org/', ''))), '[/.]+$', '') AS k1, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS k2 FROM {{works}} w)),
r AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS UBIGINT[]) AS seen, CAST(NULL AS BIGINT) AS doc_id, false AS kept
  UNION ALL SELECT t.n, CASE WHEN list_has_any(r.seen, t.ks) THEN r.seen ELSE list_concat(r.seen, t.ks) END, t.doc_id, NOT list_has_any(r.seen, t.ks) FROM r JOIN t ON t.n = r.n + 1)
SELECT doc_id FROM r WHERE kept
""")


def _verdicts(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Verdicts as a model would return them: on half of the similar titles with their ids swapped, on works 231 apart
    (of equal surnames), each judged twice, and on neighbours, most of which were never asked for."""
    ids = rows.select(F.col("id").alias("a"))
    i, j = F.col("i"), F.col("j")
    titles = pairs.where((i + j) % 2 == 0).select(j.alias("a"), i.alias("b"), F.when(i % 3 == 0, "yes").otherwise("no").alias("verdict"), F.lit(1).alias("ord"))
    far, near = F.col("a") + 231, F.col("a") + 1
    named = ids.select("a", far.alias("b"), F.lit("no").alias("verdict"), F.lit(2).alias("ord")).union(ids.where("a % 2 = 0").select(far, "a", F.lit("yes"), F.lit(3)))
    return titles.union(named).union(ids.where("a % 5 = 0").select("a", near, F.lit("yes"), F.lit(4)))


def _judged(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    return R.allowed_verdicts(rows, _verdicts(rows, pairs))


_JUDGED_SQL = f"""
WITH t AS ({_TITLES_SQL}), g AS (SELECT i, j, CASE WHEN i % 3 = 0 THEN 'yes' ELSE 'no' END AS verdict, 1 AS o FROM t WHERE (i + j) % 2 = 0
  UNION ALL SELECT doc_id, doc_id + 231, CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END, 3 FROM documents UNION ALL SELECT doc_id, doc_id + 1, 'yes', 4 FROM documents WHERE doc_id % 5 = 0),
l AS (SELECT i, j, arg_max(verdict, o) AS verdict FROM g GROUP BY 1, 2),
p AS (SELECT w.doc_id, w.ws, v.names FROM {_WORDS_SQL} w JOIN (SELECT doc_id, {_SURNAMES_SQL} AS names FROM {{works}} w1) v USING (doc_id))
SELECT i, j, verdict FROM l JOIN p a ON a.doc_id = i JOIN p b ON b.doc_id = j
WHERE list_has_any(a.names, b.names) OR len(list_intersect(a.ws, b.ws)) > 0.4 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))
"""


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that verdicts call the same, merged transitively."""
    rows = _named_words(spark, sf_dir)
    return connected_components(_judged(rows, title_pairs(rows)).where("verdict = 'yes'"), "i", "j")


B.add("connected_components", components, "WITH RECURSIVE v AS (" + _JUDGED_SQL + """), e AS (SELECT i AS a, j AS b FROM v WHERE verdict = 'yes' UNION SELECT j, i FROM v WHERE verdict = 'yes'),
r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a) SELECT node, min(reach) AS component FROM r GROUP BY 1""")


def verdict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every allowed verdict, and ``no`` for candidate links without one; what is in neither wasn't judged and is ``no``."""
    rows = _named_words(spark, sf_dir)
    pairs = cut(title_pairs(rows), "pairs")
    links = R.first_links(rows, "id", "names").select("i", "j").unionByName(pairs).distinct()
    return links.join(_judged(rows, pairs), ["i", "j"], "full").select("i", "j", F.coalesce("verdict", F.lit("no")).alias("verdict"))


B.add("verdict_merge", verdict_merge, "WITH v AS (" + _JUDGED_SQL + "), c AS (SELECT i, j FROM (" + _LINKS_SQL + ") UNION SELECT i, j FROM (" + _TITLES_SQL + ")) SELECT i, j, coalesce(verdict, 'no') AS verdict FROM c FULL JOIN v USING (i, j)")

B.add("gap_fill_merge", lambda s, d: R.gap_fill(works(s, d).withColumn("grp", F.col("doc_id") % 97), "grp", "doc_id", ["doi", "journal"]), """
SELECT doc_id % 97 AS grp, trim(arg_min(doi, doc_id) FILTER (trim(doi) <> '')) AS doi, trim(arg_min(journal, doc_id) FILTER (trim(journal) <> '')) AS journal FROM {works} w GROUP BY 1
""")


def fill_missing_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing DOIs and journals from a first index, what is still missing from a second."""
    rows = works(spark, sf_dir).select("doc_id", "doi", "journal")
    first = rows.where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("doc_id"), "doi", "journal")
    second = rows.select("doc_id", F.lit("10.9/fallback").alias("doi"), F.lit("Unknown").alias("journal"))
    return R.fill_missing(R.fill_missing(rows, first, "doc_id", ["doi", "journal"]), second, "doc_id", ["doi", "journal"])


B.add("fill_missing_cascade", fill_missing_cascade, """
WITH w AS (SELECT doc_id, doi, journal FROM {works} w0)
SELECT w.doc_id, trim(coalesce(nullif(trim(w.doi), ''), nullif(trim(x.doi), ''), '10.9/fallback')) AS doi, trim(coalesce(nullif(trim(w.journal), ''), nullif(trim(x.journal), ''), 'Unknown')) AS journal
FROM w LEFT JOIN w x ON x.doc_id = w.doc_id + 1 AND x.doc_id % 2 = 1
""")


def verify_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of document titles against the first lines of the benchmark."""
    entries = _title_words(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("ws").alias("words"))
    index = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), R.words(F.split_part(F.col("text"), F.lit("\n"), F.lit(1))).alias("words"))
    return R.audit_status(entries, index)


B.add("verify_status", verify_status, f"""
WITH w AS {_WORDS_SQL}, x AS (SELECT item_id, list_distinct([x for x in string_split(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9 ]', '', 'g'), ' ') if x <> '']) AS xs FROM benchmark),
ew AS (SELECT doc_id, unnest(ws) AS k, len(ws) AS n FROM w), ex AS (SELECT item_id, unnest(xs) AS k, len(xs) AS m FROM x),
h AS (SELECT doc_id, item_id, count(*) * 1.0 / (any_value(n) + any_value(m) - count(*)) AS s FROM ew JOIN ex USING (k) GROUP BY 1, 2), b AS (SELECT doc_id, max(s) AS s FROM h GROUP BY 1)
SELECT w.doc_id AS id, round(coalesce(s, 0.0), 6) AS similarity, CASE WHEN coalesce(s, 0) > 0.85 THEN 'verified' WHEN coalesce(s, 0) < 0.5 AND coalesce(s, 0) > 0 THEN 'hallucinated' ELSE 'unverified' END AS status FROM w LEFT JOIN b USING (doc_id)
""")

B.add("surname_list", lambda s, d: works(s, d).select("doc_id", F.array_join(R.surnames(F.col("authors")), ",").alias("surnames")), r"""
SELECT doc_id, array_to_string([y for y in [regexp_replace(lower(regexp_extract(trim(x), '[^ ]+$', 0)), '[^a-z0-9]', '', 'g') for x in regexp_split_to_array(authors, '; *|, *| and ')] if length(y) >= 2], ',') AS surnames FROM {works} w
""")


def bfs_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts within two order-to-part steps of the first orders."""
    items = read(spark, sf_dir, "lineitem")
    forward = items.select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"))
    edges = forward.union(forward.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seeds = items.where("l_orderkey <= 3").select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("node")).distinct()
    return bfs(edges, seeds, 2)


B.add("bfs_two_hop", bfs_two_hop, """
WITH f AS (SELECT concat('o', l_orderkey) AS src, concat('p', l_partkey) AS dst FROM lineitem), e AS (SELECT src, dst FROM f UNION ALL SELECT dst, src FROM f),
s AS (SELECT DISTINCT concat('o', l_orderkey) AS node FROM lineitem WHERE l_orderkey <= 3), h1 AS (SELECT DISTINCT dst AS node FROM e JOIN s ON src = node), h2 AS (SELECT DISTINCT dst AS node FROM e JOIN h1 ON src = node),
u AS (SELECT node, 0 AS level FROM s UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) SELECT node, min(level) AS level FROM u GROUP BY 1
""")


def id_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as short forms that take the text length of the last other turn."""
    notes = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("work"))
    return R.resolve_ids(notes, "conv_id", "turn", F.col("role") == "assistant", "work").select("conv_id", "turn", "resolved")


B.add("id_resolution_asof", id_resolution, """
SELECT c.conv_id, c.turn, CASE WHEN c.role <> 'assistant' THEN length(c.text) ELSE (SELECT arg_max(length(p.text), p.turn) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn AND p.role <> 'assistant') END AS resolved FROM conversations c
""")


def short_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left after runs of debris are taken out."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    line, short = F.col("line"), F.length("line") <= 26
    return R.garbled_runs(lines, short, F.length("line") <= 3, F.trim(line) == "").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


B.add("short_line_runs", short_line_runs, """
WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
m AS (SELECT *, sum(CASE WHEN length(line) <= 26 OR trim(line) = '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM l),
k AS (SELECT doc_id, run, min(line_no) AS lo, max(line_no) AS hi FROM m WHERE length(line) <= 26 AND trim(line) <> '' GROUP BY 1, 2 HAVING count(*) >= 6 AND count(CASE WHEN length(line) <= 3 THEN 1 END) >= 2)
SELECT m.doc_id, count(*) AS n_lines FROM m LEFT JOIN k ON m.doc_id = k.doc_id AND m.run = k.run WHERE k.lo IS NULL OR line_no < lo OR line_no > hi GROUP BY 1
""")


def token_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each benchmark item's distinct words that no document has."""
    found = lambda df, *c: df.select(*c, F.explode(R.words(F.col("text"))).alias("w"))
    vocabulary = found(read(spark, sf_dir, "documents")).distinct().withColumn("there", F.lit(1))
    joined = found(read(spark, sf_dir, "benchmark"), "item_id").join(vocabulary, "w", "left")
    missing = F.count_if(F.col("there").isNull())
    return joined.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_distinct"), missing.alias("n_missing"), F.when(missing * 100.0 / F.count(F.lit(1)) < 3, "OK").otherwise("FLAG").alias("verdict"))


_TOKENS = "list_distinct([x for x in string_split(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), ' ') if x <> ''])"
B.add("token_missing_pct", token_missing, f"""
WITH v AS (SELECT DISTINCT unnest({_TOKENS}) AS w FROM documents), i AS (SELECT item_id, unnest({_TOKENS}) AS w FROM benchmark)
SELECT item_id, count(*) AS n_distinct, count(*) - count(v.w) AS n_missing, CASE WHEN (count(*) - count(v.w)) * 100.0 / count(*) < 3 THEN 'OK' ELSE 'FLAG' END AS verdict FROM i LEFT JOIN v ON i.w = v.w GROUP BY 1
""")


def inverted_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their places, put back in order: the text, blanks collapsed."""
    tokens = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"\s+")).alias("pos", "w"))
    index = tokens.groupBy("item_id", "w").agg(F.collect_list("pos").alias("places"))
    placed = index.select("item_id", F.explode("places").alias("pos"), "w").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("ws"))
    return placed.select("item_id", F.array_join(F.col("ws.w"), " ").alias("text"))


B.add("inverted_index_roundtrip", inverted_index_roundtrip, r"SELECT item_id, regexp_replace(text, '\s+', ' ', 'g') AS text FROM benchmark")

B.add("json_extract_walk", lambda s, d: read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")), "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")


def even_sample_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five evenly spaced places of each language's documents, both ends among them; halves round to even."""
    n = read(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return n.select("lang", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.bround(i * (F.col("n") - 1) / 4).cast("long")))).alias("place"))


B.add("even_sample_index", even_sample_index, "SELECT DISTINCT lang, CAST(round_even(i * (n - 1) / 4.0, 0) AS BIGINT) AS place FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1), (SELECT unnest(range(5)) AS i)")

QUERIES, SQL = B.queries, B.sql
