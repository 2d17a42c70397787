"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import fresh_path
from vigil.sources.tables import read_table

BYTE_BPE, BYTE_BPE_IDS, BYTE_BPE_END = "byte_bpe_50k.json", 50257, 0
WORD_BPE, WORD_BPE_END = "word_bpe_49k.json", 1
PIECES = "piece_bpe_32k.model"


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.packing import pack_documents
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_file(WORD_BPE), WORD_BPE_END,
                          added_tokens=True)


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.pii import pseudonymise
    return pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.piece_codec import round_trip_digests
    return round_trip_digests(read_table(spark, sf_dir, "documents"), tokenizer_file(PIECES))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.warc import archived_pages, write_archives
    path = fresh_path(spark, "archives")
    write_archives(read_table(spark, sf_dir, "pages"), path)
    return archived_pages(spark, path)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.token_files import read_checksums, write_token_files
    path = fresh_path(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), path, tokenizer_file(BYTE_BPE), BYTE_BPE_END,
                      BYTE_BPE_IDS, added_tokens=True)
    return read_checksums(spark, path)


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.cotraining import classify
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.line_dedup import dedup_lines
    return dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_va_file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.va_search import exact_top_k
    return exact_top_k(spark, read_table(spark, sf_dir, "embeddings"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.order_minhash import near_duplicates
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.prefix_forest import forest_neighbours
    return forest_neighbours(spark, read_table(spark, sf_dir, "embeddings"))


def op11_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.near_vectors import near_vectors
    return near_vectors(spark, read_table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.hard_negatives import hard_negatives
    rows = read_table(spark, sf_dir, "embeddings")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark, rows.withColumn("label", relabelled))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.filter_audit import audit_filters, failing_relations
    return audit_filters(spark, *failing_relations(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_cotraining": op1_cotraining,
    "op2_line_dedup": op2_line_dedup,
    "op3_va_file_search": op3_va_file_search,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_feistel_pseudonyms": op5_feistel_pseudonyms,
    "op6_piece_codec": op6_piece_codec,
    "op7_order_minhash": op7_order_minhash,
    "op8_prefix_forest": op8_prefix_forest,
    "op9_warc": op9_warc,
    "op10_token_files": op10_token_files,
    "op11_inverted_multi_index": op11_inverted_multi_index,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op3_va_file_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLE_SQL["op9_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
), t AS (
  SELECT *, coalesce(payload_bytes >= 100 AND page_id <> first, false) AS again FROM f
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM t
"""

# The whole similarity join once more, with words ordered by their frequency and the words kept as text.
ORACLE_SQL["op2_line_dedup"] = """
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), line AS (
  SELECT doc_id, i - 1 AS line_no, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM split)
), sets AS (
  SELECT doc_id, line_no, list_filter(string_split_regex(lower(line), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS words
  FROM line
), places AS (
  SELECT row_number() OVER (ORDER BY doc_id, line_no) AS place, doc_id, line_no, list_sort(list_distinct(words)) AS words, len(list_distinct(words)) AS n
  FROM sets WHERE len(words) > 0
), firsts AS (
  SELECT min(place) AS place, words, any_value(n) AS n FROM places GROUP BY words
), word AS (
  SELECT place, n, unnest(words) AS w FROM firsts
), ranked AS (
  SELECT place, n, w, row_number() OVER (PARTITION BY place ORDER BY c, w) AS pos
  FROM word JOIN (SELECT w, count(*) AS c FROM word GROUP BY w) USING (w)
), prefix AS (
  SELECT * FROM ranked WHERE pos <= n - ceil(0.8 * n - 1e-9) + 1
), pairs AS (
  SELECT DISTINCT b.place AS place, a.place AS earlier FROM prefix a JOIN prefix b ON a.w = b.w AND a.place < b.place
  WHERE least(a.n, b.n) >= greatest(a.n, b.n) * 0.8 - 1e-9
), near AS (
  SELECT DISTINCT p.place FROM pairs p JOIN firsts a ON a.place = p.earlier JOIN firsts b ON b.place = p.place
  WHERE len(list_intersect(a.words, b.words)) * 1.8 >= (a.n + b.n) * 0.8 - 1e-9
), gone AS (
  SELECT doc_id, list(line_no) AS gone FROM places
  WHERE place IN (SELECT place FROM near) OR place NOT IN (SELECT place FROM firsts) GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS text FROM line l JOIN gone g ON l.doc_id = g.doc_id
  WHERE NOT list_contains(g.gone, l.line_no) GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN g.gone IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
       coalesce(len(g.gone), 0) AS n_removed
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

ORACLE_SQL["op13_filter_audit"] = """
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents
), word AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM doc
), label AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), mask AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS fails
  FROM word LEFT JOIN label USING (doc_id)
), pattern AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM mask GROUP BY part, fails
), letter AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.k || b.k || c.k || d.k || e.k AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before
  FROM orders, range(1, 6) t(step)
), counted AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (fails & before <> 0 AND fails & bit <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS toxic_lost
  FROM pattern, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""

ORACLE_SQL["op11_inverted_multi_index"] = """
WITH RECURSIVE ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reached(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reached r JOIN link l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS b FROM reached GROUP BY a
), links AS (
  SELECT a, count(*) AS n FROM link GROUP BY a
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(m.b, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(m.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN links l ON l.a = e.vec_id LEFT JOIN least m ON m.a = e.vec_id
"""

ORACLE_SQL["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id AS vec_id, q.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positive JOIN s USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
