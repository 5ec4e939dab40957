"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, jaccard, knn, lm, packing, pii, suffix, tokens, toxicity, winnow
from .arrays import read

RANKS = "byte_bpe_50k.tiktoken"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(read(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.winnow_neighbours(read(spark, sf_dir, "documents"))


def op4_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(knn.integer_vectors(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, 20)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read(spark, sf_dir, "documents"), tokens.path(RANKS)).drop("ids")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokens.path(RANKS))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(read(spark, sf_dir, "documents"), tokens.path(RANKS))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels"))).select("doc_id", "severity", "toxic")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_suffix_dedup, op3_winnowing, op4_voronoi_knn, op5_byte_bpe, op6_best_fit_packing, op7_ngram_jaccard, op8_pii, op9_lm_scoring, op10_toxicity, pipeline)}

_KNN = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_PLAIN_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": pii.PATTERNS["iban"][0],
}
_KIND_ROWS = " UNION ALL ".join(f"SELECT doc_id, {i} AS o, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM t" for i, (kind, p) in enumerate(_PLAIN_PATTERNS.items()))
_PII = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS ({_KIND_ROWS}),
e AS (SELECT doc_id, o, kind, unnest(m) AS x, unnest(g[1:len(m)]) AS gap, unnest(range(len(m))) AS i FROM k WHERE len(m) > 0),
p AS (SELECT *, CAST(sum(length(gap) + length(x)) OVER (PARTITION BY doc_id, o ORDER BY i) AS BIGINT) AS stop, regexp_replace(x, '[^0-9]', '', 'g') AS d, replace(x, ' ', '') AS c FROM e),
w AS (SELECT *, substr(c, 5) || substr(c, 1, 4) AS turned FROM p),
v AS (
  SELECT doc_id, o, kind, stop - length(x) AS start, stop FROM w WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR CAST('0' || substr(ltrim(y, '0'), 1, 3) AS INTEGER) > 255)) = 0
    WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE
      WHEN i % 2 = 1 THEN CAST(substr(d, CAST(length(d) - i + 1 AS BIGINT), 1) AS INTEGER)
      WHEN substr(d, CAST(length(d) - i + 1 AS BIGINT), 1) >= '5' THEN 2 * CAST(substr(d, CAST(length(d) - i + 1 AS BIGINT), 1) AS INTEGER) - 9
      ELSE 2 * CAST(substr(d, CAST(length(d) - i + 1 AS BIGINT), 1) AS INTEGER) END)) % 10 = 0
    WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
    ELSE length(c) BETWEEN 15 AND 34 AND list_reduce(list_concat([0], list_transform(range(1, length(turned) + 1), lambda i:
      CASE WHEN substr(turned, i, 1) BETWEEN '0' AND '9' THEN CAST(substr(turned, i, 1) AS INTEGER) ELSE ascii(substr(turned, i, 1)) - 55 END)),
      lambda s, n: CASE WHEN n < 10 THEN (s * 10 + n) % 97 ELSE (s * 100 + n) % 97 END) = 1 END),
a AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) FILTER (o < 4) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) AS spans
  FROM v GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (doc_id)
"""

SQL = {"op4_voronoi_knn": _KNN, "op8_pii": _PII}
