"""Registered queries of the engine's own operators, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions import metrics as M
from lodestone.functions import prompts as P
from lodestone.functions import text as T
from lodestone.operators import chunk, kg, providers, report, retrieve, tools
from lodestone.operators import score as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _docs(spark, sf) -> DataFrame:
    return _read(spark, sf, "documents").select("doc_id", "text")


def _items(spark, sf) -> DataFrame:
    return _read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark, sf) -> DataFrame:
    return _read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))


def _vector_queries(spark, sf) -> DataFrame:
    """Every row whose id is divisible by 100 asks against all rows."""
    return _vectors(spark, sf).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))


def _turns(spark, sf) -> DataFrame:
    """Pairs of a turn and the one after it in its conversation: found and truth as arrays of one text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _read(spark, sf, "conversations").withColumn("next", F.lead("text").over(w)).where("next is not null")
    return t.select("conv_id", "turn", F.array("text").alias("found"), F.array("next").alias("truth"), "text", "next")


# --- SQL building blocks -----------------------------------------------------------------------

_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+')"
_TF = f"""
docs AS (SELECT doc_id, {_TOK} AS t FROM documents),
tf AS (SELECT doc_id, token, dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM docs) GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl, sum(len(t)) AS total FROM docs),
stats AS (SELECT token, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY token),
qt AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_TOK}) AS token FROM benchmark) GROUP BY ALL)"""
_BM25 = f"""{_TF},
raw AS (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw, avgdl FROM stats, corpus),
idf AS (SELECT token, avgdl, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
bm AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.3 + 0.7 * dl / avgdl))) AS score FROM qt JOIN idf USING (token) JOIN tf USING (token) GROUP BY ALL)"""


def _top(table: str, k: int, digits: int = 6, order: str = "DESC") -> str:
    return f"SELECT query_id, doc_id, rank, score FROM (SELECT query_id, doc_id, round(score, {digits}) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, {digits}) {order}, doc_id) AS INTEGER) AS rank FROM {table}) WHERE rank <= {k}"


_DOT = lambda a, b: f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
_COS = f"{_DOT('q.embedding', 'd.embedding')} / (sqrt({_DOT('q.embedding', 'q.embedding')}) * sqrt({_DOT('d.embedding', 'd.embedding')}))"
_DENSE = f"de AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, {_COS} AS score FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0)"

# --- term statistics and scores ----------------------------------------------------------------


def _tf(spark, sf):
    docs, tokens = _docs(spark, sf), T.tokens("text")
    tf = S.postings(docs, tokens)
    return tf, S.token_stats(tf), S.corpus_stats(docs, tokens), S.query_terms(_items(spark, sf), tokens)


@query(f"WITH {_TF} SELECT token, df, CAST(cf AS BIGINT) AS cf FROM stats")
def token_stats(spark, sf):
    return _tf(spark, sf)[1]


def _best(spark, sf, k: int, shares: dict[str, float] | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: the first k documents of each item by BM25 or a mix of scores."""
    return retrieve.scored(S.query_terms(_items(spark, sf), T.tokens("text")), retrieve.Corpus(_docs(spark, sf)), k, shares)


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score FROM bm")
def bm25_scores(spark, sf):
    pairs = retrieve.scored(S.query_terms(_items(spark, sf), T.tokens("text")), retrieve.Corpus(_docs(spark, sf)), None)
    return pairs.select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25} {_top('bm', 6)}")
def bm25_topk(spark, sf):
    return _best(spark, sf, 6)


_TFIDF = f"{_TF}, ti AS (SELECT query_id, doc_id, sum(qtf * (tf / dl) * ln(n / df)) AS score FROM qt JOIN stats USING (token) JOIN tf USING (token), corpus GROUP BY ALL)"


@query(f"WITH {_TFIDF} {_top('ti', 6)}")
def tfidf_topk(spark, sf):
    return _best(spark, sf, 6, {"tfidf": 1.0})


@query(f"WITH {_TF}, jm AS (SELECT query_id, doc_id, sum(qtf * ln(1 + 0.5 * tf / dl / (0.5 * cf / total))) AS score FROM qt JOIN stats USING (token) JOIN tf USING (token), corpus GROUP BY ALL) {_top('jm', 6)}")
def jelinek_mercer_topk(spark, sf):
    return _best(spark, sf, 6, {"jelinek_mercer": 1.0})


@query(
    f"""WITH {_BM25}, tm AS (SELECT query_id, doc_id, sum(qtf * (tf / dl) * ln(n / df)) AS score FROM qt JOIN stats USING (token) JOIN tf USING (token), corpus GROUP BY ALL),
j AS (SELECT query_id, doc_id, sum(qtf * ln(1 + 0.5 * tf / dl / (0.5 * cf / total))) AS score FROM qt JOIN stats USING (token) JOIN tf USING (token), corpus GROUP BY ALL),
mx AS (SELECT query_id, doc_id, 0.2 * tm.score + 0.6 * bm.score + 0.2 * j.score AS score FROM bm JOIN tm USING (query_id, doc_id) JOIN j USING (query_id, doc_id)) {_top("mx", 6)}"""
)
def lexical_mix_topk(spark, sf):
    """Weighted mix of the three lexical scores."""
    return _best(spark, sf, 6, {"tfidf": 0.2, "bm25": 0.6, "jelinek_mercer": 0.2})


# --- vectors -----------------------------------------------------------------------------------


@query(f"WITH {_DENSE} {_top('de', 6)}")
def dense_topk(spark, sf):
    return retrieve.dense_topk(_vector_queries(spark, sf), _vectors(spark, sf), 6)


@query(
    f"WITH l2 AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, sqrt(list_sum(list_transform(list_zip(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0) {_top('l2', 6, order='ASC')}"
)
def dense_l2_topk(spark, sf):
    return retrieve.dense_topk(_vector_queries(spark, sf), _vectors(spark, sf), 6, "l2")


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS total FROM embeddings")
def unit_vectors(spark, sf):
    v = _read(spark, sf, "embeddings").select("vec_id", S.unit(F.col("embedding")).alias("u"))
    return v.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def _both(spark, sf):
    """Vectors of the items, each that of its id, and of the documents that have one."""
    v = _vectors(spark, sf)
    q = _items(spark, sf).join(v.withColumnRenamed("v", "q"), F.col("query_id") == F.col("doc_id")).select("query_id", "q")
    return q, v.join(_docs(spark, sf), "doc_id")


_HYBRID = f"""{_BM25},
dn AS (SELECT b.item_id AS query_id, d.vec_id AS doc_id, {_COS} AS score FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings d JOIN documents x ON x.doc_id = d.vec_id),
pair AS (SELECT query_id, doc_id, dn.score AS d, coalesce(bm.score, 0) AS s FROM dn LEFT JOIN bm USING (query_id, doc_id)),
ran AS (SELECT *, min(s) OVER w AS sl, max(s) OVER w AS sh, min(d) OVER w AS dl0, max(d) OVER w AS dh FROM pair WINDOW w AS (PARTITION BY query_id)),
hy AS (SELECT query_id, doc_id, 0.3 * CASE WHEN sh = sl THEN s ELSE (s - sl) / (sh - sl) END + 0.7 * CASE WHEN dh = dl0 THEN d ELSE (d - dl0) / (dh - dl0) END AS score FROM ran)"""


@query(f"WITH {_HYBRID} {_top('hy', 6)}")
def minmax_hybrid(spark, sf):
    return retrieve.hybrid_topk(_items(spark, sf), _docs(spark, sf), _both(spark, sf), 6)


_STOP = "[" + ", ".join("'" + w + "'" for w in T.STOP_WORDS) + "]"
_POOL = f"pool AS ({_top('hy', 150)})"
_RERANK = f"""{_HYBRID}, {_POOL},
kw AS (SELECT item_id AS query_id, list_distinct(list_filter({_TOK}, lambda t: NOT list_contains({_STOP}, t) AND length(t) >= 3)) AS k FROM benchmark),
boosted AS (SELECT query_id, doc_id, pool.rank AS pool_rank, pool.score AS hybrid, pool.score + 0.15 * len(list_filter(k, lambda w: contains(lower(text), w))) AS score FROM pool JOIN kw USING (query_id) JOIN documents USING (doc_id)),
fin AS (SELECT query_id, doc_id, hybrid, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, pool_rank) AS INTEGER) AS rank FROM boosted)"""


@query(f"WITH {_RERANK} SELECT query_id, doc_id, rank, score, hybrid FROM fin WHERE rank <= 6")
def keyword_rerank(spark, sf):
    return retrieve.hybrid_retrieve(_items(spark, sf), _docs(spark, sf), _both(spark, sf))


@query(
    f"""WITH {_HYBRID}, a AS ({_top("bm", 100)}), b AS ({_top("dn", 100)}),
f AS (SELECT query_id, doc_id, coalesce(0.5 / (60 + a.rank), 0) + coalesce(0.5 / (60 + b.rank), 0) AS score FROM a FULL JOIN b USING (query_id, doc_id)) {_top("f", 6, 8)}"""
)
def rrf_fusion(spark, sf):
    q, v = _both(spark, sf)
    return S.ranked(S.rrf(_best(spark, sf, 100), retrieve.dense_topk(q, v.select("doc_id", "v"), 100)), 6, digits=8)


_TRUTH = "truth AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _truth(spark, sf):
    return retrieve.containing(_items(spark, sf), _docs(spark, sf))


@query(f"WITH {_BM25}, {_TRUTH}, top AS ({_top('bm', 6)}) SELECT query_id, CAST(max(CASE WHEN top.doc_id IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS hit FROM truth LEFT JOIN top USING (query_id, doc_id) GROUP BY query_id")
def recall_at_k(spark, sf):
    return retrieve.recall_at_k(_best(spark, sf, 6), _truth(spark, sf), 6)


@query(
    f"""WITH {_BM25}, {_TRUTH}, ks AS (SELECT unnest([1, 3, 6, 10, 50]) AS k), rk AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm),
best AS (SELECT query_id, min(rank) AS best FROM truth LEFT JOIN rk USING (query_id, doc_id) GROUP BY query_id)
SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN best <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM best, ks GROUP BY k"""
)
def recall_curve(spark, sf):
    """Share of items with a containing document among the first k, for several k."""
    # a rank past the last k counts as none
    best = _truth(spark, sf).join(_best(spark, sf, 50), ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("rank").alias("best"))
    ks = F.explode(F.array(*[F.lit(k) for k in (1, 3, 6, 10, 50)]))
    return best.select("best", ks.alias("k")).groupBy("k").agg(F.round(F.avg(F.coalesce(F.col("best") <= F.col("k"), F.lit(False)).cast("double")), 6).alias("recall"))


@query("SELECT k, m, CAST(least(n, greatest(k, CASE WHEN abs(k * m - trunc(k * m)) = 0.5 THEN 2 * round(k * m / 2) ELSE round(k * m) END)) AS BIGINT) AS candidates FROM (SELECT count(*) AS n FROM documents), (VALUES (6, 3.0::DOUBLE), (50, 3.0::DOUBLE), (5, 0.5::DOUBLE), (1, 2.5::DOUBLE)) v(k, m)")
def candidate_counts(spark, sf):
    n = _docs(spark, sf).agg(F.count("*").alias("n"))
    rows = [n.select(F.lit(k).alias("k"), F.lit(m).alias("m"), S.candidate_count(F.col("n"), k, m).alias("candidates")) for k, m in ((6, 3.0), (50, 3.0), (5, 0.5), (1, 2.5))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


# --- classification and chunks -----------------------------------------------------------------


def _asked(spark, sf):
    turns = _read(spark, sf, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    items = _read(spark, sf, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("id"), "text")
    return turns.unionByName(items).withColumn("language", F.lit("en"))


def _classify_sql() -> str:
    asked = "a AS (SELECT conv_id || '-' || turn AS id, trim(coalesce(text, '')) AS q FROM conversations WHERE role = 'user' UNION ALL SELECT 'b' || item_id, trim(coalesce(text, '')) FROM benchmark)"
    cues = {
        "MULTI_DOC_INTEGRATION": r"CASE WHEN regexp_matches(lower(q), 'according to .* and .*') OR regexp_matches(lower(q), '\brespectively\b') THEN 0.6 ELSE 0 END",
        "MULTI_DOC_COMPARISON": r"CASE WHEN regexp_matches(lower(q), '\bcompare\b') AND regexp_matches(lower(q), '\bwhich\b') THEN 0.6 ELSE 0 END",
        "MULTI_DOC_TIMESEQ": r"CASE WHEN regexp_matches(lower(q), '\b(earlier|later)\b') THEN 0.8 ELSE 0 END",
    }
    raw = ", ".join(f"CASE WHEN len(regexp_extract_all(q, '(?i){C.PATTERNS_EN[t]}')) > 0 THEN least(3.0, 1.0 + 0.5 * (len(regexp_extract_all(q, '(?i){C.PATTERNS_EN[t]}')) - 1)) ELSE 0 END + {cues.get(t, '0')} AS s{i}" for i, t in enumerate(C.TYPES))
    boosted = ", ".join(f"CAST(CASE WHEN s{i} > 0 THEN round(s{i} + {C.BOOSTS.get(t, 0)}, 6) ELSE 0 END AS DOUBLE) AS f{i}" for i, t in enumerate(C.TYPES))
    top = "greatest(" + ", ".join(f"f{i}" for i in range(len(C.TYPES))) + ")"
    pick = "CASE WHEN score = 0 THEN 'UNKNOWN' " + " ".join(f"WHEN f{i} = score THEN '{t}'" for i, t in enumerate(C.TYPES)) + " END"
    return f"WITH {asked}, r AS (SELECT id, {raw} FROM a), b AS (SELECT id, {boosted} FROM r), s AS (SELECT *, {top} AS score FROM b), y AS (SELECT id, score, {pick} AS canonical_type FROM s)"


_LABELS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in C.LABELS_EN.items()) + "}"
_POLICIES = "MAP {" + ", ".join(f"'{k}': [{a}, {b}]" for k, (a, b) in C.POLICY_EN.items()) + "}"


@query(f"{_classify_sql()} SELECT id, score, canonical_type, {_LABELS}[canonical_type] AS dataset_label FROM y")
def query_type(spark, sf):
    return C.classify(_asked(spark, sf), "text").select("id", "score", "canonical_type", "dataset_label")


@query(f"{_classify_sql()} SELECT canonical_type, CAST(coalesce({_POLICIES}[canonical_type][1], 140) AS INTEGER) AS chunk_size, CAST(coalesce({_POLICIES}[canonical_type][2], 28) AS INTEGER) AS chunk_overlap, count(*) AS n FROM y GROUP BY ALL")
def chunk_policy(spark, sf):
    return C.chunk_policy(C.classify(_asked(spark, sf), "text")).groupBy("canonical_type", "chunk_size", "chunk_overlap").agg(F.count("*").alias("n"))


_HOP = " OR ".join(f"contains(lower(text), '{m}')" for m in C.HOP_MARKERS_EN)
_EVENTS = " + ".join(f"CAST(contains(lower(text), '{m}') AS INTEGER)" for m in C.HOP_EVENTS)


@query(f"SELECT conv_id, turn, {_HOP} OR ((contains(lower(text), ' and ') OR contains(lower(text), ' & ')) AND ({_EVENTS}) >= 2) AS multi_hop FROM conversations WHERE text IS NOT NULL")
def multi_hop_trigger(spark, sf):
    return _read(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", C.is_multi_hop("text").alias("multi_hop"))


_WINDOWS = "w AS (SELECT doc_id, unnest(range(0, CAST(length(text) AS BIGINT), 800)) AS s, text FROM documents WHERE length(text) > 0)"


@query(f"WITH {_WINDOWS} SELECT doc_id, CAST(s // 800 AS INTEGER) AS chunk_index, length(substr(text, s + 1, 1000)) AS n, md5(substr(text, s + 1, 1000)) AS digest FROM w")
def fixed_chunks(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.posexplode(chunk.fixed_windows(F.col("text"), 1000, 200)).alias("chunk_index", "c"))
    return rows.select("doc_id", "chunk_index", F.length("c").cast("long").alias("n"), F.md5("c").alias("digest"))


@query(f"WITH {_WINDOWS} SELECT doc_id, count(*) AS chunks, CAST(sum(length(substr(text, s + 1, 1000))) AS BIGINT) AS chars FROM w GROUP BY doc_id")
def chunk_stats(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.explode(chunk.fixed_windows(F.col("text"), 1000, 200)).alias("c"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("c")).alias("chars"))


@query()
def recursive_chunks(spark, sf):
    return chunk.recursive_chunks(_docs(spark, sf), 140, 28).select("doc_id", "chunk_index", "page_content")


_SWEEP = "WITH z AS (SELECT unnest([250, 500, 1000]) AS size), w AS (SELECT doc_id, size, unnest(range(0, CAST(length(text) AS BIGINT), size - CAST(floor(size * 0.15) AS BIGINT))) AS s, text FROM documents, z WHERE length(text) > 0) SELECT CAST(size AS INTEGER) AS chunk_size, count(*) AS chunks, CAST(sum(length(substr(text, s + 1, size))) AS BIGINT) AS chars FROM w GROUP BY size"


@query(_SWEEP)
def chunk_size_sweep(spark, sf):
    return tools.sweep(_docs(spark, sf), [250, 500, 1000]).groupBy("chunk_size").agg(F.count("*").alias("chunks"), F.sum(F.length("page_content")).alias("chars"))


# --- routing, counting, dedup ------------------------------------------------------------------


@query("SELECT doc_id, lang, source FROM documents WHERE text IS NOT NULL AND lang = 'en'")
def language_filter(spark, sf):
    docs = _read(spark, sf, "documents").withColumnsRenamed({"text": "content", "lang": "language"})
    return tools.eligible(docs, "en").select("doc_id", F.col("language").alias("lang"), "source")


@query(r"SELECT CASE WHEN regexp_matches(text, '[\x{4e00}-\x{9fa5}]') THEN 'zh' ELSE 'other' END AS bucket, count(*) AS n FROM documents WHERE trim(coalesce(text, '')) <> '' GROUP BY ALL")
def language_split(spark, sf):
    zh, other = tools.split_languages(_docs(spark, sf), "text")
    return zh.withColumn("bucket", F.lit("zh")).unionByName(other.withColumn("bucket", F.lit("other"))).groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def domain_counts(spark, sf):
    return _read(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def dedup_content(spark, sf):
    docs = _docs(spark, sf)
    return tools.first_of_content(docs, "text", "doc_id").select("doc_id", F.md5("text").alias("digest"))


@query(f"SELECT word, df FROM (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct({_TOK})) AS word FROM documents) GROUP BY word) ORDER BY df DESC, word LIMIT 200")
def learned_stopwords(spark, sf):
    return tools.learn_stop_words(_docs(spark, sf), T.tokens("text"), 200)


@query("SELECT d.doc_id, quality, toxic, length(text) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def merge_ground_truth(spark, sf):
    merged, _ = tools.merge_truth(_docs(spark, sf), _read(spark, sf, "labels"), "doc_id")
    return merged.select("doc_id", "quality", "toxic", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL)")
def remaining_queries(spark, sf):
    docs = _docs(spark, sf)
    done = docs.join(_read(spark, sf, "labels").select("doc_id"), "doc_id")
    return tools.remaining(docs, done, "doc_id", "text").select("doc_id")


@query("SELECT DISTINCT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_ids(spark, sf):
    return tools.missing_ids(_docs(spark, sf), _read(spark, sf, "labels"), "doc_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def last_by_key(spark, sf):
    return tools.last_wins(_read(spark, sf, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS ok FROM events")
def json_extract(spark, sf):
    e = _read(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.from_json("props", "map<string,string>").isNotNull().alias("ok"))


_GRAMS = " UNION ALL ".join(f"SELECT item_id, CASE WHEN len(t) >= {n} THEN list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n - 1}], ' ')) ELSE [] END AS g FROM tk" for n in (1, 2, 3, 4))


@query(f"WITH tk AS (SELECT item_id, {_TOK} AS t FROM benchmark), g AS ({_GRAMS}) SELECT item_id, count(DISTINCT x) AS grams, CAST(sum(length(x)) AS BIGINT) AS chars FROM (SELECT DISTINCT item_id, unnest(g) AS x FROM g) WHERE length(x) >= 3 GROUP BY item_id")
def ngram_candidates(spark, sf):
    rows = _read(spark, sf, "benchmark").select("item_id", F.explode(T.ngrams(T.tokens("text"), 4, 3)).alias("x"))
    return rows.groupBy("item_id").agg(F.count("*").alias("grams"), F.sum(F.length("x")).alias("chars"))


# --- metrics -----------------------------------------------------------------------------------

_PAIRS = "p AS (SELECT conv_id, turn, text, next FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE next IS NOT NULL)"
_T = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9'']+')"
_W = lambda c: f"len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''))"
_SENT = lambda c: f"list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '[^.!?\\n]+[.!?]*'), lambda s: trim(s)), lambda s: s <> '')"
_BARE = r"CASE WHEN starts_with(text, '(') THEN regexp_replace(text, '^\([^)]*\)', '') ELSE text END"
_MATCH = f"m AS (SELECT *, {_BARE} AS bare, {_SENT('next')} AS s FROM p), h AS (SELECT *, coalesce(list_sum(list_transform(list_filter(s, lambda x: contains(bare, x)), lambda x: {_W('x')})), 0) AS hit FROM m)"
_SHARE = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END"
_COMMON = f"len(list_intersect({_T('text')}, {_T('next')}))"


@query(f"WITH {_PAIRS} SELECT conv_id, turn, round({_SHARE(_COMMON, f'len(list_distinct({_T("text")}))')}, 6) AS p, round({_SHARE(_COMMON, f'len(list_distinct({_T("next")}))')}, 6) AS r FROM p")
def words_pr(spark, sf):
    t = _turns(spark, sf)
    return t.select("conv_id", "turn", F.round(M.get_metric("Words_Precision")(F.col("found"), F.col("truth")), 6).alias("p"), F.round(M.get_metric("Words_Recall")(F.col("found"), F.col("truth")), 6).alias("r"))


@query(f"WITH {_PAIRS}, {_MATCH} SELECT conv_id, turn, round({_SHARE('hit', _W('bare'))}, 6) AS p, round({_SHARE('hit', _W('next'))}, 6) AS r FROM h")
def sentence_pr(spark, sf):
    t = _turns(spark, sf)
    return t.select("conv_id", "turn", F.round(M.get_metric("Sentences_Precision")(F.col("found"), F.col("truth")), 6).alias("p"), F.round(M.get_metric("Sentences_Recall")(F.col("found"), F.col("truth")), 6).alias("r"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, len({_SENT('text')}) > 0 AND len(list_filter({_SENT('text')}, lambda x: NOT contains(next, x))) = 0 AS matched FROM p")
def exists_match(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", M.exists_match(F.col("text"), F.col("truth")).alias("matched"))


@query(f"WITH {_PAIRS}, {_MATCH} SELECT conv_id, turn, round(CASE WHEN hit > 0 AND {_W('bare')} > hit THEN 10 * log10(hit / ({_W('bare')} - hit)) ELSE 0 END, 6) AS snr FROM h")
def snr(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.round(M.snr(F.col("found"), F.col("truth")), 6).alias("snr"))


@query()
def rouge_l(spark, sf):
    t = _turns(spark, sf).withColumns({"h": T.tokens("text"), "r": T.tokens("next")})
    return t.select("conv_id", "turn", F.round(M.rouge_l(T.lcs_length("h", "r"), F.col("h"), F.col("r")), 6).alias("f"))


def _gram_counts(side: str) -> str:
    return f"SELECT conv_id, turn, n, g, count(*) AS c FROM (SELECT conv_id, turn, n, unnest(CASE WHEN len({side}) >= n THEN list_transform(range(1, CAST(len({side}) - n + 2 AS BIGINT)), lambda i: array_to_string({side}[i:i + n - 1], ' ')) ELSE [] END) AS g FROM t, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL"


_BLEU = f"""WITH l AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations),
t AS (SELECT conv_id, turn, {_TOK} AS h, {_TOK.replace('text', 'next')} AS r FROM l WHERE next IS NOT NULL),
hits AS (SELECT conv_id, turn, n, sum(least(a.c, b.c)) AS m FROM ({_gram_counts('h')}) a JOIN ({_gram_counts('r')}) b USING (conv_id, turn, n, g) GROUP BY ALL),
p AS (SELECT conv_id, turn, count(*) AS orders, sum(ln(m / (len(h) - n + 1))) / 4 AS logs FROM hits JOIN t USING (conv_id, turn) GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN orders = 4 THEN exp(logs) * CASE WHEN len(h) > len(r) THEN 1 ELSE exp(1 - len(r) / greatest(len(h), 1)) END ELSE 0 END, 6) AS bleu FROM t LEFT JOIN p USING (conv_id, turn)"""


@query(_BLEU)
def bleu(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.round(M.bleu(T.tokens("text"), T.tokens("next")), 6).alias("bleu"))


_ITEMS = "it AS (SELECT source AS file, quality::DOUBLE AS completeness, toxic::DOUBLE AS hallucination, (n_chars % 7) / 7.0::DOUBLE AS \"ROUGELScore\", CASE WHEN n_chars % 3 > 0 THEN (n_chars % 5) / 5.0::DOUBLE END AS \"Words_Precision\", (n_chars % 4) / 4.0::DOUBLE AS \"Words_Recall\" FROM documents LEFT JOIN labels USING (doc_id))"


def _evaluated(spark, sf):
    d = _read(spark, sf, "documents").join(_read(spark, sf, "labels"), "doc_id", "left")
    c = F.col("n_chars")
    return d.select(F.col("source").alias("file"), F.col("quality").cast("double").alias("completeness"), F.col("toxic").cast("double").alias("hallucination"), ((c % 7) / 7.0).alias("ROUGELScore"), F.when(c % 3 > 0, (c % 5) / 5.0).alias("Words_Precision"), ((c % 4) / 4.0).alias("Words_Recall"))


_NAMES = ["completeness", "hallucination", "ROUGELScore", "Words_Precision", "Words_Recall"]
_AVG = f"{_ITEMS}, av AS (SELECT file, avg(completeness) AS c, avg(hallucination) AS h, avg(\"ROUGELScore\") AS g, avg(\"Words_Precision\") AS p, avg(\"Words_Recall\") AS r FROM it GROUP BY file)"
_F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"


@query(f"WITH {_AVG} SELECT file, round({_F1}, 6) AS words_f1, round(c - h, 6) AS factual, round(0.5 * (c - h) + 0.5 * g, 6) AS generation, round({_F1}, 6) AS retrieval FROM av")
def metric_report(spark, sf):
    d = report.derive(report.macro_average(_evaluated(spark, sf), _NAMES))
    return d.select("file", F.round("Words_F1", 6).alias("words_f1"), F.round("factual_score", 6).alias("factual"), F.round("Generation_Total_Score", 6).alias("generation"), F.round("Retrieval_Total_Score", 6).alias("retrieval"))


_LONG = lambda where: " UNION ALL ".join(f"SELECT file, '{n}' AS metric, avg(\"{n}\") AS v FROM it WHERE {where} GROUP BY file HAVING count(\"{n}\") > 0" for n in _NAMES)


@query(
    f"""WITH {_ITEMS}, a AS ({_LONG("file <= 'src5'")}), b AS ({_LONG("file >= 'src3'")}),
j AS (SELECT file, metric, coalesce(a.v, 0) AS p, coalesce(b.v, 0) AS c FROM a FULL JOIN b USING (file, metric))
SELECT file, metric, round(p, 6) AS previous, round(c, 6) AS current, CASE WHEN c - p > 1e-5 THEN 'up' WHEN c - p < -1e-5 THEN 'down' ELSE 'same' END AS direction FROM j"""
)
def compare_reports(spark, sf):
    items = _evaluated(spark, sf)
    a, b = (report.macro_average(items.where(w), _NAMES) for w in ("file <= 'src5'", "file >= 'src3'"))
    return report.compare(a, b).select("file", "metric", F.round("previous", 6).alias("previous"), F.round("current", 6).alias("current"), "direction")


@query("SELECT source, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0 END), 6) AS hallucination, round(avg(CASE WHEN toxic = 0 AND quality = 1 THEN 1.0 ELSE 0 END), 6) AS completeness, round(avg(CASE WHEN toxic = 0 AND quality = 0 THEN 1.0 ELSE 0 END), 6) AS irrelevance FROM documents JOIN labels USING (doc_id) GROUP BY source")
def keypoint_ratio(spark, sf):
    label = F.when(F.col("toxic") == 1, "Wrong").when(F.col("quality") == 1, "Relevant").otherwise("Irrelevant")
    rows = _read(spark, sf, "documents").join(_read(spark, sf, "labels"), "doc_id").groupBy("source").agg(M.ratios_by_label(F.collect_list(label)).alias("r"))
    return rows.select("source", *[F.round(f"r.{n}", 6).alias(n) for n in ("hallucination", "completeness", "irrelevance")])


# --- graph -------------------------------------------------------------------------------------

_TRIPLES = """
t0 AS (SELECT 1 AS part, CAST(s_suppkey AS BIGINT) AS k, s_name AS head, 'Organization' AS head_type, 'located' AS relation, n_name AS tail, 'Location' AS tail_type, CAST(s_suppkey AS BIGINT) AS doc_id FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 0, CAST(n_nationkey AS BIGINT), n_name, 'Location', 'part_of', r_name, 'Location', CAST(n_regionkey AS BIGINT) FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 2, CAST(c_custkey AS BIGINT), c_name, 'Person', 'lives_in', n_name, 'Location', CAST(c_custkey AS BIGINT) FROM customer JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT part * 1000000000 + k AS pos, head, head_type, relation, tail, tail_type, doc_id FROM t0)"""


def _triples(spark, sf):
    r = lambda n: _read(spark, sf, n)
    nation, region = r("nation"), r("region")

    def of(part, rows, key, head, kind, relation, tail, doc):
        return rows.select((F.lit(part * 1_000_000_000).cast("long") + F.col(key)).alias("pos"), F.col(head).alias("head"), F.lit(kind).alias("head_type"), F.lit(relation).alias("relation"), F.col(tail).alias("tail"), F.lit("Location").alias("tail_type"), F.col(doc).cast("long").alias("doc_id"))

    a = of(0, nation.join(region, nation.n_regionkey == region.r_regionkey), "n_nationkey", "n_name", "Location", "part_of", "r_name", "n_regionkey")
    b = of(1, r("supplier").join(nation, F.col("s_nationkey") == nation.n_nationkey), "s_suppkey", "s_name", "Organization", "located", "n_name", "s_suppkey")
    c = of(2, r("customer").join(nation, F.col("c_nationkey") == nation.n_nationkey), "c_custkey", "c_name", "Person", "lives_in", "n_name", "c_custkey")
    return a.unionByName(b).unionByName(c)


_ENT = f"{_TRIPLES}, en AS (SELECT type, name, min(spot) AS first FROM (SELECT head_type AS type, head AS name, pos * 2 AS spot FROM t UNION ALL SELECT tail_type, tail, pos * 2 + 1 FROM t) GROUP BY ALL), ent AS (SELECT 'e' || row_number() OVER (ORDER BY first) AS id, type, name FROM en)"


@query(f"WITH {_ENT} SELECT id, type, name FROM ent")
def kg_entities(spark, sf):
    return kg.entities(_triples(spark, sf)).select("id", "type", "name")


@query(f"WITH {_ENT} SELECT pos, h.id AS head_id, relation, l.id AS tail_id, doc_id FROM t JOIN ent h ON h.type = head_type AND h.name = head JOIN ent l ON l.type = tail_type AND l.name = tail")
def kg_triples(spark, sf):
    t = _triples(spark, sf)
    return kg.with_ids(t, kg.entities(t)).select("pos", "head_id", "relation", "tail_id", "doc_id")


@query(f"WITH {_TRIPLES} SELECT relation, count(*) AS count, arg_min(head_type, pos) AS example_head_type, arg_min(tail_type, pos) AS example_tail_type FROM t GROUP BY relation")
def kg_relation_stats(spark, sf):
    return kg.relations(_triples(spark, sf))


@query(f"WITH {_TRIPLES}, n AS (SELECT doc_id, row_number() OVER (ORDER BY pos) - 1 AS i FROM t) SELECT doc_id, min(i) AS start_triple_index, max(i) AS end_triple_index FROM n GROUP BY doc_id")
def kg_doc_ranges(spark, sf):
    return kg.doc_ranges(_triples(spark, sf))


@query(f"WITH {_ENT} SELECT (SELECT count(*) FROM ent) AS total_entities, count(*) AS total_triples, count(DISTINCT relation) AS total_relation_types FROM t")
def kg_statistics(spark, sf):
    t = _triples(spark, sf)
    return kg.statistics(t, kg.entities(t))


_INDEX = f"{_TRIPLES}, ix AS (SELECT DISTINCT lower(e) AS entity, CAST(doc_id AS VARCHAR) AS doc_id FROM (SELECT head AS e, doc_id FROM t UNION ALL SELECT tail, doc_id FROM t))"


@query(f"WITH {_INDEX} SELECT entity, doc_id FROM ix")
def kg_entity_index(spark, sf):
    return kg.entity_index(_triples(spark, sf))


def _graph_queries(spark, sf):
    """Each region asks about itself and its nations, by name."""
    n, r = _read(spark, sf, "nation"), _read(spark, sf, "region")
    both = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_regionkey").cast("long").alias("query_id"), F.lower("n_name").alias("token"))
    return both.unionByName(r.select(F.col("r_regionkey").cast("long").alias("query_id"), F.lower("r_name").alias("token")))


_ASK = "ask AS (SELECT CAST(r_regionkey AS BIGINT) AS query_id, lower(n_name) AS token FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT CAST(r_regionkey AS BIGINT), lower(r_name) FROM region)"


@query(f"WITH {_INDEX}, {_ASK}, c AS (SELECT query_id, doc_id, count(*) AS n FROM ask JOIN ix ON token = entity GROUP BY ALL) SELECT query_id, doc_id, round(n / max(n) OVER (PARTITION BY query_id), 6) AS boost FROM c")
def kg_entity_boost(spark, sf):
    b = kg.entity_boosts(_graph_queries(spark, sf), kg.entity_index(_triples(spark, sf)))
    return b.select("query_id", "doc_id", F.round("boost", 6).alias("boost"))


_HOPS = f"""{_TRIPLES}, ed AS (SELECT DISTINCT * FROM (SELECT lower(head) AS a, lower(tail) AS b FROM t UNION ALL SELECT lower(tail), lower(head) FROM t)),
h0 AS (SELECT CAST(r_regionkey AS BIGINT) AS query_id, lower(r_name) AS entity, 0 AS hop FROM region),
h1 AS (SELECT DISTINCT query_id, b AS entity, 1 AS hop FROM h0 JOIN ed ON entity = a WHERE (query_id, b) NOT IN (SELECT (query_id, entity) FROM h0)),
h2 AS (SELECT DISTINCT query_id, b AS entity, 2 AS hop FROM h1 JOIN ed ON entity = a WHERE (query_id, b) NOT IN (SELECT (query_id, entity) FROM h0 UNION ALL SELECT (query_id, entity) FROM h1))"""


@query(f"WITH {_HOPS} SELECT query_id, entity, CAST(hop AS INTEGER) AS hop FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)")
def kg_multihop(spark, sf):
    seeds = _read(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.lower("r_name").alias("entity"))
    return kg.hops(seeds, _triples(spark, sf)).select("query_id", "entity", F.col("hop").cast("int").alias("hop"))


@query(
    f"""WITH {_HOPS}, reached AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2),
ix AS (SELECT DISTINCT lower(e) AS entity, CAST(doc_id AS VARCHAR) AS doc_id FROM (SELECT head AS e, doc_id FROM t UNION ALL SELECT tail, doc_id FROM t)),
raw AS (SELECT query_id, doc_id, sum(pow(0.5, hop)) AS raw FROM reached JOIN ix USING (entity) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, raw / max(raw) OVER (PARTITION BY query_id) AS score FROM raw) {_top("sc", 50)}"""
)
def kg_rank_docs(spark, sf):
    seeds = _read(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.lower("r_name").alias("entity"))
    return kg.rank_docs(seeds, _triples(spark, sf))


@query(
    f"""WITH {_BM25}, base AS ({_top("bm", 50)}), bo AS (SELECT doc_id, toxic * 0.5 AS boost FROM labels),
f AS (SELECT query_id, doc_id, base.score + 2.0 * coalesce(boost, 0) AS score FROM base LEFT JOIN bo USING (doc_id))
SELECT query_id, doc_id, rank, score AS final_score FROM ({_top("f", 6)})"""
)
def rerank_fusion(spark, sf):
    base = _best(spark, sf, 50).drop("rank")
    boosts = _read(spark, sf, "labels").join(F.broadcast(base.select("query_id", "doc_id")), "doc_id").select("query_id", "doc_id", (F.col("toxic") * 0.5).alias("boost"))
    return S.rerank(base, boosts, 6).select("query_id", "doc_id", "rank", "final_score")


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(0.02 + pow(score / top, 1.8) * (least(0.25, 0.15 + 0.07 * 1.5) - 0.02), 6) AS boost FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM bm)")
def graph_boost_shape(spark, sf):
    corpus, asked = retrieve.Corpus(_docs(spark, sf)), S.query_terms(_items(spark, sf), T.tokens("text"))
    top = retrieve.scored(asked, corpus, 1, digits=12).select("query_id", F.col("score").alias("top"))
    rows = retrieve.scored(asked, corpus, None).join(F.broadcast(top), "query_id")
    return rows.select("query_id", "doc_id", F.round(S.graph_boost(F.col("score") / F.col("top"), 1.5), 6).alias("boost"))


# --- context, parents, feedback ----------------------------------------------------------------

_CTX = f"{_BM25}, top AS ({_top('bm', 3)}), lab AS (SELECT query_id, rank, '### Source ' || rank || ' [domain=' || source || ' | id=' || doc_id || ']' || chr(10) || trim(text) AS b FROM top JOIN documents USING (doc_id) WHERE trim(text) <> '')"


@query(f"WITH {_CTX} SELECT query_id, md5(string_agg(b, chr(10) || chr(10) ORDER BY rank)) AS digest FROM lab GROUP BY query_id")
def context_block(spark, sf):
    docs = _read(spark, sf, "documents").select("doc_id", "text", P.metadata_label(F.col("source"), doc_id=F.col("doc_id")).alias("label"))
    return P.context_blocks(docs.join(F.broadcast(_best(spark, sf, 3)), "doc_id"), ["query_id"]).select("query_id", F.md5("context").alias("digest"))


@query("SELECT doc_id, ' [domain=' || source || ' | company=' || lang || ' | id=' || doc_id || ']' AS label FROM documents")
def metadata_label(spark, sf):
    d = _read(spark, sf, "documents")
    return d.select("doc_id", P.metadata_label(F.col("source"), company=F.col("lang"), doc_id=F.col("doc_id")).alias("label"))


@query(f"WITH {_BM25}, top AS ({_top('bm', 6)}), n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM top) SELECT query_id, doc_id, CAST(CASE WHEN rank % 2 = 1 THEN (rank + 1) // 2 ELSE n - rank // 2 + 1 END AS INTEGER) AS place FROM n")
def lost_in_middle(spark, sf):
    top = _best(spark, sf, 6).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    return top.select("query_id", "doc_id", P.lost_in_middle(F.col("n"), F.col("rank")).alias("place"))


@query(
    f"""WITH w AS (SELECT {{'d': doc_id, 'i': CAST(s / 800 AS INTEGER)}} AS doc_id, substr(text, s + 1, 1000) AS text FROM (SELECT doc_id, text, unnest(range(0, CAST(length(text) AS BIGINT), 800)) AS s FROM documents WHERE length(text) > 0)), {_BM25.replace('FROM documents', 'FROM w')},
pa AS (SELECT query_id, doc_id.d AS doc_id, max(score) AS score FROM bm GROUP BY ALL) {_top("pa", 6)}"""
)
def parent_docs(spark, sf):
    """BM25 on fixed windows, then the best window of each document."""
    return retrieve.bm25_topk(_items(spark, sf), retrieve.Corpus(_docs(spark, sf), windows=lambda t: chunk.fixed_windows(t, 1000, 200)), 6)


def _feedback(spark, sf, corpus):
    """Words that the first three documents of each item add to it."""
    return retrieve.feedback_terms(retrieve.bm25_topk(_items(spark, sf), corpus, 3), corpus, _docs(spark, sf))


@query(f"WITH {_BM25}, top AS ({_top('bm', 3)}), f AS (SELECT query_id, token AS doc_id, sum(tf * ln(n / df)) AS score FROM top JOIN tf USING (doc_id) JOIN stats USING (token), corpus GROUP BY ALL) SELECT query_id, doc_id AS token, rank, score FROM ({_top('f', 10)})")
def prf_terms(spark, sf):
    return _feedback(spark, sf, retrieve.Corpus(_docs(spark, sf)))


@query(f"WITH {_BM25}, top AS ({_top('bm', 6)}) SELECT query_id, count(*) AS n_chunks, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars, CASE WHEN count(*) < 2 OR sum(length(coalesce(text, ''))) < 100 THEN 'graph' ELSE 'chunks' END AS route FROM top JOIN documents USING (doc_id) GROUP BY query_id")
def evidence_route(spark, sf):
    return retrieve.sufficiency(_docs(spark, sf).join(F.broadcast(_best(spark, sf, 6)), "doc_id"))


@query()
def predictions(spark, sf):
    """The whole inference plan: an answer with references and type for each benchmark item."""
    from lodestone.plans.pipelines import infer

    items = _items(spark, sf).withColumn("language", F.lit("en"))
    v = _docs(spark, sf)
    return infer(items, v, providers.hashing_embedder(16)).select("query_id", F.to_json("prediction").alias("prediction"))


# --- other languages and policies --------------------------------------------------------------

#: Stand-ins for a Han text, since the tables have none: each letter becomes a character.
_LETTERS, _HAN = "abcdefghijklmnopqrstuvwxyz. ", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余。"
_ZH = f"translate(lower(coalesce(text, '')), '{_LETTERS}', '{_HAN}')"
_GRAMS = "flatten(list_transform(regexp_extract_all({0}, '[\\x{{4e00}}-\\x{{9fff}}]+'), lambda r: list_concat(list_transform(range(1, length(r) + 1), lambda i: substr(r, i, 1)), list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))".format(_ZH)


def _han(column: str = "text"):
    return F.translate(F.lower(F.coalesce(column, F.lit(""))), _LETTERS, _HAN)


def _han_texts(low):
    """The same for lower-case texts; translate() takes ten times as long for many."""
    table = {ord(c): _HAN[i] if i < len(_HAN) else None for i, c in enumerate(_LETTERS)}

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.str.translate(table)

    return run(low)


@query(f"WITH {_BM25.replace(_TOK, _GRAMS)} {_top('bm', 6)}")
def zh_bm25_topk(spark, sf):
    """BM25 by Han characters and pairs."""
    items, docs = _items(spark, sf).withColumn("text", _han()), _docs(spark, sf).withColumn("text", _han_texts(F.lower(F.coalesce("text", F.lit("")))))
    return retrieve.bm25_topk(items, docs, 6, zh=True)


_ZH_TURNS = f"""l AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations),
t AS (SELECT conv_id, turn, {_ZH} AS h, {_ZH.replace('text', 'next')} AS g FROM l WHERE next IS NOT NULL)"""


@query(
    f"""WITH {_ZH_TURNS}, m AS (SELECT *, coalesce(list_sum(list_transform(list_filter(list_transform(regexp_extract_all(g, '[^。！？\n]*[。！？]|[^。！？\n]+'), lambda s: trim(s)), lambda s: s <> '' AND contains(h, s)), lambda s: length(s))), 0) AS n FROM t)
SELECT conv_id, turn, round(CASE WHEN length(h) > 0 THEN n / length(h) ELSE 0 END, 6) AS p, round(CASE WHEN length(g) > 0 THEN n / length(g) ELSE 0 END, 6) AS r FROM m"""
)
def zh_sentence_pr(spark, sf):
    """Sentence precision and recall by characters, for Han texts."""
    t = _turns(spark, sf).withColumns({"f": F.array(_han("text")), "g": F.array(_han("next"))})
    return t.select("conv_id", "turn", F.round(M.sentence_precision(F.col("f"), F.col("g"), True), 6).alias("p"), F.round(M.sentence_recall(F.col("f"), F.col("g"), True), 6).alias("r"))


@query()
def policy_topk(spark, sf):
    """The best chunks of each benchmark item among those cut by its own policy."""
    asked = C.chunk_policy(C.classify(_items(spark, sf).withColumn("language", F.lit("en")), "text"))
    return retrieve.policy_retrieve(asked, _docs(spark, sf)).select("query_id", "doc_id", "chunk_index", "rank", "score")


from lodestone import answer_queries  # noqa: E402, F401  registers the rest
