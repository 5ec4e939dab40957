"""Registered queries of answering, judging, graph evidence and uneven fields, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions import fields as X
from lodestone.functions import prompts as P
from lodestone.functions import text as T
from lodestone.operators import answers, chunk, kg, providers, retrieve, tools
from lodestone.operators import score as S
from lodestone.queries import _asked as _all_asked
from lodestone.queries import _BM25, _COS, _HOPS, _PAIRS, _SENT, _T, _TRIPLES, _WINDOWS, _best, _classify_sql, _docs, _feedback, _items, _read, _top, _triples, _turns, query

_SHARED = lambda a, b: f"CASE WHEN len({_T(a)}) > 0 THEN len(list_intersect({_T(a)}, {_T(b)}))::DOUBLE / len(list_distinct({_T(a)})) ELSE 0 END"
_ASKED = "benchmark b JOIN top ON b.item_id = top.query_id JOIN documents d USING (doc_id)"


def _asked(spark, sf, k: int):
    """The first k documents of each benchmark item: query_id, query, doc_id, text, rank."""
    items = _items(spark, sf).withColumnRenamed("text", "query")
    return _docs(spark, sf).join(F.broadcast(_best(spark, sf, k).join(items, "query_id")), "doc_id")


# --- judging -----------------------------------------------------------------------------------

_LABELS = f"k AS (SELECT conv_id, turn, list_transform({_SENT('next')}, lambda x: CASE WHEN {_SHARED('x', 'text')} >= 0.3 THEN 1 ELSE 0 END) AS l FROM p)"


@query(
    f"""WITH {_PAIRS}, {_LABELS} SELECT conv_id, turn, len(l) AS points, round(CASE WHEN len(l) > 0 THEN list_sum(l)::DOUBLE / len(l) ELSE 0 END, 6) AS completeness,
round(CASE WHEN len(l) > 0 THEN 1 - list_sum(l)::DOUBLE / len(l) ELSE 0 END, 6) AS irrelevance, round(CASE WHEN len(l) > 0 THEN list_sum(l)::DOUBLE / len(l) END, 6) AS found_completeness FROM k"""
)
def keypoint_judging(spark, sf):
    """Each turn judged by the sentences of the next as key points."""
    items = _turns(spark, sf).select("conv_id", "turn", F.col("text").alias("answer"), T.sentences("next").alias("points"))
    judged = answers.judge_key_points(items, judge=lambda a, p: providers.key_point_judge(a, p, 0.3))
    r = lambda n: F.round(n, 6)
    return judged.select("conv_id", "turn", F.size("points").cast("long").alias("points"), r("ratios.completeness").alias("completeness"), r("ratios.irrelevance").alias("irrelevance"), r("found_ratios.completeness").alias("found_completeness"))


# --- evidence and routing ----------------------------------------------------------------------


@query(
    f"""WITH {_BM25}, top AS ({_top('bm', 8)}), j AS (SELECT query_id, doc_id, rank, {_SHARED('b.text', 'substr(d.text, 1, 700)')} AS s FROM {_ASKED} WHERE rank <= 6 AND trim(coalesce(d.text, '')) <> '')
SELECT query_id, doc_id, rank FROM (SELECT *, max(s) OVER (PARTITION BY query_id) AS m FROM j) WHERE s >= 0.2 OR m < 0.2"""
)
def relevant_chunks(spark, sf):
    """Chunks that a judge of relevance keeps; a query that would lose all keeps all."""
    return answers.relevant(_asked(spark, sf, 8)).select("query_id", "doc_id", "rank")


_CUT = lambda c, n: f"replace(substr({c}, 1, {n}), chr(10), ' ')"
_PROOF = f"CASE WHEN length(d.text) > 200 THEN {_CUT('d.text', 200)} || '...' ELSE {_CUT('d.text', 200)} END"


@query(
    f"""WITH {_BM25}, top AS ({_top('bm', 6)}), c AS (SELECT query_id, first(b.text) AS q, string_agg({_PROOF}, chr(10) ORDER BY rank) AS ctx FROM {_ASKED} WHERE rank <= 5 GROUP BY query_id),
l AS (SELECT query_id, CASE WHEN {_SHARED('q', 'ctx')} >= 0.5 THEN 'SUFFICIENT' ELSE 'INSUFFICIENT' END AS label FROM c)
SELECT query_id, label, CASE WHEN label = 'SUFFICIENT' OR query_id % 2 = 1 THEN 'chunks' ELSE 'graph' END AS route FROM l"""
)
def answer_route(spark, sf):
    """The way to each answer; the graph knows every second item."""
    graph = _items(spark, sf).where("query_id % 2 = 0").select("query_id")
    return answers.route(_asked(spark, sf, 6), graph)


@query("SELECT item_id AS query_id, coalesce((item_id % 6 = 3) OR trim(text) IN (SELECT trim(text) FROM benchmark WHERE item_id % 6 = 3), false) AS unsolvable FROM benchmark")
def unsolvable_flags(spark, sf):
    """Items that a keyword table (every third item, of these every second marked) calls unsolvable."""
    rows = _items(spark, sf).where("query_id % 3 = 0").select("query_id", F.col("text").alias("content"), T.keywords("text").alias("keywords"), (F.col("query_id") % 2).cast("int").alias("unsolve"))
    return answers.flag_unsolvable(_items(spark, sf), retrieve.keyword_table(rows)).select("query_id", "unsolvable")


@query(f"{_classify_sql()} SELECT id, regexp_matches(lower(canonical_type), 'multi|hop|compare|caus|reason') OR length(id) < 5 AS asks FROM y")
def sub_question_trigger(spark, sf):
    """Whether a question is split, with the length of its id for the count of results."""
    typed = C.classify(_all_asked(spark, sf), "text")
    return typed.select("id", C.asks_sub_question(F.col("canonical_type"), F.length("id"), 5).alias("asks"))


_PARTS = f"asked AS (SELECT item_id * 1000 + i - 1 AS item_id, s[i] AS text FROM (SELECT item_id, {_SENT('text')} AS s, unnest(range(1, len({_SENT('text')}) + 1)) AS i FROM benchmark))"


@query(
    f"""WITH {_PARTS}, {_BM25.replace('FROM benchmark', 'FROM asked')}, top AS ({_top('bm', 1)}), l AS (SELECT a.item_id AS id, a.text || ': ' || {_CUT('d.text', 200)} AS line FROM top JOIN asked a ON a.item_id = query_id JOIN documents d USING (doc_id))
SELECT id // 1000 AS query_id, md5(string_agg(line, chr(10) ORDER BY id)) AS digest FROM l GROUP BY ALL"""
)
def sub_question_chunks(spark, sf):
    """One made-up chunk for each item: its sentences as sub-questions, each with its best document."""
    docs = _docs(spark, sf)
    found = answers.sub_questions(_items(spark, sf), lambda q: retrieve.bm25_topk(q, docs, 1), docs, T.sentences)
    return found.select("query_id", F.md5("text").alias("digest"))


@query(f"WITH {_BM25}, top AS ({_top('bm', 6)}) SELECT item_id AS query_id, 0 AS priority, 0 AS rank, CAST(NULL AS BIGINT) AS doc_id FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT query_id, 1, rank, doc_id FROM top WHERE rank <= 3")
def pseudo_first(spark, sf):
    """Hints before real chunks, of which the first three stay."""
    real = _best(spark, sf, 6).select("query_id", "doc_id", "rank", F.lit(False).alias("is_pseudo"))
    hints = _items(spark, sf).where("query_id % 2 = 0").select("query_id", F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("rank"), F.lit(True).alias("is_pseudo"))
    return retrieve.with_hints(hints, real).select("query_id", "priority", "rank", "doc_id")


_PROMPT = "'Answer from the sources alone. If they do not hold the answer, say so.' || chr(10) || chr(10) || ctx || chr(10) || chr(10) || chr(10) || chr(10) || 'Question: ' || q || chr(10) || 'Answer:'"


@query(f"WITH {_BM25}, top AS ({_top('bm', 3)}), c AS (SELECT query_id, first(b.text) AS q, string_agg(coalesce(d.text, ''), chr(10) || chr(10) ORDER BY rank) AS ctx, arg_min(doc_id, rank) AS reference FROM {_ASKED} GROUP BY query_id) SELECT query_id, md5({_PROMPT}) AS digest, reference FROM c")
def baseline_answers(spark, sf):
    """The plain way: all chunks in one prompt, the first as reference."""
    return answers.baseline_answers(_asked(spark, sf, 3)).select("query_id", F.md5("prompt").alias("digest"), "reference")


# --- retrieval variants ------------------------------------------------------------------------


@query(f"WITH {_BM25}, top AS ({_top('bm', 20)}), cr AS (SELECT query_id, doc_id, {_SHARED('b.text', 'd.text')} AS score FROM {_ASKED}) {_top('cr', 6)}")
def cross_rerank_topk(spark, sf):
    """The first 20 documents ranked anew by a scorer of pairs."""
    return answers.cross_rerank(_asked(spark, sf, 20), 6)


@query(
    f"""WITH {_BM25}, top AS ({_top('bm', 3)}), f AS (SELECT query_id, token AS doc_id, sum(tf * ln(n / df)) AS score FROM top JOIN tf USING (doc_id) JOIN stats USING (token), corpus GROUP BY ALL),
more AS (SELECT query_id, doc_id AS token FROM ({_top('f', 10)})), q2 AS (SELECT query_id, token, sum(w) AS qtf FROM (SELECT query_id, token, qtf::DOUBLE AS w FROM qt UNION ALL SELECT query_id, token, 0.5 FROM more) GROUP BY ALL),
b2 AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.3 + 0.7 * dl / avgdl))) AS score FROM q2 JOIN idf USING (token) JOIN tf USING (token) GROUP BY ALL) {_top('b2', 6)}"""
)
def prf_expanded_topk(spark, sf):
    """BM25 with the terms of the first ranking's top documents added to the query."""
    corpus = retrieve.Corpus(_docs(spark, sf))
    terms = _feedback(spark, sf, corpus)
    asked = answers.expanded(S.query_terms(_items(spark, sf), T.tokens("text")), terms, 0.5)
    return retrieve.scored(asked, corpus, 6)


@query(
    f"""WITH asked AS (SELECT item_id * 2 AS item_id, text FROM benchmark UNION ALL SELECT item_id * 2 + 1, substr(text, 1, 60) FROM benchmark), {_BM25.replace('FROM benchmark', 'FROM asked')}, top AS ({_top('bm', 20)}),
fu AS (SELECT query_id // 2 AS query_id, doc_id, sum(1 / (60 + rank)) AS score FROM top GROUP BY ALL) {_top('fu', 6)}"""
)
def multi_query_fusion(spark, sf):
    """Two wordings of each item, whole and its first 60 characters, ranked apart and fused."""
    items = _items(spark, sf)
    both = items.select(F.struct("query_id", F.lit(0).alias("variant")).alias("query_id"), "text").unionByName(items.select(F.struct("query_id", F.lit(1).alias("variant")).alias("query_id"), F.substring("text", 1, 60).alias("text")))
    ranked = retrieve.bm25_topk(both, _docs(spark, sf), 20).select("query_id.query_id", "query_id.variant", "doc_id", "rank")
    return answers.fuse_variants(ranked, 6)


@query(f"WITH de AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, CASE WHEN d.vec_id % 10 = 0 THEN 0 ELSE {_COS} END AS score FROM embeddings q JOIN embeddings d ON d.vec_id // 100 = q.vec_id // 100 AND d.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0) SELECT query_id, doc_id AS keyword, rank, score FROM ({_top('de', 5)})")
def semantic_keywords(spark, sf):
    """The five candidates (rows of the same hundred, each tenth a zero vector) most like each query."""
    v = _read(spark, sf, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 100).alias("h"))
    asked = v.where("vec_id % 100 = 0").select("h", F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    zero = F.transform("embedding", lambda x: x * 0)
    pairs = asked.join(v, "h").where("vec_id <> query_id").select("query_id", F.col("vec_id").alias("keyword"), "q", F.when(F.col("vec_id") % 10 == 0, zero).otherwise(F.col("embedding")).alias("v"))
    return answers.semantic_keywords(pairs)


# --- graph -------------------------------------------------------------------------------------

_LINE = "head || ' --[' || relation || ']--> ' || tail"
_REACHED = """e2 AS (SELECT a, b, min(step) AS step FROM (SELECT lower(head) AS a, lower(tail) AS b, {0} AS step FROM t UNION ALL SELECT lower(tail), lower(head), {0} FROM t) GROUP BY ALL),
p0 AS (SELECT *, '' AS path FROM h0),
p1 AS (SELECT h1.query_id, h1.entity, 1 AS hop, min(step) AS path FROM h1 JOIN e2 ON b = h1.entity JOIN p0 ON p0.query_id = h1.query_id AND p0.entity = a GROUP BY ALL),
p2 AS (SELECT h2.query_id, h2.entity, 2 AS hop, min(path || ' ; ' || step) AS path FROM h2 JOIN e2 ON b = h2.entity JOIN p1 ON p1.query_id = h2.query_id AND p1.entity = a GROUP BY ALL),
re AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2)""".format(_LINE)


def _seeds(spark, sf):
    return _read(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.lower("r_name").alias("entity"))


@query(f"WITH {_HOPS}, {_REACHED} SELECT query_id, entity, CAST(hop AS INTEGER) AS hop, path FROM re")
def kg_paths(spark, sf):
    """A shortest way to each entity."""
    return kg.paths(_seeds(spark, sf), _triples(spark, sf))


@query(
    f"""WITH {_HOPS}, {_REACHED}, ix AS (SELECT DISTINCT lower(e) AS entity, CAST(doc_id AS VARCHAR) AS doc_id FROM (SELECT head AS e, doc_id FROM t UNION ALL SELECT tail, doc_id FROM t)),
raw AS (SELECT query_id, doc_id, sum(pow(0.5, hop)) AS raw FROM re JOIN ix USING (entity) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, raw / max(raw) OVER (PARTITION BY query_id) AS score FROM raw), top AS ({_top("sc", 5)}),
ro AS (SELECT query_id, doc_id, line, path, hop FROM top JOIN (SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_LINE} AS line, unnest([lower(head), lower(tail)]) AS entity FROM t) USING (doc_id) JOIN re USING (query_id, entity)),
li AS (SELECT query_id, doc_id, 'triple' AS kind, line, min(hop) AS hop FROM ro GROUP BY ALL UNION ALL SELECT query_id, doc_id, 'path', path, min(hop) FROM ro WHERE path <> '' GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, kind ORDER BY hop, line) AS n FROM li),
ag AS (SELECT query_id, doc_id, string_agg(line, '|' ORDER BY n) FILTER (kind = 'path' AND n <= 3) AS paths, string_agg(line, '|' ORDER BY n) FILTER (kind = 'triple' AND n <= 3) AS evidence FROM n GROUP BY ALL)
SELECT query_id, doc_id, rank, coalesce(paths, '') AS paths, coalesce(evidence, '') AS evidence FROM top LEFT JOIN ag USING (query_id, doc_id)"""
)
def kg_evidence(spark, sf):
    """The first documents of each region with paths and triples that bear them out."""
    t, seeds = _triples(spark, sf), _seeds(spark, sf)
    found = kg.evidence(kg.rank_docs(seeds, t), kg.paths(seeds, t), t)
    return found.select("query_id", "doc_id", "rank", F.array_join("paths", "|").alias("paths"), F.array_join("evidence_triples", "|").alias("evidence"))


@query(
    f"""WITH {_HOPS}, ix AS (SELECT DISTINCT lower(e) AS entity, CAST(doc_id AS VARCHAR) AS doc_id FROM (SELECT head AS e, doc_id FROM t UNION ALL SELECT tail, doc_id FROM t)),
re AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2), far AS (SELECT query_id, count(*) FILTER (hop > 0) AS multi_hop_entities, CAST(max(hop) AS INTEGER) AS max_hops FROM re GROUP BY query_id),
ro AS (SELECT query_id, string_agg(DISTINCT entity, ',' ORDER BY entity) AS entities_found, string_agg(DISTINCT doc_id, ',' ORDER BY doc_id) AS related_doc_ids FROM h0 JOIN ix USING (entity) GROUP BY query_id)
SELECT query_id, multi_hop_entities, max_hops, coalesce(entities_found, '') AS entities_found, coalesce(related_doc_ids, '') AS related_doc_ids FROM far LEFT JOIN ro USING (query_id)"""
)
def kg_entity_info(spark, sf):
    """What the graph knows of each region's name."""
    info = kg.entity_info(_seeds(spark, sf), _triples(spark, sf))
    return info.select("query_id", "multi_hop_entities", "max_hops", F.array_join("entities_found", ",").alias("entities_found"), F.array_join("related_doc_ids", ",").alias("related_doc_ids"))


@query(f"WITH {_TRIPLES} SELECT coalesce(CASE WHEN relation NOT IN ('located') THEN 'relation' END, 'none') AS problem, count(*) AS n FROM t GROUP BY ALL")
def kg_schema_check(spark, sf):
    """Triples by what is wrong with them."""
    return kg.checked(_triples(spark, sf)).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


@query(f"WITH {_TRIPLES} SELECT count(*) AS triples, count(*) FILTER (coalesce(head, '') = '') AS no_head, count(*) FILTER (coalesce(tail, '') = '') AS no_tail, count(*) FILTER (doc_id IS NULL) AS no_doc FROM t")
def kg_health(spark, sf):
    return kg.health(_triples(spark, sf))


@query(f"WITH {_TRIPLES} SELECT doc_id, arg_min(source, pos) AS domain, arg_min(lang, pos) AS language FROM t JOIN documents USING (doc_id) GROUP BY doc_id")
def kg_doc_domains(spark, sf):
    """Domain and language of each document's triples, taken from the document."""
    docs = _read(spark, sf, "documents").select("doc_id", F.col("source").alias("domain"), F.col("lang").alias("language"))
    none = F.lit(None).cast("string")
    rows = kg.with_defaults(_triples(spark, sf).withColumns({"domain": none, "language": none}), docs)
    return kg.domains(rows).join(rows.groupBy("doc_id").agg(F.min_by("language", "pos").alias("language")), "doc_id")


# --- chunks and fields -------------------------------------------------------------------------


@query(f"WITH {_WINDOWS} SELECT doc_id, count(*) AS n, md5(string_agg(substr(text, s + 1, 1000), '|' ORDER BY s)) AS digest FROM w GROUP BY doc_id")
def chunks_by_document(spark, sf):
    """The chunks of each document in order."""
    rows = _docs(spark, sf).select("doc_id", F.posexplode(chunk.fixed_windows(F.col("text"), 1000, 200)).alias("chunk_index", "text"))
    return tools.by_document(rows).select("doc_id", F.size("chunks").cast("long").alias("n"), F.md5(F.array_join("chunks", "|")).alias("digest"))


@query("WITH t AS (SELECT CAST(128 * pow(2, doc_id % 3) AS INTEGER) AS size, n_chars % 2 AS hit FROM documents), m AS (SELECT size, avg(hit) AS r FROM t GROUP BY size) SELECT size, round(r, 6) AS recall, size = (SELECT size FROM m ORDER BY r DESC, size LIMIT 1) AS best FROM m")
def best_chunk_size(spark, sf):
    """Mean recall by chunk size, and the best."""
    trials = _read(spark, sf, "documents").select((F.lit(128) * F.pow(F.lit(2), F.col("doc_id") % 3)).cast("int").alias("size"), (F.col("n_chars") % 2).alias("recall"))
    return tools.best_size(trials).select("size", F.round("recall", 6).alias("recall"), "best")


@query("SELECT doc_id, coalesce(CASE WHEN trim(lang) <> '' THEN lang END, 'en') AS language FROM documents")
def row_languages(spark, sf):
    """Each row's own language."""
    return tools.in_language(_read(spark, sf, "documents"), "auto").select("doc_id", "language")


@query("SELECT item_id AS query_id, text AS content, CASE item_id % 3 WHEN 0 THEN 1.5 ELSE 3.0 END AS weight, CASE WHEN item_id % 2 = 0 THEN 'law' ELSE 'none' END AS domain FROM benchmark")
def uneven_fields(spark, sf):
    """Queries that are texts or objects, weights that are no numbers, and a nested field with a default."""
    row = F.when(F.col("query_id") % 2 == 0, F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("query"), F.struct(F.lit("law").alias("domain")).alias("meta")))).otherwise(F.to_json(F.struct(F.col("text").alias("query"))))
    weight = F.when(F.col("query_id") % 3 == 0, "1.5").when(F.col("query_id") % 3 == 1, '{"a": 1}')
    return _items(spark, sf).select("query_id", X.query_text(row).alias("content"), X.lenient_number(weight).alias("weight"), X.field_or(row, "$.meta.domain", "none").alias("domain"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, len(list_intersect({_T('text')}, {_T('next')})) = 0 AS apart FROM p")
def disjoint_turns(spark, sf):
    """Whether a turn and the next share no word."""
    return _turns(spark, sf).select("conv_id", "turn", X.disjoint(T.tokens("text"), T.tokens("next")).alias("apart"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 25")
def first_documents(spark, sf):
    """The first 25 rows by position."""
    return tools.first_rows(_read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", 25)


@query("SELECT item_id AS query_id, CASE WHEN length(text) > 50 THEN replace(substr(text, 1, 50), chr(10), ' ') || '...' ELSE replace(text, chr(10), ' ') END AS shown, 'passage: ' || text AS passage FROM benchmark")
def previews(spark, sf):
    return _items(spark, sf).select("query_id", P.preview(F.col("text"), 50, True).alias("shown"), P.passage_input(F.col("text")).alias("passage"))
