"""From ranked chunks to an answer: what is kept, which way is taken, sub-questions, key-point judging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.functions import prompts as P
from lodestone.functions import text as T

from . import providers, retrieve
from . import score as S

#: Chunks judged for relevance and their characters; chunks of the sufficiency judge and their preview.
JUDGED, SNIPPET, PROOFS, PREVIEW = 6, 700, 5, 200


def flag_unsolvable(queries: DataFrame, table: DataFrame) -> DataFrame:
    """Queries with `unsolvable`: whether their id as text or trimmed text is so marked in a keyword table."""
    marked = table.where("unsolvable").select(F.col("key").alias("_key")).distinct()
    keys = queries.select("query_id", F.explode(F.array(F.col("query_id").cast("string"), F.trim("text"))).alias("_key"))
    hit = keys.join(marked, "_key", "left_semi").select("query_id").distinct().withColumn("_hit", F.lit(True))
    return queries.join(hit, "query_id", "left").withColumn("unsolvable", F.coalesce("_hit", F.lit(False))).drop("_hit")


def relevant(chunks: DataFrame, judge: Callable[[Column, Column], Column] = providers.relevance_judge) -> DataFrame:
    """The first JUDGED chunks (query_id, query, rank, text) that the judge calls A or B, by their first
    SNIPPET characters. Blank chunks go; a chunk without a label stays; a query left with none keeps all."""
    shown = chunks.where((F.col("rank") <= JUDGED) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return retrieve.keep_relevant(shown, judge(F.col("query"), F.substring("text", 1, SNIPPET)) != "C")


def route(chunks: DataFrame, graph: DataFrame, judge: Callable[[Column, Column], Column] = providers.sufficiency_judge) -> DataFrame:
    """query_id, label, route: "chunks" where the first PROOFS previews suffice or the graph (query_id)
    has nothing for the query, else "graph". A missing label does not suffice."""
    proofs = F.transform(F.sort_array(F.collect_list(F.struct("rank", P.preview(F.col("text"), PREVIEW, True).alias("p")))), lambda x: x["p"])
    shown = chunks.where(F.col("rank") <= PROOFS).groupBy("query_id").agg(F.first("query").alias("query"), F.array_join(proofs, "\n").alias("context"))
    judged = shown.select("query_id", judge(F.col("query"), F.col("context")).alias("label"))
    has = graph.select("query_id").distinct().withColumn("_graph", F.lit(True))
    enough = F.coalesce(providers.is_sufficient(F.col("label")), F.lit(False))
    way = F.when(enough | F.col("_graph").isNull(), "chunks").otherwise("graph")
    return judged.join(has, "query_id", "left").select("query_id", "label", way.alias("route"))


def sub_index_size(top_k: Column | int) -> Column:
    """Results that a sub-question asks for: four times the cut, from 20 to 60."""
    k = F.lit(top_k) if isinstance(top_k, int) else top_k
    return F.least(F.greatest(4 * k, F.lit(20)), F.lit(60))


def sub_questions(queries: DataFrame, search: Callable[[DataFrame], DataFrame], docs: DataFrame, decompose: Callable[[Column], Column] | None = None) -> DataFrame:
    """query_id, text, is_pseudo: one chunk for each query, a line for each sub-question with the start of
    its best document. `search` ranks (query_id, text); `decompose` gives an array of questions. Without
    it, and for queries without sub-questions or results, there is no chunk."""
    if decompose is None:
        return queries.select("query_id", "text", F.lit(True).alias("is_pseudo")).where("false")
    asked = queries.select(F.col("query_id").alias("_q"), F.posexplode(decompose(F.col("text"))).alias("_i", "text"))
    asked = asked.select(F.struct("_q", "_i").alias("query_id"), "text")
    best = search(asked).where("rank = 1").select("query_id", "doc_id")
    found = docs.select("doc_id", F.col("text").alias("_d")).join(F.broadcast(best.join(asked, "query_id")), "doc_id")
    line = F.concat("text", F.lit(": "), P.preview(F.col("_d"), PREVIEW))
    lines = F.sort_array(F.collect_list(F.struct(F.col("query_id._i").alias("i"), line.alias("l"))))
    out = found.groupBy(F.col("query_id._q").alias("query_id")).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("text"))
    return out.withColumn("is_pseudo", F.lit(True))


def judge_key_points(items: DataFrame, answer: str = "answer", points: str = "points", judge: Callable[[Column, Column], Column] = providers.key_point_judge) -> DataFrame:
    """Items with `labels` (one a key point), `ratios` over all points and `found_ratios` over the labels there are."""
    out = items.withColumn("labels", judge(F.col(answer), F.col(points)))
    return out.withColumns({"ratios": M.ratios_by_label(F.col("labels")), "found_ratios": M.ratios_of_found(F.col("labels"))})


def judge_by_model(items: DataFrame, model: Callable[[str], str], answer: str = "answer", points: str = "points", query: str = "query", retries: int = 3) -> DataFrame:
    """The same by a text model: prompt, call with bounded retries, labels in the order of the points."""
    asked = items.withColumn("_prompt", P.judge_prompt(F.col(query), F.col(answer), M.format_key_points(F.col(points)), "v2"))
    said = providers.call(asked, "_prompt", model, "_said", retries).drop("_prompt")
    out = said.withColumn("labels", F.coalesce(M.labels_in_order(F.col("_said"), F.size(points)), F.array().cast("array<string>"))).drop("_said")
    return out.withColumns({"ratios": M.ratios_by_label(F.col("labels")), "found_ratios": M.ratios_of_found(F.col("labels"))})


def baseline_answers(chunks: DataFrame, model: Callable[[str], str] | None = None) -> DataFrame:
    """query_id, prompt, reference (the first chunk's document): one prompt of all chunks in rank order;
    with a model also answer and error."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "doc_id", "text")))
    got = chunks.groupBy("query_id", "query").agg(rows.alias("r"))
    prompt = P.answer_prompt(F.col("query"), F.array_join(F.transform("r", lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n"))
    out = got.select("query_id", prompt.alias("prompt"), F.element_at("r", 1)["doc_id"].alias("reference"))
    return out if model is None else providers.call(out, "prompt", model)


def cross_rerank(candidates: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = providers.overlap_scorer) -> DataFrame:
    """Candidates (query_id, query, doc_id, text) ranked anew by a pairwise scorer."""
    return S.ranked(candidates.select("query_id", "doc_id", scorer(F.col("query"), F.col("text")).alias("score")), k)


def semantic_keywords(candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, keyword, rank, score: the k candidates (query_id, keyword, q, v) whose vector is most like
    the query's; a zero vector on either side is like nothing (score 0)."""
    a, b = S.as_double(F.col("q")), S.as_double(F.col("v"))
    like = F.when((S.norm(a) > 0) & (S.norm(b) > 0), S.cosine(a, b)).otherwise(0.0)
    scored = candidates.select("query_id", "keyword", like.alias("score"))
    return S.ranked(scored, k, doc="keyword")


def keyword_candidates(queries: DataFrame, embed: Callable[[Column], Column], most: int = 3, least: int = 3) -> DataFrame:
    """Word n-grams of each query with their vectors and the query's, for semantic_keywords()."""
    words = T.tokens("text", T.STOP_WORDS)
    grams = queries.select("query_id", "text", F.explode(T.ngrams(words, most, least)).alias("keyword"))
    return grams.select("query_id", "keyword", embed(F.col("text")).alias("q"), embed(F.col("keyword")).alias("v"))


def expanded(query_terms: DataFrame, terms: DataFrame, weight: float = 1.0) -> DataFrame:
    """Query terms (query_id, token, qtf) with `weight` added for each term of (query_id, token)."""
    more = terms.select("query_id", "token", F.lit(weight).alias("qtf"))
    return query_terms.withColumn("qtf", F.col("qtf").cast("double")).unionByName(more).groupBy("query_id", "token").agg(F.sum("qtf").alias("qtf"))


def fuse_variants(ranked: DataFrame, k: int, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of any number of rankings (query_id, variant, doc_id, rank) of a query."""
    return S.ranked(ranked.groupBy("query_id", "doc_id").agg(F.sum(1 / (c + F.col("rank"))).alias("score")), k)
