"""Term statistics, BM25, TF-IDF and Jelinek-Mercer scores, vectors, fusion and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.5, 0.7


def postings(docs: DataFrame, tokens: Column, key: str = "doc_id", vocabulary: DataFrame | None = None) -> DataFrame:
    """(key, token, tf, dl): a document's tokens and their counts; dl counts all its tokens. With a
    vocabulary (token) the others are left out before anything is shuffled."""
    rows = docs.select(key, tokens.alias("_t")).select(key, F.size("_t").alias("dl"), F.explode("_t").alias("token"))
    if vocabulary is not None:
        rows = rows.join(vocabulary.select("token").distinct(), "token", "left_semi")
    return rows.groupBy(key, "token", "dl").agg(F.count("*").alias("tf"))


def document_counts(docs: DataFrame, tokens: Column) -> DataFrame:
    """(token, df) without postings: tokens are counted before the shuffle, so the vocabulary moves, not the text."""
    # the filter changes nothing, but joins add it to their side, and equal plans are run once
    return docs.select(F.explode(F.array_distinct(tokens)).alias("token")).where("token is not null").groupBy("token").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row: n documents and their mean length, those without tokens included."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens)).alias("avgdl"), F.sum(F.size(tokens)).alias("total"))


def token_stats(tf: DataFrame) -> DataFrame:
    return tf.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def query_terms(queries: DataFrame, tokens: Column, key: str = "query_id") -> DataFrame:
    """(key, token, qtf); repeats count."""
    return queries.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("qtf"))


def bm25_idf(stats: DataFrame, corpus: DataFrame) -> DataFrame:
    """(token, df, cf, idf): negative values become a quarter of the mean over the vocabulary."""
    raw = stats.join(corpus, how="cross").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(mean, how="cross").withColumn("idf", F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")))


def _matches(queries: DataFrame, tf: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows of query terms with the documents that hold them. The vocabulary is cut to the queries'
    first, so the large side is filtered before anything is shuffled by document."""
    terms = queries.join(weights, "token")
    return tf.join(terms, "token")


def bm25(queries: DataFrame, tf: DataFrame, idf: DataFrame, k1: float = K1, b: float = B, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(query, doc, score) of pairs that share a token; others score 0."""
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return _matches(queries, tf, idf.select("token", "idf", "avgdl")).groupBy(query, doc).agg(F.sum(part).alias("score"))


def tfidf(queries: DataFrame, tf: DataFrame, stats: DataFrame, corpus: DataFrame, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    weights = stats.join(corpus, how="cross").select("token", F.log(F.col("n") / F.col("df")).alias("idf"))
    return _matches(queries, tf, weights).groupBy(query, doc).agg(F.sum(F.col("qtf") * F.col("tf") / F.col("dl") * F.col("idf")).alias("score"))


def jelinek_mercer(queries: DataFrame, tf: DataFrame, stats: DataFrame, corpus: DataFrame, smoothing: float = 0.5, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Gain of the document's model over the corpus's: sum of log(1 + (1-l) tf/dl / (l cf/total))."""
    weights = stats.join(corpus, how="cross").select("token", (F.col("cf") / F.col("total")).alias("p"))
    gain = F.log(1 + (1 - smoothing) * F.col("tf") / F.col("dl") / (smoothing * F.col("p")))
    return _matches(queries, tf, weights).groupBy(query, doc).agg(F.sum(F.col("qtf") * gain).alias("score"))


# vectors


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """A vector of length one; one of length zero (or null) stays."""
    once = F.transform(F.array(v), lambda a: F.struct(a.alias("v"), norm(a).alias("n")))  # v and its norm are computed once
    return F.transform(once, lambda s: F.when(s["n"] > 1e-9, F.transform(s["v"], lambda x: x.cast("double") / s["n"])).otherwise(as_double(s["v"])))[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector has no length or the result is no number."""
    n = norm(a) * norm(b)
    return F.coalesce(F.nanvl(F.when(n > 1e-9, dot(a, b) / n), F.lit(0.0)), F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return norm(d)


def dense_scores(queries: DataFrame, docs: DataFrame, metric: str = "cosine", query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(query, doc, score) of every query vector q with every document vector v: an exact flat scan."""
    pairs = docs.join(queries, how="cross")
    score = {"cosine": cosine, "ip": dot, "l2": distance}[metric](F.col("q"), F.col("v"))
    return pairs.select(query, doc, score.alias("score"))


# fusion and ranking


def min_max(score: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, score).otherwise((score - low) / (high - low))


def ranked(scores: DataFrame, k: int | None = None, query: str = "query_id", doc: str = "doc_id", score: str = "score", ascending: bool = False, digits: int | None = 6) -> DataFrame:
    """Adds rank by score, ties to the smaller doc; with k only the first k of each query."""
    value = F.round(score, digits) if digits is not None else F.col(score)
    order = Window.partitionBy(query).orderBy(value.asc() if ascending else value.desc(), F.col(doc).asc())
    out = scores.withColumn(score, value).withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k) if k else out


def hybrid(sparse: DataFrame, dense: DataFrame, weight: float = 0.7, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Min-max of both score lists by query, then (1 - weight) sparse + weight dense.

    dense has every pair; a pair that sparse lacks scores 0 there, and counts in its range.
    """
    both = dense.select(query, doc, F.col("score").alias("d")).join(sparse.select(query, doc, F.col("score").alias("s")), [query, doc], "left").na.fill(0.0, ["s"])
    # ranges by partial aggregates: no task holds all pairs of a query
    ranges = both.groupBy(query).agg(*[f(c).alias(f"{c}_{n}") for c in "sd" for n, f in (("low", F.min), ("high", F.max))])
    score = (1 - weight) * min_max(F.col("s"), F.col("s_low"), F.col("s_high")) + weight * min_max(F.col("d"), F.col("d_low"), F.col("d_high"))
    return both.join(ranges, query).select(query, doc, score.alias("score"))


def candidate_count(n: Column, k: int, multiplier: float) -> Column:
    """min(n, max(k, k * multiplier)), halves rounded to even."""
    return F.least(n, F.greatest(F.lit(k), F.bround(F.lit(k * multiplier)).cast("long")))


def keyword_boost(score: Column, overlap: Column, weight: float = 0.15) -> Column:
    return score + weight * overlap


def rrf(first: DataFrame, second: DataFrame, weights=(0.5, 0.5), c: int = 60, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked lists."""
    a, b = first.select(query, doc, F.col("rank").alias("a")), second.select(query, doc, F.col("rank").alias("b"))
    part = lambda w, r: F.coalesce(w / (c + F.col(r)), F.lit(0.0))
    return a.join(b, [query, doc], "full").select(query, doc, (part(weights[0], "a") + part(weights[1], "b")).alias("score"))


def graph_boost(score: Column, strength: float) -> Column:
    """Additive boost between 0.02 and min(0.25, 0.15 + 0.07 strength) for a graph score in [0, 1]."""
    top = min(0.25, 0.15 + 0.07 * strength)
    return 0.02 + F.pow(score, 1.8) * (top - 0.02)


def rerank(candidates: DataFrame, boosts: DataFrame, k: int, factor: float = 2.0, query: str = "query_id", doc: str = "doc_id", text: str | None = None) -> DataFrame:
    """base score + factor * boost, best k; with text, candidates without content go unless all lack it."""
    rows = candidates.join(boosts.select(query, doc, "boost"), [query, doc], "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)) * factor)
    if text:
        usable = F.trim(F.coalesce(F.col(text), F.lit(""))) != ""
        rows = rows.withColumn("_any", F.max(usable.cast("int")).over(Window.partitionBy(query))).where(usable | (F.col("_any") == 0)).drop("_any")
    return ranked(rows.withColumn("final_score", F.col("score") + F.col("boost")), k, query, doc, "final_score")


def parents(scores: DataFrame, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Best chunk score of each document."""
    return scores.groupBy(query, doc).agg(F.max("score").alias("score"))


def feedback_terms(ranked_docs: DataFrame, tf: DataFrame, stats: DataFrame, corpus: DataFrame, terms: int = 10, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Pseudo-relevance feedback: the best tf * idf terms of each query's top documents."""
    weights = stats.join(corpus, how="cross").select("token", F.log(F.col("n") / F.col("df")).alias("idf"))
    found = ranked_docs.select(query, doc).join(tf, doc).join(weights, "token").groupBy(query, "token").agg(F.sum(F.col("tf") * F.col("idf")).alias("score"))
    return ranked(found, terms, query, "token")
