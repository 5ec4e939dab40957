"""Hybrid retrieval of all queries at once, and its keyword stage."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions import text as T

from . import scan
from . import score as S


@dataclass(frozen=True)
class RetrieveConfig:
    """Defaults of the live configuration: 6 results of a pool of max(base_k, base_k * multiplier)."""

    top_k: int = 6
    base_k: int = 50
    multiplier: float = 3.0
    dense_weight: float = 0.7
    keyword_weight: float = 0.15
    k1: float = S.K1
    b: float = S.B
    min_keyword: int = 3
    kind: str = "bm25"

    def __post_init__(self):
        if self.kind != "bm25":
            raise ValueError(f"unknown retriever {self.kind}")

    @staticmethod
    def for_language(language: str, **values) -> RetrieveConfig:
        """zh and en differ in the dense weight; other languages count as en."""
        return RetrieveConfig(**{"dense_weight": 0.25 if language.startswith("zh") else 0.7, **values})


def bm25_of(queries: DataFrame, docs: DataFrame, config: RetrieveConfig = RetrieveConfig(), stop: list[str] | None = None, zh: bool = False) -> DataFrame:
    """BM25 of queries (query_id, text) on docs (doc_id, text); for zh by Han characters and pairs."""
    tokens = T.han_grams(F.coalesce("text", F.lit(""))) if zh else T.tokens("text", stop)
    terms = S.query_terms(queries, tokens)
    idf = S.bm25_idf(S.document_counts(docs, tokens), S.corpus_stats(docs, tokens))
    return S.bm25(terms, S.postings(docs, tokens, vocabulary=terms), idf, config.k1, config.b)


class Corpus:
    """Documents (doc_id, text) as the scans of `scan` read them: whole, in pieces that are rows of their own (`cut` gives
    doc_id, chunk_index, page_content), or by windows of which the best counts for its document.

    Rows that share an id are one document by their sums, so these few are scored by pairs; all others by scans."""

    def __init__(self, docs: DataFrame, stop: list[str] | None = None, zh: bool = False, cut: Callable[[DataFrame], DataFrame] | None = None, windows: Callable[[Column], Column] | None = None):
        self.word = lambda c: T.han_grams(F.coalesce(c, F.lit(""))) if zh else T.tokens(c, stop)
        self.keys = ["doc_id", "chunk_index"] if cut else ["doc_id"]
        self.reader = scan.HanGrams() if zh else scan.Words() if stop else scan.LowerTexts()
        # what the reader makes tokens of
        self.given = (lambda c: F.coalesce(c, F.lit(""))) if zh else self.word if stop else (lambda c: F.lower(F.coalesce(c, F.lit(""))))
        twice = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("_id"))
        again, once = None, docs
        if twice.head(1):
            once = docs.join(twice, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
            again = docs.join(twice, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        text = F.col("page_content" if cut else "text")
        if windows:
            self.rows = once.select("doc_id", F.transform(windows(text), self.given).alias("_t"))
            again = again and again.select("doc_id", F.posexplode(windows(text)).alias("i", "text"))
            self.part = F.struct("doc_id", "i")
        else:
            self.rows = (cut(once) if cut else once).select(*self.keys, self.given(text).alias("_t"))
            again = again and (cut(again) if cut else again).select(*self.keys, text.alias("text"))
            self.part = F.struct(*self.keys)
        self.again = again and again.select(self.part.alias("_k"), "text")

    def _postings(self) -> DataFrame:
        return S.postings(self.again, self.word(F.col("text")), "_k")

    def statistics(self, vocabulary: list[str], mean: bool) -> tuple[int, int, np.ndarray, np.ndarray, float]:
        """Rows, tokens, df and cf of the vocabulary, and the mean of raw idf over all words if it is asked for."""
        got = scan.counts(self.rows, "_t", self.reader, None if mean else vocabulary)
        if self.again is not None:
            size = S.corpus_stats(self.again, self.word(F.col("text"))).select(F.lit(None).cast("string").alias("token"), F.col("n").alias("df"), F.coalesce("total", F.lit(0)).alias("cf"))
            got = got.unionByName(S.token_stats(self._postings())).unionByName(size)
        got = got.groupBy("token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        asked = self.rows.sparkSession.createDataFrame([(w, True) for w in vocabulary], "token string, asked boolean")
        got = got.join(F.broadcast(asked), "token", "left").withColumn("kind", F.when(F.col("token").isNull(), 0).when(F.col("asked"), 1).otherwise(2))
        # words that no query has are only counted by their df
        rows = got.groupBy("kind", F.when(F.col("asked"), F.col("token")).alias("token"), "df").agg(F.count("*").alias("words"), F.sum("cf").alias("cf")).collect()
        n, total = next(((r.df, r.cf) for r in rows if r.kind == 0), (0, 0))
        at = {w: i for i, w in enumerate(vocabulary)}
        df, cf = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for r in rows:
            if r.kind == 1:
                df[at[r.token]], cf[at[r.token]] = r.df, r.cf
        words = sum(r.words for r in rows if r.kind)
        raw = math.fsum(r.words * (math.log(n - r.df + 0.5) - math.log(r.df + 0.5)) for r in rows if r.kind) / words if words and mean else 0.0
        return n, total, df, cf, raw


def lexicon(rows: list, at: dict, corpus: Corpus, shares: dict[str, float], config: RetrieveConfig) -> tuple[scan.Terms, list[scan.Model]]:
    """The words of the queries (query_id, token, qtf) that the corpus has, and their weights for each score."""
    vocabulary = sorted({r.token for r in rows})
    place = {w: i for i, w in enumerate(vocabulary)}
    terms = scan.Terms(vocabulary, np.array([at[r.query_id] for r in rows], np.int64), np.array([place[r.token] for r in rows], np.int64), np.array([r.qtf for r in rows], float), len(at))
    n, total, df, cf, mean = corpus.statistics(vocabulary, "bm25" in shares)
    known = df > 0
    terms, df, cf = terms.kept(known), df[known], cf[known]
    raw = np.log(n - df + 0.5) - np.log(df + 0.5)
    factors = {"bm25": np.where(raw < 0, 0.25 * mean, raw), "tfidf": np.log(n / df), "jelinek_mercer": np.ones(len(df))}
    return terms, [scan.Model(kind, factors[kind], share, config.k1, config.b, total / max(n, 1), cf / max(total, 1)) for kind, share in shares.items()]


def scored(queries: DataFrame, corpus: Corpus, k: int | None, shares: dict[str, float] | None = None, config: RetrieveConfig = RetrieveConfig(), digits: int = 6) -> DataFrame:
    """query_id, the corpus's keys, score and rank: the k best documents of each query by a weighted sum of lexical
    scores (bm25, tfidf, jelinek_mercer); without k all pairs that share a word, unrounded and without rank.

    queries: (query_id, token, qtf)."""
    shares = shares or {"bm25": 1.0}
    spark, keys = queries.sparkSession, corpus.keys
    rows = queries.select("query_id", "token", "qtf").collect()
    named, at = scan.number([r.query_id for r in rows], queries.schema["query_id"].dataType)
    terms, models = lexicon(rows, at, corpus, shares, config)
    if not terms.vocabulary:
        types = [queries.schema["query_id"], *[corpus.rows.schema[x] for x in keys]]
        none = spark.createDataFrame([], StructType(types)).withColumn("score", F.lit(0.0))
        return none.withColumn("rank", F.lit(0)) if k else none
    found = scan.lexical(corpus.rows, "_t", keys, terms, models, corpus.reader, k, digits)
    if corpus.again is not None:
        found = found.unionByName(_pairs(corpus, terms, models))
    if not k:
        return named(found)
    best = S.ranked(found.withColumn("_k", F.struct(*keys)), k, "_q", "_k", digits=digits).drop("_k")
    return scan.local(named(best), k * terms.n)


def _pairs(corpus: Corpus, terms: scan.Terms, models: list[scan.Model]) -> DataFrame:
    """(_q, keys, score) of the rows that share an id, by pairs."""
    columns = [c for m in models for c in (m.factor, m.p)]
    words = [(int(q), terms.vocabulary[w], float(c), *[float(x[w]) for x in columns]) for q, w, c in zip(terms.query, terms.word, terms.qtf, strict=True)]
    asked = corpus.rows.sparkSession.createDataFrame(words, "_q int, token string, qtf double, " + ", ".join(f"f{i} double, p{i} double" for i in range(len(models))))
    tf, dl, part = F.col("tf"), F.col("dl"), F.lit(0.0)
    for i, m in enumerate(models):
        weight = {
            "bm25": tf * (m.k1 + 1) / (tf + m.k1 * (1 - m.b + m.b * dl / m.avgdl)),
            "tfidf": tf / dl,
            "jelinek_mercer": F.log(1 + (1 - m.smoothing) * tf / dl / (m.smoothing * F.col(f"p{i}"))),
        }[m.kind]
        part = part + m.share * F.col("qtf") * F.col(f"f{i}") * weight
    pairs = corpus._postings().join(F.broadcast(asked), "token").groupBy("_q", "_k").agg(F.sum(part).alias("score"))
    rows = pairs.select("_q", *[F.col(f"_k.{x}").alias(x) for x in corpus.keys], "score")
    return rows.groupBy("_q", "doc_id").agg(F.max("score").alias("score")) if corpus.keys == ["doc_id"] else rows


def bm25_topk(queries: DataFrame, docs: DataFrame | Corpus, k: int, config: RetrieveConfig = RetrieveConfig(), stop: list[str] | None = None, zh: bool = False) -> DataFrame:
    """query_id, doc_id, score, rank: the first k of S.ranked(bm25_of(...)), by scans."""
    corpus = docs if isinstance(docs, Corpus) else Corpus(docs, stop, zh)
    return scored(S.query_terms(queries, corpus.word(F.col("text"))), corpus, k, config=config)


def feedback_terms(ranked_docs: DataFrame, corpus: Corpus, docs: DataFrame, terms: int = 10) -> DataFrame:
    """query_id, doc_id (the term), score, rank: S.feedback_terms() of ranked documents, from postings of these alone."""
    few = docs.join(F.broadcast(ranked_docs.select("doc_id").distinct()), "doc_id", "left_semi")
    tf = S.postings(few, corpus.word(F.col("text")))
    words = [r.token for r in tf.select("token").distinct().collect()]
    n, _, df, _, _ = corpus.statistics(words, False)
    stats = docs.sparkSession.createDataFrame([(w, int(d)) for w, d in zip(words, df, strict=True)], "token string, df long")
    return S.feedback_terms(ranked_docs, tf, F.broadcast(stats), docs.sparkSession.createDataFrame([(n,)], "n long"), terms)


def containing(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id of the documents that contain a passage (query_id, text). Documents are looked through once by a few
    neighbouring words of each passage; passages of fewer words are compared with each text."""
    inner = F.slice("_t", 2, F.greatest(F.size("_t") - 2, F.lit(0)))
    asked = passages.where("text is not null").withColumn("_t", T.tokens("text")).select("query_id", "text", inner.alias("_t"))
    long = F.size("_t") >= scan.SHINGLE
    short = docs.join(asked.where(~long).select("query_id", F.col("text").alias("_p")), F.contains("text", F.col("_p"))).select("query_id", "doc_id")
    rows = asked.where(long).collect()
    if not rows:
        return short
    named, at = scan.number([r.query_id for r in rows], passages.schema["query_id"].dataType)
    found = named(scan.containing(docs.select("doc_id", "text", F.lower("text").alias("_t")), [(at[r.query_id], r.text, list(r._t)) for r in rows]))
    return found.select("query_id", "doc_id").unionByName(short) if asked.where(~long).head(1) else found.select("query_id", "doc_id")


def dense_topk(queries: DataFrame, docs: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """query_id, doc_id, score, rank: the first k of S.ranked(S.dense_scores(...)) of queries (query_id, q) and docs (doc_id, v),
    by scans. Vectors with nulls, without a finite length or of another length are compared pair by pair."""
    near = metric == "l2"
    size = queries.where(scan.regular(F.col("q"), F.size("q"))).groupBy(F.size("q").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = size.n if size else 0
    fits = scan.regular(F.col("v"), dim)
    asked, odd = queries.where(scan.regular(F.col("q"), dim)), queries.where(~scan.regular(F.col("q"), dim))
    pairs = [p for p in (docs.where(~fits), docs) if p is docs or p.head(1)]
    found = S.ranked(S.dense_scores(odd if dim else queries, docs, metric), k, ascending=near) if not dim or odd.head(1) else None
    if not dim:
        return found
    rows = asked.select("query_id", "q").toArrow()
    keys = rows.column("query_id").to_pylist()
    named, at = scan.number(keys, queries.schema["query_id"].dataType)
    if len(at) < len(keys):  # queries of one id are one ranking
        return S.ranked(S.dense_scores(queries, docs, metric), k, ascending=near)
    best = named(scan.dense(docs.where(fits), "v", ["doc_id"], scan._matrix(rows.column("q"), dim), k, metric))
    if len(pairs) > 1:
        best = best.unionByName(S.dense_scores(asked, pairs[0], metric))
    best = S.ranked(best.select("query_id", "doc_id", "score"), k, ascending=near)
    return best if found is None else best.unionByName(found)


def hybrid_topk(queries: DataFrame, docs: DataFrame, vectors: tuple[DataFrame, DataFrame], k: int, config: RetrieveConfig = RetrieveConfig()) -> DataFrame:
    """query_id, doc_id, score, rank: the first k of S.hybrid() by two scans, of ranges and of scores.

    vectors: (query_id, q) and (doc_id, text, v), the documents that take part."""
    asked, held = vectors
    corpus = Corpus(docs)
    rows = asked.collect()
    sizes = {len(r.q) if r.q is not None and all(x is not None and math.isfinite(x) for x in r.q) else -1 for r in rows}
    named, at = scan.number([r.query_id for r in rows], asked.schema["query_id"].dataType)
    if corpus.again is None and len(sizes) == 1 and -1 not in sizes and len(at) == len(rows):
        q = np.array([r.q for r in rows], float)
        words = [r for r in S.query_terms(queries, corpus.word(F.col("text"))).collect() if r.query_id in at]
        terms, models = lexicon(words, at, corpus, {"bm25": 1.0}, config)
        part = held.select("doc_id", corpus.given(F.col("text")).alias("_t"), "v")
        ends = scan.hybrid(part, terms, models, corpus.reader, q, config.dense_weight, k).groupBy("_q").agg(F.min("s_low"), F.max("s_high"), F.min("d_low"), F.max("d_high")).collect()
        if all(r[0] >= 0 for r in ends):
            ranges = np.zeros((4, len(at)))
            for r in ends:
                ranges[:, r[0]] = r[1:]
            best = scan.hybrid(part, terms, models, corpus.reader, q, config.dense_weight, k, ranges)
            return scan.local(named(S.ranked(best, k, "_q")), k * len(at))
    return S.ranked(S.hybrid(bm25_of(queries, docs, config), S.dense_scores(asked, held.select("doc_id", "v")), config.dense_weight), k)


def policy_retrieve(queries: DataFrame, docs: DataFrame, config: RetrieveConfig = RetrieveConfig()) -> DataFrame:
    """query_id, doc_id, chunk_index, page_content, score, rank: each query's best chunks among those
    of its own policy. queries: query_id, text, chunk_size, chunk_overlap; docs: doc_id, text.

    Statistics are those of a policy's chunks. There are no more policies than query types; each is a
    corpus of its own, and only the documents that are found are cut once more for their chunks."""
    from .chunk import recursive_chunks

    out = None
    for size, overlap in sorted(r[:] for r in queries.select("chunk_size", "chunk_overlap").distinct().dropna().collect()):
        cut = lambda d, s=size, o=overlap: recursive_chunks(d.select("doc_id", "text"), s, o)
        best = bm25_topk(queries.where((F.col("chunk_size") == size) & (F.col("chunk_overlap") == overlap)), Corpus(docs, cut=cut), config.top_k, config)
        found = cut(docs.join(F.broadcast(best.select("doc_id").distinct()), "doc_id", "left_semi")).withColumns({"chunk_size": F.lit(size), "chunk_overlap": F.lit(overlap)})
        rows = found.join(F.broadcast(best), ["doc_id", "chunk_index"])
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        none = docs.select("doc_id", F.lit(0).alias("chunk_index"), F.lit("").alias("page_content"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        out = queries.select("query_id", "chunk_size", "chunk_overlap").join(none, F.lit(False))
    return out


def query_keywords(queries: DataFrame, known: DataFrame | None = None, least: int = 3) -> DataFrame:
    """(query_id, keywords, source): those of the keyword table, by id first, then by trimmed text, else extracted.

    known: (key, keywords) with key the id as text or the trimmed text.
    """
    own = queries.withColumn("_own", T.keywords("text", least=least))
    if known is None:
        return own.select("query_id", F.col("_own").alias("keywords"), F.lit("extracted").alias("source"))
    by_id = known.select(F.col("key").alias("_k1"), F.col("keywords").alias("_by_id"))
    by_text = known.select(F.col("key").alias("_k2"), F.col("keywords").alias("_by_text"))
    rows = own.join(by_id, F.col("query_id").cast("string") == F.col("_k1"), "left").join(by_text, F.trim("text") == F.col("_k2"), "left")
    source = F.when(F.col("_by_id").isNotNull(), "id").when(F.col("_by_text").isNotNull(), "text").otherwise("extracted")
    return rows.select("query_id", F.coalesce("_by_id", "_by_text", "_own").alias("keywords"), source.alias("source"))


def keyword_table(rows: DataFrame) -> DataFrame:
    """(key, keywords, unsolvable) of a keyword file: a row under its id and one under its trimmed text."""
    keys = F.explode(F.array_distinct(F.array_compact(F.array(F.col("query_id").cast("string"), F.trim("content")))))
    return rows.select(keys.alias("key"), F.array_distinct("keywords").alias("keywords"), (F.coalesce("unsolve", F.lit(0)) == 1).alias("unsolvable"))


def hybrid_retrieve(queries: DataFrame, docs: DataFrame, dense: DataFrame | tuple[DataFrame, DataFrame], config: RetrieveConfig = RetrieveConfig(), known: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, rank, score, hybrid: hybrid pool, keyword boost, final cut.

    dense: (query_id, doc_id, score) of every pair that takes part, or the vectors of hybrid_topk().
    """
    pool = int(max(config.base_k, round(config.base_k * config.multiplier)))
    if isinstance(dense, tuple):
        first = hybrid_topk(queries, docs, dense, pool, config)
    else:
        first = S.ranked(S.hybrid(bm25_of(queries, docs, config), dense, config.dense_weight), pool)
    candidates = first.withColumnRenamed("rank", "pool_rank").withColumnRenamed("score", "hybrid")
    words = query_keywords(queries, known, config.min_keyword).select("query_id", "keywords")
    rows = candidates.join(words, "query_id")
    # few rows of many documents: these are read past them, not shuffled
    rows = docs.select("doc_id", "text").join(F.broadcast(rows) if isinstance(dense, tuple) else rows, "doc_id")
    boosted = rows.withColumn("score", S.keyword_boost(F.col("hybrid"), T.keyword_overlap("text", "keywords"), config.keyword_weight))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "pool_rank")
    out = boosted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.top_k)
    return out.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"), "hybrid")


def by_documents(ranked_docs: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """First k chunks of each query by document rank and chunk_index; equal contents count once."""
    rows = ranked_docs.select("query_id", "doc_id", "rank").join(chunks, "doc_id")
    first = Window.partitionBy("query_id", "page_content").orderBy("rank", "chunk_index")
    order = Window.partitionBy("query_id").orderBy("rank", "chunk_index")
    once = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return once.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def with_hints(hints: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """Hints first, then the first k real chunks; hints take no real chunk's place."""
    real = chunks.where(~F.coalesce(F.col("is_pseudo"), F.lit(False))).where(F.col("rank") <= k)
    return hints.withColumn("priority", F.lit(0)).unionByName(real.withColumn("priority", F.lit(1)))


def sufficiency(chunks: DataFrame, least_chunks: int = 2, least_chars: int = 100) -> DataFrame:
    """Per query: chunks, characters, and the route ("chunks" or "graph") by the plain rule."""
    got = chunks.groupBy("query_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"))
    return got.withColumn("route", F.when((F.col("n_chunks") < least_chunks) | (F.col("n_chars") < least_chars), "graph").otherwise("chunks"))


def keep_relevant(chunks: DataFrame, keep: Column) -> DataFrame:
    """Chunks to keep; a query that would lose all keeps all. Errors (null) keep."""
    kept = F.coalesce(keep, F.lit(True))
    rows = chunks.withColumn("_keep", kept).withColumn("_any", F.max(F.col("_keep").cast("int")).over(Window.partitionBy("query_id")))
    return rows.where(F.col("_keep") | (F.col("_any") == 0)).drop("_keep", "_any")


def recall_at_k(ranked_docs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per query with a truth: whether one of its documents is among the first k."""
    hits = ranked_docs.where(F.col("rank") <= k).join(truth, ["query_id", "doc_id"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1))
    return truth.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", F.coalesce("hit", F.lit(0)).alias("hit"))
