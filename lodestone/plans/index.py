"""Building and reading an index of chunk vectors, and embedding documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import prompts as P
from lodestone.operators import chunk
from lodestone.sources import readers, writers


@dataclass(frozen=True)
class Encoder:
    """An embedder with what is known of it: vector length, whether of unit length, tokens that it reads."""

    embed: Callable[[Column], Column]
    dim: int = 384
    normalized: bool = True
    max_tokens: int = 256


def policy_chunks(docs: DataFrame, queries: DataFrame | None = None, size: int = 128, overlap: int = 64) -> DataFrame:
    """Chunks of docs (doc_id, text): those of each query's policy if there are queries, else of one size.
    One shape either way: doc_id, chunk_index, page_content, chunk_size, chunk_overlap, policy, content_hash."""
    if queries is not None:
        rows = chunk.query_aware_chunks(docs, queries)
    else:
        rows = chunk.recursive_chunks(docs.withColumns({"chunk_size": F.lit(size), "chunk_overlap": F.lit(overlap)}), size, overlap)
    return rows.select("doc_id", "chunk_index", "page_content", "chunk_size", "chunk_overlap", F.concat_ws("-", "chunk_size", "chunk_overlap").alias("policy"), F.sha2("page_content", 256).alias("content_hash"))


def cached_chunks(docs: DataFrame, path: str, queries: DataFrame | None = None, size: int = 128, overlap: int = 64) -> DataFrame:
    """policy_chunks() read from a table by policy, which is written where it is not there. The table
    belongs to these documents and queries; another corpus needs another path."""
    spark = docs.sparkSession
    if not readers.there(spark, path):
        policy_chunks(docs, queries, size, overlap).write.partitionBy("policy").parquet(path)
    return spark.read.parquet(path)


def build_index(chunks: DataFrame, encoder: Encoder, path: str) -> DataFrame:
    """Vectors of the distinct (policy, content_hash) of chunks, prefixed as passages; written and read."""
    once = chunks.groupBy("policy", "content_hash").agg(F.first("page_content").alias("page_content"))
    writers.vectors(once.select("policy", "content_hash", encoder.embed(P.passage_input(F.col("page_content"))).alias("embedding")), path)
    return chunks.sparkSession.read.parquet(path)


def load_or_build(chunks: DataFrame, encoder: Encoder, path: str) -> DataFrame:
    """The stored vectors where they fit the chunks and the encoder, else new ones."""
    stored = readers.vectors(chunks.sparkSession, path, chunks.select("policy", "content_hash").distinct(), encoder.dim)
    return stored if stored is not None else build_index(chunks, encoder, path)


def search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, encoder: Encoder, k: int, least: float | None = None) -> DataFrame:
    """query_id, chunk (doc_id, chunk_index), rank, score by cosine; with `least` no score below it."""
    from lodestone.operators import score as S

    v = chunks.join(vectors, ["policy", "content_hash"]).select(F.struct("doc_id", "chunk_index").alias("doc_id"), F.col("embedding").alias("v"))
    found = S.dense_scores(queries.select("query_id", encoder.embed(F.col("text")).alias("q")), v)
    return S.ranked(found if least is None else found.where(F.col("score") >= least), k).withColumnRenamed("doc_id", "chunk")


def embedded(docs: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    """Documents with their vector, for writers.jsonl()."""
    return docs.withColumn("embedding", encoder.embed(F.col(text)))
