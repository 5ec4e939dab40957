"""Chunking: fixed windows natively, recursive splitting by an Arrow UDF, once for each policy."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators, coarsest first; the last splits anywhere.
EN_SEPARATORS = (r"\n\n+", r"\n", r"(?<=[.!?])\s+(?=[A-Z])", r"\s+", "")
ZH_SEPARATORS = (r"\n{2,}", r"\n", "。", "！", "？", "；", "，", r"\.", "!", r"\?", "")


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of `size` code points, each starting size - overlap after the last; empty text: none."""
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))
    return F.when(F.length(text) > 0, F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def split_text(text: str, size: int, overlap: int, separators=EN_SEPARATORS, words: bool = True) -> list[str]:
    """Split at the coarsest separator there is, merge small pieces up to `size`, split large ones further.

    A separator stays at the start of the piece after it. Pieces that overlap are carried over up to
    `overlap`. Length is in words or characters; chunks are stripped, blank ones dropped.
    """
    measure = (lambda s: len(s.split())) if words else len
    out: list[str] = []

    def flush(parts: list[str]) -> None:
        chunk = "".join(parts).strip()
        if chunk:
            out.append(chunk)

    def merge(parts: list[str]) -> None:
        held: list[tuple[str, int]] = []
        total = 0
        for part in parts:
            n = measure(part)
            if held and total + n > size:
                flush([p for p, _ in held])
                while held and (total > overlap or total + n > size):
                    total -= held.pop(0)[1]
            held.append((part, n))
            total += n
        flush([p for p, _ in held])

    def cut(piece: str, at: int) -> None:
        while at < len(separators) - 1 and not re.search(separators[at], piece):
            at += 1
        sep = separators[at]
        if sep:
            spots = [0, *sorted({m.start() for m in re.finditer(sep, piece) if m.start()}), len(piece)]
            parts = [piece[a:b] for a, b in zip(spots[:-1], spots[1:], strict=True) if b > a]
        else:
            parts = list(piece)
        small: list[str] = []
        for part in parts:
            if measure(part) <= size or not sep:
                small.append(part)
            else:
                merge(small)
                small = []
                cut(part, at + 1)
        merge(small)

    if text:
        cut(text, 0)
    return out


def recursive_chunks(docs: DataFrame, size: Column | int, overlap: Column | int, text: str = "text", zh: bool = False) -> DataFrame:
    """A row for each chunk: all columns but the text, chunk_index and page_content."""

    @F.pandas_udf("array<string>")
    def run(t: pd.Series, s: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([split_text(x or "", int(a), int(b), ZH_SEPARATORS if zh else EN_SEPARATORS, not zh) for x, a, b in zip(t, s, o, strict=True)])

    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    chunks = run(F.col(text), lit(size), lit(overlap))
    return docs.select("*", F.posexplode(chunks).alias("chunk_index", "page_content")).drop(text)


def query_aware_chunks(docs: DataFrame, queries: DataFrame, text: str = "text") -> DataFrame:
    """Chunks of all documents for each distinct policy of the queries (chunk_size, chunk_overlap), once each.

    There are no more policies than query types, so they come to the driver and each document is
    exploded by a literal list of them."""
    policies = [F.struct(F.lit(r[0]).alias("chunk_size"), F.lit(r[1]).alias("chunk_overlap")) for r in sorted(queries.select("chunk_size", "chunk_overlap").distinct().collect())]
    if not policies:
        policies = [F.struct(F.lit(None).cast("int").alias("chunk_size"), F.lit(None).cast("int").alias("chunk_overlap"))]
    each = docs.withColumn("_p", F.explode(F.array(*policies))).select(*docs.columns, "_p.chunk_size", "_p.chunk_overlap").where("chunk_size is not null")
    return recursive_chunks(each, F.col("chunk_size"), F.col("chunk_overlap"), text)


def semantic_breaks(sentences: DataFrame, limit: float) -> DataFrame:
    """Chunk numbers of (doc_id, pos, vector): a new chunk where neighbours are less alike than `limit`."""
    from pyspark.sql import Window

    from .score import dot

    w = Window.partitionBy("doc_id").orderBy("pos")
    alike = dot(F.col("vector"), F.lag("vector").over(w))
    return sentences.withColumn("_new", F.when(alike < limit, 1).otherwise(0)).withColumn("chunk_index", F.sum("_new").over(w)).drop("_new")
