"""Models behind plain interfaces, with defaults that need no network and always give the same result.

A provider is a function of column values; network providers are passed in by the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T


def hashing_embedder(dim: int = 64) -> Callable[[Column], Column]:
    """Feature-hashed bag of tokens as a unit vector; native. Texts without tokens give zeros."""
    from .score import unit

    def embed(text: Column) -> Column:
        slots = F.transform(T.tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
        counts = F.transform(F.array(slots), lambda a: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.size(a) - F.size(F.array_remove(a, i))).cast("double")))[0]
        return unit(counts)

    return embed


def batched(model: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 32) -> Callable[[Column], Column]:
    """An embedder from a function of a list of texts. A batch that fails is taken text by text, and a
    text that fails gives zeros, which are like nothing; without_vector() tells those rows."""

    def alone(text: str) -> list[float]:
        try:
            return model([text])[0]
        except Exception:
            return [0.0] * dim

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list[list[float]] = []
            for i in range(0, len(texts), batch):
                part = [t or "" for t in texts.iloc[i : i + batch]]
                try:
                    out += model(part)
                except Exception:
                    out += [alone(t) for t in part]
            yield pd.Series(out)

    return run


def without_vector(vector: Column) -> Column:
    """Whether an embedder failed on a row: its vector is missing or all zeros."""
    return F.coalesce(~F.exists(vector, lambda x: x != 0), F.lit(True))


def overlap_scorer(query: Column, text: Column) -> Column:
    """In place of a cross-encoder: share of the query's distinct tokens that the text has."""
    q = F.array_distinct(T.tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.tokens(text))) / F.size(q)).otherwise(0.0)


def relevance_judge(query: Column, text: Column, yes: float = 0.5, partly: float = 0.2) -> Column:
    s = overlap_scorer(query, text)
    return F.when(s >= yes, "A").when(s >= partly, "B").otherwise("C")


def sufficiency_judge(query: Column, context: Column, least: float = 0.5) -> Column:
    return F.when(overlap_scorer(query, context) >= least, "SUFFICIENT").otherwise("INSUFFICIENT")


def is_sufficient(label: Column) -> Column:
    """The whole label must match: INSUFFICIENT is not sufficient."""
    return F.upper(F.trim(label)) == "SUFFICIENT"


def key_point_judge(answer: Column, points: Column, least: float = 0.6) -> Column:
    """A label for each key point, by the share of its tokens that the answer has."""
    return F.transform(points, lambda k: F.when(overlap_scorer(k, answer) >= least, "Relevant").otherwise("Irrelevant"))


def extractive_answer(query: Column, context: Column) -> Column:
    """The sentence of the context that has most of the query's tokens; the first of equals, empty
    where none has any. Headings of sources are no sentences."""
    q = F.array_distinct(T.tokens(query))
    body = F.regexp_replace(context, r"(?m)^### Source .*$", "")
    rated = F.transform(T.sentences(body), lambda s, i: F.struct(F.size(F.array_intersect(q, T.tokens(s))).alias("n"), (-i).alias("i"), s.alias("s")))
    best = F.array_max(rated)
    return F.coalesce(F.when(best["n"] > 0, best["s"]), F.lit(""))


def call(rows: DataFrame, prompt: str, model: Callable[[str], str], out: str = "answer", retries: int = 3) -> DataFrame:
    """Calls a text model row by row with bounded retries; errors go to a column of their own."""
    names = rows.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers, errors = [], []
            for text in part[prompt]:
                answer, error = None, None
                for _ in range(retries):
                    try:
                        answer, error = model(text), None
                        break
                    except Exception as e:
                        error = str(e)
                answers.append(answer)
                errors.append(error)
            yield part.assign(**{out: answers, "error": errors})[[*names, out, "error"]]

    from pyspark.sql.types import StringType, StructField, StructType

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(out, StringType()), StructField("error", StringType())]))


def extract_triples(docs: DataFrame) -> DataFrame:
    """Rule-based extraction: "X is the R of Y" and "X R-ed Y" for a few relations, as (doc_id, pos, head, ...)."""
    pattern = r"([A-Z][A-Za-z0-9]*(?: [A-Z][A-Za-z0-9]*)*) (founded|acquired|invested in|is located in|is a subsidiary of) ([A-Z][A-Za-z0-9]*(?: [A-Z][A-Za-z0-9]*)*)"
    found = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "head"), (2, "relation"), (3, "tail"))])
    rows = docs.select("doc_id", F.posexplode(found).alias("pos", "t"))
    return rows.select("doc_id", "pos", F.col("t.head").alias("head"), F.lit("Organization").alias("head_type"), F.regexp_replace("t.relation", " ", "_").alias("relation"), F.col("t.tail").alias("tail"), F.lit("Organization").alias("tail_type"))
