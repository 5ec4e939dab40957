"""Stop-word learning, merges by anti-join, last-wins, validation, language routing, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_frequency(docs: DataFrame, tokens: Column) -> DataFrame:
    return docs.select(F.explode(F.array_distinct(tokens)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def learn_stop_words(docs: DataFrame, tokens: Column, most: int = 200) -> DataFrame:
    """The words in most documents, ties by word."""
    return document_frequency(docs, tokens).orderBy(F.desc("df"), "word").limit(most)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_truth(predictions: DataFrame, truth: DataFrame, key: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """Predictions with their truth, and those without one."""
    return predictions.join(truth, key), predictions.join(truth, key, "left_anti")


def remaining(rows: DataFrame, done: DataFrame, id_: str, text: str) -> DataFrame:
    """Rows whose id and text are both not done yet: two anti-joins on equality."""
    return rows.join(done.select(id_).where(F.col(id_).isNotNull()).distinct(), id_, "left_anti").join(done.select(text).where(F.col(text).isNotNull()).distinct(), text, "left_anti")


def missing_ids(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def first_of_content(rows: DataFrame, content: str, order: str) -> DataFrame:
    """First row of each content by order: an aggregate, so hot contents are combined before the shuffle."""
    every = F.struct(order, *[c for c in rows.columns if c not in (order, content)])
    return rows.groupBy(content).agg(F.min_by(every, order).alias("_r")).select(*[F.col(c) if c == content else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def split_languages(rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows with Han characters, and the others; rows without text go to neither."""
    from lodestone.functions.text import has_han

    there = rows.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    return there.where(has_han(text, True)), there.where(~has_han(text, True))


def eligible(docs: DataFrame, language: str) -> DataFrame:
    return docs.where(F.col("content").isNotNull() & (F.col("language") == language))


def validate(raw: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of JSON text with whether each parses to the schema and has a query id."""
    parsed = F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return raw.withColumn("parsed", parsed).withColumn("ok", F.col("parsed").isNotNull() & F.col("parsed._corrupt").isNull() & F.col("parsed.query.query_id").isNotNull())


PREDICTION = "query struct<query_id:bigint,content:string>, prediction struct<content:string,references:array<string>>, _corrupt string"


def check_output(inputs: DataFrame, outputs: DataFrame) -> dict[str, int]:
    """Counts of non-blank lines of both, rows that do not parse, and ids without an output."""
    there = lambda df: df.where(F.trim("value") != "")
    want, got = validate(there(inputs), PREDICTION), validate(there(outputs), PREDICTION)
    ids = lambda df: df.select(F.col("parsed.query.query_id").alias("id"))
    return {"inputs": want.count(), "outputs": got.count(), "invalid": got.where("not ok").count(), "missing": missing_ids(ids(want), ids(got), "id").count()}


def sweep(docs: DataFrame, sizes: list[int], overlap_share: float = 0.15) -> DataFrame:
    """Fixed-window chunks of every size in one job, with chunk_size."""
    from .chunk import fixed_windows

    parts = [docs.select("doc_id", F.lit(s).alias("chunk_size"), F.posexplode(fixed_windows(F.col("text"), s, int(overlap_share * s))).alias("chunk_index", "page_content")) for s in sizes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def best_size(trials: DataFrame, size: str = "size", value: str = "recall") -> DataFrame:
    """(size, value, best): the mean of each size; the highest is best, the smaller size of equals."""
    means = trials.groupBy(size).agg(F.avg(value).alias(value))
    top = means.agg(F.max(F.struct(F.col(value), (-F.col(size)).alias("n"))).alias("_top"))
    return means.join(F.broadcast(top), how="cross").withColumn("best", -F.col("_top.n") == F.col(size)).drop("_top")  # one row


def by_document(chunks: DataFrame, doc: str = "doc_id", order: str = "chunk_index", text: str = "text") -> DataFrame:
    """(doc_id, chunks): the chunks of each document in order."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return chunks.groupBy(doc).agg(F.transform(rows, lambda x: x["t"]).alias("chunks"))


def first_rows(rows: DataFrame, order: str, n: int | None = None) -> DataFrame:
    """The first n rows by position; all without n."""
    return rows if n is None else rows.orderBy(order).limit(n)


def in_language(rows: DataFrame, language: str, column: str = "lang", default: str = "en") -> DataFrame:
    """Rows with `language`: the one asked for, or with "auto" each row's own, `default` where it has none."""
    own = F.coalesce(F.when(F.trim(column) != "", F.col(column)), F.lit(default))
    return rows.withColumn("language", own if language == "auto" else F.lit(language))
