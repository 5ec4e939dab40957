"""Averages over evaluated items, derived scores and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed order of the metrics that come first in a comparison.
KEY_METRICS = ("Retrieval_Total_Score", "Generation_Total_Score", "Words_F1", "Sentences_F1", "ROUGELScore", "factual_score", "completeness", "hallucination")
DEAD_BAND = 1e-5


def macro_average(items: DataFrame, metrics: list[str], key: str = "file") -> DataFrame:
    """(key, metric, value, n): mean over the items that have the metric; metrics that none has are left out."""
    wide = items.groupBy(key).agg(*[F.avg(m).alias(m) for m in metrics], *[F.count(m).alias(f"{m}_n") for m in metrics])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.col(f"{m}_n").alias("n")) for m in metrics]))
    return wide.select(key, rows.alias("r")).select(key, "r.metric", "r.value", "r.n").where("n > 0")


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).when((p + r).isNotNull(), 0.0)


def derive(averages: DataFrame, key: str = "file") -> DataFrame:
    """One row a key: averages by metric and the scores derived from them, null where parts are missing."""
    names = ["ROUGELScore", "Words_Precision", "Words_Recall", "Sentences_Precision", "Sentences_Recall", "completeness", "hallucination", "irrelevance"]
    wide = averages.groupBy(key).pivot("metric", names).agg(F.first("value"))
    c = F.col
    wide = wide.withColumns({"Words_F1": f1(c("Words_Precision"), c("Words_Recall")), "Sentences_F1": f1(c("Sentences_Precision"), c("Sentences_Recall")), "factual_score": c("completeness") - c("hallucination")})
    parts = F.array_compact(F.array("Words_F1", "Sentences_F1"))
    mean = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts))
    return wide.withColumns({"Generation_Total_Score": 0.5 * c("factual_score") + 0.5 * c("ROUGELScore"), "Retrieval_Total_Score": mean})


def compare(before: DataFrame, after: DataFrame, key: str = "file") -> DataFrame:
    """Both values of each (key, metric), missing ones 0, their difference, direction and place in the report."""
    rows = before.select(key, "metric", F.col("value").alias("previous")).join(after.select(key, "metric", F.col("value").alias("current")), [key, "metric"], "full").na.fill(0.0, ["previous", "current"])
    change = F.col("current") - F.col("previous")
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(m) for m in KEY_METRICS]), F.col("metric")), F.lit(0)), F.lit(len(KEY_METRICS) + 1))
    return rows.withColumns({"change": change, "direction": F.when(change > DEAD_BAND, "up").when(change < -DEAD_BAND, "down").otherwise("same"), "place": place.cast("int")})
