"""Writers of the file formats."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import there


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def routed(df: DataFrame, path: str, bucket: str) -> None:
    """One folder for each value of a column."""
    df.write.mode("overwrite").partitionBy(bucket).json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def report(averages: DataFrame, path: str, key: str = "file") -> dict:
    """A small report as pretty JSON on the driver: {key: {metric: value}}."""
    rows = averages.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("values")).collect()
    out = {r[key]: dict(r["values"]) for r in rows}
    with open(path, "w", encoding="utf-8") as file:
        json.dump(out, file, ensure_ascii=False, indent=2, sort_keys=True)
    return out


def graph(entities: DataFrame, triples: DataFrame, path: str) -> None:
    entities.write.mode("overwrite").parquet(f"{path}/entities")
    triples.write.mode("overwrite").parquet(f"{path}/triples")


def vectors(df: DataFrame, path: str) -> None:
    """(policy, content_hash, embedding), by policy, so that another policy's vectors are never taken."""
    df.write.mode("overwrite").partitionBy("policy").parquet(path)


def words(df: DataFrame, path: str, column: str = "word") -> None:
    df.select(column).coalesce(1).write.mode("overwrite").text(path)


def append_missing(df: DataFrame, path: str, key: str) -> None:
    """Appends rows whose key is not in the table yet: a step can be run again after a failure."""
    spark = df.sparkSession
    done = spark.read.parquet(path).select(key).distinct() if there(spark, path) else None
    (df.join(done, key, "left_anti") if done is not None else df).write.mode("append").parquet(path)
