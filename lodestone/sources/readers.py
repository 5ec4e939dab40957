"""Readers of the file formats, with explicit schemas."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES = """domain string, language string, query struct<query_id:bigint,query_type:string,content:string>,
 ground_truth struct<doc_ids:array<bigint>,content:string,references:array<string>,keypoints:array<string>>,
 prediction struct<content:string,references:array<string>,reference_doc_ids:array<bigint>,query_type_pred:string,query_type_canonical:string>"""
DOCUMENTS = "doc_id bigint, content string, language string, domain string, company_name string, court_name string, hospital_patient_name string"
KEYWORDS = "query_id bigint, content string, keywords array<string>, unsolve int, embedding array<float>"
TRIPLE = "struct<head:string,head_type:string,relation:string,tail:string,tail_type:string,doc_id:bigint,properties:map<string,string>>"
GRAPH = f"entities array<struct<id:string,name:string,type:string,properties:map<string,string>>>, triples array<{TRIPLE}>"


def jsonl(spark: SparkSession, path: str, schema: str | None = None, bad: str = "fail") -> DataFrame:
    """JSON lines; blank lines are skipped. Bad lines: fail, drop, or keep in _corrupt_record."""
    mode = {"fail": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}[bad]
    reader = spark.read.option("mode", mode)
    if schema:
        reader = reader.schema(schema + (", _corrupt_record string" if bad == "keep" else ""))
    return reader.json(path)


def folder(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All *.jsonl files of a folder, with the file's name."""
    reader = spark.read.option("pathGlobFilter", "*.jsonl")
    return (reader.schema(schema) if schema else reader).json(path).select("*", F.col("_metadata.file_name").alias("file"))


def whole_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def there(spark: SparkSession, path: str) -> bool:
    """Whether a path exists; storage faults are raised."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def whole_json_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same, without rows if the file is missing."""
    if not there(spark, path):
        return spark.createDataFrame([], schema)
    return whole_json(spark, path, schema)


def triples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of a merged graph file, with their place."""
    return whole_json(spark, path, GRAPH).select(F.posexplode("triples").alias("pos", "t")).select("pos", "t.*")


def stop_words(spark: SparkSession, path: str) -> list[str]:
    """One word a line, stripped, blanks dropped; a list for the driver, so for stop lists only."""
    return [r[0] for r in spark.read.text(path).select(F.trim("value")).where("trim(value) <> ''").collect()]


def config(*paths: str) -> dict:
    """The first YAML file that there is."""
    for path in paths:
        if Path(path).exists():
            return yaml.safe_load(Path(path).read_text()) or {}
    raise FileNotFoundError(f"none of {paths}")


def processed_ids(rows: DataFrame) -> DataFrame:
    return rows.select(F.coalesce(F.col("query.query_id").cast("string"), F.col("query.content")).alias("id")).distinct()


def vectors(spark: SparkSession, path: str, keys: DataFrame, dim: int) -> DataFrame | None:
    """A stored vector table, if it has each (policy, content_hash) key with `dim` values; else None: compute anew."""
    if not there(spark, path):
        return None
    stored = spark.read.parquet(path)
    wrong = keys.join(stored.where(F.size("embedding") == dim), ["policy", "content_hash"], "left_anti").limit(1).count()
    return None if wrong else stored


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    from lodestone.operators.tools import last_wins

    return last_wins(rows, key, order)
