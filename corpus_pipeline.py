"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its output is
written as Parquet and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard, packing, pii, suffix, tokens, toxicity
from lodestone.llm.arrays import cut, drop_table, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew (null text: 0)."""
    return docs.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression, fitted on the labels, does not call toxic. Null and
    empty texts stay, as do all rows where no label tells toxic rows from others."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return _columns(toxicity.score(docs.select(*COLUMNS), model).where("not toxic"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five words, similarity 0.8 or more): the
    smallest doc_id, then by the text's hash. Rows are compared by their own texts, so rows that
    repeat an id with another text are judged apart; of rows of equal id and text one stays, null
    and empty texts included, and rows without id all stay. No rows give no rows."""
    known = cut(docs.where("doc_id is not null").select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = jaccard.components(known.select(F.col("_row").alias("doc_id"), "text"), percent=80, words=5)
    about = known.select("_row", "doc_id", F.xxhash64("text").alias("hash"), "source", "lang").join(found.withColumnRenamed("doc_id", "_row"), "_row")
    # texts without words are linked with nothing, but equal rows are one
    empty = F.col("n_shingles") == 0
    group = [F.when(~empty, F.col("component_id")).alias("a"), F.when(empty, F.col("doc_id")).alias("b"), F.when(empty, F.col("hash")).alias("c")]
    kept = about.groupBy(*group).agg(F.min(F.struct("doc_id", "hash", "source", "lang", "_row")).alias("first")).select("first._row")
    return _columns(known.join(kept, "_row", "left_semi").select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS)))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that also stand elsewhere. Every row stays; a
    null text stays null, and a text that is all repeated becomes empty."""
    return _columns(suffix.remove_repeats(docs.select(*COLUMNS)))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by the kind in angle brackets. Every row stays, null and empty
    texts as they are."""
    return _columns(pii.redact(pii.find(docs.select(*COLUMNS))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place; a null or empty text is one piece of the
    end alone, and repeated rows are packed as often as they stand there."""
    return packing.pack_documents(docs, tokens.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("suffix_array_dedup", cut_repeats),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: The fitted classifier, connected components and packing can't be written in SQL; tests compare the
#: stages after the first with plain versions, and the classifier with labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_table(before)
    return docs
