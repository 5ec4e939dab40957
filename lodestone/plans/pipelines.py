"""End-to-end plans: inference over all queries, evaluation of predictions, graph building."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions import metrics as M
from lodestone.functions import prompts as P
from lodestone.functions import text as T
from lodestone.operators import kg, providers, report, retrieve


def infer(queries: DataFrame, docs: DataFrame, embed=None, config: retrieve.RetrieveConfig = retrieve.RetrieveConfig(), cut: int = 3) -> DataFrame:
    """queries (query_id, text, language), docs (doc_id, text): answers with references and query type.

    One plan for all queries: classify, hybrid ranking, context of the first `cut` documents, answer.
    """
    embed = embed or providers.hashing_embedder()
    typed = C.chunk_policy(C.classify(queries, "text"))
    vectors = queries.select("query_id", embed(F.col("text")).alias("q")), docs.select("doc_id", "text", embed(F.col("text")).alias("v"))
    found = retrieve.hybrid_retrieve(queries, docs, vectors, config).where(F.col("rank") <= cut)
    chunks = docs.join(F.broadcast(found), "doc_id").withColumn("label", P.metadata_label(doc_id=F.col("doc_id")))
    block = F.when(F.trim("text") != "", F.concat(F.lit("### Source "), F.col("rank").cast("string"), F.col("label"), F.lit("\n"), F.trim("text")))
    # context and references come from one aggregate, so the ranking is computed once
    refs = chunks.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "text", block.alias("block")))).alias("r"))
    out = typed.join(refs, "query_id", "left").withColumn("context", F.array_join(F.transform("r", lambda x: x["block"]), "\n\n"))
    answer = providers.extractive_answer(F.col("text"), F.coalesce("context", F.lit("")))
    return out.select(
        "query_id",
        F.struct(
            answer.alias("content"),
            F.transform("r", lambda x: x["text"]).alias("references"),
            F.array_distinct(F.transform("r", lambda x: x["doc_id"])).alias("reference_doc_ids"),
            F.col("dataset_label").alias("query_type_pred"),
            F.col("canonical_type").alias("query_type_canonical"),
        ).alias("prediction"),
    )


def evaluate(items: DataFrame, metrics: list[str], found: str = "found", truth: str = "truth", answer: str = "answer", expected: str = "expected") -> DataFrame:
    """Items with a column for each metric and ROUGE-L of the answer."""
    out = items.withColumns({m: M.get_metric(m)(F.col(found), F.col(truth)) for m in metrics})
    out = out.withColumns({"_h": T.tokens(answer), "_r": T.tokens(expected)})
    return out.withColumn("ROUGELScore", M.rouge_l(T.lcs_length("_h", "_r"), F.col("_h"), F.col("_r"))).drop("_h", "_r")


def summarize(items: DataFrame, metrics: list[str], key: str = "file") -> DataFrame:
    return report.derive(report.macro_average(items, [*metrics, "ROUGELScore"], key), key)


def build_graph(triples: DataFrame) -> dict[str, DataFrame]:
    ents = kg.entities(triples)
    return {"entities": ents, "triples": kg.with_ids(triples, ents), "relations": kg.relations(triples), "doc_ranges": kg.doc_ranges(triples), "statistics": kg.statistics(triples, ents), "index": kg.entity_index(triples)}
