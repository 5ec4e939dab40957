"""Scans move no pairs of queries and documents, and give what the pairs give."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import retrieve, scan
from lodestone.operators import score as S

#: Queries whose pairs must not be shuffled.
LEXICAL = [
    "parent_docs",  # F1
    "policy_topk",  # F2
    "zh_bm25_topk",  # F3
    "lexical_mix_topk",  # F4
    "prf_expanded_topk",  # F5
    "sub_question_chunks",  # F8
    "rerank_fusion",  # F9
    "evidence_route",  # F10
    "recall_curve",  # F11
    "multi_query_fusion",  # F12
    "prf_terms",  # F13
    "recall_at_k",  # F14
    "tfidf_topk",  # F15
    "jelinek_mercer_topk",  # F16
    "relevant_chunks",  # F17
    "rrf_fusion",  # F18
    "pseudo_first",  # F19
    "cross_rerank_topk",  # F20
    "context_block",  # F21
    "predictions",  # F22
    "graph_boost_shape",  # F23
    "answer_route",  # F24
    "lost_in_middle",  # F25
]


@pytest.fixture(scope="module")
def grown(sf, tmp_path_factory):
    """A folder with the documents once, and one with them eight times over; ids are shifted."""
    out = []
    for times in (1, 8):
        d = tmp_path_factory.mktemp(f"times{times}")
        for name in os.listdir(sf):
            os.symlink(f"{sf}/{name}", d / name)
        docs = pq.read_table(f"{sf}/documents.parquet")
        at = docs.schema.get_field_index("doc_id")
        parts = [docs.set_column(at, "doc_id", pa.array([x + i * 100_000 for x in docs.column("doc_id").to_pylist()], docs.schema.field("doc_id").type)) for i in range(times)]
        os.unlink(d / "documents.parquet")
        pq.write_table(pa.concat_tables(parts), d / "documents.parquet")
        out.append(str(d))
    return out


def moved(spark, run) -> int:
    """Rows shuffled by all stages of a run."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def rows():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    before = rows()
    run().write.format("noop").mode("overwrite").save()
    return rows() - before


@pytest.mark.parametrize("name", LEXICAL)
def test_shuffled_rows_do_not_follow_pairs(spark, grown, name):
    from lodestone.queries import QUERIES

    once, more = (moved(spark, lambda d=d: QUERIES[name](spark, d)) for d in grown)
    assert more < 2 * once


def pairs(docs, queries):
    """BM25 as the SQL has it: rows of one id, length and token are one."""
    tokens = T.tokens("text")
    tf = S.postings(docs, tokens)
    return S.bm25(S.query_terms(queries, tokens), tf, S.bm25_idf(S.token_stats(tf), S.corpus_stats(docs, tokens)))


def rows(df, *names):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect()), key=str)


def test_rows_that_share_an_id_count_as_by_pairs(spark):
    texts = [(1, "red apples grow"), (1, "red apples grow on red trees"), (1, "apples red seas"), (2, "blue seas lie there"), (None, "red red"), (None, "apples"), (3, None), (4, ""), (5, "red apples"), (6, "the red red seas")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    asked = spark.createDataFrame([(7, "red apples red"), (8, "seas"), (9, "zebra"), (10, None)], "query_id long, text string")
    found = retrieve.bm25_topk(asked, docs, 3)
    want = S.ranked(pairs(docs, asked), 3)
    assert rows(found, "query_id", "doc_id", "score", "rank") == rows(want, "query_id", "doc_id", "score", "rank")
    assert rows(retrieve.scored(S.query_terms(asked, T.tokens("text")), retrieve.Corpus(docs), None), "query_id", "doc_id", "score") == rows(pairs(docs, asked), "query_id", "doc_id", "score")
    assert retrieve.bm25_topk(asked.where("query_id = 9"), docs, 3).count() == 0
    assert retrieve.bm25_topk(asked, docs.where("false"), 3).count() == 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dense_topk", "dense_l2_topk"])
def test_vectors_are_scanned_not_joined(spark, sf, name):
    from lodestone.queries import QUERIES

    plan = plan_of(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_odd_vectors_count_as_by_pairs(spark, metric):
    vectors = [(i, [float(i % 5), 1.0, float(i % 3) - 1]) for i in range(40)] + [(40, None), (41, [1.0, None, 2.0]), (42, [1.0, 2.0]), (43, [float("inf"), 1.0, 1.0]), (44, [0.0, 0.0, 0.0]), (45, [1e-3, 1e3, 1e5])]
    docs = spark.createDataFrame(vectors, "doc_id long, v array<double>")
    asked = docs.where("doc_id in (0, 7, 40, 42, 44, 45)").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    near = metric == "l2"
    want = S.ranked(S.dense_scores(asked, docs, metric), 4, ascending=near)
    assert rows(retrieve.dense_topk(asked, docs, 4, metric), "query_id", "doc_id", "score", "rank") == rows(want, "query_id", "doc_id", "score", "rank")


def test_passages_are_found_as_by_contains(spark, grown):
    from lodestone.queries import QUERIES

    assert "NestedLoopJoin" not in plan_of(QUERIES["recall_curve"](spark, grown[0]))
    texts = ["one two three four five six seven", "xone two three four five sixy", "ONE TWO three four five six", None, "", "one  two three four five six", "a b one two three four five six one two three four five six"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = [(1, "one two three four five six"), (2, "ne two three four five si"), (3, "three four"), (4, ""), (5, None), (6, "TWO three four five six"), (7, "two three four five six one two"), (1, " three four five six seven")]
    items = spark.createDataFrame(asked, "query_id long, text string")
    want = docs.join(items.withColumnRenamed("text", "p"), F.contains("text", F.col("p"))).select("query_id", "doc_id")
    assert rows(retrieve.containing(items, docs).distinct(), "query_id", "doc_id") == rows(want.distinct(), "query_id", "doc_id")


def test_tokens_cut_from_bytes_are_those_of_the_pattern(spark):
    texts = ["It's 3 o'clock, ÉTÉ in Köln", "", None, "a", "b", "...", "İstanbul K 天地x玄", "tail"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    r = got.select(F.lower("text").alias("l"), T.tokens("text").alias("t")).toArrow().combine_chunks()
    for part in (r, r.slice(3, 4)):
        found, n = scan.LowerTexts().tokens(part.column("l").chunk(0))
        want = part.column("t").to_pylist()
        assert n.tolist() == [len(x) for x in want] and found.to_pylist() == [w for x in want for w in x]


def test_han_grams_as_numbers(spark):
    got = spark.createDataFrame([("天地x玄黄宇",), (None,), ("a",), ("洪",)], "t string").coalesce(1)
    r = got.select("t", T.han_grams(F.coalesce("t", F.lit(""))).alias("g")).toArrow().combine_chunks()
    want = [w for x in r.column("g").to_pylist() for w in x]
    for few in (scan.HanGrams.FEW, 0):  # by a table, and by sorting
        reader = scan.HanGrams()
        reader.FEW = few
        names, at, row, n = reader.counted(r.column("t").chunk(0))
        assert sorted(names[i].as_py() for i in at.tolist()) == sorted(want) and n.tolist() == [len(x) for x in r.column("g").to_pylist()]
        at, row, _ = reader.found(r.column("t").chunk(0), ["玄", "天地", "洪", "zz"[:1]])
        assert sorted(at.tolist()) == [0, 1, 2] and sorted(row.tolist()) == [0, 0, 3]
