"""Sub-questions, judging by a model, the index, uneven fields and the command line, by small examples."""

import json

from pyspark.sql import functions as F

from lodestone.__main__ import main
from lodestone.functions import fields as X
from lodestone.functions import text as T
from lodestone.operators import answers, providers, retrieve
from lodestone.operators import score as S
from lodestone.plans import index


def test_no_sub_questions_without_a_provider_or_results(spark):
    docs = spark.createDataFrame([(1, "red apples grow here"), (2, "blue seas")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "Where do apples grow? And the zebras?"), (8, "zebras?")], "query_id long, text string")
    search = lambda q: S.ranked(retrieve.bm25_of(q, docs), 1)
    assert answers.sub_questions(asked, search, docs).count() == 0
    found = answers.sub_questions(asked, search, docs, T.sentences).collect()
    assert [(r.query_id, r.text, r.is_pseudo) for r in found] == [(7, "Where do apples grow?: red apples grow here", True)]
    assert spark.range(1).select(answers.sub_index_size(3), answers.sub_index_size(10), answers.sub_index_size(40)).first()[:] == (20, 40, 60)


def test_key_points_judged_by_a_model(spark):
    items = spark.createDataFrame([(1, "q", "a", ["x", "y", "z"]), (2, "q", "fail", ["x"])], "query_id long, query string, answer string, points array<string>")

    def model(prompt):
        if "fail" in prompt:
            raise ValueError("no")
        return "1. relevant 2. wrong"

    a, b = answers.judge_by_model(items, model).orderBy("query_id").collect()
    assert list(a.labels) == ["Relevant", "Wrong"] and a.found_ratios.completeness == 0.5 and a.found_ratios.irrelevance == 0
    assert list(b.labels) == [] and b.found_ratios.completeness is None and b.ratios.completeness == 0 and b.error == "no"


def test_routes_and_relevance(spark):
    rows = [(1, "red apples", 1, "red apples grow"), (1, "red apples", 2, " "), (2, "zebra", 1, "nothing"), (2, "zebra", 2, None), (3, "zebra", 1, "nothing")]
    chunks = spark.createDataFrame(rows, "query_id long, query string, rank int, text string")
    got = {r.query_id: (r.label, r.route) for r in answers.route(chunks, spark.createDataFrame([(1,), (2,)], "query_id long")).collect()}
    assert got == {1: ("SUFFICIENT", "chunks"), 2: ("INSUFFICIENT", "graph"), 3: ("INSUFFICIENT", "chunks")}
    assert sorted((r.query_id, r.rank) for r in answers.relevant(chunks).collect()) == [(1, 1), (2, 1), (3, 1)]


def test_keywords_by_meaning(spark):
    asked = spark.createDataFrame([(1, "red apples and blue seas")], "query_id long, text string")
    found = answers.semantic_keywords(answers.keyword_candidates(asked, providers.hashing_embedder(32)), 2).collect()
    assert len(found) == 2 and found[0].score >= found[1].score


def test_an_embedder_fails_text_by_text(spark):
    def model(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(1, "one"), (2, "bad"), (3, None)], "id long, text string").coalesce(1)
    got = rows.withColumn("v", providers.batched(model, 2)(F.col("text"))).withColumn("failed", providers.without_vector(F.col("v")))
    assert [(r.id, list(r.v), r.failed) for r in got.orderBy("id").collect()] == [(1, [3, 1], False), (2, [0, 0], True), (3, [0, 1], False)]


def test_index_is_built_once_and_searched(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red apples grow here"), (2, "blue seas lie there"), (3, "red apples grow here")], "doc_id long, text string")
    chunks = index.cached_chunks(docs, f"{tmp_path}/chunks", size=20, overlap=0)
    assert chunks.count() == index.cached_chunks(docs, f"{tmp_path}/chunks").count() == 3
    encoder = index.Encoder(providers.hashing_embedder(32), 32)
    vectors = index.load_or_build(chunks, encoder, f"{tmp_path}/vectors")
    assert vectors.count() == 2  # equal chunks once
    assert index.load_or_build(chunks, encoder, f"{tmp_path}/vectors").count() == 2
    asked = docs.where("doc_id = 2").select(F.col("doc_id").alias("query_id"), "text")
    best = index.search(asked, chunks, vectors, encoder, 1).first()
    assert best["chunk"]["doc_id"] == 2
    assert index.search(asked, chunks, vectors, encoder, 3, least=1.1).count() == 0
    assert len(index.embedded(docs, encoder).first().embedding) == 32


def test_uneven_fields(spark):
    row = spark.range(1).select(
        X.lenient_number(F.lit("nan?")).alias("a"),
        X.first_of_nested(F.array(F.array(F.lit("x"), F.lit("y")), F.array().cast("array<string>"))).alias("b"),
        X.scaled(F.create_map(F.lit("k"), F.lit(2.0)), 0.5).alias("c"),
        X.disjoint(F.lit(None).cast("array<string>"), F.array(F.lit("x"))).alias("d"),
        X.query_text(F.lit("{}")).alias("e"),
    ).first()
    assert (row.a, list(row.b), row.c, row.d, row.e) == (3.0, ["x"], {"k": 1.0}, True, None)


def test_command_line(spark, tmp_path):
    def lines(name, rows):
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows))
        return str(tmp_path / name)

    queries = lines("q.jsonl", [{"query_id": 1, "text": "Where do apples grow?", "language": "en"}])
    docs = lines("d.jsonl", [{"doc_id": 1, "text": "Red apples grow here."}, {"doc_id": 2, "text": "Blue seas."}])
    main(["infer", queries, docs, f"{tmp_path}/out"], spark)
    assert spark.read.json(f"{tmp_path}/out").first().prediction.content == "Red apples grow here."
    items = lines("i.jsonl", [{"file": "a", "found": ["x y."], "truth": ["x y."], "answer": "x", "expected": "x"}])
    main(["evaluate", items, f"{tmp_path}/report", "--profile", "baseline"], spark)
    assert spark.read.json(f"{tmp_path}/report").first().ROUGELScore == 1
    triples = lines("t.jsonl", [{"doc_id": 1, "pos": 0, "head": "A", "head_type": "Organization", "relation": "founded", "tail": "B", "tail_type": "Person"}])
    main(["graph", triples, f"{tmp_path}/graph"], spark)
    assert spark.read.parquet(f"{tmp_path}/graph/entities").count() == 2


def test_rouge_of_all_turns_against_a_plain_table(spark, sf):
    from lodestone.queries import QUERIES, _turns

    def rouge(a, b):
        last = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
            last = row
        n = last[-1]
        p, r = n / max(1, len(a)), n / max(1, len(b))
        return 2 * p * r / (p + r) if n else 0.0

    tokens = _turns(spark, sf).select("conv_id", "turn", T.tokens("text").alias("a"), T.tokens("next").alias("b"))
    want = {(r.conv_id, r.turn): rouge(r.a, r.b) for r in tokens.collect()}
    got = {(r.conv_id, r.turn): r[2] for r in QUERIES["rouge_l"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
