"""Hand-made cases of the operators."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions import metrics as M
from lodestone.functions import text as T
from lodestone.functions.porter import stem
from lodestone.operators import chunk, kg, providers, report, retrieve, score, tools
from lodestone.sources import readers, writers


def col(spark, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()])


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry"), (3, ""), (4, "date"), (5, "elder fig")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "apple banana"), (2, "banana banana zzz")], "query_id int, text string")
    got = {(r.query_id, r.doc_id): round(r.score, 6) for r in retrieve.bm25_of(queries, docs).collect()}
    assert got == {(1, 1): 1.489175, (1, 2): 0.3045, (2, 1): 0.492098, (2, 2): 0.609}


def test_hybrid_and_boost(spark):
    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry"), (3, ""), (4, "date"), (5, "elder fig")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "apple banana")], "query_id int, text string")
    dense = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.9), (1, 3, 0.1), (1, 4, 0.5), (1, 5, 0.1)], "query_id int, doc_id int, score double")
    got = {r.doc_id: round(r.score, 6) for r in score.hybrid(retrieve.bm25_of(queries, docs), dense).collect()}
    assert got == {1: 0.3875, 2: 0.761343, 3: 0.0, 4: 0.35, 5: 0.0}
    known = spark.createDataFrame([("1", ["apple", "Fig"])], "key string, keywords array<string>")
    got = {r.doc_id: r.score for r in retrieve.hybrid_retrieve(queries, docs, dense, known=known).collect()}
    assert got[1] == 0.5375 and got[5] == 0.15


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("When was Acme founded?", "FACTUAL", 1.5),
        ("Compare Acme and Globex: which had more staff?", "MULTI_DOC_COMPARISON", 2.25),
        ("Which ruling came earlier?", "MULTI_DOC_TIMESEQ", 2.0),
        ("Summarize the report.", "SUMMARY", 1.1),
        ("How did the merger lead to growth?", "MULTIHOP", 1.1),
        ("According to Acme and Globex, list sites respectively.", "MULTI_DOC_INTEGRATION", 1.7),
        ("Summarize what happened after the merger.", "MULTI_DOC_TIMESEQ", 1.2),
        ("Describe the garden.", "UNKNOWN", 0.0),
    ],
)
def test_query_type(spark, text, kind, value):
    r = C.chunk_policy(C.classify(spark.createDataFrame([(text, "en")], "query string, language string"))).first()
    assert (r.canonical_type, round(r.score, 6)) == (kind, value)
    if kind == "UNKNOWN":
        assert (r.dataset_label, r.chunk_size, r.chunk_overlap) == ("Irrelevant Unsolvable Question", 140, 28)


def test_query_type_zh(spark):
    rows = spark.createDataFrame([("比较两家公司，哪家更早成立？", "zh"), (None, "zh"), (None, None)], "query string, language string")
    got = [(r.canonical_type, r.chunk_size) for r in C.chunk_policy(C.classify(rows)).collect()]
    assert got == [("MULTI_DOC_COMPARISON", 224), ("UNKNOWN", 128), ("UNKNOWN", 140)]


def test_chunks(spark):
    assert col(spark, t="abcdefghij").select(chunk.fixed_windows(F.col("t"), 4, 1)).first()[0] == ["abcd", "defg", "ghij", "j"]
    assert col(spark, t="").select(chunk.fixed_windows(F.col("t"), 4, 1)).first()[0] == []
    text = "One two three. Four five six.\n\nSeven eight nine ten."
    assert chunk.split_text(text, 4, 0) == ["One two three.", "Four five six.", "Seven eight nine ten."]
    assert " ".join(chunk.split_text(text, 3, 0)).split() == text.split()
    assert chunk.split_text("", 4, 0) == []
    assert all(len(c) <= 5 for c in chunk.split_text("甲乙丙丁戊己庚。辛壬", 5, 2, chunk.ZH_SEPARATORS, False))


def test_retrieval_metrics(spark):
    d = col(spark, found=["The cat sat. It ran away.", "Dogs bark loudly."], truth=["The cat sat.", "Birds sing."])
    get = lambda n: d.select(M.get_metric(n)(F.col("found"), F.col("truth"))).first()[0]
    assert get("Sentences_Precision") == pytest.approx(3 / 9)
    assert get("Sentences_Recall") == pytest.approx(3 / 5)
    assert get("Words_Precision") == pytest.approx(3 / 9)
    assert get("Words_Recall") == pytest.approx(3 / 5)
    with pytest.raises(KeyError):
        M.get_metric("none")


def test_rouge_and_bleu(spark):
    d = col(spark, h="the police killed the gunman", r="police ended the gunman").select(T.tokens("h").alias("h"), T.tokens("r").alias("r")).withColumn("l", T.lcs_length("h", "r"))
    r = d.select("l", M.rouge_l(F.col("l"), F.col("h"), F.col("r")).alias("f"), M.bleu(F.col("h"), F.col("h")).alias("one"), M.bleu(F.col("h"), F.col("r")).alias("none")).first()
    assert (r.l, round(r.f, 6), round(r.one, 6), r.none) == (3, 0.666667, 1.0, 0.0)


def test_key_points(spark):
    r = col(spark, a='x {"complete_ids": [1, 2], "irrelevant_ids": [3]} y').select(M.ids_from_json(F.col("a")).alias("j")).select(M.ratios_by_ids(F.col("j.complete_ids"), F.col("j.irrelevant_ids"), F.lit(4)).alias("r")).first()[0]
    assert (r.completeness, r.irrelevance, r.hallucination) == (0.5, 0.25, 0.25)
    r = col(spark, a="Relevant, irrelavant; WRONG Relevant").select(M.labels_in_order(F.col("a"), F.lit(3))).first()[0]
    assert r == ["Relevant", "Irrelevant", "Wrong"]
    assert col(spark, a="[[[Wrong]]]").select(M.label_of(F.col("a"))).first()[0] == "Wrong"
    assert col(spark, p=["first", "2. second"]).select(M.format_key_points(F.col("p"))).first()[0] == "1. first\n2. second"
    assert col(spark, p="1. a\n2、b").select(M.parse_key_points(F.col("p"))).first()[0] == ["a", "b"]


def test_graph(spark):
    rows = [(0, 1, "A", "Org", "r1", "B", "Loc"), (1, 1, "A", "Org", "r2", "C", "Event"), (2, 2, "A", "Person", "r1", "B", "Loc"), (3, 2, None, None, "r1", "B", "Loc")]
    t = spark.createDataFrame(rows, "pos long, doc_id long, head string, head_type string, relation string, tail string, tail_type string")
    assert {r.id: (r.type, r.name) for r in kg.entities(t).collect()} == {"e1": ("Org", "A"), "e2": ("Loc", "B"), "e3": ("Event", "C"), "e4": ("Person", "A")}
    assert {r.relation: (r["count"], r.example_head_type, r.example_tail_type) for r in kg.relations(t).collect()} == {"r1": (2, "Org", "Loc"), "r2": (1, "Org", "Event")}
    assert {r.doc_id: (r.start_triple_index, r.end_triple_index) for r in kg.doc_ranges(t).collect()} == {1: (0, 1), 2: (2, 2)}
    index = {}
    for r in kg.entity_index(t.where("head is not null")).collect():
        index.setdefault(r.entity, set()).add(r.doc_id)
    assert index == {"a": {"1", "2"}, "b": {"1", "2"}, "c": {"1"}}
    seeds = spark.createDataFrame([(1, "c")], "query_id long, entity string")
    assert {(r.entity, r.hop) for r in kg.hops(seeds, t).collect()} == {("c", 0), ("a", 1), ("b", 2)}


def test_report(spark):
    items = spark.createDataFrame([("f", 0.5, 1.0, 0.2), ("f", None, 0.0, 0.4)], "file string, completeness double, hallucination double, ROUGELScore double")
    avg = report.macro_average(items, ["completeness", "hallucination", "ROUGELScore"])
    assert {r.metric: (r.value, r.n) for r in avg.collect()}["completeness"] == (0.5, 1)
    d = report.derive(avg).first()
    assert d.factual_score == 0.0 and round(d.Generation_Total_Score, 6) == 0.15 and d.Retrieval_Total_Score is None
    c = report.compare(avg, avg.where("metric <> 'completeness'")).collect()
    assert {r.metric: r.direction for r in c} == {"completeness": "down", "hallucination": "same", "ROUGELScore": "same"}


def test_small_functions(spark):
    assert [stem(w) for w in ("caresses", "ponies", "relational", "hopping", "sky", "happy", "generalizations")] == ["caress", "poni", "relat", "hop", "sky", "happi", "gener"]
    assert col(spark, t="a b c").select(T.ngrams(T.tokens("t"), 2)).first()[0] == ["a", "b", "c", "a b", "b c"]
    assert col(spark, t="北京大学").select(T.han_grams("t")).first()[0] == ["北", "京", "大", "学", "北京", "京大", "大学"]
    assert not col(spark, s="INSUFFICIENT").select(providers.is_sufficient(F.col("s"))).first()[0]
    r = col(spark, v=[3.0, 4.0]).select(score.unit(F.col("v")).alias("u"), score.cosine(F.col("v"), F.col("v")).alias("c")).first()
    assert r.u == [0.6, 0.8] and r.c == pytest.approx(1.0)
    with pytest.raises(ValueError):
        retrieve.RetrieveConfig(kind="other")


def test_files(spark, tmp_path):
    f = tmp_path / "q.jsonl"
    f.write_text('{"query": {"query_id": 1, "content": "a"}}\n\n{"query": {"query_id": 2, "content": "b"}}\n')
    assert readers.jsonl(spark, str(f), readers.QUERIES).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"query": {"query_id": 1}}\nnot json\n')
    assert readers.jsonl(spark, str(tmp_path / "bad.jsonl"), readers.QUERIES, "drop").where("query is not null").count() == 1
    assert {r.file for r in readers.folder(spark, str(tmp_path), readers.QUERIES).select("file").collect()} >= {"q.jsonl"}
    assert readers.whole_json_or_empty(spark, str(tmp_path / "none.json"), "a int").count() == 0
    rows = spark.createDataFrame([("f", "m", 0.5)], "file string, metric string, value double")
    writers.report(rows, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"f": {"m": 0.5}}
    for _ in range(2):
        writers.append_missing(rows, str(tmp_path / "t"), "file")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    lines = spark.createDataFrame([('{"query": {"query_id": 1}, "prediction": {"content": "x", "references": []}}',), ('{"query": {"query_id": "x"}}',)], "value string")
    assert tools.check_output(lines, lines)["invalid"] == 1


def test_stream(spark, tmp_path):
    from lodestone.streaming.jobs import evaluate_stream, run_until_complete

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"text": "a b"}\n')
    start = lambda: evaluate_stream(spark, str(tmp_path / "in"), "text string", lambda d: d.withColumn("n", F.size(T.tokens("text"))), str(tmp_path / "out"), str(tmp_path / "check"))
    run_until_complete(start)
    (tmp_path / "in" / "b.json").write_text('{"text": "c"}\n')
    run_until_complete(start)
    assert sorted(r.n for r in spark.read.json(str(tmp_path / "out")).collect()) == [1, 2]
