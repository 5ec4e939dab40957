"""The pipeline's stages on a small corpus, each against a plain version."""

import re

import corpus_pipeline
import pytest
from .test_operators import brute_groups


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_stages_keep_columns_and_take_effect(spark, sf, corpus):
    docs = corpus
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, sf), "test")
        if name != "best_fit_packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            rows[name] = {r.doc_id: r.text for r in docs.collect()}
    every = {r.doc_id: r.text for r in corpus.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    left = set(rows["toxicity"])
    assert len(toxic - left) >= 0.5 * len(toxic) and len(left) >= len(every) - 2 * len(toxic)  # 80 labelled rows
    once = {}
    for d in sorted(rows["toxicity"]):
        once.setdefault(rows["toxicity"][d], d)
    assert set(rows["near_duplicates"]) <= set(once.values())
    assert all("@" not in t or "<EMAIL>" in t or t.count("@") < 3 for t in rows["pii"].values() if t)
    assert docs.select("doc_id").distinct().count() == len(rows["pii"])


def test_near_duplicates_keep_one(spark, sf):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text), (2, text), (3, text + " x"), (4, "other words here"), (None, "n"), (None, "n"), (5, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.keep_one_of_each_group(spark, docs, sf)
    assert sorted((str(r.doc_id) for r in got.collect())) == ["1", "4", "5", "None", "None"]


def test_near_duplicates_of_reused_ids(spark, sf):
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"z{i}" for i in range(60))
    rows = [(1, text), (2, text + " x"), (2, other), (3, other + " y"), (4, None), (4, None), (4, " "), (5, text), (5, "a b c d e f")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.keep_one_of_each_group(spark, docs, sf)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, text), (2, other), (4, None), (4, " "), (5, "a b c d e f")], key=str)


def plain_cut(rows, n=200):
    """Texts without the bytes that a string of n bytes which stands twice covers."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = {}
    for _, x in texts:
        for i in range(len(x) - n + 1):
            seen[x[i : i + n]] = seen.get(x[i : i + n], 0) + 1
    out = {}
    for d, x in texts:
        mark = bytearray(len(x))
        for i in range(len(x) - n + 1):
            if seen[x[i : i + n]] > 1:
                mark[i : i + n] = b"\1" * n
        out[d] = bytes(c for c, m in zip(x, mark, strict=True) if not m).decode("utf-8", "ignore")
    return out


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_against_plain_versions(spark, sf, corpus):
    docs = corpus.where("doc_id % 2 = 0 and length(text) < 6000")
    kept = corpus_pipeline.cut(corpus_pipeline.keep_one_of_each_group(spark, docs, sf), "test")
    rows = rows_of(docs)
    empty = {d for d, n, _ in brute_groups(rows, 80, 5) if n == 0}
    firsts = {c for d, n, c in brute_groups(rows, 80, 5) if n} | empty
    assert {d for d, _ in rows_of(kept)} == firsts and kept.count() == len(firsts)

    whole = corpus_pipeline.cut(corpus_pipeline.cut_repeats(spark, kept, sf), "test")
    assert dict(rows_of(whole)) == plain_cut(rows_of(kept))

    clean = corpus_pipeline.cut(corpus_pipeline.redact_personal_data(spark, whole, sf), "test")
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    for (d, before), (e, after) in zip(sorted(rows_of(whole)), sorted(rows_of(clean)), strict=True):
        assert d == e and not mail.search(after) and after.count("<EMAIL>") - before.count("<EMAIL>") == len(mail.findall(before))
        if not re.search(r"[0-9@]", before):
            assert before == after

    packed = corpus_pipeline.pack_sequences(spark, clean, sf).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in rows_of(clean)}
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_of_edge_rows(spark, sf, corpus):
    schema = corpus.select(*corpus_pipeline.COLUMNS).schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x" * 70_000, None, None, 1)], schema)
    for docs, most in ((odd, 4), (odd.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.cut(stage(spark, docs.withColumn("mark", docs.doc_id) if name != "toxicity" else docs, sf), "test")
            n = docs.count()
            assert (n == 0) == (most == 0), name
