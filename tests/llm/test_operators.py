"""Operators against brute force, round trips and edge cases: nulls, empty and long texts, ties,
repeated rows, empty tables, clashing column names."""

import hashlib
import pickle
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import functions as F

from lodestone.llm import bpe, html, jaccard, knn, lm, packing, pii, queries, suffix, tokens, toxicity, winnow
from lodestone.llm.arrays import text_bytes
from lodestone.llm.components import connected_components

RANKS = tokens.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def rows_of(sf, table, columns):
    return duckdb.sql(f"select {columns} from '{sf}/{table}.parquet'").fetchall()


def sorted_rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


# 1


def test_html_text():
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class='cookie-notice'>ok?</div><article><h1>A &amp; B</h1><p>one <b>two</b>\n three<br>four<p>five<script>x<y</script></article><div id=comments>bad</div><footer>f</footer></body></html>"
    assert html.extract(page, None) == "A & B one two three four five"
    assert html.extract(None, None) == "" and html.extract("", ">body.") == ""
    assert html.extract("plain 1 < 2 text", None) == "plain 1 < 2 text"
    assert html.extract("<p>" * 3000 + "deep", None) == "deep"
    assert html.extract("<div>" * 100_000 + "deep", None) == "deep"
    # words that name furniture elsewhere don't inside an article; reader comments go everywhere
    page = "<body><article><p>" + "text " * 40 + "</p><div class='share-price'>12 up</div><div class='side effects'>none</div><div class='comments'>first!</div><div id='comment-list'>second</div></article></body>"
    assert html.extract(page, None) == "text " * 40 + "12 up none"
    # menus that nothing marks are known by their links
    links = "".join(f"<a href='/{i}'>go to page {i}</a> " for i in range(8))
    page = f"<body><div class=top>{links}</div><div class=story><p>{'words ' * 50}</p><form>name</form></div><div class=right><ul>{links}</ul></div><div class='cookie-notice left'>ok</div></body>"
    assert html.extract(page, None) == ("words " * 50).strip()
    page = f"<body><div>{links}</div><div><p>{'words ' * 50}</p></div></body>"
    assert html.extract(page, None) == ("words " * 50).strip()


def test_html_host_overrules_page(spark):
    page = "<body><div class=main><p>{0}</p></div><div class=extra><p>{1}</p></div></body>"
    rows = [(i, "http://h.example/", page.format("long article text " * 20, "more")) for i in range(5)] + [(9, "http://h.example/", page.format("short", "a far longer box " * 20))]
    got = {r.page_id: r.text for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "short" and got[0] == ("long article text " * 20).strip()


def test_html_hosts(spark):
    good = "<body><div class='main{0}'><p>{1}</p></div><div class='side'><p>x</p></div></body>"
    rows = [(i, "http://h.example/a", good.format(i, "long text here " * 5)) for i in range(4)] + [(9, None, None), (9, None, None), (10, "x", "")]
    got = sorted_rows(html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).select("page_id", "text", "n_chars"))
    text = ("long text here " * 5).strip()
    assert got == sorted([(i, text, len(text)) for i in range(4)] + [(9, "", 0), (9, "", 0), (10, "", 0)], key=str)
    assert html.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 2


def brute_repeats(rows, n=200):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + n] for _, b in texts for i in range(len(b) - n + 1))
    out = []
    for d, b in texts:
        mark = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                mark[i : i + n] = b"\1" * n
        runs = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((d, len(b), sum(mark), runs, hashlib.sha256(bytes(x for x, m in zip(b, mark, strict=True) if not m)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT_CONTEXTS", hot)
    rng = random.Random(1)
    w = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    p, q = w(260), w(199)
    rows = [(1, None), (2, ""), (3, p), (4, "x" + p + "y" + p), (5, q), (6, q), (7, "a" * 1000), (8, "ab" * 150), (9, p[:150] + q + p), (None, p), (None, p[20:] + "z"), (10, w(3000) + p[3:250]), (11, "a" * 200), (11, "a" * 200)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, DOCS).withColumn("mark", F.lit(1))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted_rows(got) == brute_repeats(rows)
    assert suffix.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("batches", [1, 2, 5, 9])
def test_suffix_levels(spark, batches):
    rng = random.Random(batches)
    w = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    shared = [w(220) for _ in range(6)]
    rows = [(i, w(rng.randint(0, 300)) + rng.choice(shared)[rng.randint(0, 19) :] + w(rng.randint(0, 90))) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    index = suffix.SuffixIndex()
    for i in range(batches):
        index.add(docs.where(F.pmod("doc_id", F.lit(batches)) == i))
    assert [size for size, _ in index.levels] == [s for s in range(4, -1, -1) if batches >> s & 1]
    assert sum(n for _, r in index.levels for n, in r.select("n").collect()) == len(suffix.sampled(*text_bytes(pa.array([t for _, t in rows])))[0])
    index.drop()
    spans = {}
    for r in suffix.repeated_spans(docs, batches).collect():
        spans.setdefault(r.did, set()).update(range(r.start, r.end))
    assert {d: len(spans.get(d, ())) for d, _ in rows} == {d: removed for d, _, removed, _, _ in brute_repeats(rows)}


def test_suffix_null_ids(spark):
    rng = random.Random(3)
    w = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    p = w(230)
    rows = [(None, w(200 + i % 50) + (p if i % 3 == 0 else "")) for i in range(2000)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted_rows(got) == brute_repeats(rows)


def test_suffix_past_16_mib():
    rng = random.Random(10)
    w = lambda n: bytes(rng.choices(b"abcd ", k=n))
    passage = w(300)
    data = np.frombuffer(w(1000) * ((1 << 24) // 1000 + 1) + passage + w(500), np.uint8)
    _, anchor, lo, hi, key, _, _ = suffix.sampled(data, np.array([0, len(data)]))
    assert ((lo <= anchor) & (anchor <= hi + suffix.LENGTH - suffix.K)).all()
    alone = np.frombuffer(passage, np.uint8)
    _, there, _, _, want, _, _ = suffix.sampled(alone, np.array([0, len(alone)]))
    place = len(data) - 800
    assert {(a - place, k) for a, k in zip(anchor.tolist(), key.tolist(), strict=True)} >= set(zip(there.tolist(), want.tolist(), strict=True))


# 3


def test_winnow_guarantee_and_ties():
    rng = random.Random(2)
    shared = "".join(rng.choice("abcd ") for _ in range(winnow.K + winnow.WINDOW - 1))
    a, b = "x" * 300 + shared + "y" * 50, shared + "q" * 400
    t, v, at = winnow.winnow([a, b, "", "short", "é" * 200])
    assert set(v[t == 0]) & set(v[t == 1])
    assert not (t == 2).any() and (t == 3).sum() == 1
    same = at[t == 4]  # all hashes equal: the rightmost of each window
    assert same.min() == winnow.WINDOW - 1 and same.max() == 200 - winnow.K


def test_winnow_past_2_to_24():
    rng = random.Random(11)
    w = lambda n: "".join(rng.choices("abcd ", k=n))
    long, other, last = w(1000) * ((1 << 24) // 1000 + 1), w(900), w(90)
    text, value, at = winnow.winnow([long + other, other, last])
    for i, x in ((1, other), (2, last)):  # what stands after place 2^24 of the batch
        _, want, places = winnow.winnow([x])
        assert value[text == i].tolist() == want.tolist() and at[text == i].tolist() == places.tolist()
    tail = (text == 0) & (at >= len(long))
    assert set(winnow.winnow([other])[1]) <= set(value[tail])


def test_winnow_short_texts():
    rng = random.Random(9)
    w = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    texts = [w(n) for n in (*range(20, 200, 3), 199, 1000, 150, 300, 40, 201, 900, 5, 260)]
    texts += [texts[-1][:120], texts[-1]]
    grams = lambda t: {t[i : i + winnow.K] for i in range(max(1, len(t) - winnow.K + 1))}
    like = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    got = winnow._rows(list(range(len(texts) - 1)), texts[:-1], texts[-1]).to_pylist()
    for r, t, o in zip(got, texts[:-1], texts[1:], strict=True):
        e = winnow._edit(t, o)
        if min(len(t), len(e)) < winnow.SHORT:
            assert r["near_edited"] == pytest.approx(like(t, e))
        if min(len(t), len(o)) < winnow.SHORT:
            assert r["near_next"] == pytest.approx(like(t, o))
    assert [len(r["fingerprint"]) // 18 for r in got if 20 <= r["n_chars"] < winnow.SHORT] == [len(t) - 19 for t in texts[:-1] if 20 <= len(t) < winnow.SHORT]


def test_winnow_neighbours(spark, sf):
    rows = rows_of(sf, "documents", "doc_id, text")
    got = {r.doc_id: r for r in winnow.winnow_neighbours(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    order = sorted(rows, reverse=True)
    for (d, t), (_, nxt) in zip(order, [*order[1:], order[0]], strict=True):
        n = len(t)
        assert got[d].n_chars == n and got[d].edited_sha256 == hashlib.sha256((t[: n - n // 2] + nxt[: n // 2]).encode()).hexdigest()
        assert 0 <= got[d].near_next <= 1
    few = winnow.winnow_neighbours(spark.createDataFrame([(1, None), (2, "same text"), (3, "same text"), (None, "z"), (3, "same text")], DOCS)).collect()
    assert len(few) == 5 and len({r.fingerprint for r in few if r.n_chars == 9}) == 1
    assert {(r.doc_id, r.near_next) for r in few} >= {(3, 1.0)}
    assert winnow.winnow_neighbours(spark.createDataFrame([], DOCS)).count() == 0


# 4


def test_knn(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-9, 9, (300, 8))
    v[100:200] = v[0]
    rows = [(i, [float(x) / 64 for x in r]) for i, r in enumerate(v)] + [(1000, None), (1020, [None] * 8), (1040, [float("nan")] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn.top_k(knn.integer_vectors(table), F.col("vec_id") % 20 == 0, 5).collect()}
    for q in range(0, 300, 20):
        best = sorted(((-int(v[q] @ v[i]), i) for i in range(300) if i != q))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert len(got) == 15 * 5
    assert knn.top_k(knn.integer_vectors(table.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


# 5 and 6

ODD = ["", " ", "  a", "a  b\n\n c \x1c!\x1c x　 y", "x" * 3000, "ab" * 700 + " " * 500, "été ’s don't 12½²_a__b\t\tq ", "'s", "'", "'r", "'re're'llx 'sa !'s \n's 'll\n'", "🙂🙂 ok ñ　'tt", "<|endoftext|>"]


def test_bpe(spark):
    pairs = bpe.loaded(RANKS)
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("abé'sl re\n 1½.") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    data, at = text_bytes(pa.array(texts))
    ids, id_at = pairs.encode(data, at)
    assert [ids[a:b].tolist() for a, b in zip(id_at[:-1], id_at[1:], strict=True)] == [enc.encode_ordinary(t) for t in texts]
    back, back_at = pairs.decode(ids, id_at)
    assert back.tobytes() == data.tobytes() and (back_at == at).all()
    rows = spark.createDataFrame([(1, None), (2, "a b"), (2, "a b"), (None, "x")], DOCS).withColumn("ids", F.lit(0))
    assert Counter(r.n_tokens for r in bpe.encode_decode(rows, RANKS).collect()) == {0: 1, 2: 2, 1: 1}


def test_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-2, "")], DOCS))
    got = packing.pack_documents(docs, RANKS).collect()
    pairs = bpe.loaded(RANKS)
    per_doc = {}
    for r in got:
        per_doc.setdefault(r.doc_id, []).append(r)
    for d, t in rows_of(sf, "documents", "doc_id, text"):
        ids, _ = pairs.encode(*text_bytes(pa.array([t])))
        whole = ids.astype("<u4").tolist() + [2]
        at = 0
        for r in sorted(per_doc[d], key=lambda r: r.piece):
            assert r.start == at and zlib.crc32(np.array(whole[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(whole) and all(r.length == 1024 for r in per_doc[d] if r.piece)
    assert len(per_doc[-1]) == 1 and len(per_doc[-2]) == 2
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    lengths = np.array([r.length for r in got])
    assert len(bins) <= packing.lower_bound(lengths) + 1


def test_packing_ids_of_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "hello world <|endoftext|> x", "<|endoftext|>", "<|endoftext|><|endoftext|>a", "<|endoftext", "plain é 漢 text" * 300, "tail<|endoftext|>"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(90, None)]
    got = packing.pieces(spark.createDataFrame(rows, DOCS).withColumn("piece", F.lit("clash")), RANKS).collect()
    for d, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, packing.END], "<u4")
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == d)
        assert sum(n for _, _, n, _ in mine) == len(ids)
        assert all(c == zlib.crc32(ids[s : s + n].tobytes()) and n <= 1024 for _, s, n, c in mine)
    assert packing.pack_documents(spark.createDataFrame([], DOCS), RANKS).count() == 0


def test_long_matches_that_sums_confuse(spark):
    a = "a"
    for _ in range(10):  # Thue-Morse words: equal polynomial sums modulo 2**64
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    assert a != b
    got = {r.doc_id: r.decoded_sha256 for r in bpe.encode_decode(spark.createDataFrame([(1, a), (2, b)], DOCS), RANKS).collect()}
    assert got == {1: hashlib.sha256(a.encode()).hexdigest(), 2: hashlib.sha256(b.encode()).hexdigest()}
    raw = a.encode() + b.encode()
    hashes, _ = lm.words(np.frombuffer(raw, np.uint8), np.array([0, len(a), len(raw)]))
    assert hashes[0] != hashes[1]


def test_repacking(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(rng.integers(1, 1024, 3000))]
    items = spark.createDataFrame(rows, packing.PIECES)
    got = packing.pack(items, per_task=300).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024
    whole = packing.best_fit(np.array([r[3] for r in rows]))[2]
    assert len(fill) <= 1.02 * len(whole)
    assert packing.lower_bound(np.array([600, 600, 600])) == 3 and packing.lower_bound(np.array([], int)) == 0


# 7


def brute_groups(rows, percent, words):
    def shingles(t):
        w = WORD.findall(lower(t))
        return frozenset([tuple(w)] if 0 < len(w) < words else (tuple(w[i : i + words]) for i in range(len(w) - words + 1)))

    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index, common = {}, Counter()
    for d, s in sets.items():
        for g in s:
            common.update((o, d) for o in index.get(g, ()))
            index.setdefault(g, []).append(d)
    for (a, b), k in common.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted([(d, len(s), find(d)) for d, s in sets.items()], key=str)


@pytest.mark.parametrize(("percent", "words", "block"), [(90, 3, 4_000_000), (80, 5, 300)])
def test_jaccard(spark, sf, monkeypatch, percent, words, block):
    monkeypatch.setattr(jaccard, "BLOCK_ELEMENTS", block)
    rng = random.Random(6)
    base = [rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randint(0, 50)) for _ in range(80)]
    rows = rows_of(sf, "documents", "doc_id, text")
    rows += [(10_000 + i, " ".join(w if rng.random() > 0.02 else "new%d" % i for w in base)) for i in range(40)]
    rows += [(20_001, None), (20_002, ""), (20_003, " \t"), (20_004, "a"), (20_005, "A"), (20_006, "a b"), (20_007, "A  B"), (20_008, "a b c")]
    got = jaccard.components(spark.createDataFrame(rows, DOCS).withColumn("n", F.lit(0)), percent, words)
    assert sorted_rows(got) == brute_groups(rows, percent, words)
    few = jaccard.components(spark.createDataFrame([(9, "a"), (9, "a"), (None, "a b c")], DOCS))
    assert sorted_rows(few) == [(9, 1, 9), (9, 1, 9), (None, 1, None)]
    assert jaccard.components(spark.createDataFrame([], DOCS)).count() == 0


def test_frequency_table_is_sent_small(spark, sf):
    sent = pickle.dumps(jaccard.frequency_table(spark.read.parquet(f"{sf}/documents.parquet"), 3))
    table, counts = pickle.loads(sent), Counter()
    for _, t in rows_of(sf, "documents", "doc_id, text"):
        hashes, _ = jaccard.shingles(*text_bytes(pa.array([t], pa.string())), 3)
        counts.update((hashes & np.uint64(len(table) - 1)).tolist())
    want = np.zeros(len(table), np.uint8)
    for slot, n in counts.items():
        want[slot] = min(255, 8 * np.log2(1.0 + n))
    assert np.array_equal(table, want) and len(sent) < 0.8 * len(want)


def test_jaccard_leaves_little_on_the_driver(spark, sf):
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    used = lambda: (runtime.totalMemory() - runtime.freeMemory()) / 1e6
    found = jaccard.components(spark.read.parquet(f"{sf}/documents.parquet"), 80, 5)
    left = used()
    jvm.System.gc()
    assert left - used() < 30 and found.count()


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = dict(sorted_rows(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100}


# 8


def test_pii(spark):
    text = "é mail a@b.c_d@e.f x@y. 1.2.3.4.5.6.7.8 999.1.1.1 x 4111 1111 1111 1111 x 4111111111111112 x +49 (30) 123-4567 +1 2 iban DE89 3704 0044 0532 0130 00 end"
    rows = [(1, text), (2, None), (3, ""), (4, "a@b.c" * 2000), (5, "1" * 100_000), (5, "a" * 100_000)]
    found = pii.find(spark.createDataFrame(rows, DOCS).withColumn("pii", F.lit(1)))
    got = [r for r in found.collect() if r.doc_id == 1][0]
    spans = [(s.kind, text[s.start : s.end]) for s in got.pii]
    assert spans == [("email", "a@b.c"), ("email", "_d@e.f"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 123-4567"), ("iban", "DE89 3704 0044 0532 0130 00")]
    assert all(0 < s.score <= 1 for s in got.pii)
    d = {r.doc_id: r for r in pii.digest(found).where("doc_id in (2, 3)").collect()}
    assert d[2].base_sha256 == hashlib.sha256(b"").hexdigest() and d[3].spans == ""
    clean = [r.text for r in pii.redact(found).where("doc_id = 1").collect()][0]
    assert "<EMAIL>" in clean and "4111 1111" not in clean and clean.startswith("é mail <EMAIL><EMAIL> x@y.")
    assert pii.find(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted_rows(queries.QUERIES[name](spark, sf).select(*names)) == sorted(want.fetchall(), key=str)


# 9


def test_lm(spark, sf):
    rows = rows_of(sf, "documents", "doc_id, text")
    got = {r.doc_id: r for r in lm.score_texts(spark.read.parquet(f"{sf}/documents.parquet"), RANKS).collect()}
    count, words = Counter(), {}
    for d, t in rows:
        words[d] = [*WORD.findall(lower(t)), None]
        if zlib.crc32(str(d).encode()) % 7 != 2:
            count.update(words[d])
    n, v = sum(count.values()), len(count)
    for d, ws in words.items():
        base = sum(np.log10((count[w] + 1) / (n + v + 1)) for w in ws)
        assert got[d].base_score == pytest.approx(base, rel=1e-9)
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
    few = lm.score_texts(spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "a a")], DOCS), RANKS).collect()
    assert len(few) == 4 and all(r.score < 0 for r in few)
    assert lm.score_texts(spark.createDataFrame([], DOCS), RANKS).count() == 0


def naive_log(m, ids):
    """Log probability of one text by the model's definition, position by position."""
    p = {x: v.astype(float) for x, v in m.p.items()}
    seq = [m.end, *(int(m.rank[i]) for i in ids)]
    pairs = [((r * 40503 + (seq[i - 1] if i else m.end) * 2654435761) % 2**32) >> 16 for i, r in enumerate(seq)]
    total = 0.0
    for t, target in enumerate([*seq[1:], m.end]):
        k = 0 if t < lm.CONTEXT else -(-(t - lm.CONTEXT + 1) // lm.STRIDE)  # first window that holds t
        span = range(k * lm.STRIDE, t + 1)
        e = p["embed"][seq[t]]
        w = np.array([e @ p["query"] @ (p["embed"][seq[j]] @ p["key"]) / lm.WIDTH**0.5 + p["lag"][t - j, 0] for j in span])
        w = np.exp(w - w.max())
        h = e + p["pair"][pairs[t]] + sum(x * (p["embed"][seq[j]] @ p["value"]) for x, j in zip(w / w.sum(), span, strict=True))
        h = np.append(h, 1)
        top = p["top"] @ h
        c = m.class_of[target]
        total += top[c] - np.log(np.exp(top).sum())
        if target == m.n:
            total += float(m.unseen)
        else:
            inner = p["out"][m.edge[c] : m.edge[c + 1]] @ h
            total += inner[target - m.edge[c]] - np.log(np.exp(inner).sum())
    return total


def random_model(seed=7):
    rng = np.random.default_rng(seed)
    counts = np.zeros(lm.VOCABULARY, int)
    counts[rng.choice(lm.VOCABULARY, 300, replace=False)] = rng.integers(1, 500, 300)
    counts[lm.END] = 20
    m = lm.Attention(counts)
    for x in ("top", "out", "lag"):
        m.p[x] = m.p[x] + rng.standard_normal(m.p[x].shape).astype(np.float32) / 5
    return m, rng, np.flatnonzero(counts)


def test_lm_scores_by_definition():
    m, rng, known = random_model()
    sizes = [0, 1, lm.CONTEXT - 1, lm.CONTEXT, lm.CONTEXT + 1, lm.CONTEXT + lm.STRIDE, 97]
    texts = [np.where(rng.random(n) < 0.9, rng.choice(known, n), rng.integers(0, lm.VOCABULARY, n)) for n in sizes]
    got = m.scores(m.rank[np.concatenate(texts)], np.cumsum([0, *sizes]))
    assert got == pytest.approx([naive_log(m, t) for t in texts], rel=1e-4)
    # each id is scored once, and all ids together have the whole probability
    off = np.cumsum([0, *(n + 1 for n in sizes)])
    start, stop, _, whole = lm.windows(off, lm.CONTEXT, lm.STRIDE)
    scored = np.concatenate([np.arange(a if f else a + lm.CONTEXT - lm.STRIDE, min(b, a + lm.CONTEXT)) for a, b, f in zip(start, stop, whole, strict=True)])
    assert sorted(scored) == list(range(off[-1]))
    h = np.append(rng.standard_normal(lm.WIDTH), 1).astype(np.float32)[None]
    logs = m.softmax(np.repeat(h, m.n + 1, 0), np.arange(m.n + 1, dtype=np.uint16)).astype(float)
    assert np.exp(logs[: m.n]).sum() + (lm.VOCABULARY - m.n) * np.exp(logs[m.n]) == pytest.approx(1, rel=1e-4)


def test_lm_row_sums():
    rng = np.random.default_rng(4)
    rows, values = rng.integers(0, 50, 400).astype(np.uint16), rng.standard_normal((400, lm.WIDTH)).astype(np.float32)
    found, sums, times = lm._row_sums(rows, values)
    assert found.tolist() == np.unique(rows).tolist() and times.tolist() == np.bincount(rows)[found].tolist()
    assert np.allclose(sums, [values[rows == r].sum(0) for r in found], atol=1e-5)


def test_lm_gradient():
    m, rng, known = random_model()
    ids, at = m.rank[rng.choice(known, 90)], np.array([0, 3, 90])
    given, target, pair, off = m.stream(ids, at)
    start, stop, _, _ = lm.windows(off, lm.CONTEXT, lm.CONTEXT)
    weight = np.arange(1, len(start) + 1, dtype=np.float32)

    def loss():
        out = 0.0
        for a, b, w in zip(start, stop, weight, strict=True):
            log, _ = m.gradients(given, target, pair, np.array([a]), np.array([b]))
            out -= w * float(log.astype(float).sum())
        return out

    _, grads = m.gradients(given, target, pair, start, stop, weight)
    for x, (rows, g, _) in grads.items():
        r = int(np.argmax(np.abs(g).max(1)))
        c = int(np.argmax(np.abs(g[r])))
        row = r if rows is None else rows[r]
        old = m.p[x][row, c]
        m.p[x][row, c] = old + 0.01
        up = loss()
        m.p[x][row, c] = old - 0.01
        assert (up - loss()) / 0.02 == pytest.approx(g[r, c], rel=0.03), x
        m.p[x][row, c] = old
    before = m.scores(ids, at).sum()
    for _ in range(20):
        m.step(given, target, pair, start, stop)
    assert m.scores(ids, at).sum() > before


def test_lm_gradient_in_parts_and_of_copies(monkeypatch):
    m, rng, known = random_model()
    ids, at = m.rank[rng.choice(known, 900)], np.array([0, 0, 3, 90, 900])
    given, target, pair, off = m.stream(ids, at)
    start, stop, _, _ = lm.windows(off, lm.CONTEXT, lm.CONTEXT)
    each = rng.integers(1, 4, len(start))
    log, grads = m.gradients(given, target, pair, start, stop, each.astype(np.float32))
    monkeypatch.setattr(lm, "PART", 5)
    monkeypatch.setattr(lm, "ROWS", 32)
    parts, again = m.gradients(given, target, pair, start, stop, each.astype(np.float32))
    _, copies = m.gradients(given, target, pair, np.repeat(start, each), np.repeat(stop, each))
    assert np.allclose(log, parts, atol=1e-4)
    for x, (rows, g, _) in grads.items():
        for other in (again[x], copies[x]):
            assert rows is None or rows.tolist() == other[0].tolist()
            assert np.allclose(g, other[1], atol=1e-3 * np.abs(g).max()), x


def test_lm_softmax_far_out_stays_finite():
    m, rng, _ = random_model()
    h, y = rng.standard_normal((500, lm.WIDTH)).astype(np.float32), rng.integers(0, m.n + 1, 500).astype(np.uint16)
    near = m.softmax(h, y)
    assert np.allclose(near, m.softmax(h, y, True)[0], atol=1e-4)
    logs, _, dh, dtop, dout = m.softmax(h * 1000, y, True)
    assert all(np.isfinite(x).all() for x in (logs, dh, dtop, dout)) and (logs < 1e-3).all()
    assert np.allclose(logs, m.softmax(h * 1000, y), rtol=1e-4, atol=1e-3)


def test_lm_word_pieces_and_lookup(monkeypatch):
    texts = ["", "Ab c", " ", "d" * 300, "", "ab  c e", "f"]
    data, at = text_bytes(pa.array(texts))
    hashes, text = lm.words(data, at)
    assert text.tolist() == [i for i, t in enumerate(texts) for _ in t.split()]
    monkeypatch.setattr(lm, "WORDS", 4)
    pieces, text_of = lm.words(data, at)
    assert pieces.tolist() == hashes.tolist() and text_of.tolist() == text.tolist()
    assert [len(x) for x in lm.words(*text_bytes(pa.array([], pa.string())))] == [0, 0]
    rng = np.random.default_rng(2)
    some = rng.integers(0, 1 << 64, 5000, dtype=np.uint64)
    full = (np.uint64(9) << np.uint64(60)) + np.arange(50, dtype=np.uint64)  # in one bucket
    for known in (some[:0], some[:1], np.concatenate([some[:1000], full, np.array([0, 2**64 - 1], np.uint64)])):
        known = np.unique(known)
        asked = np.concatenate([some, full, known, known + np.uint64(1), np.zeros(1, np.uint64)])
        place, hit = lm.Lookup(known)(asked)
        assert hit.tolist() == np.isin(asked, known).tolist() and (known[place[hit]] == asked[hit]).all()


def test_lm_trains_on_every_training_text_however_partitioned(spark, sf, monkeypatch):
    pairs = bpe.loaded(RANKS)
    firsts = {}  # texts of one id that no other text has
    for i in range(300, 50_000):
        word = pairs.decode(np.array([i]), np.array([0, 1]))[0].tobytes()
        if word.isalpha() and word.isascii() and len(pairs.encode(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0]) == 1:
            firsts[i] = word.decode()
        if len(firsts) == 200:
            break
    counts = np.ones(lm.VOCABULARY, int)
    rows = [(d, -d, np.array([i, i], "<u2").tobytes()) for d, i in enumerate(firsts)]
    texts = spark.createDataFrame(rows, "k1 long, k2 long, ids binary")
    start = lm.Attention(counts)
    start.p["out"] += np.random.default_rng(9).standard_normal(start.p["out"].shape).astype(np.float32) / 10  # at 0 nothing reaches the embeddings
    with monkeypatch.context() as m:
        m.setattr(lm, "SHARD_IDS", 150)  # three shards
        model, again = lm.train(start.copy(), texts, 400), lm.train(start.copy(), texts.repartition(7), 400)
    moved = (model.p["embed"] != start.p["embed"]).any(1)
    assert all(moved[start.rank[i]] for i in firsts)
    assert all(np.array_equal(model.p[x], again.p[x]) for x in model.p)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, many = ({(r.doc_id): r.score for r in lm.score_texts(docs.repartition(n), RANKS).collect()} for n in (1, 32))
    assert one == pytest.approx(many, rel=1e-5)


def test_lm_rows_that_repeat_and_clash(spark):
    text = "the words of this text " * 40
    rows = [(1, text, 5), (1, text, 6), (None, text, 7), (None, None, 8), (None, "", 8), (4, "x" * 70_000, 9)]
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string, score long").withColumn("k1", F.lit("clash")), RANKS).collect()
    assert len(got) == 6 and got[0].train_tokens > 0
    ones = [r.score for r in got if r.doc_id == 1]
    assert len(ones) == 2 and ones[0] == ones[1] and all(np.isfinite(r.score) for r in got)


# 10


def test_toxicity(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, marks = [], []
    for i in range(1200):
        bad = i % 8 == 0
        ws = [word() for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(2, 6) if bad else 0):
            ws.insert(rng.randint(0, len(ws)), rng.choice(["zorgle", "Zorgling.", "blarg"]))
        rows.append((i, " ".join(ws)))
        marks.append((i, int(bad)))
    d = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit(d.where("doc_id < 800"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(d.withColumn("severity", F.lit(0)), model).collect()}
    held = range(800, 1200)
    assert sum(got[i].toxic == (i % 8 == 0) for i in held) >= 396
    assert np.mean([got[i].severity for i in held if i % 8 == 0]) > 0.9
    few = toxicity.score(spark.createDataFrame([(1, None), (1, ""), (None, "zorgle blarg")], DOCS), toxicity.fit(docs.limit(0), labels)).collect()
    assert [r.toxic for r in few] == [False] * 3
    assert (np.diff(model.thresholds) >= 0).all()
