"""Winnowing (Schleimer, Wilkerson and Aiken 2003) of whole texts and of each text's successor.

Rolling hashes of K code points; of every WINDOW neighbouring hashes the smallest is chosen, the
rightmost where equal; positions are kept. So any passage of K + WINDOW - 1 code points that two
texts share leaves a common hash in both, and the positions tell where it stands. A text of fewer
than SHORT code points keeps every gram, as a few chosen ones say little of it; two texts of which
one is that short are compared by all grams of both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, mix, partitions, powers, prefix_sums, smallest_places

K, WINDOW, SHORT = 20, 81, 200
#: Bytes of text fingerprinted at once; arrays take about 100 times as much memory.
BLOCK = 1 << 19


def winnow(texts: list[str], k: int = K, window: int = WINDOW, short: int = SHORT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, 40-bit hash, position) of each chosen k-gram, in order: all of a text of fewer
    than `short` code points. A longer text of fewer than `window` k-grams has one window; one
    shorter than k is one gram; an empty one has none."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = prefix_sums(mix(points.astype(np.uint64) + np.uint64(0x51ED270B)))
    n = len(points)
    grams = np.zeros(n, np.uint64)
    if n >= k:
        grams[: n - k + 1] = mix((sums[k:] - sums[:-k]) * powers(n + 1, inverse=True)[: n - k + 1])
    chosen = []
    count = sizes - k + 1
    many = np.flatnonzero((count >= window) & (sizes >= short))
    if len(many):
        low = smallest_places(grams, window)
        # only the windows of grams that lie within one text
        inside = np.zeros(len(low) + 1, np.int64)
        np.add.at(inside, starts[many], 1)
        np.add.at(inside, starts[many] + count[many] - window + 1, -1)
        low = low[np.cumsum(inside[:-1]) > 0]
        keep = np.ones(len(low), bool)
        keep[1:] = low[1:] != low[:-1]
        chosen.append(low[keep])
    whole = np.flatnonzero((count >= 1) & (sizes < short))
    if len(whole):
        owner = np.repeat(whole, count[whole])
        chosen.append(starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count[whole]) - count[whole], count[whole]))
    few = np.flatnonzero((count >= 1) & (count < window) & (sizes >= short))
    if len(few):
        chosen.append(np.array([a + smallest_places(grams[a : a + c], c)[0] for a, c in zip(starts[few].tolist(), count[few].tolist(), strict=True)], np.int64))
    tiny = np.flatnonzero((sizes >= 1) & (count < 1))
    if len(tiny):
        grams[starts[tiny]] = mix((sums[ends[tiny]] - sums[starts[tiny]]) * powers(n + 1, inverse=True)[starts[tiny]])
        chosen.append(starts[tiny])
    at = np.sort(np.concatenate(chosen))
    text = np.searchsorted(ends, at, side="right")
    return text, grams[at] >> np.uint64(24), at - starts[text]


def fingerprints(n: int, text: np.ndarray, value: np.ndarray, at: np.ndarray) -> list[str]:
    """Hex of each chosen hash (5 bytes) and its position (4 bytes), in order."""
    raw = np.zeros((len(value), 9), np.uint8)
    raw[:, :5] = value.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    raw[:, 5:] = at.astype(">u4").view(np.uint8).reshape(-1, 4)
    flat = raw.tobytes().hex()
    edge = np.searchsorted(text, np.arange(n + 1)) * 18
    return [flat[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def likeness(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard likeness of hash sets by row; codes are row << 40 | hash, sorted and distinct."""
    both = np.intersect1d(a, b, assume_unique=True)
    row = lambda x: np.bincount((x >> np.uint64(40)).astype(np.int64), minlength=n)[:n]
    common = row(both)
    union = row(a) + row(b) - common
    return np.where(union == 0, 1.0, common / np.maximum(union, 1))


def _codes(chosen: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    return np.unique((chosen[0].astype(np.uint64) << np.uint64(40)) | chosen[1])


def _compared(texts: list[str], others: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness by row from the codes a and b, but by all grams of both where one text is short."""
    out = likeness(len(texts), a, b)
    # two long texts or two short ones were chosen from alike
    rows = [i for i, (t, o) in enumerate(zip(texts, others, strict=True)) if (len(t) < SHORT) != (len(o) < SHORT)]
    for i in rows:
        every = max(len(texts[i]), len(others[i])) + 1
        out[i] = likeness(1, *(_codes(winnow([x], short=every)) for x in (texts[i], others[i])))[0]
    return out


def _edit(text: str, following: str) -> str:
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], last: str) -> pa.RecordBatch:
    """Results for texts whose successors are the next in the list, and `last` after the last."""
    n = len(texts)
    following = [*texts[1:], last]
    edited = [_edit(t, f) for t, f in zip(texts, following, strict=True)]
    own = winnow([*texts, last])
    new = winnow(edited)
    a, e = _codes(own), _codes(new)
    shifted = a[(a >> np.uint64(40)) > 0] - (np.uint64(1) << np.uint64(40))
    mine = a[(a >> np.uint64(40)) < n]
    return pa.record_batch(
        [
            pa.array(ids, pa.int64()),
            pa.array(map(len, texts), pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
            pa.array(fingerprints(n + 1, *own)[:n]),
            pa.array(fingerprints(n, *new)),
            pa.array(_compared(texts, edited, mine, e)),
            pa.array(_compared(texts, following, mine, shifted)),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def winnow_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, by descending doc_id.

    In: doc_id, text (null: empty). Rows of equal doc_id follow each other by text; null ids come
    last. A single row is its own successor. Rows are dealt to ranges of ids that each hold about
    a partition's share; the first row of a range also goes, as a guest, to the range before it.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = max(1, partitions(spark))
    cuts = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    edges = np.array(sorted({int(c) for c in cuts}), np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(edges, ids[known].to_numpy(np.int64), side="right") + 1
        return pd.Series(out)

    placed = docs.select(bucket(F.col("doc_id")).alias("bucket"), F.lit(False).alias("guest"), "doc_id", "text")
    tops = placed.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()  # one row for each partition
    ranges = sorted((r["bucket"], r["top"]) for r in tops) if tops else []
    ranges.sort(key=lambda r: -r[0])
    before = {b: ranges[i - 1][0] for i, (b, _) in enumerate(ranges)}
    guests = placed.limit(0)
    if ranges:
        to = spark.createDataFrame([(b, t, before[b]) for b, t in ranges], "bucket int, top long, to int")
        ids = [t for _, t in ranges if t is not None]
        wanted = F.col("doc_id").isin(ids) if all(t is not None for _, t in ranges) else F.col("doc_id").isin(ids) | F.col("doc_id").isNull()
        firsts = placed.where(wanted).join(F.broadcast(to), "bucket").where(F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("to").agg(F.min("text").alias("text"))
        guests = firsts.select(F.col("to").alias("bucket"), F.lit(True).alias("guest"), F.lit(None).cast("long").alias("doc_id"), "text")
    dealt = placed.unionByName(guests).repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]):
        ids: list = []
        texts: list[str] = []
        for block in blocks(batches, BLOCK, "text"):
            for guest, doc, text in zip(block.column(1).to_pylist(), block.column(2).to_pylist(), block.column(3).to_pylist(), strict=True):
                if not guest:
                    ids.append(doc)
                    texts.append(text)
                elif texts:
                    yield _rows(ids, texts, text)
                    ids, texts = [], []
            if len(texts) > 1:
                yield _rows(ids[:-1], texts[:-1], texts[-1])
                ids, texts = ids[-1:], texts[-1:]

    return dealt.mapInArrow(run, OUT)
