"""Toxicity: cumulative-link ordinal regression on sparse text features.

Features: presence of each word (a run of letters, A-Z lower-cased; bytes from 0x80 on count as
letters) and of its first 4 and first 5 bytes, as 64-bit hashes. One weight vector is shared by
all ordered thresholds: P(grade >= k) = sigmoid(w.x - t_k). Grades come from the labels: 0 for a
row that is not toxic; toxic rows are cut at the median of their evidence (the score of a first,
two-grade fit) into 1 and 2, so these two grade the evidence, not a label. The output is the expected grade, the sum of P(grade >= k).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .arrays import BYTE_VALUES, blocks, mix, prefix_sums, release_driver, slice_hashes, text_bytes

#: Labelled rows that the classifier is fitted on at most, taken by a hash of their id.
TRAINING_ROWS = 6_000
#: Texts that a feature stands in at least to be fitted.
LEAST_TEXTS = 4
PREFIXES = (4, 5)


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every feature occurrence in texts end to end."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = letter.copy()
    start[1:] &= ~letter[:-1] | edge[1:-1]
    end = letter.copy()
    end[:-1] &= ~letter[1:] | edge[1:-1]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    sums = prefix_sums(BYTE_VALUES[low])
    text = np.searchsorted(at, first, side="right") - 1
    found, of = [slice_hashes(sums, first, last)], [text]
    for n in PREFIXES:
        longer = last - first > n
        found.append(mix(slice_hashes(sums, first[longer], first[longer] + n) + np.uint64(n)))
        of.append(text[longer])
    return np.concatenate(found), np.concatenate(of)


@dataclass
class Ordinal:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self):
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def evidence(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        hashes, text = features(data, at)
        maybe = self.gate[(hashes & np.uint64(0xFFFF)).astype(np.int64)]
        hashes, text = hashes[maybe], text[maybe]
        slot = np.searchsorted(self.keys, hashes)
        slot[slot == len(self.keys)] = 0
        real = self.keys[slot] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        pairs = np.unique(text[real] * np.int64(len(self.keys) or 1) + slot[real])
        n = len(self.keys) or 1
        return np.bincount(pairs // n, weights=self.weights[pairs % n] if len(pairs) else None, minlength=len(at) - 1).astype(float)

    def at_least(self, evidence: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(-np.clip(evidence[:, None] - self.thresholds, -60, 60)))


def _fit(rows: np.ndarray, cols: np.ndarray, n_rows: int, n_cols: int, grade: np.ndarray, steps: int = 300, ridge: float = 1e-4, lasso: float = 2e-4):
    """Adam on the likelihood of grades 0..K; a soft threshold after each step keeps weights sparse."""
    top = int(grade.max())
    w, t = np.zeros(n_cols), np.linspace(1.0, 2.0, top)
    params = np.concatenate([w, t])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, t = params[:n_cols], params[n_cols:]
        s = np.bincount(rows, weights=w[cols], minlength=n_rows)
        f = 1 / (1 + np.exp(-np.clip(s[:, None] - t, -40, 40)))
        f = np.concatenate([np.ones((n_rows, 1)), f, np.zeros((n_rows, 1))], axis=1)
        here, above = f[np.arange(n_rows), grade], f[np.arange(n_rows), grade + 1]
        ds = 1 - here - above  # of the log likelihood by the score
        gap = np.maximum(here - above, 1e-9)
        dt = np.zeros(top)
        for k in range(1, top + 1):
            slope = f[:, k] * (1 - f[:, k])
            dt[k - 1] = np.sum(np.where(grade == k - 1, slope / gap, 0)) - np.sum(np.where(grade == k, slope / gap, 0))
        g = -np.concatenate([np.bincount(cols, weights=ds[rows], minlength=n_cols), dt]) / n_rows
        g[:n_cols] += ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        params = params - rate
        params[:n_cols] = np.sign(params[:n_cols]) * np.maximum(np.abs(params[:n_cols]) - lasso, 0)
        params[n_cols:] = np.sort(params[n_cols:])
    return params[:n_cols], params[n_cols:]


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> Ordinal:
    """The classifier from at most `most` labelled rows; texts alike count once.

    Rows without id, label or text take no part. With no toxic or no clean row the classifier
    calls nothing toxic.
    """
    spark = docs.sparkSession
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    none = Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.array([40.0, 80.0]))
    if not chosen:
        return none
    picked = F.broadcast(spark.createDataFrame([(r[0], r[1]) for r in chosen], "doc_id long, toxic int"))
    rows = docs.select("doc_id", "text").where("text is not null").join(picked, "doc_id").select("text", "toxic")

    def extract(batches):
        for block in blocks(batches, 1 << 19):
            data, at = text_bytes(block.column(0))
            hashes, text = features(data, at)
            order = np.lexsort((hashes, text))
            hashes, text = hashes[order], text[order]
            keep = np.ones(len(hashes), bool)
            keep[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
            hashes, text = hashes[keep], text[keep]
            ends = np.searchsorted(text, np.arange(block.num_rows + 1))
            yield pa.record_batch([pa.array([hashes[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), block.column(1)], names=["features", "toxic"])

    table = rows.mapInArrow(extract, "features binary, toxic int").toArrow()
    seen: dict[bytes, int] = {}
    for x, y in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
        seen[x] = max(seen.get(x, 0), y)
    del table
    release_driver(spark)
    toxic = np.array([1 if y else 0 for y in seen.values()])
    if not len(toxic) or toxic.min() == toxic.max():
        return none
    least = min(LEAST_TEXTS, max(1, len(toxic) // 20))
    # features in too few texts go before any array of all of them is sorted
    slot = lambda x: (np.frombuffer(x, np.uint64) >> np.uint64(42)).astype(np.int64)
    often = np.zeros(1 << 22, np.int32)
    for x in seen:
        np.add.at(often, slot(x), 1)
    sets = [np.frombuffer(x, np.uint64)[often[slot(x)] >= least] for x in seen]
    n_texts = len(sets)
    del seen, often
    row = np.repeat(np.arange(n_texts, dtype=np.int32), [len(x) for x in sets])
    keys, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    del sets
    in_toxic = np.bincount(col, weights=toxic[row], minlength=len(keys))
    share = toxic.mean()
    tells = (in_toxic - count * share) / np.sqrt(count * share * (1 - share) + 1)
    kept = np.flatnonzero((count >= least) & (np.abs(tells) >= 3))
    if not len(kept):
        return none
    place = np.full(len(keys), -1)
    place[kept] = np.arange(len(kept))
    used = place[col] >= 0
    row, col = row[used], place[col[used]]
    w, t = _fit(row, col, n_texts, len(kept), toxic)
    evidence = np.bincount(row, weights=w[col], minlength=n_texts)
    middle = np.median(evidence[toxic == 1])
    grade = np.where(toxic == 0, 0, np.where(evidence > middle, 2, 1))
    if len(np.unique(grade)) == 3:
        w, t = _fit(row, col, n_texts, len(kept), grade)
    live = w != 0
    release_driver(spark)
    return Ordinal(keys[kept][live], w[live], t)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """All columns of docs, then severity (expected grade) and toxic (P(grade >= 1) of one half or more).

    In: text; other columns pass through, save `severity` and `toxic`, which are replaced. A null
    or empty text has no features and the severity of the thresholds alone.
    """
    docs = docs.drop("severity", "toxic")
    spot = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for block in blocks(batches, 1 << 19):
            data, at = text_bytes(block.column(spot))
            p = sent.value.at_least(sent.value.evidence(data, at))
            yield pa.record_batch([*block.columns, pa.array(p.sum(axis=1), pa.float64()), pa.array(p[:, 0] >= 0.5, pa.bool_())], names=[*block.schema.names, "severity", "toxic"])

    schema = StructType([*docs.schema.fields, StructField("severity", DoubleType()), StructField("toxic", BooleanType())])
    return docs.mapInArrow(run, schema)
