"""Exact best documents of all queries by scans: no pair of query and document leaves its task unless it may be among
the first k.

The words of the queries come to the driver (a row for each query and word) and go to the executors. There, a block of
documents is a matrix of word weights; its product with the queries' matrix holds all scores of the block, and a task
passes on the k best of each query. Vectors are scanned alike. Blocks hold at most CELLS values, queries are taken
BLOCK at a time, so a task's memory hangs on k and the number of queries, not on that of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import score as S

#: Values of a block of scores or weights, and queries scored at once.
CELLS, BLOCK = 1 << 22, 512
#: Rows of a result of queries and ranks that may come to the driver.
LOCAL = 1_000_000


def local(df: DataFrame, rows: int) -> DataFrame:
    """The same rows held by the driver, so that what follows computes them once; more than LOCAL stay a plan."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema) if rows <= LOCAL else df


# --- tokens of a batch ---------------------------------------------------------------------------


def _inner(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of a list array and how many each list has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


class Words:
    """Tokens that are given as arrays of strings."""

    def tokens(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All tokens, and how many each row has."""
        return _inner(column)

    def counted(self, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct tokens, the code of each token, and rows and tokens of each row."""
        flat, n = self.tokens(column)
        coded = flat.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(n)), n), n

    def found(self, column: pa.Array, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the vocabulary and row of each token that it has, and the number of all tokens of each row."""
        flat, n = self.tokens(column)
        at = pc.fill_null(pc.index_in(flat, pa.array(vocabulary, flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        return at[at >= 0], row[at >= 0], n


class LowerTexts(Words):
    """The tokens of text.tokens(), cut from lower-case texts here: as runs of bytes, since no letter of
    a token has more than one. That takes a fraction of the time of the pattern."""

    LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789'", np.uint8))

    def tokens(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column, "").cast(pa.large_string())
        _, offsets, data = column.buffers()
        if not len(column) or data is None:
            return pa.array([], pa.large_string()), np.zeros(len(column), np.int64)
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw, at = np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]
        letter = self.LETTER[raw]
        first, kept = letter.copy(), raw[letter]
        first[1:] &= ~letter[:-1]
        edge = at[:-1][at[:-1] < len(raw)]
        first[edge] = letter[edge]
        place = np.flatnonzero(first)
        starts = np.flatnonzero(first[letter])  # where tokens start among the bytes that are kept
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(kept)).astype(np.int64)), pa.py_buffer(kept))
        return found, np.diff(np.searchsorted(place, at))


class HanGrams:
    """Single Han characters and pairs of neighbours, from texts; those of text.han_grams()."""

    #: Letters whose pairs are looked up in a table; more are sorted.
    FEW = 1000

    def _places(self, letters: np.ndarray) -> tuple[np.ndarray, int]:
        """Place of each distinct letter from 0, -1 for others, and their number; 0 is no letter."""
        used = np.bincount(letters, minlength=1 << 16) > 0
        used[0] = False
        return np.where(used, np.cumsum(used) - 1, -1), int(used.sum())

    def _spot(self, codes: np.ndarray, place: np.ndarray, m: int) -> np.ndarray:
        """Place in a square of m + 1 letters; 0 where a letter has no place."""
        a, b = place[codes >> 16] + 1, place[codes & 0xFFFF] + 1
        return np.where((b == 0) | ((codes >= 1 << 16) & (a == 0)), 0, a * (m + 1) + b)

    def _codes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = ["" if t is None else t for t in column.to_pylist()]
        n = np.array([len(t) for t in texts], np.int64)
        c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        han = (c >= 0x4E00) & (c <= 0x9FFF)
        both = np.full((len(c), 2), -1, np.int64)
        both[han, 0] = c[han]
        pair = np.flatnonzero(han[:-1] & han[1:] & (row[:-1] == row[1:])) if len(c) else np.zeros(0, np.int64)
        both[pair, 1] = (c[pair] << 16) | c[pair + 1]
        codes = both.ravel()
        kept = codes >= 0
        row = np.repeat(row, 2)[kept]
        return codes[kept], row, np.bincount(row, minlength=len(n)).astype(np.int64)

    def counted(self, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        codes, row, n = self._codes(column)
        place, m = self._places(codes[codes < 1 << 16])
        if m > self.FEW:
            distinct, at = np.unique(codes, return_inverse=True)
        else:
            at = self._spot(codes, place, m)
            used = np.bincount(at, minlength=(m + 1) ** 2) > 0
            letters = np.flatnonzero(place >= 0)
            distinct = ((np.concatenate([[0], letters])[:, None] << 16) | np.concatenate([[0], letters])[None, :]).ravel()[used]
            at = (np.cumsum(used) - 1)[at]
        return pa.array([chr(c) if c < 1 << 16 else chr(c >> 16) + chr(c & 0xFFFF) for c in distinct.tolist()], pa.string()), at, row, n

    def found(self, column: pa.Array, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, row, n = self._codes(column)
        known = np.array([ord(w) if len(w) == 1 else (ord(w[0]) << 16) | ord(w[1]) for w in vocabulary], np.int64)
        place, m = self._places(np.concatenate([known & 0xFFFF, known >> 16]))
        if m <= self.FEW:
            table = np.full((m + 1) ** 2, -1, np.int64)
            table[self._spot(known, place, m)] = np.arange(len(known))
            table[0] = -1
            at = table[self._spot(codes, place, m)]
            return at[at >= 0], row[at >= 0], n
        order = np.argsort(known)
        spot = np.minimum(np.searchsorted(known[order], codes), len(known) - 1)
        hit = known[order][spot] == codes
        return order[spot[hit]], row[hit], n


def _nested(rows: DataFrame, tokens: str, reader) -> bool:
    kind = rows.schema[tokens].dataType
    return kind.typeName() == "array" and (isinstance(reader, LowerTexts) or not isinstance(reader, Words) or kind.elementType.typeName() == "array")


def _small(batches: Iterator[pa.RecordBatch], tokens: str, reader) -> Iterator[pa.RecordBatch]:
    """Batches of texts cut to about CELLS bytes, so that a gram array stays small; arrays of words as they are."""
    for batch in batches:
        start, column = 0, batch.column(batch.schema.get_field_index(tokens))
        if not isinstance(reader, HanGrams):
            yield batch
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + CELLS, "right")))
            yield batch.slice(start, end - start)
            start = end


def counts(rows: DataFrame, tokens: str, reader, only: list[str] | None = None) -> DataFrame:
    """(token, df, cf) by batches, to be summed; the row of token null has the number of rows and of all
    tokens. With `only` other tokens are left out. Where tokens are nested one level more, parts count as rows."""
    nested = _nested(rows, tokens, reader)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, tokens, reader):
            column = _inner(batch.column(0))[0] if nested else batch.column(0)
            if only is None:
                words, at, row, n = reader.counted(column)
            else:
                words = pa.array(only, pa.string())
                at, row, n = reader.found(column, only) if only else (np.zeros(0, np.int64), np.zeros(0, np.int64), reader.counted(column)[3])
            size = max(len(words), 1)
            cf = np.bincount(at, minlength=size)
            if size <= 1 << 12:  # rows by words in blocks; else sorted
                df = np.zeros(size, np.int64)
                for start in range(0, len(n), CELLS // size):
                    a, b = np.searchsorted(row, [start, start + CELLS // size])
                    seen = np.bincount((row[a:b] - start) * size + at[a:b], minlength=size * min(CELLS // size, len(n) - start))
                    df += np.count_nonzero(seen.reshape(-1, size), axis=0)
            else:
                keys = np.sort(row * size + at)
                df = np.bincount(keys[np.concatenate([[True], keys[1:] != keys[:-1]])] % size, minlength=size)
            used = np.flatnonzero(df)
            names = words.cast(pa.string()).take(pa.array(used))
            yield pa.record_batch([pa.concat_arrays([names, pa.nulls(1, pa.string())]), pa.array([*df[used], len(n)], pa.int64()), pa.array([*cf[used], int(n.sum())], pa.int64())], ["token", "df", "cf"])

    return rows.select(tokens).mapInArrow(run, "token string, df long, cf long")


# --- the best of each query ----------------------------------------------------------------------


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x)


class Best:
    """The first k of each of n queries by rounded score, ties to the smaller key; rows come in blocks."""

    def __init__(self, n: int, k: int, digits: int, ascending: bool = False):
        self.n, self.k, self.digits, self.sign = n, k, digits, -1.0 if ascending else 1.0
        self.floor = np.full(n, -np.inf)
        self.held: list[np.ndarray] | None = None

    def add(self, scores: np.ndarray, keys: list[np.ndarray], first: int = 0) -> None:
        """scores: rows by queries (those from number `first` on), NaN where there is no pair."""
        scores = self.sign * scores
        floor = self.floor[first : first + scores.shape[1]]
        slack = 0.6 * 10.0**-self.digits
        hit = scores >= floor
        if len(scores) > 8 * self.k and np.count_nonzero(hit) > 8 * self.k * scores.shape[1]:
            top = np.partition(np.where(hit, scores, -np.inf), len(scores) - self.k, axis=0)[len(scores) - self.k]
            hit &= scores >= top - 2 * slack
        row, query = np.nonzero(hit)
        if not len(row):
            return
        new = [query + first, rounded(scores[row, query], self.digits), scores[row, query], *[k[row] for k in keys]]
        held = new if self.held is None else [np.concatenate(x) for x in zip(self.held, new, strict=True)]
        order = np.lexsort([*reversed(held[3:]), -held[1], held[0]])
        query = held[0][order]
        rank = np.arange(len(order)) - np.searchsorted(query, np.arange(self.n))[query]
        self.held = [x[order[rank < self.k]] for x in held]
        last = rank == self.k - 1
        self.floor[query[last]] = held[1][order[last]] - slack

    def rows(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Number of the query, score, keys."""
        return (self.held[0], self.sign * self.held[2], self.held[3:]) if self.held else (np.zeros(0, np.int64), np.zeros(0), [])


def _keys(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    """Key columns as arrays that sort; those that are no whole numbers as objects."""
    got = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return [c.to_numpy(zero_copy_only=False) if pa.types.is_integer(c.type) and not c.null_count else np.array(c.to_pylist(), object) for c in got]


def _found_schema(rows: DataFrame, names: list[str]) -> StructType:
    return StructType([StructField("_q", IntegerType()), *[rows.schema[n] for n in names], StructField("score", DoubleType())])


def _found(query: np.ndarray, score: np.ndarray, keys: list[np.ndarray], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(query, pa.int32()), *[pa.array(k, t) for k, t in zip(keys, types, strict=True)], pa.array(score, pa.float64())], ["_q", *names, "score"])


def number(queries: list, schema) -> tuple[Callable[[DataFrame], DataFrame], dict]:
    """The number of each query, and a function that gives rows with `_q` their query_id."""
    at = {q: i for i, q in enumerate(dict.fromkeys(queries))}
    fields = StructType([StructField("_q", IntegerType()), StructField("query_id", schema)])

    def named(found: DataFrame) -> DataFrame:
        ids = found.sparkSession.createDataFrame([(i, q) for q, i in at.items()], fields)
        return found.join(F.broadcast(ids), "_q").drop("_q")

    return named, at


# --- lexical scores ------------------------------------------------------------------------------


@dataclass
class Model:
    """One lexical score: `share` of the whole, `kind`, a factor for each word of the vocabulary, and what the kind needs."""

    kind: str
    factor: np.ndarray
    share: float = 1.0
    k1: float = S.K1
    b: float = S.B
    avgdl: float = 0.0
    p: np.ndarray | None = None
    smoothing: float = 0.5

    def weights(self, tf: np.ndarray, dl: np.ndarray, word: np.ndarray) -> np.ndarray:
        if self.kind == "bm25":
            return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / self.avgdl))
        if self.kind == "tfidf":
            return tf / dl
        return np.log(1 + (1 - self.smoothing) * tf / dl / (self.smoothing * self.p[word]))


@dataclass
class Terms:
    """Words of the queries: vocabulary, and query, word and count of each pair."""

    vocabulary: list[str]
    query: np.ndarray
    word: np.ndarray
    qtf: np.ndarray
    n: int
    blocks: list = field(default_factory=list)

    def kept(self, known: np.ndarray) -> Terms:
        """Only the words marked."""
        place = np.cumsum(known) - 1
        on = known[self.word]
        return Terms([w for w, k in zip(self.vocabulary, known, strict=True) if k], self.query[on], place[self.word[on]], self.qtf[on], self.n)

    def matrices(self, models: list[Model]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray | None]]:
        """For each BLOCK of queries: the first one, its words, a matrix of words and queries for each
        model, and that of ones where a score may be 0 or less though words are shared."""
        positive = all((m.factor > 0).all() for m in models)
        for first in range(0, self.n, BLOCK):
            on = (self.query >= first) & (self.query < first + BLOCK)
            words, at = np.unique(self.word[on], return_inverse=True)
            shape = (len(words), min(BLOCK, self.n - first))
            made = []
            for m in models:
                x = np.zeros(shape)
                x[at, self.query[on] - first] = m.share * self.qtf[on] * m.factor[self.word[on]]
                made.append(x)
            ones = None
            if not positive:
                ones = np.zeros(shape, np.float32)
                ones[at, self.query[on] - first] = 1
            yield first, words, made, ones


class Scorer:
    """Scores of a batch's rows by all queries, block by block."""

    def __init__(self, terms: Terms, models: list[Model], reader):
        self.terms, self.models, self.reader = terms, models, reader
        made = terms.matrices(models)
        self.held = list(made) if terms.n <= BLOCK else None

    def __call__(self, column: pa.Array, edges: np.ndarray | None = None) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(first row, end, first query, scores), NaN where no word is shared. With edges, the first row of each
        group and the end, a block has whole groups."""
        v = len(self.terms.vocabulary)
        at, row, dl = self.reader.found(column, self.terms.vocabulary)
        most = max(1, CELLS // max(v, min(BLOCK, self.terms.n)))
        start = 0
        while start < len(dl):
            end = min(len(dl), start + most)
            if edges is not None and end < len(dl):
                end = int(edges[max(np.searchsorted(edges, end, "right") - 1, np.searchsorted(edges, start, "right"))])
            a, b = np.searchsorted(row, [start, end])
            tf = np.bincount((row[a:b] - start) * v + at[a:b], minlength=(end - start) * v)
            spot = np.flatnonzero(tf)
            word, each = spot % v, spot // v
            weights = []
            for m in self.models:
                w = np.zeros((end - start) * v)
                w[spot] = m.weights(tf[spot].astype(float), dl[start:end][each].astype(float), word)
                weights.append(w.reshape(end - start, v))
            for first, words, made, ones in self.held if self.held is not None else self.terms.matrices(self.models):
                part = slice(None) if len(words) == v else words
                scores = sum(w[:, part] @ x for w, x in zip(weights, made, strict=True))
                shared = scores > 0 if ones is None else (tf.reshape(end - start, v)[:, part] > 0).astype(np.float32) @ ones > 0
                yield start, end, first, np.where(shared, scores, np.nan)
            start = end


def lexical(rows: DataFrame, tokens: str, keys: list[str], terms: Terms, models: list[Model], reader, k: int | None, digits: int = 6) -> DataFrame:
    """(_q, keys, score): the k best of each task for each query, or without k all pairs that share a word.

    Where tokens are nested one level more, a row is scored by its best part."""
    nested = _nested(rows, tokens, reader)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, best, kinds = Scorer(terms, models, reader), None, None
        if k:
            best = Best(terms.n, k, digits)
        for batch in _small(batches, tokens, reader):
            column = batch.column(batch.schema.get_field_index(tokens))
            ids = _keys(batch, keys)
            kinds = [batch.schema.field(n).type for n in keys]
            edges = None
            if nested:
                column, n = _inner(column)
                ids = [x[n > 0] for x in ids]
                edges = np.concatenate([[0], np.cumsum(n[n > 0])])
            for start, end, first, scores in scorer(column, edges):
                own = slice(start, end)
                if nested:
                    own = slice(*np.searchsorted(edges, [start, end]))
                    none = np.where(np.isnan(scores), -np.inf, scores)
                    scores = np.maximum.reduceat(none, edges[own] - start, axis=0)
                    scores = np.where(np.isinf(scores), np.nan, scores)
                if best:
                    best.add(scores, [x[own] for x in ids], first)
                else:
                    row, query = np.nonzero(~np.isnan(scores))
                    yield _found(query + first, scores[row, query], [x[own][row] for x in ids], keys, kinds)
        if best and best.held:
            query, score, held = best.rows()
            yield _found(query, score, held, keys, kinds)

    return rows.select(*keys, tokens).mapInArrow(run, _found_schema(rows, keys))


# --- passages ------------------------------------------------------------------------------------

#: Neighbouring words by which a passage is looked for.
SHINGLE = 4


def _shingles(at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each SHINGLE neighbours of a group that have a place, and where they start."""
    last = len(at) - SHINGLE + 1
    if last <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ok = group[:last] == group[SHINGLE - 1 :]
    key = np.zeros(last, np.uint64)
    for i in range(SHINGLE):
        ok &= at[i : i + last] >= 0
        key = key * np.uint64(0x9E3779B97F4A7C15) + at[i : i + last].astype(np.uint64)
    start = np.flatnonzero(ok)
    return key[start], start


def containing(rows: DataFrame, passages: list[tuple[int, str, list[str]]]) -> DataFrame:
    """(_q, doc_id) of the rows (doc_id, text, _t: in lower case) whose text contains a passage (number, text, inner words).

    A passage's words but the first and last are whole words of each text around it, so its first SHINGLE
    inner words stand there one after the other; texts that have them are searched for the passage."""
    vocabulary = sorted({w for _, _, inner in passages for w in inner[:SHINGLE]})
    at = {w: i for i, w in enumerate(vocabulary)}
    keys, _ = _shingles(np.array([at[w] for _, _, inner in passages for w in inner[:SHINGLE]], np.int64), np.repeat(np.arange(len(passages)), SHINGLE))
    order = np.argsort(keys, kind="stable")
    known, asked = keys[order], [passages[i] for i in order]
    kinds = StructType([StructField("_q", IntegerType()), rows.schema["doc_id"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(vocabulary, pa.string())
        for batch in batches:
            ids, texts, tokens = (batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "text", "_t"))
            flat, n = LowerTexts().tokens(tokens)
            row = np.repeat(np.arange(len(n)), n)
            key, start = _shingles(pc.fill_null(pc.index_in(flat, words.cast(flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64), row)
            a, b = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
            hit = np.flatnonzero(b > a)
            maybe = {(int(row[start[i]]), j) for i in hit for j in range(a[i], b[i])}
            found = sorted((r, asked[j][0]) for r, j in maybe if asked[j][1] in (texts[r].as_py() or ""))
            yield pa.record_batch([pa.array([q for _, q in found], pa.int32()), ids.take(pa.array([r for r, _ in found], pa.int64()))], ["_q", "doc_id"])

    return rows.select("doc_id", "text", "_t").mapInArrow(run, kinds)


# --- vectors -------------------------------------------------------------------------------------


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat, _ = _inner(column)
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def vector_scores(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Rows by queries: cosine (0 where it is no number), or distance; the latter is exact to about 1e-7 only."""
    with np.errstate(all="ignore"):
        product = v @ q.T
        a, b = np.einsum("ij,ij->i", v, v), np.einsum("ij,ij->i", q, q)
        if metric == "l2":
            return np.sqrt(np.maximum(a[:, None] + b[None, :] - 2 * product, 0))
        n = np.sqrt(a)[:, None] * np.sqrt(b)[None, :]
        return np.nan_to_num(np.where(n > 1e-9, product / n, 0.0), nan=0.0, posinf=np.inf, neginf=-np.inf)


class Near(Best):
    """The same for distances: candidates by the product, then their distances by differences."""

    def __init__(self, n: int, k: int, digits: int, queries: np.ndarray):
        super().__init__(n, k, digits, True)
        self.queries = queries

    def take(self, v: np.ndarray, keys: list[np.ndarray], first: int, q: np.ndarray) -> None:
        near = vector_scores(v, q, "l2")
        # squares are off by a few units of the last place of their sum, at most so much of the distance
        off = 1e-7 * np.sqrt(1 + np.einsum("ij,ij->i", v, v))[:, None] + 1e-7 * np.sqrt(np.einsum("ij,ij->i", q, q))[None, :]
        hit = -near >= self.floor[None, first : first + len(q)] - off
        if len(v) > 8 * self.k and np.count_nonzero(hit) > 8 * self.k * len(q):
            top = np.partition(near + off, self.k - 1, axis=0)[self.k - 1]
            hit &= near - off <= top + 10.0**-self.digits
        row, query = np.nonzero(hit)
        out = np.full(near.shape, np.nan)
        for a in range(0, len(row), CELLS // v.shape[1]):
            r, c = row[a : a + CELLS // v.shape[1]], query[a : a + CELLS // v.shape[1]]
            d = v[r] - q[c]
            out[r, c] = np.sqrt(np.einsum("ij,ij->i", d, d))
        self.add(out, keys, first)


def dense(rows: DataFrame, vector: str, keys: list[str], queries: np.ndarray, k: int, metric: str = "cosine", digits: int = 6) -> DataFrame:
    """(_q, keys, score): the k best of each task by a flat scan of vectors that are all of the queries' length."""
    dim = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Near(len(queries), k, digits, queries) if metric == "l2" else Best(len(queries), k, digits)
        kinds = None
        for batch in batches:
            ids, kinds = _keys(batch, keys), [batch.schema.field(n).type for n in keys]
            v = _matrix(batch.column(batch.schema.get_field_index(vector)), dim)
            most = max(1, CELLS // min(len(queries), 8 * BLOCK))
            for a in range(0, len(v), most):
                part = [x[a : a + most] for x in ids]
                for first in range(0, len(queries), 8 * BLOCK):
                    q = queries[first : first + 8 * BLOCK]
                    if metric == "l2":
                        best.take(v[a : a + most], part, first, q)
                    else:
                        best.add(vector_scores(v[a : a + most], q, metric), part, first)
        if best.held:
            query, score, held = best.rows()
            yield _found(query, score, held, keys, kinds)

    return rows.select(*keys, vector).mapInArrow(run, _found_schema(rows, keys))


def regular(v: Column, dim: int) -> Column:
    """Whether a vector has so many values, all of them finite."""
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def hybrid(rows: DataFrame, terms: Terms, models: list[Model], reader, queries: np.ndarray, weight: float, k: int, ranges: np.ndarray | None = None, digits: int = 6) -> DataFrame:
    """Min-max fusion of lexical scores (0 where no word is shared) and cosines of rows (doc_id, _t, v).

    Without ranges: (_q, s_low, s_high, d_low, d_high) of each task; a row of _q -1 if a vector is missing or not of the
    queries' length. With them (the same columns by query): (_q, doc_id, score), the k best of each task."""
    dim = queries.shape[1]

    def scores(batch: pa.RecordBatch, scorer: Scorer):
        v = _matrix(batch.column(batch.schema.get_field_index("v")), dim)
        for start, end, first, sparse in scorer(batch.column(batch.schema.get_field_index("_t"))):
            yield start, end, first, np.nan_to_num(sparse, nan=0.0), vector_scores(v[start:end], queries[first : first + sparse.shape[1]], "cosine")

    def fits(column: pa.Array) -> bool:
        flat, n = _inner(column)
        return bool((n == dim).all()) and not column.null_count and not flat.null_count and bool(np.isfinite(flat.to_numpy(zero_copy_only=False)).all())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, low, high = Scorer(terms, models, reader), np.full((2, terms.n), np.inf), np.full((2, terms.n), -np.inf)
        for batch in batches:
            if not fits(batch.column(batch.schema.get_field_index("v"))):
                yield pa.record_batch([pa.array([-1], pa.int32()), *[pa.array([0.0])] * 4], names)
                return
            for _, _, first, *both in scores(batch, scorer):
                for i, x in enumerate(both):
                    part = slice(first, first + x.shape[1])
                    low[i, part], high[i, part] = np.minimum(low[i, part], x.min(axis=0)), np.maximum(high[i, part], x.max(axis=0))
        on = np.flatnonzero(np.isfinite(low[0]))
        yield pa.record_batch([pa.array(on, pa.int32()), *[pa.array(x[i][on]) for i in (0, 1) for x in (low, high)]], names)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, best, kind = Scorer(terms, models, reader), Best(terms.n, k, digits), None
        for batch in batches:
            ids, kind = _keys(batch, ["doc_id"]), batch.schema.field("doc_id").type
            for start, end, first, *both in scores(batch, scorer):
                sums = 0.0
                for i, (x, share) in enumerate(zip(both, (1 - weight, weight), strict=True)):
                    low, high = ranges[2 * i : 2 * i + 2, first : first + x.shape[1]]
                    span = np.where(high == low, 1.0, high - low)
                    sums = sums + share * np.where(high == low, x, (x - low) / span)
                best.add(sums, [ids[0][start:end]], first)
        if best.held:
            query, score, held = best.rows()
            yield _found(query, score, held, ["doc_id"], [kind])

    names = ["_q", "s_low", "s_high", "d_low", "d_high"]
    rows = rows.select("doc_id", "_t", "v")
    if ranges is None:
        return rows.mapInArrow(measure, "_q int, s_low double, s_high double, d_low double, d_high double")
    return rows.mapInArrow(choose, _found_schema(rows, ["doc_id"]))
