"""Suffix-array deduplication with a logarithmic family of sorted levels.

Suffixes are sampled at minimisers: of the K-grams in each window of LENGTH bytes the one with the
smallest hash (rightmost, if equal). Equal windows choose the same place, so every repeat of LENGTH
bytes meets at a sampled suffix, while only one suffix in about 85 is kept. A batch's suffix array
holds its sampled suffixes as fingerprints of their first K bytes and of their context, the bytes of
all windows that chose them, sorted by both; the order by fingerprint brings equal prefixes
together just as the lexicographic one does, in 16 bytes a suffix.

SuffixIndex.add() sorts a new batch, merge-scans it against itself and every level for prefixes that
stand in both, which go to a table of matches, and merges levels of equal size, so each suffix is
rewritten a logarithmic number of times. Matches are then settled to the byte, from the matched
prefixes alone: suffixes with equal contexts repeat in all their windows; where a prefix has several
contexts, their windows are compared one by one within the prefix's group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BYTE_VALUES, blocks, cut, drop_table, mix, prefix_sums, slice_hashes, smallest_places, text_bytes

LENGTH, K = 200, 32
#: Batches that one load is cut into; bits of a filter for each of its keys, and bits at least and at most.
BATCHES, BITS_A_KEY, LEAST_BITS, MOST_BITS = 3, 16, 1 << 16, 1 << 27
#: Rows of a settling group on average; contexts of one prefix beyond which its windows are shuffled singly.
GROUP_ROWS, HOT_CONTEXTS = 20_000, 20_000


def sampled(data: np.ndarray, at: np.ndarray, length: int = LENGTH, k: int = K):
    """Sampled suffixes of texts end to end: (text, anchor, first window, last window, key, context hash)."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64), np.zeros(1, np.uint64)
    sums = prefix_sums(BYTE_VALUES[data])
    place = np.arange(n - k + 1)
    grams = slice_hashes(sums, place, place + k)
    anchor = smallest_places(grams, length - k + 1)
    starts = np.arange(len(anchor))
    # windows that stay within one text
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(anchor)]
    good = starts + length <= at[1:][text]
    starts, anchor, text = starts[good], anchor[good], text[good]
    if not len(starts):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64), sums
    opens = np.ones(len(starts), bool)
    opens[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(starts)) - 1
    a, lo, hi = anchor[first], starts[first], starts[last]
    context = slice_hashes(sums, lo, hi + length)
    context = mix(context ^ (((a - lo) << 8) | (a - hi)).astype(np.uint64))
    return text[first], a, lo, hi, grams[a], context, sums


def _identity(docs: DataFrame) -> DataFrame:
    """docs with did and mark, which tell rows apart: the id and a 64-bit hash of the text; for rows
    without an id another hash of the text stands in its place. Equal rows have equal spans."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("did", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(7), text))).withColumn("mark", F.xxhash64(text))


class SuffixIndex:
    """Levels of sorted suffix arrays as tables in the shared folder, and the matches of their scans.

    A level has a row for each (key, context): how many suffixes have it. A level of size class s
    holds 2**s batches; no two levels are of one class.
    """

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []  # (size class, rows), the largest first
        self.found: list[DataFrame] = []  # keys that a scan has met twice

    def add(self, batch: DataFrame) -> None:
        """Sort a batch (text), scan it against itself and the levels, merge equal-sized levels."""

        def entries(batches):
            for block in blocks(batches, 1 << 19):
                _, _, _, _, key, context, _ = sampled(*text_bytes(block.column(0)))
                if len(key):
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(context.view(np.int64))], names=["key", "context"])

        def run(rows: DataFrame) -> DataFrame:
            return cut(rows.groupBy("key", "context").agg(F.sum("n").alias("n")).sortWithinPartitions("key", "context"), "level")

        level = run(batch.select("text").mapInArrow(entries, "key long, context long").withColumn("n", F.lit(1).cast("long")))
        twice = level.groupBy("key").agg(F.min("context").alias("a"), F.max("context").alias("b"), F.sum("n").alias("n")).where("n > 1 or a <> b").select("key")
        for _, older in self.levels:
            twice = twice.unionByName(level.select("key").join(older.select("key"), "key", "left_semi"))
        self.found.append(cut(twice.distinct(), "matches"))
        size = 0
        while self.levels and self.levels[-1][0] == size:
            _, older = self.levels.pop()
            merged = run(older.unionByName(level))
            drop_table(older, level)
            level, size = merged, size + 1
        self.levels.append((size, level))

    def contexts(self) -> DataFrame:
        """(key, context, n) of the matched keys over all levels."""
        keys, rows = self.found[0], self.levels[0][1]
        for more in self.found[1:]:
            keys = keys.unionByName(more)
        for _, more in self.levels[1:]:
            rows = rows.unionByName(more)
        met = rows.join(keys.distinct(), "key", "left_semi")
        return met.groupBy("key", "context").agg(F.sum("n").alias("n"))

    def drop(self) -> None:
        drop_table(*self.found, *(rows for _, rows in self.levels))
        self.levels, self.found = [], []


def _filter(keys: DataFrame, n: int) -> np.ndarray:
    """Bits of the n keys, by their number up to MOST_BITS; keys that share a bit only send more rows on."""
    size = LEAST_BITS
    while size < MOST_BITS and size < BITS_A_KEY * n:
        size *= 2
    bit = F.pmod("key", F.lit(size))
    words = keys.select(bit.alias("bit")).select(F.expr("cast(bit div 64 as int)").alias("i"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("bits")).groupBy("i").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words.column("i").to_numpy()] = words.column("bits").to_numpy()
    return out


def _has(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    bit = (key & np.uint64(64 * len(bits) - 1)).astype(np.int64)
    return ((bits[bit >> 6] >> (bit & 63)) & 1).astype(bool)


def _settle(table: pa.Table) -> pa.Table:
    """Repeated spans of suffixes that are alone with their context, by the windows of whole keys.

    One row for each (key, context): how many suffixes have it (n), the bytes, and one suffix's place.
    """
    key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    raw = table.column("bytes").combine_chunks()
    there = raw.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero((count[inverse] > 1) & there)
    cols = [np.zeros(0, np.int64)] * 4
    if len(rows):
        did, mark, lo, windows = (table.column(c).to_numpy()[rows] for c in ("did", "mark", "lo", "windows"))
        data = np.frombuffer(b"".join(raw.take(pa.array(rows)).to_pylist()), np.uint8)
        sizes = windows + LENGTH - 1
        base = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(rows)), windows)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = base[owner] + step
        hashes = slice_hashes(prefix_sums(BYTE_VALUES[data]), start, start + LENGTH)
        _, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
        hit = np.flatnonzero((times[back] > 1) & (n[rows][owner] == 1))
        if len(hit):
            cuts = np.ones(len(hit), bool)
            cuts[1:] = (owner[hit][1:] != owner[hit][:-1]) | (step[hit][1:] != step[hit][:-1] + 1)
            first = np.flatnonzero(cuts)
            last = np.append(first[1:], len(hit)) - 1
            row = owner[hit[first]]
            cols = [did[row], mark[row], lo[row] + step[hit[first]], lo[row] + step[hit[last]] + LENGTH]
    return pa.table([pa.array(x, pa.int64()) for x in cols], names=["did", "mark", "start", "end"])


SPANS = "did long, mark long, start long, end long"


def repeated_spans(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(did, mark, start, end) of byte spans covered by a LENGTH-byte string that starts elsewhere too."""
    spark = docs.sparkSession
    rows = _identity(docs).select("did", "mark", F.coalesce("text", F.lit("")).alias("text"))
    index = SuffixIndex()
    for i in range(batches):
        index.add(rows.where(F.pmod(F.xxhash64("did", "mark"), F.lit(batches)) == i))
    contexts = cut(index.contexts(), "contexts")
    index.drop()
    found = cut(contexts.groupBy("key").agg(F.count("*").alias("contexts")).where("contexts > 1"), "mixed")
    whole = cut(contexts.where("n > 1").select("key", "context"), "whole")
    drop_table(contexts)
    n, total, most = found.agg(F.count("*"), F.coalesce(F.sum("contexts"), F.lit(0)), F.coalesce(F.max("contexts"), F.lit(0))).first()
    sent = []

    def send(bits: np.ndarray):
        sent.append(spark.sparkContext.broadcast(bits))
        return sent[-1]

    full = send(_filter(whole.select(F.col("context").alias("key")), whole.count()))

    # suffixes whose context stands in two places: all their windows are repeated. A context with very
    # many copies is a skewed side of an equality join, which Spark splits.
    def repeated(batches):
        for block in blocks(batches, 1 << 19):
            data, at = text_bytes(block.column(2))
            text, _, lo, hi, key, context, _ = sampled(data, at)
            keep = np.flatnonzero(_has(full.value, context))
            if len(keep):
                text, lo, hi = text[keep], lo[keep], hi[keep]
                did, mark = np.asarray(block.column(0))[text], np.asarray(block.column(1))[text]
                start = lo - at[text]
                yield pa.record_batch([pa.array(x) for x in (key[keep].view(np.int64), context[keep].view(np.int64), did, mark, start, start + (hi - lo) + LENGTH)], names=["key", "context", "did", "mark", "start", "end"])

    spans = rows.mapInArrow(repeated, f"key long, context long, {SPANS}").join(whole, ["key", "context"], "left_semi").select("did", "mark", "start", "end")
    mixed = send(_filter(found, n))
    many = found.where(f"contexts > {HOT_CONTEXTS}")
    hot = send(_filter(many, many.count())) if most > HOT_CONTEXTS else None

    def suffixes(batches):
        """Suffixes whose key may have several contexts; the first with a context in a task has its bytes."""
        given: set[int] = set()
        for block in blocks(batches, 1 << 19):
            data, at = text_bytes(block.column(2))
            text, _, lo, hi, key, context, _ = sampled(data, at)
            keep = _has(mixed.value, key)
            if hot is not None:
                keep &= ~_has(hot.value, key)
            keep = np.flatnonzero(keep)
            if not len(keep):
                continue
            text, lo, hi, key, context = (x[keep] for x in (text, lo, hi, key, context))
            raw = data.tobytes()
            parts = []
            for c, a, b in zip(context.tolist(), lo.tolist(), hi.tolist(), strict=True):
                parts.append(None if c in given else raw[a : b + LENGTH])
                given.add(c)
            if len(given) > 200_000:
                given.clear()
            did, mark = np.asarray(block.column(0))[text], np.asarray(block.column(1))[text]
            yield pa.record_batch(
                [pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), pa.array(did), pa.array(mark), pa.array(lo - at[text]), pa.array(hi - lo + 1), pa.array(parts, pa.binary())],
                names=["key", "context", "did", "mark", "lo", "windows", "bytes"],
            )

    schema = "key long, context long, did long, mark long, lo long, windows long, bytes binary"
    groups = max(1, -(-total // GROUP_ROWS))
    # copies of a context are counted before the shuffle, so a key's group has its contexts, not its copies
    once = rows.mapInArrow(suffixes, schema).groupBy("key", "context").agg(F.count("*").alias("n"), F.first("did").alias("did"), F.first("mark").alias("mark"), F.first("lo").alias("lo"), F.first("windows").alias("windows"), F.first("bytes", True).alias("bytes"))
    spans = spans.unionByName(once.groupBy(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("grp")).applyInArrow(_settle, SPANS))
    if hot is not None:

        def single(batches):
            """Every window of the suffixes with a hot key, by the hash of its bytes."""
            for block in blocks(batches, 1 << 19):
                data, at = text_bytes(block.column(2))
                text, _, lo, hi, key, _, sums = sampled(data, at)
                keep = np.flatnonzero(_has(hot.value, key))
                if len(keep):
                    text, lo, n = text[keep], lo[keep], (hi - lo + 1)[keep]
                    owner = np.repeat(np.arange(len(keep)), n)
                    start = lo[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                    window = slice_hashes(sums, start, start + LENGTH)
                    did, mark = np.asarray(block.column(0))[text[owner]], np.asarray(block.column(1))[text[owner]]
                    yield pa.record_batch([pa.array(window.view(np.int64)), pa.array(did), pa.array(mark), pa.array(start - at[text[owner]])], names=["window", "did", "mark", "start"])

        every = rows.mapInArrow(single, "window long, did long, mark long, start long")
        twice = every.groupBy("window").count().where("count > 1").select("window")
        more = every.join(twice, "window", "left_semi").select("did", "mark", "start", (F.col("start") + LENGTH).alias("end"))
        spans = spans.unionByName(more)
    done = cut(spans, "spans")
    for x in sent:
        x.destroy()
    drop_table(found, whole)
    return done


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All columns of docs, with text cut, and n_bytes, n_removed, n_spans, kept_sha256, kept (bytes).

    In: doc_id, text; columns of those names, did, mark, starts and ends are replaced. A null text
    counts as empty (its row keeps the null). Texts of fewer than LENGTH bytes keep everything.
    Rows that repeat an id, or have none, are judged by their own texts; no rows give no rows.
    What is cut may split a character: `kept` has the very bytes, `text` them without broken ones.
    """
    new = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "did", "mark", "starts", "ends")
    docs = docs.drop(*new)
    spans = repeated_spans(docs).groupBy("did", "mark").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    joined = _identity(docs).join(spans, ["did", "mark"], "left").drop("did", "mark")
    spot = joined.columns.index("text")
    width, names = len(docs.columns), [*docs.columns, *new[:5]]

    def apply(batches):
        for block in blocks(batches, 2 << 20):
            data, at = text_bytes(block.column(spot))
            whole = data.tobytes()
            null = block.column(spot).is_null().to_pylist()
            texts, stats, kept_bytes = [], [], []
            for i, (starts, ends) in enumerate(zip(block.column(width).to_pylist(), block.column(width + 1).to_pylist(), strict=True)):
                raw = whole[at[i] : at[i + 1]]
                kept, runs, pos = [], 0, 0
                for s, e in sorted(zip(starts or (), ends or (), strict=True)):
                    if s > pos or not runs:
                        kept.append(raw[pos:s])
                        runs += 1
                    pos = max(pos, e)
                kept.append(raw[pos:])
                left = b"".join(kept)
                texts.append(None if null[i] else left.decode("utf-8", "ignore") if runs else raw.decode("utf-8", "surrogatepass"))
                stats.append((len(raw), len(raw) - len(left), runs, hashlib.sha256(left).hexdigest()))
                kept_bytes.append(left)
            columns = [pa.array(texts, pa.string()) if j == spot else block.column(j) for j in range(width)]
            a, b, c, d = zip(*stats, strict=True)
            yield pa.record_batch([*columns, pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d), pa.array(kept_bytes, pa.binary())], names=names)

    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

    fields = [*docs.schema.fields, *(StructField(x, LongType()) for x in new[:3]), StructField("kept_sha256", StringType()), StructField("kept", BinaryType())]
    return joined.mapInArrow(apply, StructType(fields))
