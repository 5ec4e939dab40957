"""Best-fit-decreasing packing of token sequences, certified by dual-feasible functions.

Pieces are dealt over partitions and packed there by best-fit decreasing. Lower bounds from
dual-feasible functions certify each partition's bin count; partitions that may have a bin too
many give the documents of their unfilled bins to a common pool, which is dealt again over fewer
partitions and repacked, in ROUNDS rounds at most: each leaves about one unfilled bin in a partition
of PER_TASK pieces, so what a further round could save is less than a bin in thousands.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, cut, text_bytes
from .bpe import BLOCK, BytePairs, loaded

CAPACITY, END = 1024, 2
#: The vocabulary's added token, which the library finds in any text, and its id.
ADDED, ADDED_ID = "<|endoftext|>", 50256
#: Pieces that one task packs.
PER_TASK = 40_000
ROUNDS = 3
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _ids(pairs: BytePairs, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text and their offsets; the added token's string is one id, what is between is encoded apart."""
    if not pc.any(pc.match_substring(column, ADDED)).as_py():
        return pairs.encode(*text_bytes(column))
    parts, first = [], []
    for text in column.to_pylist():
        first.append(len(parts))
        parts += (text or "").split(ADDED)
    ids, at = pairs.encode(*text_bytes(pa.array(parts, pa.string())))
    added = np.ones(len(parts), bool)  # before each part but a text's first
    added[first] = False
    before = np.concatenate([[0], np.cumsum(added)])
    rows = np.array([*first, len(parts)])
    return np.insert(ids, at[:-1][added], ADDED_ID), at[rows] + before[rows]


def pieces(docs: DataFrame, ranks_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Each document's ids and `end`, cut into pieces of `capacity` ids, the first maybe shorter.

    In: doc_id, text; other columns are not read. Null or empty texts have the id `end` alone;
    repeated rows stay, no rows give no rows. The ids are those of the `tokenizers` library for the
    same vocabulary, which takes the string of the added token as that token.
    """

    def run(batches):
        pairs = loaded(ranks_path)
        for block in blocks(batches, BLOCK):
            ids, at = _ids(pairs, block.column(1))
            raw = ids.astype("<u4").tobytes()
            tail = np.array([end], "<u4").tobytes()
            out: list[tuple] = []
            for doc, a, b in zip(block.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                whole = raw[4 * a : 4 * b] + tail
                n = b - a + 1
                first = n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                out += [(doc, i, s, e - s, zlib.crc32(whole[4 * s : 4 * e])) for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            cols = list(zip(*out, strict=True))
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length by best-fit decreasing, and the fill of each bin."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    stacks: dict[int, list[int]] = {}  # free room: bins that have it
    rooms: list[int] = []  # sorted rooms with a bin
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = stacks[room].pop()
            if not stacks[room]:
                del rooms[at]
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        left = room - n
        if left:
            if not stacks.get(left):
                insort(rooms, left)
                stacks[left] = []
            stacks[left].append(b)
    return bins, offsets, np.array(fills, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, by dual-feasible functions over all thresholds.

    The functions are the identity; the threshold functions of Martello and Toth, which count a
    piece above capacity - e as a whole bin and leave out pieces below e; and the rounding
    functions of Fekete and Schepers, u_k(x) = x where (k+1)x is a multiple of the capacity, else
    floor((k+1)x / capacity) / k.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    for e in range(1, capacity // 2 + 1):
        f = np.where(x > capacity - e, capacity, np.where(x >= e, x, 0))
        best = max(best, -(-int((count * f).sum()) // capacity))
    for k in range(1, 20):
        whole = ((k + 1) * x) % capacity == 0
        f = np.where(whole, x * k, capacity * (((k + 1) * x) // capacity))  # times k * capacity
        best = max(best, -(-int((count * f).sum()) // (k * capacity)))
    return best


PACKED = f"{PIECES}, part int, bin long, offset long, fill long, bins long, bound long"


def _pack_part(table: pa.Table) -> pa.Table:
    lengths = table.column("length").to_numpy()
    bins, offsets, fills = best_fit(lengths)
    n = table.num_rows
    more = {"bin": bins, "offset": offsets, "fill": fills[bins], "bins": np.full(n, len(fills)), "bound": np.full(n, lower_bound(lengths))}
    for name, values in more.items():
        table = table.append_column(name, pa.array(values, pa.int64()))
    return table


def _deal(items: DataFrame, parts: int, seed: int) -> DataFrame:
    """Deal pieces over parts by a hash of the whole row and a salt for repeated rows."""
    return items.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(parts)).cast("int"))


def pack(items: DataFrame, rounds: int = ROUNDS, per_task: int = PER_TASK) -> DataFrame:
    """sequence_id and offset for each piece (columns of PIECES): gapless, at most CAPACITY a sequence.

    Pieces of full length have a sequence each. Only counts by partition come to the driver. Empty
    input gives no rows; repeated rows are packed as often as they stand there.
    """
    full = items.where(F.col("length") == CAPACITY).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest, done = items.where(F.col("length") < CAPACITY), []
    for step in range(rounds + 1):
        n = rest.count()
        if not n:
            break
        parts = max(1, -(-n // per_task))
        packed = cut(_deal(rest, parts, step).groupBy("part").applyInArrow(_pack_part, PACKED), "pack")
        base = F.lit(step).cast("long") * (1 << 58) + F.col("part").cast("long") * (1 << 32)
        result = packed.withColumn("sequence_id", base + F.col("bin"))
        # a partition whose count meets its bound is done; others keep their filled bins and pool the rest
        gap = packed.where("bins > bound").select("part").distinct().count()
        if step == rounds or parts == 1 or gap <= 1:
            done.append(result)
            break
        kept = (F.col("bins") <= F.col("bound")) | (F.col("fill") == CAPACITY)
        done.append(result.where(kept))
        rest = packed.where(~kept).select(*items.columns)
    columns = [*items.columns, "sequence_id", "offset"]
    out = full.select(*columns)
    for part in done:
        out = out.unionByName(part.select(*columns))
    return out


def pack_documents(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Pieces of all documents with sequence_id and offset."""
    return pack(cut(pieces(docs, ranks_path), "pieces"))
