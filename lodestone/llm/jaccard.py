"""N-gram Jaccard join with rare-first prefixes (Xiao et al. 2008), grouped into components.

1. Document frequencies of all shingles over all documents, in a table whose slots follow the
   number of words, up to MOST_SLOTS. Any total order of shingles gives right prefixes; the table
   makes it rare-first, as a slot that few shingles fall in tells how rare they are.
2. Equal sets collapse to one node.
3. Nodes that share a prefix shingle, with sizes in reach of each other, get a common candidate
   component: the nodes of a shingle are chained to a leader by size, never paired.
4. The prefixes of a candidate component meet (in pairs of blocks, if it is large): sets that have
   too few prefix shingles in common can't be linked, which leaves small components.
5. The whole sets of these meet likewise, where a local prefix join with size, positional and
   suffix filters verifies each pair at most once and passes over pairs that are connected already.
   No link between components can be missed.
6. The links' components are the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import blocks, cut, drop_table, mix, partitions, release_driver, text_bytes, word_hashes, word_spans
from .components import connected_components

#: Least similarity in percent; words of a shingle.
PERCENT, WORDS = 90, 3
#: Slots of the frequency table at least and at most (a byte each when sent), chunks that it is summed in.
LEAST_SLOTS, MOST_SLOTS, CHUNKS = 1 << 16, 1 << 25, 64
#: Bits of the filter on texts.
FILTER_BITS = 1 << 23
#: Set elements that one task compares at most, before a component is cut into blocks; how many of
#: them a prefix element, which is kept in a dictionary, counts for.
BLOCK_ELEMENTS, PREFIX_WEIGHT = 3_000_000, 5


def shingles(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, text by text, and the offset of each text's first."""
    n_texts = len(at) - 1
    low, first, last, text = word_spans(data, at)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    hashes = word_hashes(low, first, last)
    count = np.bincount(text, minlength=n_texts)
    found, of = [], []
    if len(hashes) >= words:
        joined = hashes[: len(hashes) - words + 1].copy()
        for i in range(1, words):
            joined = joined * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - words + 1 + i]
        same = text[: len(joined)] == text[words - 1 :]
        found.append(mix(joined[same]))
        of.append(text[: len(joined)][same])
    begin = np.cumsum(count) - count
    for size in range(1, words):  # fewer words: the whole sequence
        short = np.flatnonzero(count == size)
        if len(short):
            joined = hashes[begin[short]].copy()
            for i in range(1, size):
                joined = joined * np.uint64(0x9E3779B97F4A7C15) + hashes[begin[short] + i]
            found.append(mix(joined + np.uint64(size)))
            of.append(short)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    hashes, text = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[keep], text[keep]
    return hashes, np.searchsorted(text, np.arange(n_texts + 1))


def ordered_keys(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Keys whose order is the global one: by frequency class, then by hash (of which 55 bits stay)."""
    rank = table[(hashes & np.uint64(len(table) - 1)).astype(np.int64)].astype(np.uint64)
    return (rank << np.uint64(55)) | (hashes >> np.uint64(9))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n) // 100 + 1


class Frequencies:
    """Frequency classes of the slots in compressed pieces, which the driver passes on as they came;
    where it is unpickled, it is the table."""

    def __init__(self, pieces: list[bytes], per: int):
        self.pieces, self.per = pieces, per

    def __reduce__(self):
        return expand, (self.pieces, self.per)


def expand(pieces: list[bytes], per: int) -> np.ndarray:
    """The table of these pieces; an empty piece has no shingles."""
    table = np.zeros(len(pieces) * per, np.uint8)
    for i, x in enumerate(pieces):
        if x:
            table[i * per : (i + 1) * per] = np.frombuffer(pa.Codec("zstd").decompress(x, per), np.uint8)
    return table


def frequency_table(docs: DataFrame, words: int = WORDS) -> Frequencies:
    """Frequency classes (8 a doubling, as bytes) of the slots, from all shingles of all documents."""
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    slots = LEAST_SLOTS
    while slots < MOST_SLOTS and slots < size // 4:
        slots *= 2
    per = slots // CHUNKS

    def count(batches):
        """Slots that a task has met and how often, each chunk packed as gaps and counts."""

        def packed(found):
            slot, n = np.unique(np.concatenate(found), return_counts=True)
            edges = np.searchsorted(slot, np.arange(CHUNKS + 1) * per)
            pieces = []
            for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                gap = np.diff(slot[a:b].astype(np.int64), prepend=i * per)
                steps = gap // 255  # a gap is as many bytes of 255 as it takes, of count 0, and the rest
                ends = np.cumsum(steps + 1) - 1
                gaps, counts = np.full(int(steps.sum()) + b - a, 255, np.uint8), np.zeros(int(steps.sum()) + b - a, np.uint16)
                gaps[ends], counts[ends] = gap % 255, np.minimum(n[a:b], 0xFFFF)
                pieces.append(gaps.tobytes() + counts.tobytes())
            return pa.record_batch([pa.array(range(CHUNKS), pa.int32()), pa.array(pieces, pa.binary())], names=["chunk", "counts"])

        found, held = [], 0
        for block in blocks(batches, 1 << 19):
            hashes, _ = shingles(*text_bytes(block.column(0)), words)
            found.append((hashes & np.uint64(slots - 1)).astype(np.uint32))
            held += len(hashes)
            if held > 3_000_000:
                yield packed(found)
                found, held = [], 0
        if held:
            yield packed(found)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Frequency classes of one chunk, summed batch by batch."""
        total, chunk = np.zeros(per, np.uint64), None
        for table in batches:
            for c, x in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
                chunk, n = c, len(x) // 3
                at = np.cumsum(np.frombuffer(x, np.uint8, n), dtype=np.int64)
                count = np.frombuffer(x[n:], np.uint16)
                total[at[count > 0]] += count[count > 0]
        classes = np.minimum(255, 8 * np.log2(1.0 + total)).astype(np.uint8)
        yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([pa.Codec("zstd", 3).compress(classes, asbytes=True)], pa.binary())], names=["chunk", "classes"])

    # a chunk is a fixed share of the table, whatever the input; its parts are added as they come
    found = docs.select("text").mapInArrow(count, "chunk int, counts binary")
    pieces = [b""] * CHUNKS
    for r in found.groupBy("chunk").applyInArrow(add, "chunk int, classes binary").collect():
        pieces[r["chunk"]] = bytes(r["classes"])
    return Frequencies(pieces, per)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _need(nx: int, ny: int, percent: int) -> int:
    """Least intersection of linked sets of these sizes."""
    return -(-percent * (nx + ny) // (100 + percent))


def _may_link(a: np.ndarray, last_a: int, rest_a: int, b: np.ndarray, last_b: int, rest_b: int, need: int) -> bool:
    """Whether two sets may be linked, by the shared shingles of their prefixes, the prefixes' last
    shingles and what follows them: of the set whose prefix ends first, all common shingles stand in
    the prefixes or in the rest of the set."""
    return _common(a, b) + (rest_a if last_a <= last_b else rest_b) >= need


def _link(sx: np.ndarray, sy: np.ndarray, px: int, py: int, percent: int) -> bool:
    """Whether two whole sets, whose first common shingle is at px and py at the latest, are linked."""
    nx, ny = len(sx), len(sy)
    need = _need(nx, ny, percent)
    if min(nx - px, ny - py) < need:
        return False  # position
    middle = px + (nx - px) // 2
    split = int(np.searchsorted(sy, sx[middle]))
    if abs((middle - px) - (split - py)) + abs((nx - middle) - (ny - split)) > nx + ny - 2 * need:
        return False  # the suffixes, cut at one shingle, differ too much in size
    common = _common(sx, sy)
    return 100 * common >= percent * (nx + ny - common)


def _solve(nodes, prefixes, sizes, linked, sides, percent: int, cross: bool):
    """Links that join the members of one candidate component (in cross mode: of its two blocks).

    Members come in order of size. Postings of a shingle are kept by component, so that members
    which are connected already are passed over together; linked(x, y, px, py) is asked once a pair.
    prefixes has (position, shingle) of the shingles that more than one member has.
    """
    root_of = list(range(len(nodes)))

    def find(i: int) -> int:
        while root_of[i] != i:
            root_of[i] = root_of[root_of[i]]
            i = root_of[i]
        return i

    links = []
    postings: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for x in sorted(range(len(nodes)), key=lambda i: (sizes[i], nodes[i])):
        prefix = list(zip(*(a.tolist() for a in prefixes[x]), strict=True))
        roots: dict[int, None] = {}
        for _, key in prefix:
            lists = postings.get(key)
            if lists:
                for r in list(lists):
                    now = find(r)
                    if now != r:  # merged since: one list for each component
                        lists.setdefault(now, []).extend(lists.pop(r))
                    roots[now] = None
        mine = find(x)
        for r in roots:
            if find(r) == mine:
                continue
            asked = set()
            for px, key in prefix:
                for y, py in reversed(postings.get(key, {}).get(r, ())):
                    if y in asked or cross and sides[x] == sides[y]:
                        continue
                    asked.add(y)
                    if 100 * sizes[y] >= percent * sizes[x] and linked(x, y, px, py):
                        links.append((nodes[x], nodes[y]))
                        root_of[find(y)] = mine
                        break
                else:
                    continue
                break
        here = find(x)
        for px, key in prefix:
            postings.setdefault(key, {}).setdefault(here, []).append((x, px))
    return links


def _shared(prefixes: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and values of the shingles of each prefix that another prefix has too."""
    if not prefixes:
        return []
    _, inverse, count = np.unique(np.concatenate(prefixes), return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    out, at = [], 0
    for p in prefixes:
        spots = np.flatnonzero(twice[at : at + len(p)])
        out.append((spots, p[spots]))
        at += len(p)
    return out


def _in_blocks(members, weight: str):
    """Rows of candidate components (root, node, weight of the component, ...) dealt to pairs of blocks.

    A component up to BLOCK_ELEMENTS is one block; a larger one is cut by a hash and every pair of
    its blocks meets, so that no task gets more and no pair is left out.
    """
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    out = members.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col(weight) / BLOCK_ELEMENTS).cast("int"))).withColumn("own", own)
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return out.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("parts", "other", weight)


def _dealt(members: DataFrame, weight: str, columns: list[str]):
    """The rows by (root, i, j), over tasks of their own: small tables are not drawn together."""
    rows = _in_blocks(members, weight).select("root", "i", "j", *columns)
    return rows.repartition(partitions(members.sparkSession), "root", "i", "j").groupBy("root", "i", "j")


def components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of each row.

    In: doc_id, text; other columns are not read. Null, empty or blank texts have the empty set and
    are linked with nothing: their component is their own id. A null doc_id has no component (null)
    and links nothing, but its row stays. Rows are nodes by their sets, so rows of equal id and
    text are one, and rows that repeat an id with another text are judged by their own texts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    table = spark.sparkContext.broadcast(frequency_table(docs, words))  # MOST_SLOTS bytes at most, before compression
    release_driver(spark)

    def describe(batches):
        for block in blocks(batches, 1 << 19):
            hashes, at = shingles(*text_bytes(block.column(1)), words)
            keys = ordered_keys(hashes, table.value)
            signs, prefixes = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                signs.append(hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest())
                p = prefix_length(b - a, percent) if b > a else 0
                own = keys[a:b]
                prefixes.append(np.partition(own, p - 1)[:p].astype(np.int64) if 0 < p < b - a else own.astype(np.int64))
            sizes = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(prefixes) if prefixes else [], pa.int64()))
            first, second = (pa.array([int.from_bytes(x[i : i + 8], "little", signed=True) for x in signs], pa.int64()) for i in (0, 8))
            yield pa.record_batch([block.column(0), block.column(2), pa.array(np.diff(at), pa.int64()), first, second, lists], names=["doc_id", "hash", "n", "node", "more", "prefix"])

    rows = cut(docs.mapInArrow(describe, "doc_id long, hash long, n long, node long, more long, prefix array<long>"), "rows")
    # a set is known by 128 bits; its first 64 name the node
    nodes = cut(rows.where("n > 0 and doc_id is not null").groupBy("node", "more").agg(F.min("doc_id").alias("first"), F.min("hash").alias("hash"), F.max("n").alias("n"), F.first("prefix").alias("prefix")), "nodes")

    by_size = Window.partitionBy("key").orderBy("n", "node")
    members = nodes.select("node", "n", F.explode("prefix").alias("key"))
    far = F.lag("n").over(by_size)
    runs = members.withColumn("opens", far.isNull() | (far * 100 < F.col("n") * percent)).withColumn("alone", far.isNull() & F.lead("n").over(by_size).isNull())
    leader = F.last(F.when(F.col("opens"), F.col("node")), ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, 0))
    # shingles that stand in one prefix alone can't join anything
    runs = cut(runs.withColumn("leader", leader).where("not alone").select("node", "key", "leader"), "runs")
    edges = runs.select(F.col("node").alias("a"), F.col("leader").alias("b")).where("a <> b")
    shared = runs.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("shared"))
    about = nodes.select("node", "n", F.array_max("prefix").alias("last"), (F.col("n") - F.size("prefix")).alias("rest"))
    joined = connected_components(edges, "shared")
    roots = cut(joined.join(shared, "node").join(about, "node"), "roots")
    release_driver(spark)
    weights = roots.groupBy("root").agg((F.sum(F.size("shared")) * PREFIX_WEIGHT).alias("weight"))

    def refine(table: pa.Table) -> pa.Table:
        """Links between sets that may be linked by their prefixes."""
        ids, own, n, last, rest = (table.column(c).to_pylist() for c in ("node", "own", "n", "last", "rest"))
        keys = [np.asarray(x.values) for x in table.column("shared").combine_chunks()]
        cross = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        linked = lambda x, y, px, py: _may_link(keys[x], last[x], rest[x], keys[y], last[y], rest[y], _need(n[x], n[y], percent))
        links = _solve(ids, _shared(keys), n, linked, own, percent, cross)
        return pa.table([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    close = _dealt(roots.join(weights, "root"), "weight", ["own", "node", "n", "last", "rest", "shared"]).applyInArrow(refine, "a long, b long")
    near = connected_components(close, "candidates")
    candidates = near.join(nodes.select("node", "n", "hash"), "node")
    weights = candidates.groupBy("root").agg(F.sum("n").alias("weight"))
    candidates = cut(candidates.select("node", "hash", "root").join(weights, "root"), "candidates")
    drop_table(runs, joined, roots, near)
    release_driver(spark)

    # a filter of fixed size on the texts' hashes spares most sets the shuffle
    bit = F.pmod("hash", F.lit(FILTER_BITS))
    words_of = candidates.select(bit.alias("bit")).select(F.expr("cast(bit div 64 as int)").alias("i"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("bits")).groupBy("i").agg(F.bit_or("bits").alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words_of:
        bits[r["i"]] = r["bits"]
    wanted = spark.sparkContext.broadcast(bits)

    def full_sets(batches):
        """Sets of the texts that may be candidates; of equal texts of a task, the first."""
        sent: set[int] = set()
        for block in blocks(batches, 1 << 19):
            bit = np.asarray(block.column(1)) % FILTER_BITS
            hit = ((wanted.value[bit // 64] >> (bit % 64)) & 1).astype(bool)
            for i in np.flatnonzero(hit).tolist():
                h = block.column(1)[i].as_py()
                hit[i] = h not in sent
                sent.add(h)
            block = block.filter(pa.array(hit))
            if block.num_rows:
                hashes, at = shingles(*text_bytes(block.column(0)), words)
                keys = ordered_keys(hashes, table.value)
                packed = [np.sort(keys[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.record_batch([block.column(1), pa.array(packed, pa.binary())], names=["hash", "keys"])

    texts = docs.where("doc_id is not null and text is not null").select("text", "hash")
    sets = texts.mapInArrow(full_sets, "hash long, keys binary").join(candidates, "hash")

    def solve(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_pylist()
        once = list({x: i for i, x in enumerate(ids)}.values())  # a text may come from several tasks
        table = table.take(pa.array(once))
        ids, own = table.column("node").to_pylist(), table.column("own").to_pylist()
        members = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
        sizes = [len(m) for m in members]
        prefixes = _shared([m[: prefix_length(len(m), percent)] for m in members])
        cross = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        linked = lambda x, y, px, py: _link(members[x], members[y], px, py, percent)
        links = _solve(ids, prefixes, sizes, linked, own, percent, cross)
        return pa.table([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    links = _dealt(sets, "weight", ["own", "node", "keys"]).applyInArrow(solve, "a long, b long")
    found = connected_components(links, "components")
    table.destroy()
    wanted.destroy()
    release_driver(spark)
    named = nodes.select("node", "more", "first").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    group = named.join(least, "root").select("node", "more", "component_id")
    out = rows.select("doc_id", "n", "node", "more").join(group, ["node", "more"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    result = cut(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")), "grouped")
    drop_table(rows, nodes, candidates, found)
    release_driver(spark)
    return result
