"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each leaf of the tree stands for a byte position and holds the rank of the pair that starts there;
the root holds the smallest rank, leftmost position first. A merge changes three leaves (the merged
pair, its left neighbour, the position that dies), each a logarithmic point update, so a match of
n bytes costs O(n log n) whatever its content. Matches of up to 256 bytes are encoded many at a
time, one tree per row of an array; longer ones one by one. Each distinct match of a block of
texts (told apart by a 64-bit hash, of the bytes themselves where they are many) is encoded once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens
from .arrays import BYTE_VALUES, blocks, hex_digest, prefix_sums, slice_keys, text_bytes

_NONE = np.int64(1) << np.int64(50)
_BATCHED = 256
#: Text that is encoded at once; arrays take about 60 times as much memory.
BLOCK = 2 << 20
#: Distinct matches that a worker remembers from earlier blocks, at about 40 bytes each.
REMEMBERED = 600_000


class BytePairs:
    """Ranks of all pairs of known tokens, and the trees that merge them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        words = [b""] * (max(ranks.values()) + 1)
        self.pair: dict[tuple[int, int], int] = {}
        for word, rank in ranks.items():
            words[rank] = word
            for i in range(1, len(word)):
                left, right = ranks.get(word[:i]), ranks.get(word[i:])
                if left is not None and right is not None:
                    self.pair[left, right] = rank
        codes = np.array([(a << 20) | b for a, b in self.pair], dtype=np.int64)
        order = np.argsort(codes)
        self.codes = np.append(codes[order], _NONE)
        self.code_ranks = np.append(np.fromiter(self.pair.values(), np.int64, len(self.pair))[order], _NONE)
        self.byte_pairs = np.full(1 << 16, -1, np.int32)
        for i in range(256):
            for j in range(256):
                self.byte_pairs[i * 256 + j] = ranks.get(bytes([i, j]), -1)
        self.word_bytes = np.frombuffer(b"".join(words), np.uint8)
        self.word_at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        self._forget()

    def _forget(self) -> None:
        """Matches of earlier blocks: sorted hashes, where their ids are, and the ids."""
        self.known, self.known_at, self.known_count, self.known_ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = (left << np.int64(20)) | right
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = len(self.codes) - 1
        return np.where((self.codes[at] == code) & (left >= 0) & (right >= 0), self.code_ranks[at], _NONE)

    def merge_rows(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and how many each has. raw: bytes, padded to a power of two.

        Arrays are flat: row r has its links at r * (size + 1) and its tree at r * 2 * size.
        Column `size` of the links stands for "no neighbour".
        """
        n, size = raw.shape
        wide, none = size + 1, np.int32(2**31 - 1)
        ids = np.full((n, wide), -1, np.int64)
        ids[:, :size] = np.where(np.arange(size) < lengths[:, None], self.byte_ids[raw], -1)
        after = np.tile(np.minimum(np.arange(1, size + 2), size).astype(np.int32), n)
        before = np.tile(np.arange(-1, size, dtype=np.int32), n)
        tree = np.full((n, 2 * size), none, np.int32)
        rank = self.byte_pairs[raw[:, :-1].astype(np.int32) * 256 + raw[:, 1:]]
        cell = np.arange(size - 1, dtype=np.int32)
        tree[:, size : 2 * size - 1] = np.where((rank >= 0) & (cell + 1 < lengths[:, None]), rank * size + cell, none)
        level = size
        while level > 1:
            level //= 2
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
        ids, tree = ids.ravel(), tree.ravel()

        def put(base: np.ndarray, at: np.ndarray, value: np.ndarray | np.int32) -> None:
            """Point update of one leaf in each row, up to the root."""
            node = at + size
            tree[base + node] = value
            left = size
            while left > 1:
                node = node >> 1
                left >>= 1
                below = base + 2 * node
                tree[base + node] = np.minimum(tree[below], tree[below + 1])

        rows = np.arange(n)
        while True:
            rows = rows[tree[rows * (2 * size) + 1] < none]
            if not len(rows):
                break
            base, link = rows * (2 * size), rows * wide
            top = tree[base + 1]
            at, merged = top % size, (top // size).astype(np.int64)
            gone = after[link + at]
            following = after[link + gone]
            left = before[link + at]
            ids[link + at], ids[link + gone] = merged, -1
            after[link + at] = following
            before[link + following] = at
            rank = self.pair_ranks(merged, ids[link + following])
            put(base, gone, none)
            put(base, at, np.where(rank < _NONE, rank * size + at, none).astype(np.int32))
            has = left >= 0
            base, x = base[has], left[has]
            rank = self.pair_ranks(ids[link[has] + x], merged[has])
            put(base, x, np.where(rank < _NONE, rank * size + x, none).astype(np.int32))
        ids = ids.reshape(n, wide)[:, :size]
        live = ids >= 0
        return ids[live].astype(np.uint32), live.sum(axis=1)

    def merge_one(self, word: bytes) -> list[int]:
        """The same for one long match, on lists."""
        size = 1 << max(0, (len(word) - 1).bit_length())
        ids = [int(self.byte_ids[b]) for b in word] + [-1] * (size + 1 - len(word))
        after, before = list(range(1, size + 2)), list(range(-1, size + 1))
        none, pair = int(_NONE), self.pair
        tree = [none] * (2 * size)
        for i in range(len(word) - 1):
            rank = pair.get((ids[i], ids[i + 1]))
            if rank is not None:
                tree[size + i] = rank * size + i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(at: int, value: int) -> None:
            node = at + size
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] < none:
            rank, at = divmod(tree[1], size)
            gone = after[at]
            following, left = after[gone], before[at]
            ids[at], ids[gone] = rank, -1
            after[at], before[following] = following, at
            new = pair.get((rank, ids[following])) if following < size else None
            put(gone, none)
            put(at, none if new is None else new * size + at)
            if left >= 0:
                new = pair.get((ids[left], rank))
                put(left, none if new is None else new * size + left)
        return [i for i in ids if i >= 0]

    def encode_matches(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of matches given by their bytes' place: ids, and each match's first id and count."""
        where, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        parts, total = [], 0
        wide = np.maximum(4, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
        for width in np.unique(wide).tolist():
            group = np.flatnonzero(wide == width)
            if width > _BATCHED:
                for i in group.tolist():
                    word = data[start[i] : start[i] + size[i]].tobytes()
                    whole = self.ranks.get(word)
                    ids = np.array([whole] if whole is not None else self.merge_one(word), np.uint32)
                    parts.append(ids)
                    where[i], count[i] = total, len(ids)
                    total += len(ids)
                continue
            step = max(1, (1 << 19) // width)
            for k in range(0, len(group), step):
                g = group[k : k + step]
                cell = np.minimum(start[g][:, None] + np.arange(width), len(data) - 1)
                raw = np.where(np.arange(width) < size[g][:, None], data[cell], 0)
                ids, n = self.merge_rows(raw, size[g])
                parts.append(ids)
                ends = np.cumsum(n)
                where[g], count[g] = total + ends - n, n
                total += len(ids)
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), where, count

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts end to end, and the offset of each text's ids. data, at: as of text_bytes()."""
        start = tokens.matches(data, at)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        end = np.append(start[1:], len(data))
        key = slice_keys(data, prefix_sums(BYTE_VALUES[data]), start, end)
        seen, index, inverse = np.unique(key, return_index=True, return_inverse=True)
        ids_where, ids_count = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
        slot = np.searchsorted(self.known, seen)
        hit = np.zeros(len(seen), bool)
        inside = slot < len(self.known)
        hit[inside] = self.known[slot[inside]] == seen[inside]
        ids_where[hit], ids_count[hit] = self.known_at[slot[hit]], self.known_count[slot[hit]]
        new = np.flatnonzero(~hit)
        ids = self.known_ids
        if len(new):
            fresh, where, count = self.encode_matches(data, start[index[new]], (end - start)[index[new]])
            ids_where[new], ids_count[new] = where + len(ids), count
            ids = np.concatenate([ids, fresh])
            place = slot[new]
            self.known, self.known_at, self.known_count, self.known_ids = np.insert(self.known, place, seen[new]), np.insert(self.known_at, place, ids_where[new]), np.insert(self.known_count, place, count), ids
            if len(self.known) > REMEMBERED:
                self._forget()
        count = ids_count[inverse]
        ends = np.cumsum(count)
        flat = ids[np.repeat(ids_where[inverse] - (ends - count), count) + np.arange(ends[-1])]
        first = np.searchsorted(start, at)  # each text's first match
        return flat, np.concatenate([[0], ends])[first]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of texts end to end and the offset of each, from their ids."""
        count = (self.word_at[1:] - self.word_at[:-1])[ids]
        ends = np.concatenate([[0], np.cumsum(count)])
        flat = self.word_bytes[np.repeat(self.word_at[ids] - ends[:-1], count) + np.arange(ends[-1])]
        return flat, ends[at]


_LOADED: dict[str, BytePairs] = {}


def loaded(path: str) -> BytePairs:
    """The ranks of a file, read once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = BytePairs(tokens.load_ranks(path))
    return _LOADED[path]


def encode_decode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Ids of each whole text, and their digest and that of the decoded bytes.

    In: doc_id, text (other columns are not read). Out, one row per row: doc_id, n_tokens,
    ids (packed little-endian unsigned 32-bit), ids_sha256, decoded_sha256. A null text counts as
    empty and has no ids; a null doc_id and repeated rows stay as they are; no rows give no rows.
    """

    def run(batches):
        pairs = loaded(ranks_path)
        for block in blocks(batches, BLOCK):
            data, at = text_bytes(block.column(1))
            ids, id_at = pairs.encode(data, at)
            text, text_at = pairs.decode(ids, id_at)
            flat, raw = ids.astype("<u4").tobytes(), text.tobytes()
            packed = [flat[4 * a : 4 * b] for a, b in zip(id_at[:-1].tolist(), id_at[1:].tolist(), strict=True)]
            decoded = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(text_at[:-1].tolist(), text_at[1:].tolist(), strict=True)]
            yield pa.record_batch(
                [block.column(0).cast(pa.int64()), pa.array(np.diff(id_at), pa.int64()), pa.array(packed, pa.binary()), pa.array(map(hex_digest, packed), pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
