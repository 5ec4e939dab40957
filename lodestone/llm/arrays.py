"""Shared helpers: Arrow text as one byte array, rolling hashes, scratch tables and small aggregates.

Slice hashes are polynomial sums modulo 2**64 over a fixed random table, so the hash of any slice
comes from two prefix sums; `mix` spreads the bits afterwards. Such sums have known collisions from
1,024 letters on, so slices of any length are told apart by slice_keys(), which hashes the bytes of
long ones with blake2b.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Slices of more bytes are hashed by blake2b.
LONG = 64
#: Windows whose minima are taken at once, by places of 24 bits.
PIECE = 1 << 23
_LOW = np.uint64((1 << 24) - 1)

_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i (or its inverse) for i < n, kept per process and grown by need."""
    key = "inverse" if inverse else "forward"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n + n // 8, 1 << 16)
        steps = np.full(size, INVERSE if inverse else BASE, dtype=np.uint64)
        steps[0] = 1
        _POWERS[key] = have = np.multiply.accumulate(steps)
    return have[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i; values are uint64."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def slice_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each slice [start, end), the same wherever it stands."""
    return mix((sums[end] - sums[start]) * powers(len(sums), inverse=True)[start])


def slice_keys(data: np.ndarray, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit keys of slices of any length: slice_hashes() of short ones, blake2b of long ones."""
    keys = slice_hashes(sums, start, end)
    for i in np.flatnonzero(end - start > LONG).tolist():
        keys[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return keys


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased, and start, end and text number of each word (a run without white space)."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    if not len(low):
        return low, *[np.zeros(0, np.int64)] * 3
    word = ~((low == 32) | ((low >= 9) & (low <= 13)))
    edge = np.zeros(len(low) + 1, bool)
    edge[at] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end[:-1] &= ~word[1:] | edge[1:-1]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    return low, first, last, np.searchsorted(at, first, side="right") - 1


def word_hashes(low: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit key of each word."""
    return slice_keys(low, prefix_sums(BYTE_VALUES[low]), first, last) if len(first) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end and the n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(batches, most: int = 8 << 20, column: str = "text"):
    """Cut record batches so that each piece holds about `most` bytes of text (one row at least).

    At the end the worker gives the memory it no longer needs back, as it may live on idle.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(at, at[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
        del batch
    release()


def release() -> None:
    """Hand freed memory back to the system."""
    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def release_driver(spark: SparkSession) -> None:
    """Collect the garbage that the steps so far left on the driver, where the heap else grows to its
    limit first; shuffles and broadcasts that nothing reads any more go with it."""
    release()
    spark.sparkContext._jvm.System.gc()


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by block prefix and suffix minima."""
    n = len(x)
    if n < w:
        return x[:0]
    if w == 1:
        return x
    padded = np.concatenate([x, np.full((-n) % w, x.max(), dtype=x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def smallest_places(hashes: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest hash (by its upper 40 bits; rightmost, if equal) of each w neighbours.

    Hash and place within a piece share 64 bits; pieces overlap, so the input may be of any length.
    """
    n = max(0, len(hashes) - w + 1)
    out = np.empty(n, np.int64)
    for start in range(0, n, PIECE):
        part = hashes[start : min(start + PIECE, n) + w - 1]
        low = sliding_minimum(((part >> np.uint64(24)) << np.uint64(24)) | (_LOW - np.arange(len(part), dtype=np.uint64)), w)
        out[start : start + len(low)] = (_LOW - (low & _LOW)).astype(np.int64) + start
    return out


def hex_digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables between steps: under spark.checkpoint.dir, which executors share.

    Only on one machine, and only where the session names no such folder (as in tests), one below
    /tmp is taken; a cluster's executors could not read it, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file:///tmp/lodestone-{os.getuid()}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows as a written table in the shared folder: lineage ends and lost executors lose nothing.

    `by` names a column whose values get folders of their own, so a filter on it reads no others.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def drop_table(*tables: DataFrame | None) -> None:
    """Delete tables made by cut() once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "__dict__", {}).get("scratch_path")
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
