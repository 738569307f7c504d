"""Helpers that the operators of this package share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch, shared_dir  # noqa: F401

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, return.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; plain lower() where the string is all ASCII, which is faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def whole_ids(df: DataFrame, id_col: str) -> DataFrame:
    """``df``, if its ids are whole numbers; else an error that says so."""
    kind = dict(df.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"{id_col} must hold whole numbers, not {kind}; give other ids a number first")
    return df


def hash128(*cols: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds: a key that 10^13 values share by chance with odds below 1e-12."""
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(7919), *cols).alias("h2")]


def about(k: int, n: int, *key: Column) -> Column:
    """A filter by hash that keeps about 2k of n rows (all if n is small): what a choice of k rows must sort stays small."""
    share = min(1.0, (2 * k + 100) / max(1, n))
    return F.bitwise_not(F.xxhash64(*key)).bitwiseAND(F.lit((1 << 30) - 1)) >= int((1 - share) * (1 << 30))


# ---- numpy helpers for Arrow batches -------------------------------------------------

def blobs(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array, without copying; nulls are empty.

    ``offsets`` has one entry more than rows and starts anywhere in ``bytes``.
    """
    import pyarrow as pa

    kind = column.type
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(kind) or pa.types.is_large_string(kind) else b"")
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), o


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: list[np.ndarray] = []
_BASE = 0x9E3779B97F4A7C15
#: A random 64-bit value for each byte; A-Z have the values of a-z.
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n-1 of an odd base modulo 2^64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(raw: np.ndarray, values: np.ndarray = _VALUE) -> np.ndarray:
    """H with H[j] - H[i] = the hash of raw[i:j] times base^i, modulo 2^64."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * up[: len(raw)], out=out[1:])
    return out


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each word of a byte array, A-Z folded."""
    black = np.ones(256, bool)
    black[[32, *range(9, 14)]] = False
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = black[raw]
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[::2], edge[1::2]
    h = prefix_hash(raw, _FOLDED)
    return start, mix64((h[end] - h[start]) * powers(len(raw) + 1)[1][start] + (end - start).astype(np.uint64))


def blocks(offsets: np.ndarray, size: int, rows: int = 1 << 12):
    """Ranges of rows with about ``size`` bytes each; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, i + rows, max(i + 1, j))
        yield i, j
        i = j
