"""Shared helpers of the text operators: row identity, fold membership and
vectorised hashing of Arrow text columns.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; those bytes never
occur inside a multi-byte UTF-8 character, so whole texts are hashed as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The word pattern of the query contracts.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: Texts are hashed in runs of about this many bytes, which bounds a task's memory.
SLICE_BYTES = 1 << 20

#: Rows of a join side that are sent to every task at most.
MAX_BROADCAST_ROWS = 1_000_000
#: Bytes of a join side of long rows that are sent to every task at most.
MAX_BROADCAST_BYTES = 32 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True
_BYTE_VALUE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
for _c in range(ord("A"), ord("Z") + 1):
    _BYTE_VALUE[_c] = _BYTE_VALUE[_c + 32]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def fold_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % modulus


def text_key(text: str | Column) -> Column:
    """64-bit hash that tells rows with the same id and different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with nulls equal; the keys of the right side are dropped."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    cond = None
    for k in keys:
        one = left[k].eqNullSafe(renamed[f"_right_{k}"])
        cond = one if cond is None else cond & one
    return left.join(renamed, cond, how).drop(*[f"_right_{k}" for k in keys])


def small_side(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows (of a few
    numbers each); larger ones are joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def light_side(df: DataFrame, cost: Column | int, most: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows, each of ``cost`` bytes, come to at
    most ``most`` bytes together; larger ones are joined by a shuffle."""
    total = df.agg(F.sum(cost if isinstance(cost, Column) else F.lit(cost)).alias("total")).first()["total"]
    return F.broadcast(df) if (total or 0) <= most else df


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mix of unsigned 64-bit values (wraps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POWERS[kind]
    if len(have) < n:
        step = np.full(max(n, 2 * len(have)), _BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        have = _POWERS[kind] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of rows of about
    ``limit`` bytes; null counts as empty. A longer text is a run of its own."""
    col = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = IS_SPACE
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the words' offsets per row.
    ``separators`` marks the byte values that part words (ASCII only)."""
    space = separators[data]
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = True, space[:-1]
        after[-1], after[:-1] = True, space[1:]
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        before[inner] = True
        inner = offsets[1:-1]
        inner = inner[inner > 0]
        after[inner - 1] = True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed 64-bit polynomial hash of each span, A-Z hashed as a-z."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * _powers("up", len(data)), dtype=np.uint64, out=total[1:])
    raw = (total[ends] - total[starts]) * _powers("down", len(data) + 1)[starts]
    return mix64(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(1)))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (A-Z folded) and the words' offsets per row."""
    starts, ends, rows = word_spans(data, offsets)
    return span_hashes(data, starts, ends), rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside a row; a row with fewer
    words (but some) has its whole sequence as its one shingle. Returns
    (hashes, row of each)."""
    count = np.diff(rows)
    n = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    row = np.repeat(np.arange(len(count)), n)
    first = rows[:-1][row] + (np.arange(len(row)) - (np.cumsum(n) - n)[row])
    length = np.minimum(count[row], width)
    out = length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        inside = k < length
        at = np.minimum(first + k, max(len(words) - 1, 0))
        part = words[at] * np.uint64((2 * k + 3) * 0x9FB21C651E98DF25 % 2**64 | 1) if len(words) else out
        out = mix64(out + np.where(inside, part, np.uint64(0))) if k == width - 1 else out + np.where(inside, mix64(part), np.uint64(0))
    return out, row
