"""Words of Arrow text columns as numpy arrays: borders, 64-bit hashes, hashes of windows.

A slice of a column is handled at once; the loops over bytes and words run inside numpy.
Hashes are sums of a random number per byte times a power of an odd constant, mixed at the end;
two different words share one with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 20  # text per numpy pass; a longer document is a slice of its own
BATCH_BYTES = 4 << 20  # of an Arrow batch that goes to a Python worker; a longer row is a batch of its own

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BLOCK = 4096  # powers kept at a time
_BYTE_STEP, _WORD_STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so powers have inverses


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(8)
def _low(step: int) -> np.ndarray:
    """The powers 0 to ``BLOCK - 1``."""
    ones = np.full(BLOCK, step, np.uint64)
    ones[0] = 1
    return np.cumprod(ones, dtype=np.uint64)


def _high(step: int, n: int) -> np.ndarray:
    """Powers of the places 0, ``BLOCK``, 2 * ``BLOCK`` ... below n and one more."""
    steps = np.full(n // BLOCK + 1, pow(step, BLOCK, 1 << 64), np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def prefix_sums(values: np.ndarray, step: int) -> np.ndarray:
    """Sums of the first 0, 1, ... values, each times the power of its place; powers are made block by block."""
    n = len(values)
    whole = n // BLOCK * BLOCK
    low, high = _low(step), _high(step, n)
    sums = np.zeros(n + 1, np.uint64)
    np.multiply(values[:whole].reshape(-1, BLOCK), low, out=sums[1 : whole + 1].reshape(-1, BLOCK))
    sums[1 : whole + 1].reshape(-1, BLOCK)[:] *= high[: whole // BLOCK, None]
    sums[whole + 1 :] = values[whole:] * low[: n - whole] * high[-1]
    return np.cumsum(sums, out=sums)


def inverse_powers(step: int, at: np.ndarray, n: int) -> np.ndarray:
    """What takes the powers of places below n back."""
    inverse = pow(step, -1, 1 << 64)
    return _low(inverse)[at % BLOCK] * _high(inverse, n)[at // BLOCK]


def byte_table(lower: bool) -> np.ndarray:
    """A random odd number per byte; with ``lower`` A-Z share those of a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BYTE_STEP)) | np.uint64(1)
    if lower:
        table[65:91] = table[97:123]
    return table


SPACE_WORDS = np.ones(256, bool)  # words [^\x20\x09-\x0D]+
SPACE_WORDS[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM_WORDS = np.zeros(256, bool)  # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM_WORDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of a column: ``start``/``end`` in ``data``, ``doc`` row, ``first`` word of each row."""

    def __init__(self, column: pa.Array, alphabet: np.ndarray = SPACE_WORDS, lower: bool = False):
        self.data, self.offsets = text_buffers(column)
        self.lower = lower
        inside = alphabet[self.data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(inside))]
        before[edges] = False
        after[edges - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.n = len(self.start)

    def hashes(self) -> np.ndarray:
        return mix(self.spans(self.start, self.end, self.lower) + (self.end - self.start).astype(np.uint64) * np.uint64(_WORD_STEP))

    def spans(self, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
        """A number for the bytes from each start to its end, wherever they lie; not mixed yet."""
        sums = prefix_sums(byte_table(lower)[self.data], _BYTE_STEP)
        return (sums[end] - sums[start]) * inverse_powers(_BYTE_STEP, start, len(self.data))

    def word(self, i: int) -> bytes:
        raw = self.data[self.start[i] : self.end[i]].tobytes()
        return raw.lower() if self.lower else raw

    def strings(self, which: np.ndarray) -> list[str]:
        """The words with these numbers; they hold no line end."""
        size = self.end[which] - self.start[which] + 1
        begin = np.cumsum(size) - size
        take = np.repeat(self.start[which] - begin, size) + np.arange(size.sum())
        joined = self.data[np.minimum(take, len(self.data) - 1)]
        joined[begin + size - 1] = 10
        return joined[:-1].tobytes().decode().split("\n")


def windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words inside one row, and the place of its first word."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = prefix_sums(hashes, _WORD_STEP)
    at = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])
    return mix((sums[at + size] - sums[at]) * inverse_powers(_WORD_STEP, at, n) + np.uint64(size)), at


def covered(n: int, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Which of n places lie in one of the spans [at, at + size)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + size, -1)
    return np.cumsum(change[:-1]) > 0


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text, or of one row."""
    _, offsets = text_buffers(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def bounded(df: DataFrame) -> DataFrame:
    """The frame, of which Python workers now get batches of at most ``BATCH_BYTES``.

    Spark's own bound is 10 000 rows or 64 MB, so a batch of texts took tens of megabytes outside the heap on both sides
    of each task. The setting is the session's; one that was made before stays.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def annotate(
    df: DataFrame, text: str, fn: Callable[[pa.Array], list[pa.Array]], fields: str, keep: list[str], most: int = SLICE_BYTES
) -> DataFrame:
    """The columns ``keep`` in a struct ``row``, and what ``fn`` makes of each slice of texts.

    No shuffle, and whatever the columns of ``df`` are called, none clashes with ``fields``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, texts = batch.columns
            for lo, hi in slices(texts, most):
                made = fn(texts.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([row.slice(lo, hi - lo), *made], names)

    made = bounded(df).select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    names = ["row", *StructType.fromDDL(fields).names]
    return made.mapInArrow(run, f"row {made.schema['row'].dataType.simpleString()}, {fields}")
