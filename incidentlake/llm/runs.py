"""Periodic runs of words, by block convolution.

A run is a longest stretch of words in which words ``period`` apart are equal, of at least two periods and
``least`` words. Periods are searched at dyadic scales: at scale B, blocks of B words meet the words
``2 B`` to ``4 B`` further on (the first scale takes all shorter distances too). A run of such a period
holds a whole block together with its copy one period later. The sums of squared differences between a
block and all places of its window are ``sum b**2 + sum t**2 - 2 (b * t)``, with the products from number-theoretic
transforms; they are computed modulo as many primes as the largest sum needs, so zero means equal. The
distances found are seeds: neighbouring blocks with one distance are joined, and extended word by word to
the ends of the stretch.

What keeps this near linear: a block is only transformed if some of its words recur at such a distance,
and neither blocks nor seeds are followed whose words lie, copy included, in a run of a period of at most B:
two runs that share the sum of their periods are one (the theorem of Fine and Wilf), so nothing new starts there.

Words are told apart by 64-bit hashes. Null and empty texts have no words and no runs. Repeated rows are
judged each for itself. A text of any length is handled whole, by one task: its arrays take some hundred bytes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from incidentlake.llm.words import Words, slices

#: Primes with a power of two (at least 2**25) in prime - 1, and a primitive root of each.
PRIMES = ((2013265921, 31), (469762049, 3), (167772161, 3))
POINTS = 1 << 18  # numbers transformed at a time; one longer block is transformed alone
PROBES = 6  # words of a block looked up before it is transformed
STRIDE = 64  # words compared at a time when a seed is extended


@lru_cache(64)
def _powers(prime: int, root: int, half: int) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order ``2 * half``."""
    base, out = pow(root, (prime - 1) // (2 * half), prime), np.ones(half, np.uint64)
    done = 1
    while done < half:
        out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done *= 2
    return out


def _reduced(x: np.ndarray, p: np.uint64) -> np.ndarray:
    return x - x // p * p


def forward(a: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Transforms of the rows, in bit-reversed order."""
    p, (rows, size) = np.uint64(prime), a.shape
    half = size // 2
    while half:
        pair = a.reshape(rows, -1, 2, half)
        u, v = pair[:, :, 0], pair[:, :, 1]
        total = u + v
        out = np.empty_like(pair)
        np.minimum(total, total - p, out=out[:, :, 0])  # unsigned: below p, the difference wraps round to a large number
        out[:, :, 1] = _reduced((u + (p - v)) * _powers(prime, root, half), p)
        a = out.reshape(rows, size)
        half //= 2
    return a


def backward(a: np.ndarray, prime: int, root: int) -> np.ndarray:
    """What ``forward`` made, transformed back."""
    p, (rows, size) = np.uint64(prime), a.shape
    inverse, half = pow(root, -1, prime), 1
    while half < size:
        pair = a.reshape(rows, -1, 2, half)
        u, v = pair[:, :, 0], _reduced(pair[:, :, 1] * _powers(prime, inverse, half), p)
        out = np.empty_like(pair)
        total = u + v
        np.minimum(total, total - p, out=out[:, :, 0])
        total = u + (p - v)
        np.minimum(total, total - p, out=out[:, :, 1])
        a = out.reshape(rows, size)
        half *= 2
    return _reduced(a * np.uint64(pow(size, -1, prime)), p)


def mismatches(blocks: np.ndarray, windows: np.ndarray, places: int, prime: int, root: int) -> np.ndarray:
    """Sums of squared differences between each block and its window, at the first places, modulo the prime."""
    p, (rows, width) = np.uint64(prime), blocks.shape
    size = 1 << (windows.shape[1] - 1).bit_length()
    turned, wide = np.zeros((rows, size), np.uint64), np.zeros((rows, size), np.uint64)
    turned[:, 0] = blocks[:, 0]
    turned[:, size - width + 1 :] = blocks[:, :0:-1]
    wide[:, : windows.shape[1]] = windows
    products = backward(_reduced(forward(turned, prime, root) * forward(wide, prime, root), p), prime, root)[:, :places]
    own = _reduced(_reduced(blocks * blocks, p).sum(axis=1), p)
    squares = np.zeros((rows, windows.shape[1] + 1), np.uint64)
    np.cumsum(_reduced(windows * windows, p), axis=1, out=squares[:, 1:])
    other = squares[:, width : width + places] - squares[:, :places]
    return _reduced(own[:, None] + other + 2 * (p - products), p)


def occurrences(ids: np.ndarray, at: np.ndarray, stop: np.ndarray, width: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) wherever a block of ``width`` words equals the words ``low`` to ``high - 1`` further on."""
    places, reach = high - low, high - low + width - 1
    none = ids.max() + 1  # stands behind the end of a document
    needed, primes = width * int(none) ** 2, 1
    while np.prod([float(p) for p, _ in PRIMES[:primes]]) <= needed and primes < len(PRIMES):
        primes += 1
    step = max(1, POINTS // (1 << (reach - 1).bit_length()))
    found_at, found_far = [], []
    for lo in range(0, len(at), step):
        begin, end = at[lo : lo + step, None], stop[lo : lo + step, None]
        blocks = ids[begin + np.arange(width)].astype(np.uint64)
        place = begin + low + np.arange(reach)
        windows = np.where(place < end, ids[np.minimum(place, len(ids) - 1)], none).astype(np.uint64)
        live, equal = np.arange(len(blocks)), None
        for prime, root in PRIMES[:primes]:
            # blocks without a zero under one prime have none
            zero = mismatches(blocks[live], windows[live], places, prime, root) == 0
            equal = zero if equal is None else equal & zero
            some = equal.any(axis=1)
            live, equal = live[some], equal[some]
            if not len(live):
                break
        row, far = np.nonzero(equal)
        found_at.append(at[lo + live[row]])
        found_far.append(far + low)
    return np.concatenate(found_at), np.concatenate(found_far)


def agree(ids: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words are equal from the places a and b on, going by ``step``, at most ``room``."""
    got = np.zeros(len(a), np.int64)
    live = np.flatnonzero(room > 0)
    while len(live):
        j = got[live, None] + np.arange(STRIDE)
        inside = j < room[live, None]
        j = np.where(inside, j, 0) * step
        same = inside & (ids[a[live, None] + j] == ids[b[live, None] + j])
        n = np.where(same.all(axis=1), STRIDE, same.argmin(axis=1))
        got[live] += n
        live = live[n == STRIDE]
    return got


def find(hashes: np.ndarray, first: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, ordered; ``first`` has the first word of each document, and the end."""
    empty = np.zeros(0, np.int64)
    n, counts = len(hashes), np.diff(first)
    if not n:
        return empty, empty, empty
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, doc))
    new = np.ones(n, bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    name = np.empty(n, np.int64)
    name[order] = np.cumsum(new) - 1  # one number for each word of each document
    base = np.zeros(len(counts), np.int64)
    base[counts > 0] = name[order[first[:-1][counts > 0]]]
    ids = name - base[doc]
    stop, begin = first[1:][doc], first[:-1][doc]
    occurs = name[order] * np.int64(n) + order  # ascending: by word, then by place

    starts, ends, periods = empty, empty, empty
    width = 2 if least >= 6 else 1
    low, high, longest = 1, 4 * width, int(counts.max())
    while low <= longest // 2:
        at = np.concatenate([np.arange(a, b - width + 1, width) for a, b in zip(first[:-1], first[1:]) if b - a >= max(2 * low, least)] or [empty])
        # runs found so far, of a period of at most ``width``: where one ends that began here or before
        reach = np.zeros(n, np.int64)
        short = periods <= width
        np.maximum.at(reach, starts[short], ends[short])
        reach = np.maximum.accumulate(reach)
        at = at[at + low + width <= stop[at]]
        at = at[reach[at] < np.minimum(at + high - 1 + width, stop[at])]
        for k in np.unique(np.linspace(0, width - 1, PROBES).astype(np.int64)):
            key = name[at + k] * np.int64(n) + at + k
            i = np.searchsorted(occurs, key + low)
            near = (i < n) & (occurs[np.minimum(i, n - 1)] <= np.minimum(key + high - 1, name[at + k] * np.int64(n) + stop[at] - 1))
            at = at[near]
        if len(at):
            p, d = occurrences(ids, at, stop[at], width, low, high)
            own = reach[p] < p + d + width
            p, d = p[own], d[own]
            by = np.lexsort((p, d))
            p, d = p[by], d[by]
            head = np.ones(len(p), bool)
            head[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1] + width) | (doc[p[1:]] != doc[p[:-1]])
            tail = np.append(head[1:], True) if len(p) else head
            a, b, d = p[head], p[tail] + width, d[head]
            left = agree(ids, a - 1, a - 1 + d, np.minimum(width, a - begin[a]), -1)
            right = agree(ids, b, b + d, np.minimum(width, stop[a] - b - d), 1)
            # a whole block more: it was left out as part of a run of a shorter period, and so is this stretch
            fresh = (left < width) & (right < width)
            a, b, d = (a - left)[fresh], (b + right)[fresh], d[fresh]
            long = (b - a >= d) & (b - a + d >= least)
            starts, ends, periods = (np.concatenate(x) for x in ((starts, a[long]), (ends, (b + d)[long]), (periods, d[long])))
            # of one stretch, the smallest period counts
            by = np.lexsort((periods, ends, starts))
            starts, ends, periods = starts[by], ends[by], periods[by]
            one = np.ones(len(starts), bool)
            one[1:] = (starts[1:] != starts[:-1]) | (ends[1:] != ends[:-1])
            starts, ends, periods = starts[one], ends[one], periods[one]
        low, high, width = high, 2 * high, high // 2
    by = np.lexsort((periods, starts))
    return starts[by], ends[by], periods[by]


def looped(first: np.ndarray, draws: list[int | None]) -> np.ndarray:
    """For each word, the word that stands in its place: a tenth of the documents have their tails looped.

    With the draw h and g = h // 10: if h % 10 is 0, the words from a = g % n on repeat the first p of them,
    p = 1 + (n - a) // (3 + g % 8). A null draw changes nothing.
    """
    place = np.arange(first[-1])
    for lo, hi, h in zip(first[:-1].tolist(), first[1:].tolist(), draws):
        if h is not None and h % 10 == 0 and hi > lo:
            g = h // 10
            a = g % (hi - lo)
            period = 1 + (hi - lo - a) // (3 + g % 8)
            place[lo + a : hi] = lo + a + np.arange(hi - lo - a) % period
    return place


FIELDS = (
    "n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, "
    "runs_sha256 string, collapsed_sha256 string"
)


def _judged(texts: pa.Array, draws: list[int | None] | None, least: int) -> list[pa.Array]:
    words = Words(texts)
    first, rows = words.first, len(words.counts)
    place = np.arange(words.n) if draws is None else looped(first, draws)
    starts, ends, periods = find(words.hashes()[place], first, least)
    doc = words.doc[starts]
    cut = np.searchsorted(doc, np.arange(rows + 1))
    length, start = ends - starts, starts - first[doc]
    best = np.full(rows, -1)
    rank = np.lexsort((periods, starts, -length, doc))
    some, at = np.unique(doc[rank], return_index=True)
    best[some] = rank[at]

    gone = np.zeros(words.n + 1, np.int64)
    np.add.at(gone, starts + periods, 1)
    np.add.at(gone, ends, -1)
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    size = words.end[place[kept]] - words.start[place[kept]] + 1
    after = np.cumsum(size)
    begin = after - size
    body = words.data[np.minimum(np.repeat(words.start[place[kept]] - begin, size) + np.arange(size.sum()), max(len(words.data) - 1, 0))]
    body[after - 1] = 32  # a space behind each word
    edge = np.append(begin, after[-1] if len(after) else 0)[np.searchsorted(kept, first)]
    lists = [f"{s},{n},{p}\n" for s, n, p in zip(start.tolist(), length.tolist(), periods.tolist())]

    def digest(raw) -> str:
        return hashlib.sha256(raw).hexdigest()

    def of_best(values: np.ndarray) -> pa.Array:
        taken = values[best] if len(values) else np.zeros(rows, np.int64)
        return pa.array(taken, pa.int64(), mask=best < 0)

    listed = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, periods)], ["start", "length", "period"])
    return [
        pa.array(words.counts, pa.int64()), pa.array(np.diff(cut), pa.int64()), of_best(start), of_best(length), of_best(periods),
        pa.ListArray.from_arrays(pa.array(cut, pa.int32()), listed),
        pa.array([digest("".join(lists[lo:hi]).encode()) for lo, hi in zip(cut, cut[1:])]),
        pa.array([digest(body[lo : max(lo, hi - 1)]) for lo, hi in zip(edge, edge[1:])]),
    ]


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text", least: int = 12, loop: Column | None = None) -> DataFrame:
    """The columns ``keep`` in a struct ``row``, the runs, the longest one (ties: smallest start, then period), digests.

    ``loop`` is a number for each row by which tails of texts are looped first (see ``looped``). No shuffle.
    """
    made = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), (F.lit(None) if loop is None else loop).cast("bigint").alias("draw"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    names = ["row", *StructType.fromDDL(FIELDS).names]
    plain = loop is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, draw, texts = batch.columns
            for lo, hi in slices(texts):
                draws = None if plain else draw.slice(lo, hi - lo).to_pylist()
                yield pa.RecordBatch.from_arrays([row.slice(lo, hi - lo), *_judged(texts.slice(lo, hi - lo), draws, least)], names)

    return made.mapInArrow(run, f"row {made.schema['row'].dataType.simpleString()}, {FIELDS}")
