"""Benchmark decontamination by Wu-Manber search over words.

Every window of ``size`` consecutive words of an item is a pattern (an item of fewer words, but not
none, is one). Patterns of one length are searched together. A block is the last two words under the
search window (one for one-word patterns):

* shift table: how far the window may move for a block; a block of no pattern allows the most;
* suffix-hash buckets: where the shift is 0, the block names the patterns that end with it;
* direct comparison of the words confirms an occurrence.

Long texts are cut into lanes by the place where a window ends, and all lanes of a slice advance
together. Texts are lower-cased in A-Z; null text has no words; a document without words is clean.
An item without
text has no patterns; one without id marks the words that it holds, but can't be named. Repeated rows are judged each for itself. An empty benchmark hits nothing. Any columns may be kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlake.llm.words import ALNUM_WORDS, Words, annotate, mix, windows

BLOCK_WORDS = 2_000_000  # words of items that one pass carries to the tasks; more take more passes
LANE = 512
TABLE_BITS = 20


class PatternSet:
    """Shift table and buckets for the distinct patterns of one length."""

    def __init__(self, length: int, patterns: list[tuple[bytes, ...]], owners: list[list[int]], hashes: np.ndarray):
        self.length, self.patterns, self.owners = length, patterns, owners
        self.block = min(2, length)
        self.most = length - self.block + 1
        self.shift = np.full(1 << TABLE_BITS, min(self.most, 255), np.uint8)
        for back in range(self.most):  # the block that ends ``back`` words before the end
            end = length - back
            slot = self.slot(hashes[:, end - 1], hashes[:, end - 2])
            np.minimum.at(self.shift, slot, min(back, 255))
        suffix = self.slot(hashes[:, -1], hashes[:, length - 2])
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.order = suffix[order], order
        self.prefix = hashes[:, 0][order]

    def slot(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        x = last if self.block == 1 else last * np.uint64(3) + before
        return (mix(x) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern number of every occurrence."""
        m = self.length
        # lanes: places where a window may end, cut into runs of LANE
        begin = words.first[:-1] + m - 1
        todo = np.maximum(words.counts - m + 1, 0)
        per = -(-todo // LANE)
        row = np.repeat(np.arange(len(todo)), per)
        at = begin[row] + (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * LANE
        stop = np.minimum(at + LANE, (begin + todo)[row])
        hits = []
        while len(at):
            move = self.shift[self.slot(hashes[at], hashes[at - (self.block > 1)])].astype(np.int64)
            zero = at[move == 0]
            if len(zero):
                hits.append(zero)
            at = at + np.maximum(move, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end = np.concatenate(hits)
        suffix = self.slot(hashes[end], hashes[end - (self.block > 1)])
        lo, hi = np.searchsorted(self.suffix, suffix, "left"), np.searchsorted(self.suffix, suffix, "right")
        bucket = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange((hi - lo).sum())
        start = np.repeat(end - m + 1, hi - lo)
        same = self.prefix[bucket] == hashes[start]
        start, found = start[same], self.order[bucket[same]]
        right = np.fromiter((all(words.word(s + i) == w for i, w in enumerate(self.patterns[p])) for s, p in zip(start.tolist(), found.tolist())), bool, len(start))
        return start[right], found[right]


def pattern_sets(items: list[tuple[int, str | None]], size: int) -> list[PatternSet]:
    """Patterns of the items by length; owners are places in ``items``."""
    words = Words(pa.array([t for _, t in items], pa.string()), ALNUM_WORDS, True)
    hashes = words.hashes()
    found: dict[int, dict[tuple[bytes, ...], tuple[int, set[int]]]] = {}
    for row, (lo, n) in enumerate(zip(words.first[:-1].tolist(), words.counts.tolist())):
        length = min(size, n)
        text = [words.word(i) for i in range(lo, lo + n)]
        for at in range(n - length + 1 if n else 0):
            found.setdefault(length, {}).setdefault(tuple(text[at : at + length]), (lo + at, set()))[1].add(row)
    sets = []
    for length, patterns in sorted(found.items()):
        starts = np.array([s for s, _ in patterns.values()])
        sets.append(PatternSet(length, list(patterns), [sorted(o) for _, o in patterns.values()], hashes[starts[:, None] + np.arange(length)]))
    return sets


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], size: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The columns ``keep`` in a struct ``row``, with n_words, n_hit, and the sorted ids of the items that occur.

    The items are read in blocks of ``BLOCK_WORDS`` words and go to the tasks block by block; the
    spans of all blocks are united by document, inside the same tasks.
    """
    out = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("keep"), F.col(f"`{text}`").cast("string").alias("text"),
        F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"),
    )
    listed = benchmark.select(F.col(f"`{item}`").cast("string").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    for sets, names in _blocks(listed, size):
        out = annotate(out, "text", partial(_find, sets=sets, names=names), "n bigint, at array<int>, found array<string>", ["keep", "text", "hits", "items"])
        out = out.select("row.keep", "row.text", F.col("n").alias("n_words"), F.array_union("row.hits", "at").alias("hits"), F.array_union("row.items", "found").alias("items"))
    return out.select(F.col("keep").alias("row"), "n_words", F.size("hits").cast("long").alias("n_hit"), F.array_sort("items").alias("items"))


def _blocks(items: DataFrame, size: int) -> Iterator[tuple[list[PatternSet], list[str | None]]]:
    block, held = [], 0
    for r in items.filter("text is not null").toLocalIterator():
        block.append((r["id"], r["text"]))
        held += r["text"].count(" ") + 1
        if held >= BLOCK_WORDS:
            yield pattern_sets(block, size), [i for i, _ in block]
            block, held = [], 0
    yield pattern_sets(block, size), [i for i, _ in block]


def _find(texts: pa.Array, sets: list[PatternSet], names: list[str | None]) -> list[pa.Array]:
    words = Words(texts, ALNUM_WORDS, True)
    hashes = words.hashes()
    hit = np.zeros(words.n, bool)
    items: list[set[str]] = [set() for _ in range(len(texts))]
    for patterns in sets:
        start, found = patterns.search(words, hashes)
        for i in range(patterns.length):
            hit[start + i] = True
        for row, p in set(zip(words.doc[start].tolist(), found.tolist())):
            items[row].update(names[o] for o in patterns.owners[p] if names[o] is not None)
    place = np.flatnonzero(hit)
    first = np.searchsorted(place, words.first)
    inside = (place - words.first[words.doc[place]]).astype(np.int32)
    return [pa.array(words.counts), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(inside)), pa.array([sorted(i) for i in items], pa.list_(pa.string()))]
