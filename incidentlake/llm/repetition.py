"""Quality rules on repetition, by suffix arrays over words.

The words of all documents of a slice form one sequence in which a word of one document equals no word
of another. Prefix doubling ranks its suffixes by their first 1, 2, 4, ... words; only suffixes that
still share a rank go on. Neighbours in the suffix array get their longest common prefix from the
ranks of each doubling. The larger prefix a suffix shares with its two neighbours is the depth of
its innermost longest-common-prefix interval: the longest repeated run of words that starts there.
The union of these runs is the union of all maximal repeats.

Kept are documents that pass the base rules and whose repeats of ``long_repeat`` words or more cover
at most ``most_covered`` of the words, and in which no repeat is longer than ``longest`` words, whatever
share of the document that is.

Null and empty texts have no words and fail the base rules. Repeated rows are judged each for itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlake.llm.words import Words, annotate, covered, mix

FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_long_repeat_words bigint, longest_repeat bigint"
)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def repeats(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Length of the longest repeated run of words that starts at each word, inside its document."""
    n = len(ids)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    # one end mark behind each document, unlike anything else
    place = np.arange(n) + doc
    size = n + int(doc[-1]) + 1
    _, first = np.unique(ids ^ mix(doc.astype(np.uint64) + np.uint64(1)), return_inverse=True)
    top = int(first.max()) + 1
    rank = top + np.arange(size, dtype=np.int64)
    rank[place] = first
    levels = [rank]
    # suffixes whose rank another one has too
    counts = np.bincount(first, minlength=top)
    live = place[counts[first] > 1]
    step = 1
    fresh = top + size
    tied = []
    while len(live):
        # a live suffix has ``step`` words, so live + step is at most the end mark
        key = np.lexsort((rank[np.minimum(live + step, size - 1)], rank[live]))
        order = live[key]
        a, b = rank[order], rank[np.minimum(order + step, size - 1)]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        tied.append((order, a))
        group = np.cumsum(new) - 1
        rank = rank.copy()
        rank[order] = fresh + group
        fresh += len(order)
        levels.append(rank)
        many = np.bincount(group)
        live = order[many[group] > 1]
        step *= 2
    # suffix order of those that shared their first word: by the ranks of the last doubling they were in
    chain = levels[0][place]
    some = place[np.bincount(chain, minlength=top)[chain] > 1]
    keys = [lv[some] for lv in reversed(levels[1:])] + [levels[0][some]]
    order = some[np.lexsort(keys)] if len(keys) > 1 else some[np.argsort(keys[0], kind="stable")]
    left, right = order[:-1], order[1:]
    common = np.zeros(len(left), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        lv = levels[level]
        same = (left + common < size) & (right + common < size)
        same &= lv[np.minimum(left + common, size - 1)] == lv[np.minimum(right + common, size - 1)]
        common += same.astype(np.int64) << level
    depth = np.zeros(size, np.int64)
    np.maximum.at(depth, left, common)
    np.maximum.at(depth, right, common)
    return depth[place]


def duplicate_lines(words: Words) -> np.ndarray:
    """Per row, the lines with a word that equal an earlier line of the row."""
    data, offsets = words.data, words.offsets
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    row = np.searchsorted(offsets, start, "right") - 1
    ok = (start < len(data)) & (row < len(offsets) - 1)
    start, row = start[ok], row[ok]
    nxt = np.searchsorted(breaks, start)
    end = np.append(breaks, len(data))[nxt]
    end = np.minimum(end, offsets[row + 1])
    some = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, row = start[some], end[some], row[some]
    line = mix(words.spans(start, end, False) + (end - start).astype(np.uint64))
    _, first = np.unique(line ^ mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)
    again = np.ones(len(line), bool)
    again[first] = False
    return np.bincount(row[again], minlength=len(words.counts))


def measure(texts: pa.Array, window: int, long_repeat: int) -> list[pa.Array]:
    words = Words(texts)
    rows = len(words.counts)
    depth = repeats(words.hashes(), words.doc)

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[words.first[1:]] - sums[words.first[:-1]]

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[words.offsets[1:]] - sums[words.offsets[:-1]]

    space = np.isin(words.data, [0x20, 9, 10, 11, 12, 13])
    chars = per_text(~space & ((words.data & 0xC0) != 0x80))

    def union(least: int) -> np.ndarray:
        at = np.flatnonzero(depth >= least)
        return per_row(covered(words.n, at, depth[at])) if len(at) else np.zeros(rows, np.int64)

    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, words.doc, depth)
    made = (words.counts, chars, per_text(_SYMBOLS[words.data]), duplicate_lines(words), union(window), union(long_repeat), longest)
    return [pa.array(x.astype(np.int64)) for x in made]


def quality(
    docs: DataFrame, keep: list[str], text: str = "text", window: int = 3, min_words: int = 50, long_repeat: int = 8,
    most_covered: float = 0.3, longest: int = 50,
) -> DataFrame:
    """The columns ``keep`` in a struct ``row``, the measures, base_failed and kept; no shuffle."""
    out = annotate(docs, text, lambda texts: measure(texts, window, long_repeat), FIELDS, keep)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    loops = (F.col("n_long_repeat_words") > most_covered * F.col("n_words")) | (F.col("longest_repeat") > longest)
    return out.withColumn("base_failed", base).withColumn("kept", ~base & ~loops)
