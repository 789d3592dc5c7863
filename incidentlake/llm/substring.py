"""Substring dedup by fixed-block anchors.

A repeat is a run of at least ``size`` words that occurs twice. Reference blocks are the runs of
``size // 2`` words at every ``size // 2``-th word of a document, so each repeat holds a whole reference
block of every place where it occurs. The work goes by chunks of documents:

1. Every rolling window of the block length probes the index of reference blocks. A chunk sends each
   of its windows once, as 40 bits of its hash with two marks (twice here; at a block border), sorted and
   split into byte planes, to the part of the index that holds this range of hashes. The index answers
   with the windows that meet a reference block elsewhere.
2. Hits are extended: runs of ``size`` words around a hit are candidates, and chains of them are the
   maximal repeats. Each chunk sends the 64-bit hash of its candidates with the first document that has
   it; the answer names those that an earlier document of another chunk has.
3. Words under a window that starts earlier elsewhere, or earlier in the same chunk, are removed.

Two different windows are taken for equal with a chance of about 2**-64 a pair. Chunks are dealt by a
hash of id and text, so copies and hot keys spread; a window sent by a chunk counts once, so a passage
that a third of all documents share sends one entry per chunk.

The order is document id, then (for repeated ids) chunk and text; null ids come first. Null and empty
texts have no words and stay as they are. Removed words go with the white space behind them; the rest of
the text is not changed. Any columns may be kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlake.llm.chunks import blobs, chunk_table, planes, split, unplanes
from incidentlake.llm.tables import written
from incidentlake.llm.words import Words, covered, windows

CHUNK_BYTES = 4 << 20
PART_BYTES = 16 << 20  # text whose windows one part of the index takes
FINGERPRINT_BITS = 40
_LEAST = -(1 << 63)


class _Chunk:
    """Documents of a chunk in their order."""

    def __init__(self, table: pa.Table):
        order = pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")], null_placement="at_start")
        self.table = table.take(order).combine_chunks()
        self.ids = self.table["id"].to_numpy()
        self.words = Words(self.table["text"])
        self.hashes = self.words.hashes()

    def fingerprints(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        w, at = windows(self.hashes, self.words.doc, block)
        return w >> np.uint64(64 - FINGERPRINT_BITS), at


def _probe(table: pa.Table, block: int, parts: int) -> pa.Table:
    chunk = _Chunk(table)
    prints, at = chunk.fingerprints(block)
    order = np.argsort(prints, kind="stable")
    prints, at = prints[order], at[order]
    border = (at - chunk.words.first[chunk.words.doc[at]]) % block == 0
    head = np.ones(len(prints), bool)
    head[1:] = prints[1:] != prints[:-1]
    first = np.flatnonzero(head)
    twice = np.diff(np.append(first, len(prints))) > 1
    marks = (np.maximum.reduceat(border, first) if len(first) else np.zeros(0, bool)).astype(np.uint64) | twice.astype(np.uint64) << np.uint64(1)
    prints = prints[first]
    number = table["chunk"][0].as_py()
    values = prints << np.uint64(2) | marks
    return blobs([(p, number, planes(values[lo:hi], 6)) for p, lo, hi in split(prints, FINGERPRINT_BITS, parts)], ("part", "chunk"))


def _gather(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all blobs of a part and the row each came with."""
    sent = [unplanes(b, width) for b in table["blob"].to_pylist()]
    return np.concatenate(sent), np.repeat(np.arange(len(sent)), [len(b) for b in sent])


def _back(table: pa.Table, row: np.ndarray, values: np.ndarray, width: int) -> pa.Table:
    """Sorted numbers for each chunk."""
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    cuts = np.searchsorted(row, np.arange(table.num_rows + 1))
    chunks = table["chunk"].to_pylist()
    made = [(chunks[i], planes(values[lo:hi], width)) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
    return pa.table({"chunk": pa.array([m[0] for m in made], pa.int32()), "blob": pa.array([m[1] for m in made], pa.binary())})


def _meet(table: pa.Table) -> pa.Table:
    """Fingerprints with a reference block at another place than their own."""
    values, row = _gather(table, 6)
    order = np.argsort(values >> np.uint64(2), kind="stable")
    values, row = values[order], row[order]
    prints = values >> np.uint64(2)
    head = np.ones(len(prints), bool)
    head[1:] = prints[1:] != prints[:-1]
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, len(prints)))
    marks = np.bitwise_or.reduceat(values & np.uint64(3), first)
    found = ((size > 1) | (marks & np.uint64(2) > 0)) & (marks & np.uint64(1) > 0)
    hit = np.repeat(found, size)
    return _back(table, row[hit], prints[hit], 5)


def _answers(table: pa.Table, width: int) -> np.ndarray:
    return np.sort(np.concatenate([unplanes(b, width) for b in table["blob"].to_pylist()])) if table.num_rows else np.zeros(0, np.uint64)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    i = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[i] == values


def _extend(docs: pa.Table, hits: pa.Table, size: int, parts: int) -> pa.Table:
    block = size // 2
    if not docs.num_rows or not hits.num_rows:
        return blobs([], ("part", "chunk"))
    chunk = _Chunk(docs)
    prints, at = chunk.fingerprints(block)
    anchors = np.zeros(chunk.words.n + 1, np.int64)
    anchors[at[_among(prints, _answers(hits, 5))] + 1] = 1
    anchors = np.cumsum(anchors)
    runs, place = windows(chunk.hashes, chunk.words.doc, size)
    near = anchors[place + size - block + 1] > anchors[place]
    runs, first = np.unique(runs[near], return_index=True)
    ids = chunk.ids[chunk.words.doc[place[near][first]]].astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    number = docs["chunk"][0].as_py()
    return blobs([(p, number, planes(runs[lo:hi], 8) + planes(ids[lo:hi], 8)) for p, lo, hi in split(runs, 64, parts)], ("part", "chunk"))


def _earlier(table: pa.Table) -> pa.Table:
    """Windows of which another chunk has an earlier document."""
    halves = [(b[: len(b) // 2], b[len(b) // 2 :]) for b in table["blob"].to_pylist()]
    runs = [unplanes(a, 8) for a, _ in halves]
    row = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    runs, ids = np.concatenate(runs), np.concatenate([unplanes(b, 8) for _, b in halves])
    order = np.lexsort((table["chunk"].to_numpy()[row], ids, runs))
    later = np.zeros(len(order), bool)
    later[1:] = runs[order[1:]] == runs[order[:-1]]
    order = order[later]
    return _back(table, row[order], runs[order], 8)


def _remove(docs: pa.Table, later: pa.Table, size: int) -> pa.Table:
    chunk = _Chunk(docs)
    words = chunk.words
    runs, place = windows(chunk.hashes, words.doc, size)
    gone = _among(runs, _answers(later, 8))
    _, first = np.unique(runs, return_index=True)
    again = np.ones(len(runs), bool)
    again[first] = False
    out = covered(words.n, place[gone | again], size)
    change = np.zeros(len(words.data) + 1, np.int64)
    behind = np.append(words.start[1:], len(words.data))
    behind = np.minimum(behind, words.offsets[words.doc + 1]) if words.n else behind[:0]
    np.add.at(change, words.start[out], 1)
    np.add.at(change, behind[out], -1)
    stay = np.cumsum(change[:-1]) == 0
    offsets = np.concatenate([[0], np.cumsum(stay)])[words.offsets]
    texts = pa.LargeStringArray.from_buffers(len(words.counts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(words.data[stay].tobytes()))
    texts = pc.if_else(pc.is_valid(chunk.table["text"]), texts.cast(pa.string()), None)
    removed = np.concatenate([[0], np.cumsum(out)])[words.first]
    return pa.table({"row": chunk.table["row"], "text": texts, "n_words": pa.array(words.counts), "n_removed": pa.array(np.diff(removed))})


def remove_repeats(docs: DataFrame, keep: list[str], size: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns ``keep`` in a struct ``row``, with text, n_words and n_removed.

    The chunks are a bucketed table in the shared folder, so each of the three passes over the texts
    reads them in place and only fingerprints are shuffled.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    chunks, parts = max(8, -(-total // CHUNK_BYTES)), max(4, -(-total // PART_BYTES))
    dealt = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(_LEAST)).alias("id"),
        F.col(f"`{text}`").cast("string").alias("text"),
    ).withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int"))
    table = chunk_table(dealt, chunks)
    sent_as, answer = "part int, chunk int, blob binary", "chunk int, blob binary"
    slim = table.select("chunk", "id", "text")
    block = size // 2
    hits = written(slim.groupBy("chunk").applyInArrow(lambda t: _probe(t, block, parts), sent_as).groupBy("part").applyInArrow(_meet, answer), "hits")
    sent = slim.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(lambda d, h: _extend(d, h, size, parts), sent_as)
    later = written(sent.groupBy("part").applyInArrow(_earlier, answer), "later")
    made = table.schema["row"].dataType.simpleString()
    return table.groupBy("chunk").cogroup(later.groupBy("chunk")).applyInArrow(
        lambda d, h: _remove(d, h, size), f"row {made}, text string, n_words bigint, n_removed bigint"
    )
