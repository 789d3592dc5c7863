"""Best-fit packing by linear grouping.

Documents become token ids plus an end id; longer ones than a sequence are cut into pieces.
Pieces have at most ``capacity`` different lengths, so the plan is made on their histogram:

1. Lengths above ``large_share`` of a sequence are cut into groups of equal cardinality, and each is
   rounded up to the largest of its group (linear grouping).
2. Configurations of these few sizes are chosen one by one: the largest size left together with the
   set of others that leaves the least room, used as often as the stock allows.
3. Actual lengths are substituted, which gives room back.
4. Small lengths go, largest first, into the sequence with the least room that still takes them.

Every step works on runs of equal sequences, so the plan's size depends on ``capacity`` and
``groups``, not on the rows. Each piece then finds its place by its length and its rank among the
pieces of that length.

Null text is empty and an empty document is its end id. Repeated rows are packed as often as they
occur. An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from incidentlake.llm.tables import with_rank, written
from incidentlake.llm.words import Words, annotate

CACHE_WORDS = 700_000  # words remembered by a worker
PIECES = "pieces array<struct<piece int, start bigint, length bigint, ids_crc32 bigint, ids array<int>>>"


class WordIds:
    """Ids of single words, as the tokenizer file gives them.

    Words of Latin letters, digits and marks go through the byte-pair merges of tiktoken, loaded with
    the ranks of the tokenizer file and 0xFF as the word end; that is about ten times as fast. Any
    other word is given to the tokenizer itself. The vocabulary must have every merged token reachable
    by its own merges, which makes both the same; the tests check this for each token.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = {c: bytes([b]) for b, c in _byte_letters().items()}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks, self.ids = {b"\xff": 0}, [0]
        vocab = sorted(self.tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
        for token, number in vocab:
            if token not in special:
                end = token.endswith("</w>")
                body = b"".join(letters[c] for c in token.removesuffix("</w>"))
                if b"\xff" not in body:  # no UTF-8 text has this byte
                    ranks[body + b"\xff" * end] = len(ranks)
                    self.ids.append(number)
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.odd = regex.compile(r"[^!-~¡-ɏ\n]")
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n")
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}  # hash of a word -> its number in first and size
        self.part_ids: dict[str, list[int]] = {}
        self.first, self.size, self.flat = (np.zeros(0, kind) for kind in (np.int64, np.int64, np.uint32))

    def encode(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each word; the words hold no white space of ASCII."""
        joined = "\n".join(words)
        slow = {i for i, w in enumerate(words) if self.odd.search(w)} if self.odd.search(joined) else set()
        known, piece = self.part_ids, self.core.encode_single_piece
        number, ids = 0, []
        for part in self.parts.findall("\n".join("" if i in slow else w for i, w in enumerate(words)).lower() if slow else joined.lower()):
            if part == "\n":
                yield self.of(words[number]) if number in slow else ids
                number, ids = number + 1, []
                continue
            found = known.get(part)
            if found is None:
                found = known[part] = [self.ids[x] for x in piece(part.encode() + b"\xff")]
            ids += found
        yield self.of(words[number]) if number in slow else ids

    def of(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def ids_of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and their number per word."""
        if not words.n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        distinct, at, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.place) > CACHE_WORDS:
            self.clear()
        place = np.fromiter(map(self.place.get, distinct.tolist(), repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(place < 0)
        if len(new):
            each = list(self.encode(words.strings(at[new])))
            size = np.fromiter(map(len, each), np.int64, len(each))
            place[new] = len(self.size) + np.arange(len(new))
            self.place.update(zip(distinct[new].tolist(), place[new].tolist()))
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(each), np.uint32, size.sum())])
        place = place[back]
        counts = self.size[place]
        begin = np.cumsum(counts) - counts
        return self.flat[np.repeat(self.first[place] - begin, counts) + np.arange(counts.sum())], counts


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it shows, else from U+0100 on."""
    shown = [b for b in range(256) if unicodedata.category(chr(b)) not in ("Cc", "Cf", "Zs")]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(docs: DataFrame, path: str, capacity: int, key: str = "doc_id", text: str = "text", end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, ids) of every document; ``ids`` only if asked for."""

    def cut(texts: pa.Array) -> list[pa.Array]:
        words = Words(texts)
        flat, counts = word_ids(path).ids_of(words)
        ends = np.concatenate([[0], np.cumsum(counts)])[words.first]
        rows = []
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
            ids = np.append(flat[lo:hi], np.uint32(end_id)).astype("<u4")
            cuts = [ids[s : s + capacity] for s in range(0, len(ids), capacity)]
            rows.append(
                [
                    {"piece": p, "start": p * capacity, "length": len(c), "ids_crc32": zlib.crc32(c), "ids": c.astype(np.int32) if keep_ids else None}
                    for p, c in enumerate(cuts)
                ]
            )
        kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]))
        return [pa.array(rows, kind)]

    pieces = annotate(docs, text, cut, PIECES, [key]).select(F.col(f"row.`{key}`").alias(key), F.explode("pieces").alias("p"))
    names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    return pieces.select(key, *[F.col(f"p.{n}").alias(n) for n in names])


def _configurations(sizes: Counter, capacity: int) -> Iterator[tuple[list[int], int]]:
    """Sets of sizes and how often each is used, until the stock is gone."""
    left = dict(sizes)
    while left:
        order = sorted(left, reverse=True)
        head = order[0]
        room = capacity - head
        keep = (1 << (room + 1)) - 1
        small = [s for s in order if s <= room]
        sums = [1]
        for _ in range(room // order[-1]):
            nxt = 0
            for s in small:
                nxt |= sums[-1] << s
            sums.append(nxt & keep)
        depth = max(range(len(sums)), key=lambda j: (sums[j].bit_length(), -j))
        rest, chosen = sums[depth].bit_length() - 1, [head]
        for j in range(depth, 0, -1):
            s = next(s for s in small if s <= rest and sums[j - 1] >> (rest - s) & 1)
            chosen.append(s)
            rest -= s
        used = Counter(chosen)
        used = {s: min(k, left[s]) for s, k in used.items()}
        times = min(left[s] // k for s, k in used.items())
        for s, k in used.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
        yield [s for s in sorted(used, reverse=True) for _ in range(used[s])], times


def make_plan(histogram: dict[int, int], capacity: int, large_share: float = 0.125, groups: int = 1024) -> tuple[np.ndarray, int]:
    """Slots (length, first rank, count, first sequence, offset), and the number of sequences."""
    large = sorted((n for n in histogram if n > capacity * large_share), reverse=True)
    total, seen = sum(histogram[n] for n in large), 0
    stock: dict[int, list[list[int]]] = {}
    size, group = 0, -1
    for n in large:
        if seen * groups // total != group:
            group, size = seen * groups // total, n
        stock.setdefault(size, []).append([n, histogram[n]])
        seen += histogram[n]
    used: Counter = Counter()
    slots: list[tuple[int, int, int, int, int]] = []
    rooms: dict[int, list[list[int]]] = defaultdict(list)
    order: list[int] = []
    sequences = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        slots.append((length, used[length], n, first, offset))
        used[length] += n

    def offer(room: int, first: int, n: int) -> None:
        if room and n:
            if not rooms[room]:
                insort(order, room)
            rooms[room].append([first, n])

    for sizes, times in _configurations(Counter({s: sum(c for _, c in x) for s, x in stock.items()}), capacity):
        while times:
            # the same lengths serve as many sequences as the scarcest of them allows
            step, heads, need = times, [], Counter(sizes)
            for s in sizes:
                heads.append(stock[s][0][0])
            for s, k in need.items():
                have = stock[s][0][1]
                if have >= k:
                    step = min(step, have // k)
                else:  # the last few of this length share one sequence with the next length
                    step, heads = 1, None
                    break
            if heads is None:
                heads = []
                for s in sizes:
                    heads.append(stock[s][0][0])
                    _take(stock, s, 1)
            else:
                for s, k in need.items():
                    _take(stock, s, k * step)
            offset = 0
            for i, length in enumerate(heads):
                put(length, step, sequences, offset)
                offset += length
            offer(capacity - offset, sequences, step)
            sequences += step
            times -= step
    for length in sorted((n for n in histogram if n <= capacity * large_share), reverse=True):
        left = histogram[length]
        while left:
            i = bisect_left(order, length)
            if i == len(order):
                more = -(-left // (capacity // length))
                offer(capacity, sequences, more)
                sequences += more
                continue
            room = order[i]
            first, n = rooms[room].pop()
            if not rooms[room]:
                order.pop(i)
            m = min(left, n)
            put(length, m, first, capacity - room)
            offer(room, first + m, n - m)
            offer(room - length, first, m)
            left -= m
    return np.array(sorted(slots), np.int64).reshape(-1, 5), sequences


def _take(stock: dict[int, list[list[int]]], size: int, n: int) -> None:
    stock[size][0][1] -= n
    if not stock[size][0][1]:
        stock[size].pop(0)


def pack(pieces: DataFrame, capacity: int, large_share: float = 0.125, groups: int = 1024) -> DataFrame:
    """Add sequence_id and offset to rows that have a ``length`` from 1 to ``capacity``.

    The histogram has at most ``capacity`` rows and is the only thing the driver sees; the plan's
    slots, a few thousand rows whatever the input, go to the tasks in the function itself.
    """
    ranked = written(with_rank(pieces, ["length"]), "pieces")
    histogram = {r["length"]: r["count"] for r in ranked.groupBy("length").count().collect()}
    slots, _ = make_plan(histogram, capacity, large_share, groups)
    starts = (slots[:, 0] << 44) + slots[:, 1]
    names = [*ranked.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(starts, (length << 44) + rank, "right") - 1
            sequence = slots[i, 3] + rank - slots[i, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(slots[i, 4])], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint").drop("rank")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, key: str = "doc_id", text: str = "text", end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: key, piece, start, length, ids_crc32, sequence_id, offset.

    The tokenizer file at ``path`` must lie at that place on every worker.
    """
    return pack(token_pieces(docs, path, capacity, key, text, end_id, keep_ids), capacity)
