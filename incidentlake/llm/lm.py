"""Language-model scoring with a weighted backoff automaton.

Training counts every run of 1 to ``order`` tokens (words, and the end of each text); none is left out,
so the model grows with the corpus. Every run that occurs is an arc, and every run of fewer than
``order`` tokens that occurs is a state:

    p(w)     = (c(w) + 1) / (N + V + 1)                          in the empty state
    p(w | s) = (c(s w) + mass * p(w | fail(s))) / (c(s) + mass)  if s has an arc for w
    p(w | s) = rest(s) * p(w | fail(s))                          else; the failure arc weighs rest(s) = mass / (c(s) + mass)

The failure arc of a state leads to the state of its last words, one fewer. The probabilities of all known
words and of one unknown word sum to 1 in every state. A text is read once from left to right: the state
follows its arc for the next token, or else failure arcs whose weights are added, until there is one.

No task holds the whole automaton. Runs of one length after the other, each chunk of texts sends its distinct
runs once, as gaps of sorted 64-bit hashes with the counts of its training rows, cut into ranges; the part that
holds a range adds up the counts of all chunks and answers each one. A chunk then has the exact weights of all
states and arcs that its texts can reach, and walks them. A run that a third of all texts hold is one entry a
chunk. The shuffle files of one length are removed before the next is sent.
A chunk takes ``chunk_bytes`` of text on average, or one longer text; a part takes the runs of all lengths of
``part_bytes`` of text, and so those of one length of ``order`` times as much.

Two different runs share a hash with a chance of about 2**-63. Null texts are empty and score their end
only. Repeated rows count and are scored as often as they occur. Rows where ``training`` is null are not
learned from. With an empty training set every token is unknown: N = V = 0 and each has probability 1.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlake.llm.chunks import blobs, chunk_table, planes, split, unplanes
from incidentlake.llm.tables import shuffles_removed, written
from incidentlake.llm.words import Words, windows

END = np.uint64(0x5851F42D4C957F2D)  # stands for the end of a text
CHUNK_BYTES, PART_BYTES = 4 << 20, 2 << 20
LANE = 256
_COUNT, _TOTAL = 4, 6  # bytes of a chunk's count and of the corpus's


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and ends of all rows, the row of each, and the first token of each row."""
    words = Words(texts, lower=True)
    rows = len(words.counts)
    first = words.first + np.arange(rows + 1)
    hashes = np.full(first[-1], END, np.uint64)
    hashes[np.arange(words.n) + words.doc] = words.hashes()
    return hashes, np.repeat(np.arange(rows), np.diff(first)), first


class Grams:
    """The runs of 1 to ``order`` tokens inside the rows, numbered by length, then by their sorted distinct keys.

    ``at[k, i]`` is the run of k + 1 tokens that ends with token i, or -1 where the row is too short;
    ``length`` and ``last`` are a run's number of tokens and the token that one of its places ends with.
    """

    def __init__(self, texts: pa.Array, order: int):
        hashes, self.row, self.first = tokens(texts)
        self.at = np.full((order, len(hashes)), -1)
        length, last, n = [], [], 0
        for k in range(1, order + 1):
            key, start = windows(hashes, self.row, k)
            keys, place, back = np.unique(key, return_index=True, return_inverse=True)
            self.at[k - 1, start + k - 1] = back + n
            length.append(np.full(len(keys), k))
            last.append(start[place] + k - 1)
            n += len(keys)
        self.length, self.last = np.concatenate(length), np.concatenate(last)

    def counts(self, learned: np.ndarray) -> np.ndarray:
        """How often each run occurs in the rows to learn from."""
        here = learned[self.row]
        return sum(np.bincount(at[here & (at >= 0)], minlength=len(self.length)) for at in self.at)


class Automaton:
    """States and arcs that some texts can reach; a state is the run that it stands for, ``empty`` the last one."""

    def __init__(self, grams: Grams, counts: np.ndarray, total: int, distinct: int, mass: float):
        order, n = len(grams.at), len(grams.length)
        self.at, self.empty, self.arc = grams.at, n, counts > 0
        self.base = float(np.log10(total + distinct + 1))
        p, self.fail = np.zeros(n), np.full(n, n)
        for k in range(1, order + 1):
            mine = np.flatnonzero(grams.length == k)
            end = grams.last[mine]
            if k == 1:
                p[mine] = (counts[mine] + 1) / (total + distinct + 1)
            else:
                state, shorter = grams.at[k - 2, end - 1], grams.at[k - 2, end]
                p[mine] = (counts[mine] + mass * p[shorter]) / (counts[state] + mass)
                self.fail[mine] = shorter
        self.weight, self.rest = np.log10(p), np.log10(mass / (counts + mass))
        self.next = np.where(grams.length < order, np.where(self.arc, np.arange(n), n), self.fail)
        self.length = np.append(grams.length, 0)

    def follow(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight (log10) of each token in its state, and the next state."""
        weight, out = np.zeros(len(state)), np.zeros(len(state), np.int64)
        here, todo = state.copy(), np.arange(len(state))
        while len(todo):
            s = here[todo]
            arc = self.at[self.length[s], token[todo]]
            found = self.arc[arc] | (s == self.empty)
            weight[todo[found]] += self.weight[arc[found]]
            out[todo[found]] = self.next[arc[found]]
            todo, s = todo[~found], s[~found]
            weight[todo] += self.rest[s]
            here[todo] = self.fail[s]
        return weight, out


def walk(model: Automaton, first: np.ndarray) -> np.ndarray:
    """The log10 probability of each text; ``first`` is the first token of each, and the end.

    Texts are cut into lanes that all advance one token a step. A lane starts as many tokens early as a
    state remembers, without adding anything for them.
    """
    size = np.diff(first)
    lanes = -(-size // LANE)
    text = np.repeat(np.arange(len(size)), lanes)
    begin = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
    stop = np.minimum(begin + LANE, first[text + 1])
    at = np.maximum(begin - len(model.at) + 1, first[text])
    state, score = np.full(len(text), model.empty), np.zeros(len(text))
    live = np.arange(len(text))
    while len(live):
        here = at[live]
        weight, state[live] = model.follow(state[live], here)
        score[live] += np.where(here >= begin[live], weight, 0.0)
        at[live] += 1
        live = live[at[live] < stop[live]]
    return np.bincount(text, score, len(size))


def _send(table: pa.Table, length: int, parts: int) -> pa.Table:
    """The distinct runs of ``length`` tokens of a chunk, and their counts, for each part."""
    hashes, row, _ = tokens(table["text"])
    key, start = windows(hashes, row, length)
    keys, back = np.unique(key, return_inverse=True)
    counts = np.bincount(back[table["train"].to_numpy()[row[start]]], minlength=len(keys))
    number, before = table["chunk"][0].as_py(), (length - 1) * parts
    return blobs([(before + p, number, planes(np.diff(keys[lo:hi], prepend=np.uint64(0)), 8) + planes(counts[lo:hi], _COUNT)) for p, lo, hi in split(keys, 64, parts)], ("part", "chunk"))


def _add(table: pa.Table, length: int) -> pa.Table:
    """The corpus's counts for each chunk; of single tokens, the first row has the part's distinct ones and all."""
    sent = table["blob"].to_pylist()
    sizes = [len(b) // (8 + _COUNT) for b in sent]
    keys, back = np.unique(np.concatenate([np.cumsum(unplanes(b[: 8 * n], 8)) for b, n in zip(sent, sizes)]), return_inverse=True)
    counts = np.concatenate([unplanes(b[8 * n :], _COUNT) for b, n in zip(sent, sizes)])
    total = np.bincount(back, counts.astype(np.float64), len(keys)).astype(np.int64)
    single = total if length == 1 else total[:0]
    answers = np.split(total[back], np.cumsum(sizes)[:-1])
    none = [0] * (len(sent) - 1)
    return pa.table({
        "chunk": table["chunk"], "part": table["part"], "blob": pa.array([planes(a, _TOTAL) for a in answers], pa.binary()),
        "words": pa.array([int((single > 0).sum()), *none], pa.int64()), "tokens": pa.array([int(single.sum()), *none], pa.int64()),
    })


def _score(docs: pa.Table, answers: pa.Table, order: int, total: int, distinct: int, mass: float) -> pa.Table:
    grams = Grams(docs["text"], order)
    counts = np.concatenate([unplanes(b, _TOTAL) for b in answers.sort_by("part")["blob"].to_pylist()]).astype(np.int64)
    model = Automaton(grams, counts, total, distinct, mass)
    seen, size = counts[grams.at[0]], np.diff(grams.first)
    return pa.table({
        "row": docs["row"], "n_tokens": pa.array(size), "n_known": pa.array(np.bincount(grams.row[seen > 0], minlength=len(size))),
        "train_tokens": pa.array(np.full(len(size), total)),
        "base_score": pa.array(np.bincount(grams.row, np.log10(seen + 1), len(size)) - size * model.base),
        "score": pa.array(walk(model, grams.first)),
    })


def _counted(table: DataFrame, length: int, parts: int) -> DataFrame:
    sent = table.groupBy("chunk").applyInArrow(lambda t: _send(t, length, parts), "part int, chunk int, blob binary")
    added = sent.groupBy("part").applyInArrow(lambda t: _add(t, length), "chunk int, part int, blob binary, words bigint, tokens bigint")
    return written(added, "counts")


def score(
    docs: DataFrame, keep: list[str], training: Column, text: str = "text", order: int = 3, mass: float = 200.0,
    chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Learn from the rows where ``training`` holds and score all rows.

    The columns ``keep`` in a struct ``row``, with n_tokens, n_known, train_tokens, base_score, score.
    """
    if order < 1 or mass <= 0:
        raise ValueError("order must be at least 1 and mass above 0")
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    chunks, parts = max(8, -(-size // chunk_bytes)), max(4, -(-size // (order * part_bytes)))
    with shuffles_removed(docs.sparkSession):
        table = chunk_table(docs.select(
            F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"),
            F.coalesce(training, F.lit(False)).alias("train"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int").alias("chunk"),
        ), chunks)
        each = [_counted(table.select("chunk", "text", "train"), k, parts) for k in range(1, order + 1)]
    answers = reduce(DataFrame.unionByName, each)
    distinct, total = each[0].agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    made = table.schema["row"].dataType.simpleString()
    return table.select("chunk", "row", "text").groupBy("chunk").cogroup(answers.select("chunk", "part", "blob").groupBy("chunk")).applyInArrow(
        lambda d, a: _score(d, a, order, total, distinct, mass),
        f"row {made}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
