"""Language of texts: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the runs of one to three characters inside the words of a text, with a space before and behind
each word; letters are lower-cased, marks belong to words, and all else counts as a space. A run is
numbered by its code points themselves (three of 21 bits), so no two share a feature. A run that occurs
n times weighs ``(1 + ln n) * idf``, and the weights of a text have length 1.

Document frequencies are counted over all rows to learn from. The classifier is fitted on at most
``max_labelled`` of them (and the drawing's deviation), the same number of each language as far as there are
that many, chosen by a hash of the key. It follows the regularised leader: each coordinate keeps its gradients'
sum and squares, and its weight is their proximal solution under an elastic net, exactly 0 where the sum stays under
``l1``. A fifth of the rows is not fitted; on these a temperature is chosen that makes the predicted
probabilities as likely as can be.

Rows without key, text or language are not learned from. A text that is null or has no letter gets ``und``
with score 0, and so does every text if there is nothing to learn from. Ties go to the language that sorts
first. A text of any length is read whole. Repeated rows get equal answers.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlake.llm.words import annotate, slices, text_buffers
from incidentlake.session import local_table

UNDETERMINED = "und"
_POINTS, _SPACE = 0x110000, 32
_MERGE, _SEND = 1 << 21, 1 << 20  # runs that a task collects before it adds them up, and before it sends them on


@lru_cache(1)
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: what it counts as (lower case, or a space), and whether it is a letter."""
    fold, letter = np.full(_POINTS, _SPACE, np.uint32), np.zeros(_POINTS, bool)
    for point in range(_POINTS):
        kind = unicodedata.category(chr(point))[0]
        if kind in "LM":
            small = chr(point).lower()
            fold[point] = ord(small) if len(small) == 1 else point
            letter[point] = kind == "L"
    return fold, letter


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffers(texts)
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        rows = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets, offsets[1:])]
        return np.concatenate([*rows, np.zeros(0, np.uint32)]), np.cumsum([0, *map(len, rows)])
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, heads[offsets]


@dataclass
class Grams:
    """Distinct runs of each row, ordered by row: ``row``, ``code`` and how often; and which rows have a letter."""

    row: np.ndarray
    code: np.ndarray
    times: np.ndarray
    lettered: np.ndarray


def grams(texts: pa.Array) -> Grams:
    fold, letter = _folding()
    points, offsets = _code_points(texts)
    rows = len(offsets) - 1
    found = np.concatenate([[0], np.cumsum(letter[points], dtype=np.int64)])
    lettered = found[offsets[1:]] > found[offsets[:-1]]
    # each row with a space before and behind, and one space at a time
    row = np.repeat(np.arange(rows), np.diff(offsets) + 2)
    line = np.full(len(row), _SPACE, np.uint32)
    line[np.arange(len(points)) + 2 * np.repeat(np.arange(rows), np.diff(offsets)) + 1] = fold[points]
    keep = np.ones(len(line), bool)
    keep[1:] = (line[1:] != _SPACE) | (line[:-1] != _SPACE) | (row[1:] != row[:-1])
    line, row = line[keep], row[keep]
    # letters of this slice numbered from 1; a run is up to three such numbers and its row
    alphabet = np.flatnonzero(np.bincount(line, minlength=1))
    bits = int(len(alphabet)).bit_length()
    if rows > 1 and 3 * bits + rows.bit_length() > 62:
        a, b = grams(texts.slice(0, rows // 2)), grams(texts.slice(rows // 2))
        parts = ((a.row, b.row + rows // 2), (a.code, b.code), (a.times, b.times), (a.lettered, b.lettered))
        return Grams(*(np.concatenate(p) for p in parts))
    number = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.int64)
    number[alphabet] = np.arange(1, len(alphabet) + 1)
    s, place, blank = number[line], row.astype(np.int64) << (3 * bits), line == _SPACE
    two = row[1:] == row[:-1]
    three = (row[2:] == row[:-2]) & ~blank[1:-1]
    keys = np.concatenate([
        (place + s)[~blank],
        (place[1:] + (s[:-1] << bits) + s[1:])[two],
        (place[2:] + (s[:-2] << (2 * bits)) + (s[1:-1] << bits) + s[2:])[three],
    ])
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    back, mask = np.concatenate([[0], alphabet]).astype(np.int64), (1 << bits) - 1
    code = (back[(keys >> (2 * bits)) & mask] << 42) | (back[(keys >> bits) & mask] << 21) | back[keys & mask]
    return Grams(keys >> (3 * bits), code, times, lettered)


def frequencies(docs: DataFrame, text: str) -> DataFrame:
    """(code, n): in how many rows each run occurs. Tasks add up what they see, so frequent runs are no hot keys."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            own, n = np.unique(np.concatenate(waiting or [np.zeros(0, np.int64)]), return_counts=True)
            both, back = np.unique(np.concatenate([codes, own]), return_inverse=True)
            return both, np.bincount(back, np.concatenate([times, n]), len(both)).astype(np.int64)

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(times)], ["code", "n"])

        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                found = grams(batch.column(0).slice(lo, hi - lo)).code
                waiting.append(found)
                size += len(found)
                if size >= _MERGE:
                    codes, times = merged()
                    waiting, size = [], 0
                    if len(codes) >= _SEND:
                        yield sent()
                        codes, times = codes[:0], times[:0]
        codes, times = merged()
        yield sent()

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "code bigint, n bigint")
    return parts.groupBy("code").agg(F.sum("n").alias("n"))


class Leader:
    """Follow-the-regularised-leader weights of a multinomial logistic regression."""

    def __init__(self, features: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        # the last feature is the intercept
        self.sums, self.squares = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.sums[at]
        step = (self.beta + np.sqrt(self.squares[at])) / self.alpha + self.l2
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0) / step

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        odds = x @ w
        p = np.exp(odds - odds.max())
        p /= p.sum()
        p[label] -= 1.0
        gradient = x[:, None] * p
        squares = self.squares[at] + gradient**2
        self.sums[at] += gradient - (np.sqrt(squares) - np.sqrt(self.squares[at])) / self.alpha * w
        self.squares[at] = squares


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # sorted
    idf: np.ndarray
    weights: np.ndarray  # (codes and the intercept, languages)
    temperature: float = 1.0

    def features(self, found: Grams, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in ``codes``, weight) of the runs that the model knows; weights of a row have length 1."""
        i = np.minimum(np.searchsorted(self.codes, found.code), max(len(self.codes) - 1, 0))
        hit = self.codes[i] == found.code if len(self.codes) else np.zeros(len(i), bool)
        row, i = found.row[hit], i[hit]
        x = (1.0 + np.log(found.times[hit])) * self.idf[i]
        size = np.sqrt(np.bincount(row, x * x, rows))
        return row, i, x / size[row]

    def odds(self, found: Grams, rows: int) -> np.ndarray:
        row, i, x = self.features(found, rows)
        columns = [np.bincount(row, x * self.weights[i, k], rows) for k in range(len(self.languages))]
        return np.column_stack(columns) + self.weights[-1]

    def predict(self, texts: pa.Array) -> list[pa.Array]:
        found = grams(texts)
        p = softmax(self.odds(found, len(texts)) / self.temperature)
        best = p.argmax(axis=1)
        names = np.where(found.lettered, np.array(self.languages, object)[best], UNDETERMINED)
        return [pa.array(names.tolist(), pa.string()), pa.array(np.where(found.lettered, p.max(axis=1), 0.0))]


def softmax(odds: np.ndarray) -> np.ndarray:
    p = np.exp(odds - odds.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def best_temperature(odds: np.ndarray, label: np.ndarray) -> float:
    """Where the labels are likeliest, between 1/50 and 50, by golden sections of its logarithm.

    One row more than there are is taken to have another label, so rows without any error don't make it 0.
    """
    n, classes = odds.shape
    wish = np.full(odds.shape, 1 / (n + 2) / max(classes - 1, 1))
    wish[np.arange(n), label] = 1 - (classes > 1) / (n + 2)

    def loss(t: float) -> float:
        z = odds / np.exp(t)
        top = z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z - top).sum(axis=1)) + top[:, 0] - (z * wish).sum(axis=1)))

    ratio, lo, hi = (5**0.5 - 1) / 2, -np.log(50.0), np.log(50.0)
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _sample(rows: DataFrame, max_labelled: int) -> tuple[list[str], pa.Table]:
    """Languages, and the runs of the rows drawn."""
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    each = max(1, max_labelled // max(1, len(languages)))
    shares = local_table(
        rows.sparkSession, [(name, i, min(1 << 30, (each << 30) // counts[name])) for i, name in enumerate(languages)], "lang string, label int, most bigint"
    )
    drawn = rows.join(shares, "lang").withColumn("draw", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).filter("draw < most")

    def runs(texts: pa.Array) -> list[pa.Array]:
        found = grams(texts)
        cut = pa.array(np.searchsorted(found.row, np.arange(len(texts) + 1)), pa.int32())
        return [pa.ListArray.from_arrays(cut, pa.array(found.code)), pa.ListArray.from_arrays(cut, pa.array(found.times, pa.int32()))]

    drawn = drawn.select("text", "draw", "id", F.xxhash64("text").alias("same"), "label")
    made = annotate(drawn, "text", runs, "codes array<bigint>, times array<int>", ["draw", "id", "same", "label"])
    return languages, made.select("row.*", "codes", "times").toArrow().sort_by([(c, "ascending") for c in ("draw", "id", "same", "label")])


def fit(
    docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", max_labelled: int = 6_000, epochs: int = 2,
    alpha: float = 1.0, beta: float = 1.0, l1: float = 0.2, l2: float = 0.05,
) -> Model | None:
    """The model, or None if there is no row to learn from."""
    rows = docs.filter(learn).select(
        F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")
    ).dropna()
    languages, sample = _sample(rows, max_labelled)
    if not len(sample):
        return None
    label = sample["label"].to_numpy().astype(np.int64)
    lists = sample["codes"].combine_chunks()
    cut = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))]).astype(np.int64)
    found = Grams(np.repeat(np.arange(len(label)), np.diff(cut)), lists.flatten().to_numpy(), sample["times"].combine_chunks().flatten().to_numpy(), np.zeros(0, bool))
    codes = np.unique(found.code)
    counted = rows.sparkSession.createDataFrame(pa.table({"code": codes})).join(frequencies(rows, "text"), "code").toArrow()
    n = np.zeros(len(codes))
    n[np.searchsorted(codes, counted["code"].to_numpy())] = counted["n"].to_numpy()
    total = rows.count()
    model = Model(languages, codes, np.log((1.0 + total) / (1.0 + n)) + 1.0, np.zeros(0))
    _, i, x = model.features(found, len(label))
    leader = Leader(len(codes), len(languages), alpha, beta, l1, l2)
    held = np.arange(len(label)) % 5 == 4
    for _ in range(epochs):
        for r in np.flatnonzero(~held):
            part = slice(cut[r], cut[r + 1])
            leader.learn(np.append(i[part], len(codes)), np.append(x[part], 1.0), label[r])
    model.weights = leader.weights()
    if held.any():
        model.temperature = best_temperature(model.odds(found, len(label))[held], label[held])
    return model


def identify(docs: DataFrame, keep: list[str], learn: Column, text: str = "text", **options) -> DataFrame:
    """The columns ``keep`` in a struct ``row``, lang_pred and score (its probability); no shuffle of texts.

    ``learn`` tells the rows that may be learned from; ``options`` go to ``fit``.
    """
    model = fit(docs, learn, text=text, **options)

    def predict(texts: pa.Array) -> list[pa.Array]:
        if model is None:
            return [pa.array([UNDETERMINED] * len(texts), pa.string()), pa.array([0.0] * len(texts))]
        return model.predict(texts)

    return annotate(docs, text, predict, "lang_pred string, score double", keep)
