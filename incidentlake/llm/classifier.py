"""Quality classifier by co-training of two views.

* content view: the presence of words that tell the classes apart, weighed by logistic regression;
* metadata view: source, language, length and the shape of the page (lines, symbols, capitals, digits).

A document is good if its label has quality 1 and no toxic mark. Both classifiers start from the
labelled rows. In each round all rows of the table are scored by both views inside the tasks; of the rows without
a label of which a view is certain for a class, ``given`` are drawn and join the other view's training set.
Each view is calibrated on labelled rows that it was not fitted on, and the log-odds of both views
are added (less the prior, which both hold). The round whose sum predicts those rows best scores every document.

Bounds hold only for what enters a fit: at most ``max_labelled`` labelled rows, and ``given`` rows for a view, class and
round, both drawn by a hash of the row. Every word above the ratio has a weight, and every source and language that
was seen in a fit; null is a value of its own, and values not seen share one more. Of a label that is repeated,
the worse one counts. Labels that are null in quality or toxic are left out, and their rows count as unlabelled. Null
text is empty. With labels of one class only, or none, everything is kept. Repeated rows get equal scores. A
text of any length is read whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from incidentlake.llm.tables import written
from incidentlake.llm.words import ALNUM_WORDS, SPACE_WORDS, Words, bounded, slices


def _slices(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def shape(words: Words) -> np.ndarray:
    """Numbers on the form of each text, about 0 to 1 each."""
    data, offsets = words.data, words.offsets
    size = np.maximum(np.diff(offsets), 1)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit, space = (data >= 48) & (data <= 57), ~SPACE_WORDS[data]
    mark = ~upper & ~lower & ~digit & ~space & (data < 128)
    n = np.maximum(words.counts, 1)
    lines = _slices(data == 10, offsets) + 1
    symbols = _slices(np.isin(data, list(b"#*$%&|<>")), offsets)
    same = np.zeros(words.n, bool)
    if words.n > 1:
        hashes = words.hashes()
        same[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    repeated = np.bincount(words.doc[same], minlength=len(n))
    parts = (
        np.log1p(words.counts) / 10, np.log1p(lines) / 5, lines / n, _slices(upper, offsets) / size, _slices(digit, offsets) / size,
        _slices(mark, offsets) / size, symbols / n, np.minimum(size / n, 40) / 10, repeated / n, words.counts < 20,
    )
    return np.column_stack(parts).astype(np.float64)


@dataclass
class Design:
    """A sparse matrix by its entries."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    rows: int
    width: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.rows)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], self.width)


def logistic(x: Design, y: np.ndarray, l2: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights with the intercept last, by Newton steps whose equations are solved by conjugate gradients."""
    w, ridge = np.zeros(x.width + 1), np.append(np.full(x.width, l2), 1e-6)

    def odds(v: np.ndarray) -> np.ndarray:
        return x.dot(v[:-1]) + v[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.append(x.back(r), r.sum())

    def loss(v: np.ndarray) -> float:
        z = odds(v)
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + (ridge * v * v).sum() / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(odds(w), -30, 30)))
        gradient, weight = back(p - y) + ridge * w, np.maximum(p * (1 - p), 1e-6)
        step, r = np.zeros_like(w), -gradient
        d, size = r.copy(), r @ r
        for _ in range(200):
            if size <= 1e-12 * (gradient @ gradient) + 1e-18:
                break
            q = back(weight * odds(d)) + ridge * d
            rate = size / (d @ q)
            step, r = step + rate * d, r - rate * q
            fresh = r @ r
            d, size = r + fresh / size * d, fresh
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))  # where all rows are far from the border, a full step leads astray
        while (after := loss(w + step)) > now and np.abs(step).max() >= 1e-7:
            step /= 2
        if after > now:
            break
        w, now = w + step, after
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Rows:
    """Features of some rows: distinct words of each (``keys`` from ``start`` on), shape, source, language."""

    start: np.ndarray
    keys: np.ndarray
    form: np.ndarray
    source: list[str | None]
    lang: list[str | None]

    @classmethod
    def of(cls, table: pa.Table) -> Rows:
        keys, form = (table[c].combine_chunks() for c in ("keys", "form"))
        start = np.concatenate([[0], np.cumsum(np.diff(keys.offsets.to_numpy()))]).astype(np.int64)
        return cls(start, keys.flatten().to_numpy().view(np.uint64), form.flatten().to_numpy().reshape(len(table), -1), table["source"].to_pylist(), table["lang"].to_pylist())

    def __len__(self) -> int:
        return len(self.source)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(self)), np.diff(self.start)), self.keys

    def take(self, which: np.ndarray) -> Rows:
        size = np.diff(self.start)[which]
        place = np.repeat(self.start[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return Rows(np.concatenate([[0], np.cumsum(size)]), self.keys[place], self.form[which], [self.source[i] for i in which], [self.lang[i] for i in which])

    def plus(self, other: Rows) -> Rows:
        return Rows(
            np.concatenate([self.start, other.start[1:] + self.start[-1]]), np.concatenate([self.keys, other.keys]),
            np.vstack([self.form, other.form]), self.source + other.source, self.lang + other.lang,
        )


class ContentView:
    """Words chosen by their log-likelihood ratio, as 0 or 1 for each document."""

    def __init__(self, least_docs: int = 3, least_ratio: float = 12.0):
        self.least, self.ratio = least_docs, least_ratio
        self.keys, self.weights = np.zeros(0, np.uint64), np.zeros(1)

    def design(self, rows: Rows) -> Design:
        doc, keys = rows.words()
        i = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        hit = self.keys[i] == keys if len(self.keys) else np.zeros(len(i), bool)
        return Design(doc[hit], i[hit], np.ones(hit.sum()), len(rows), len(self.keys))

    def fit(self, rows: Rows, y: np.ndarray) -> None:
        doc, keys = rows.words()
        words, back = np.unique(keys, return_inverse=True)
        good, all_ = y.sum(), len(y)
        in_good = np.bincount(back, y[doc], len(words))
        seen = np.bincount(back, minlength=len(words)).astype(float)
        table = np.stack([in_good, seen - in_good, good - in_good, all_ - good - seen + in_good])
        expected = np.stack([seen * good, seen * (all_ - good), (all_ - seen) * good, (all_ - seen) * (all_ - good)]) / all_
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * np.nansum(np.where(table > 0, table * np.log(table / expected), 0.0), axis=0)
        self.keys = words[(seen >= self.least) & (ratio >= self.ratio)]
        self.weights = logistic(self.design(rows), y, l2=0.1)

    def odds(self, rows: Rows) -> np.ndarray:
        return self.design(rows).dot(self.weights[:-1]) + self.weights[-1]


class MetaView:
    """Shape with its squares and roots, and one place for each source and language seen, null, and any other."""

    def __init__(self):
        self.places: dict[tuple[str, str | None], int] = {}
        self.width, self.weights = 0, np.zeros(1)

    def design(self, rows: Rows) -> Design:
        dense = np.hstack([rows.form, rows.form**2, np.sqrt(np.abs(rows.form))])
        n, wide = dense.shape
        places = [[wide + self.places.get((kind, v), len(self.places) + at) for v in values] for at, (kind, values) in enumerate((("source", rows.source), ("lang", rows.lang)))]
        row = np.concatenate([np.repeat(np.arange(n), wide), np.arange(n), np.arange(n)])
        column = np.concatenate([np.tile(np.arange(wide), n), *[np.array(p, np.int64) for p in places]])
        return Design(row, column, np.concatenate([dense.reshape(-1), np.ones(2 * n)]), n, wide + len(self.places) + 2)

    def fit(self, rows: Rows, y: np.ndarray) -> None:
        seen = sorted({("source", v) for v in rows.source} | {("lang", v) for v in rows.lang}, key=lambda k: (k[0], k[1] is not None, k[1] or ""))
        self.places = {k: i for i, k in enumerate(seen)}
        self.weights = logistic(self.design(rows), y)

    def odds(self, rows: Rows) -> np.ndarray:
        return self.design(rows).dot(self.weights[:-1]) + self.weights[-1]


@dataclass
class Model:
    content: ContentView
    meta: MetaView
    scales: list[np.ndarray] = field(default_factory=lambda: [np.array([1.0, 0.0])] * 2)  # calibration: slope and intercept
    prior: float = 0.0

    def views(self, rows: Rows) -> list[np.ndarray]:
        """Calibrated log-odds of both views."""
        return [z * s[0] + s[1] for z, s in zip((self.content.odds(rows), self.meta.odds(rows)), self.scales)]

    def odds(self, rows: Rows) -> np.ndarray:
        a, b = self.views(rows)
        return a + b - self.prior

    def calibrate(self, rows: Rows, y: np.ndarray) -> None:
        base = np.array([0.0, np.log(y.mean() / (1 - y.mean()))])
        lines = [Design(np.arange(len(y)), np.zeros(len(y), np.int64), z, len(y), 1) for z in (self.content.odds(rows), self.meta.odds(rows))]
        fitted = [logistic(line, y, l2=1e-2) for line in lines]
        self.scales = [scale if scale[0] > 0 else base for scale in fitted]

    def loss(self, rows: Rows, y: np.ndarray) -> float:
        z = self.odds(rows)
        return float(np.mean(np.logaddexp(0, z) - y * z))


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    hashes = words.hashes()
    order = np.lexsort((hashes, words.doc))
    doc, keys = words.doc[order], hashes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], keys[new]


def co_train(sample: Rows, label: np.ndarray, certain: Callable[[Model], dict[tuple[int, int], Rows]], rounds: int = 3) -> Model:
    """``certain`` gives, for a view and a class (0 or 1), unlabelled rows of which the calibrated view is certain.

    A fifth of the labelled rows is kept for the calibration, and to tell which round's model predicts best: rows
    that one view is sure of may mislead the other where it can't see what they have in common.
    """
    place = np.arange(len(sample))
    held, own = place[place % 5 == 0], place[place % 5 != 0]
    train = [(sample.take(own), label[own].astype(float))] * 2
    kept, y = sample.take(held), label[held].astype(float)
    good = np.clip(label.mean(), 1e-3, 1 - 1e-3)

    def fitted() -> Model:
        model = Model(ContentView(), MetaView(), prior=float(np.log(good / (1 - good))))
        model.content.fit(*train[0])
        model.meta.fit(*train[1])
        if 0 < y.sum() < len(y):
            model.calibrate(kept, y)
        return model

    models = [fitted()]
    for _ in range(rounds):
        found = certain(models[-1])
        for (view, kind), rows in found.items():
            before, marks = train[1 - view]
            train[1 - view] = before.plus(rows), np.concatenate([marks, np.full(len(rows), float(kind))])
        if not any(len(rows) for rows in found.values()):
            break
        models.append(fitted())
    return min(models, key=lambda model: model.loss(kept, y)) if len(y) else models[-1]


def _measured(texts: pa.Array, row: pa.Array) -> Rows:
    words = Words(texts, ALNUM_WORDS, True)
    doc, keys = distinct_words(words)
    return Rows(np.searchsorted(doc, np.arange(len(texts) + 1)), keys, shape(Words(texts)), row.field("source").to_pylist(), row.field("lang").to_pylist())


def _features(rows: DataFrame) -> pa.Table:
    """Features of rows that enter a fit, with their other columns, in the order of their draw."""

    def measure(texts: pa.Array, row: pa.Array) -> list[pa.Array]:
        made = _measured(texts, row)
        wide = np.arange(len(made) + 1, dtype=np.int32) * made.form.shape[1]
        return [
            pa.ListArray.from_arrays(pa.array(made.start.astype(np.int32)), pa.array(made.keys.view(np.int64))),
            pa.ListArray.from_arrays(pa.array(wide), pa.array(made.form.reshape(-1))),
        ]

    kept = [c for c in rows.columns if c != "text"]
    out = _annotated(rows, measure, "keys array<bigint>, form array<double>", kept).select("row.*", "keys", "form")
    return out.toArrow().sort_by([("draw", "ascending"), ("id", "ascending")])


def fit(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 4_000, given: int = 250, rounds: int = 3, sure: float = 0.97,
    key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
) -> Model | None:
    """The model, or None if the labelled rows are not of two classes."""
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    marked = labels.where("quality is not null and toxic is not null").select(F.col(key).cast("string").alias("id"), good.alias("good")).dropna()
    marked = marked.groupBy("id").agg(F.min("good").alias("good"))
    n = marked.count()
    few = marked.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_labelled / max(n, 1))))
    rows = docs.select(*[F.col(f"`{c}`").cast("string").alias(name) for c, name in ((key, "id"), (text, "text"), (source, "source"), (lang, "lang"))])
    rows = rows.withColumn("draw", F.xxhash64("id", "text"))
    # at most max_labelled rows (and the drawing's deviation) of two values, so they may go to every task
    sample = _features(rows.join(F.broadcast(few), "id"))
    label = sample["good"].to_numpy().astype(np.int64)
    if len(np.unique(label)) < 2:
        return None
    limit = float(np.log(sure / (1 - sure)))

    def certain(model: Model) -> dict[tuple[int, int], Rows]:
        """Of all rows without label and certain to a view, ``given`` with the smallest draws for each view and class.

        A task names twice as many of its own at most, since some may have labels; only names are sent.
        """

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least: dict[tuple[int, int], list] = {(v, k): [] for v in (0, 1) for k in (0, 1)}
            for batch in batches:
                row, texts = batch.columns
                for lo, hi in slices(texts):
                    part = row.slice(lo, hi - lo)
                    part = pa.StructArray.from_arrays(part.flatten(), part.type.names)
                    odds = model.views(_measured(texts.slice(lo, hi - lo), part))
                    draws, ids = part.field("draw").to_numpy(zero_copy_only=False), part.field("id").to_pylist()
                    for view, kind in least:
                        at = np.flatnonzero(odds[view] >= limit if kind else odds[view] <= -limit)
                        fresh = [(int(draws[i]), ids[i]) for i in at]
                        least[view, kind] = heapq.nsmallest(2 * given, least[view, kind] + fresh, key=lambda x: (x[0], x[1] or ""))
            found = [(view, kind, draw, i) for (view, kind), some in least.items() for draw, i in some]
            if found:
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate(kinds)], ["view", "kind", "draw", "id"])

        wide = bounded(rows).select(F.struct("id", "draw", "source", "lang").alias("row"), "text")
        named = written(wide.mapInArrow(name, "view int, kind int, draw bigint, id string").join(marked, "id", "left_anti"), "certain")
        chosen: dict[int, list[tuple[int, int]]] = {}
        for view in (0, 1):
            for kind in (0, 1):
                own = named.where((F.col("view") == view) & (F.col("kind") == kind)).select("draw").distinct().orderBy("draw").limit(given)
                for r in own.collect():  # at most ``given``
                    chosen.setdefault(r.draw, []).append((view, kind))
        if not chosen:
            return {}
        table = _features(rows.where(F.col("draw").isin(list(chosen))).dropDuplicates(["draw"]))
        made, draws = Rows.of(table), table["draw"].to_pylist()
        return {(v, k): made.take(np.array([i for i, d in enumerate(draws) if (v, k) in chosen[d]], np.int64)) for v in (0, 1) for k in (0, 1)}

    return co_train(Rows.of(sample), label, certain, rounds)


def _annotated(df: DataFrame, fn, fields: str, keep: list[str]) -> DataFrame:
    """Like ``annotate`` for functions that also look at the kept columns."""

    def run(batches):
        for batch in batches:
            row, texts = batch.columns
            for lo, hi in slices(texts):
                part = row.slice(lo, hi - lo)
                columns = pa.StructArray.from_arrays(part.flatten(), part.type.names)
                yield pa.RecordBatch.from_arrays([part, *fn(texts.slice(lo, hi - lo), columns)], names)

    made = bounded(df).select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text"))
    names = ["row", *StructType.fromDDL(fields).names]
    return made.mapInArrow(run, f"row {made.schema['row'].dataType.simpleString()}, {fields}")


def classify(docs: DataFrame, labels: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", **bounds: int) -> DataFrame:
    """The columns ``keep`` in a struct ``row``, with score (probability of a good document) and kept."""
    model = fit(docs, labels, key=key, text=text, source=source, lang=lang, **bounds)
    wide = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("keep"), F.col(f"`{source}`").cast("string").alias("source"),
        F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"),
    )
    if model is None:
        return wide.select(F.col("keep").alias("row"), F.lit(1.0).alias("score"), F.lit(True).alias("kept"))

    def judge(texts: pa.Array, row: pa.Array) -> list[pa.Array]:
        return [pa.array(1 / (1 + np.exp(-np.clip(model.odds(_measured(texts, row)), -500, 500))))]

    out = _annotated(wide, judge, "score double", ["keep", "source", "lang"])
    return out.select(F.col("row.keep").alias("row"), "score", (F.col("score") >= 0.5).alias("kept"))
