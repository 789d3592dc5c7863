"""Random forests grown one level at a time from counts over binned columns.

The method is that of MLlib's ``RandomForestClassifier`` with its defaults: the same split candidates (every category,
and at most 31 cuts of an ordered column, from some 10 000 rows if there are more), Gini gain, the square root of the
features at each node, a Poisson(1) bootstrap, leaves alike merged. Without bootstrap and with all features it gives
MLlib's trees. What differs is the work for a row: MLlib meets a row with every tree through objects, a microsecond at
a time; here a task holds its rows as small integers, column by column, and counts those of a node at once.

How often a tree draws a row follows from a hash of the row's key and the tree, so trees depend neither on the order
of the rows nor on their partitions. Rows with the same key are drawn independently, too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlake.session import materialized

MOST_BINS = 32
LEAST_SAMPLE = 10_000  # rows that cuts are chosen from, at least; MLlib's number
BLOCK_ROWS = 250_000  # rows that a task holds at a time: some 10 MB
MOST_COUNTS = 16_000_000  # that a task holds at a time; trees beyond wait for another pass
_KEY_STEP, _TREE_STEP = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
DRAWS = np.searchsorted(np.round(_POISSON * 65536), np.arange(65536), side="right").astype(np.uint8)  # by 16 random bits


def mix(x: np.ndarray) -> np.ndarray:
    """Finish of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts(values: np.ndarray, most: int = MOST_BINS - 1) -> np.ndarray:
    """At most ``most`` thresholds between the values, as MLlib sets them: a value up to a cut lies left of it."""
    found, counts = np.unique(values, return_counts=True)
    middles = (found[:-1] + found[1:]) / 2.0
    if len(middles) <= most:
        return middles
    stride = counts.sum() / (most + 1)
    seen, target, chosen = counts[0], stride, []
    for i in range(1, len(found)):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target):
            chosen.append(middles[i - 1])
            target += stride
    return np.array(chosen)


@dataclass
class Binning:
    """Columns as small integers: categories by their place in a list (others come last), numbers by the cuts below them."""

    categories: dict[str, list[str]]
    cuts: dict[str, np.ndarray]

    @staticmethod
    def of(rows: DataFrame, n: int, key: str, categorical: list[str], numeric: list[str], seed: int) -> Binning:
        indexed = StringIndexer(inputCols=categorical, outputCols=[f"_{c}" for c in categorical]).fit(rows)
        need = max(MOST_BINS**2, LEAST_SAMPLE)
        some = rows.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n)) < need).select(*[F.col(c).cast("double") for c in numeric])
        table = some.toArrow()
        labels = dict(zip(categorical, map(list, indexed.labelsArray)))
        return Binning(labels, {c: cuts(table[c].to_numpy()) for c in numeric})

    @property
    def columns(self) -> list[str]:
        return [*self.categories, *self.cuts]

    @property
    def sizes(self) -> list[int]:
        return [len(x) + 1 for x in (*self.categories.values(), *self.cuts.values())]

    @property
    def dtype(self) -> np.dtype:
        return np.min_scalar_type(max(self.sizes))

    def features(self) -> list[tuple[int, int]]:
        """(column, category) of each feature; a column of numbers is one feature with category -1."""
        hot = [(c, v) for c, values in enumerate(self.categories.values()) for v in range(len(values) + 1)]
        return hot + [(c, -1) for c in range(len(self.categories), len(self.sizes))]

    def bins(self, arrays: list[pa.Array]) -> np.ndarray:
        """Bins by column and row."""
        out = np.empty((len(arrays), len(arrays[0])), self.dtype)
        for i, (array, values) in enumerate(zip(arrays, self.categories.values())):
            out[i] = pc.fill_null(pc.index_in(array, pa.array(values, array.type)), len(values)).to_numpy(zero_copy_only=False)
        for i, (array, at) in enumerate(zip(arrays[len(self.categories) :], self.cuts.values()), len(self.categories)):
            numbers = pc.cast(array, pa.float64()).to_numpy(zero_copy_only=False)
            if array.null_count or np.isnan(numbers).any():
                raise ValueError(f"null or NaN in {self.columns[i]}")
            out[i] = np.searchsorted(at, numbers, side="left")
        return out


def _encoded(batches: Iterator[pa.RecordBatch], binning: Binning, labels: list[list[str]]) -> Iterator[pa.RecordBatch]:
    """Blocks of (keys, bins, labels) as bytes from rows sorted by their key; the i-th row of a key gets a key of its own."""
    held: list[tuple] = []
    last, times = None, 0

    def block():
        keys, bins, classes = (np.concatenate(x, axis=-1) for x in zip(*held))
        held.clear()
        parts = [pa.array([x.tobytes()], pa.binary()) for x in (keys, bins, classes)]
        return pa.RecordBatch.from_arrays(parts, ["keys", "bins", "classes"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        nth = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        if key[0] == last:
            nth[: first[1] if len(first) > 1 else len(key)] += times
        last, times = key[-1], nth[-1] + 1
        own = mix(key.view(np.uint64) + nth.astype(np.uint64) * np.uint64(_KEY_STEP))
        at = len(binning.sizes) + 1
        classes = np.stack([pc.index_in(batch.column(at + i), pa.array(v)).to_numpy() for i, v in enumerate(labels)]).astype(np.uint16)
        held.append((own, binning.bins(batch.columns[1:at]), classes))
        if sum(len(x[0]) for x in held) >= BLOCK_ROWS:
            yield block()
    if held:
        yield block()


@dataclass
class Grown:
    """Trees of one label under way, nodes numbered as in a heap. An inner node with a column is split: rows of its
    category, or with bins above ``at``, go right. ``counts`` are the drawn rows of each class."""

    column: np.ndarray  # trees x nodes, -1 where not split
    at: np.ndarray
    counts: np.ndarray  # trees x nodes x classes

    @staticmethod
    def empty(trees: int, depth: int, classes: int) -> Grown:
        nodes = 2 ** (depth + 1) - 1
        return Grown(np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes), np.int32), np.zeros((trees, nodes, classes)))


@dataclass
class Level:
    """What tasks need to count and to choose: features tried at each open node of one level, (label, tree) -> node -> features."""

    binning: Binning
    grown: list[Grown]
    open: dict[tuple[int, int], dict[int, list[int]]]
    seed: int
    bootstrap: bool

    def layout(self, label: int, tree: int) -> tuple[dict[int, dict[int, slice]], int]:
        """Where the counts of each open node and column stand, and how many there are."""
        features, sizes, classes = self.binning.features(), self.binning.sizes, self.grown[label].counts.shape[2]
        places: dict[int, dict[int, slice]] = {}
        end = 0
        for node, tried in self.open[label, tree].items():
            places[node] = {}
            for c in sorted({features[f][0] for f in tried}):
                places[node][c] = slice(end, end := end + sizes[c] * classes)
        return places, end

    def drawn(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Rows that each tree draws, and how often."""
        trees = sorted({t for _, t in self.open})
        if not self.bootstrap:
            yield from ((t, np.arange(len(keys)), np.ones(len(keys))) for t in trees)
            return
        hashed = -1
        for t in trees:
            if t // 4 != hashed:  # a hash serves four trees
                hashed = t // 4
                bits = mix(keys + np.uint64((self.seed + 1 + hashed) * _TREE_STEP % 2**64)).view(np.uint16).reshape(-1, 4)
            times = DRAWS.take(bits[:, t % 4])
            rows = np.flatnonzero(times)
            yield t, rows, times.take(rows).astype(np.float64)

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(label, tree, counts) of the blocks of a partition."""
        layouts = {k: self.layout(*k) for k in self.open}
        sums = {k: np.zeros(size) for k, (_, size) in layouts.items()}
        any_rows = False
        for batch in batches:
            for i in range(batch.num_rows):
                any_rows = True
                self._count_block(*(np.frombuffer(c[i].as_buffer(), t) for c, t in zip(batch.columns, (np.uint64, self.binning.dtype, np.uint16))), layouts, sums)
        if any_rows:
            names = ["label", "tree", "counts"]
            label, tree = zip(*sums)
            blobs = [x.astype(np.uint32).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(tree, pa.int32()), pa.array(blobs, pa.binary())], names)

    def _count_block(self, keys, bins, classes, layouts, sums) -> None:
        sizes, ordered_from = self.binning.sizes, len(self.binning.categories)
        bins, classes = bins.reshape(len(sizes), -1), classes.reshape(len(self.grown), -1)
        codes = []
        for y, g in zip(classes, self.grown):
            k = g.counts.shape[2]
            kind = np.min_scalar_type(max(sizes) * k)
            codes.append([(x.astype(kind) * kind.type(k) + y.astype(kind)) for x in bins])
        for tree, drawn, times in self.drawn(keys):
            for label, g in enumerate(self.grown):
                if (label, tree) not in layouts:
                    continue
                places, into = layouts[label, tree][0], sums[label, tree]
                column, at = g.column[tree].tolist(), g.at[tree].tolist()
                waiting = [(0, drawn, times)]
                while waiting:
                    node, rows, weights = waiting.pop()
                    if node in places:
                        for c, place in places[node].items():
                            into[place] += np.bincount(codes[label][c].take(rows), weights, place.stop - place.start)
                    elif (c := column[node]) >= 0:
                        x = bins[c].take(rows)
                        right = x > at[node] if c >= ordered_from else x == at[node]
                        for child, side in ((2 * node + 1, ~right), (2 * node + 2, right)):
                            waiting.append((child, rows.compress(side), weights.compress(side)))

    def choose(self, table: pa.Table) -> pa.Table:
        """Best split of each open node of one tree: (label, tree, node, column, at, left, right); column -1 if none gains."""
        label, tree = table["label"][0].as_py(), table["tree"][0].as_py()
        classes = self.grown[label].counts.shape[2]
        places, size = self.layout(label, tree)
        total = np.zeros(size, np.int64)
        for blob in table["counts"]:
            total += np.frombuffer(blob.as_buffer(), np.uint32)
        features, out = self.binning.features(), []
        for node, tried in self.open[label, tree].items():
            counts = {c: total[place].reshape(-1, classes).astype(np.float64) for c, place in places[node].items()}
            whole = next(iter(counts.values())).sum(axis=0)
            left, tests = [np.zeros((0, classes))], []
            for c, v in (features[f] for f in tried):
                if v < 0:
                    left.append(counts[c].cumsum(axis=0)[:-1])
                    tests += [(c, i) for i in range(len(counts[c]) - 1)]
                else:
                    left.append((whole - counts[c][v])[None])
                    tests.append((c, v))
            best, sides = _best(np.concatenate(left), whole)
            out.append((label, tree, node, *(tests[best] if best >= 0 else (-1, 0)), *(x.tolist() for x in sides)))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), _CHOSEN.types)], schema=_CHOSEN)


    def passes(self) -> Iterator[Level]:
        """The level in parts of as many trees as a task can hold the counts of, one tree at least."""
        part, held = {}, 0
        for k in sorted(self.open, key=lambda k: k[::-1]):
            size = self.layout(*k)[1]
            if part and held + size > MOST_COUNTS:
                yield replace(self, open=part)
                part, held = {}, 0
            part[k] = self.open[k]
            held += size
        if part:
            yield replace(self, open=part)

    def splits(self, blocks: DataFrame) -> list[tuple]:
        """The rows of ``choose`` for all trees of the level."""
        fields = "label int, tree int, node int, column int, at int, left array<double>, right array<double>"

        def found(part: Level) -> list[tuple]:
            counted = blocks.mapInArrow(part.count, "label int, tree int, counts binary")
            return counted.groupBy("label", "tree").applyInArrow(lambda table: part.choose(table), fields).collect()

        return [row for part in self.passes() for row in found(part)]


_CHOSEN = pa.schema([*[(c, pa.int32()) for c in ("label", "tree", "node", "column", "at")], ("left", pa.list_(pa.float64())), ("right", pa.list_(pa.float64()))])


def _gini(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    out = np.ones(len(counts))
    for c in counts.T:
        share = c / total
        out -= share * share
    return out


def _best(left: np.ndarray, whole: np.ndarray) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """The first split of the highest gain with rows on both sides, and its sides; -1 if no split gains."""
    right, n = whole - left, whole.sum()
    n_left, n_right = left.sum(axis=1), right.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = _gini(whole[None], n) - n_left / n * _gini(left, n_left) - n_right / n * _gini(right, n_right)
    gain[(n_left < 1) | (n_right < 1)] = 0.0
    if len(gain) and gain.max() > 0:
        best = int(gain.argmax())
        return best, (left[best], right[best])
    return -1, (whole, np.zeros_like(whole))


class LevelForest:
    """A fitted forest; ``transform`` adds the probabilities of the labels, as MLlib's model does."""

    def __init__(self, binning: Binning, grown: Grown):
        self.binning = binning
        column, counts = grown.column.copy(), grown.counts
        inner, guess = column.shape[1] // 2, counts.argmax(axis=2)
        column[:, inner:] = -1
        for i in reversed(range(inner)):  # two leaves of one answer become one
            a, b = 2 * i + 1, 2 * i + 2
            column[(column[:, a] < 0) & (column[:, b] < 0) & (guess[:, a] == guess[:, b]), i] = -1
        total = counts.sum(axis=2, keepdims=True)
        shares = np.divide(counts, total, out=np.zeros_like(counts), where=total > 0)
        for i in range(inner):  # what lies below a leaf answers as the leaf
            for child in (2 * i + 1, 2 * i + 2):
                shares[column[:, i] < 0, child] = shares[column[:, i] < 0, i]
                column[column[:, i] < 0, child] = -1
        self.leaves = shares[:, inner:]
        tests = np.stack([column[:, :inner], np.where(column < 0, 0, grown.at)[:, :inner]], axis=-1)
        self.tests, test = np.unique(tests.reshape(-1, 2), axis=0, return_inverse=True)
        self.test = test.reshape(tests.shape[:2])

    def probabilities(self, rows: pa.StructArray) -> pa.Array:
        bins, n = self.binning.bins(rows.flatten()), len(rows)
        ordered_from = len(self.binning.categories)
        goes = np.stack([(bins[c] > at if c >= ordered_from else bins[c] == at) & (c >= 0) for c, at in self.tests]).ravel()
        votes, each = np.zeros((n, self.leaves.shape[2])), np.arange(n)
        for test, leaves in zip(self.test * n, self.leaves):
            node = np.zeros(n, np.intp)
            for _ in range(len(leaves).bit_length() - 1):
                node += node + 1 + goes.take(test.take(node) + each)
            votes += leaves.take(node - len(test), axis=0)
        shares = votes / votes.sum(axis=1, keepdims=True)
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * shares.shape[1])
        return pa.ListArray.from_arrays(offsets, pa.array(shares.ravel()))

    def transform(self, df: DataFrame) -> DataFrame:
        def probabilities(rows: pa.Array) -> pa.Array:
            return self.probabilities(rows)

        scored = F.arrow_udf(probabilities, "array<double>")(F.struct(*self.binning.columns))
        return df.withColumn("probability", array_to_vector(scored))


def _tried(features: int, trees: int, seed: int, *node: int) -> list[int]:
    """The features looked at in a node: as many as the root of their number, or all for a single tree."""
    some = features if trees == 1 else math.ceil(math.sqrt(features))
    return list(range(features)) if some == features else np.random.default_rng([seed, *node]).choice(features, some, replace=False).tolist()


def fit(
    rows: DataFrame, n: int, key: str, categorical: list[str], numeric: list[str], labels: dict[str, list[str]],
    trees: int, depth: int, seed: int, bootstrap: bool = True,
) -> dict[str, LevelForest]:
    """A forest per label on ``n`` rows, all rows of a key in one partition. Passes over the levels read their blocks of bins."""
    binning = Binning.of(rows, n, key, categorical, numeric, seed)
    kept = rows.select(F.xxhash64(key).alias("_key"), *binning.columns, *labels)
    encoded = kept.sortWithinPartitions(*kept.columns).mapInArrow(
        partial(_encoded, binning=binning, labels=list(labels.values())), "keys binary, bins binary, classes binary"
    )
    blocks = materialized(encoded)
    grown = [Grown.empty(trees, depth, len(values)) for values in labels.values()]
    features = len(binning.features())
    open_nodes = {(label, t): {0: _tried(features, trees, seed, label, t, 0)} for label in range(len(grown)) for t in range(trees)}
    for level in range(depth):
        if not open_nodes:
            break
        chosen = Level(binning, grown, open_nodes, seed, bootstrap).splits(blocks)
        open_nodes = {}
        for label, t, node, column, at, *sides in chosen:
            g = grown[label]
            if node == 0:
                g.counts[t, 0] = np.add(*sides)
            if column < 0:
                continue
            g.column[t, node], g.at[t, node] = column, at
            for child, side in zip((2 * node + 1, 2 * node + 2), sides):
                g.counts[t, child] = side
                if level + 1 < depth and np.count_nonzero(side) > 1:
                    open_nodes.setdefault((label, t), {})[child] = _tried(features, trees, seed, label, t, child)
    return {label: LevelForest(binning, g) for label, g in zip(labels, grown)}
