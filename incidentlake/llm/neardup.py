"""MinHash near-dedup with odd sketches.

A document is the set of its distinct shingles (64-bit hashes of runs of ``k`` words; with fewer words
the whole sequence is one). ``BANDS * ROWS`` MinHash samples give ``BANDS`` band keys, and every sample
flips one bit of a bitmap of ``SKETCH_BITS`` (the odd sketch): the population count of the XOR of two
bitmaps tells how many samples differ. Work:

1. Documents with equal sets form a class; only its first row goes on.
2. Every class is linked to the smallest class of each of its band buckets, and to the most similar of
   the classes that its buckets draw by hash, if the odd sketches allow a similarity near the limit and
   the full sets confirm it. Components of these links are formed.
3. In buckets that still hold several components, classes of different components are compared: sizes,
   sketches and an exact bound from the parities of the full sets let through little but true links,
   which the full sets confirm. In a bucket of at most ``CROWD`` such classes that is done in pairs, inside
   the join. Classes of larger buckets (pages of one template that are alike, but not near duplicates) meet
   only where they share a rare shingle: two sets at the limit must share one of the rarest few of each, of
   which more than ``overlap - 1`` are left in both. That holds for every pair, so no bucket has a cap.

At similarity 0.8 a pair shares no bucket with a chance below 1e-7, and the sketch cut is 5.5 standard
deviations away. Null texts and texts without words are linked with nothing. Repeated rows are copies.
Rows with a null id are compared as well; a component's id is its smallest id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlake.llm.graph import components
from incidentlake.llm.tables import written
from incidentlake.llm.words import Words, annotate, mix, windows
from incidentlake.operators.skew import hot_values, spread_join

BANDS, ROWS, SKETCH_BITS, SET_BITS = 32, 4, 256, 1024
CROWD = 64  # classes of a bucket that are compared in pairs
SLOTS = 1 << 20  # counters for the order of shingles, rare ones first; it only decides the speed
HUB = 500  # classes of a component whose names are handed out by several tasks, if it is a large share
PASS_VALUES = 1 << 18  # shingles per numpy pass
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)


def shingles(texts: pa.Array, k: int, lower: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct shingle hashes sorted by row and value, the row of each, and the number of rows."""
    words = Words(texts, lower=lower)
    hashes = words.hashes()
    found, at = windows(hashes, words.doc, k)
    doc = words.doc[at]
    for n in range(1, k):  # rows of fewer words
        short = np.flatnonzero(words.counts == n)
        if len(short):
            whole, place = windows(hashes, words.doc, n)
            mine = np.isin(words.doc[place], short)
            found, doc = np.concatenate([found, whole[mine]]), np.concatenate([doc, words.doc[place[mine]]])
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[new], doc[new], len(words.counts)


def sign(texts: pa.Array, k: int, lower: bool) -> list[pa.Array]:
    """n_shingles, two sums that identify the set, band keys, odd sketch."""
    found, doc, rows = shingles(texts, k, lower)
    n = np.bincount(doc, minlength=rows).astype(np.int64)
    some = np.flatnonzero(n)
    first = np.searchsorted(doc, some)
    sums, bands, sketch = np.zeros((2, rows), np.uint64), np.zeros((rows, BANDS), np.uint64), np.zeros((rows, SKETCH_BITS // 64), np.uint64)
    if len(some):
        for i in range(2):
            sums[i, some] = np.add.reduceat(mix(found + _SEEDS[i]), first)
        for j, seed in enumerate(_SEEDS):
            least = mix(np.minimum.reduceat(found * seed, first) + seed)
            band = j // ROWS
            bands[some, band] = mix(bands[some, band] * np.uint64(31) + least + np.uint64(band + 1))
            bit = (least >> np.uint64(40)) % np.uint64(SKETCH_BITS)
            sketch[some, (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1).view(np.int64)))

    return [pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists(bands), lists(sketch)]


def sketch_cut(percent: int) -> int:
    """Differing bits that a pair at the limit exceeds by chance less than once in ten million."""
    samples, differ = BANDS * ROWS, BANDS * ROWS * (1 - percent / 100)
    keep = (1 - 2 / SKETCH_BITS) ** (2 * differ)
    mean = SKETCH_BITS * (1 - keep) / 2
    slope = -SKETCH_BITS * keep * np.log(1 - 2 / SKETCH_BITS)
    noise = np.sqrt(SKETCH_BITS * (1 - keep**2) / 4 + slope**2 * samples * (percent / 100) * (1 - percent / 100))
    return int(np.ceil(mean + 5.5 * noise))


def _differing(x: Column, y: Column) -> Column:
    """Differing bits of the odd sketches."""
    return sum((F.bit_count(x["sketch"][i].bitwiseXOR(y["sketch"][i])) for i in range(SKETCH_BITS // 64)), F.lit(0))


def _close(x: Column, y: Column, percent: int) -> Column:
    """Whether sizes, odd sketches and set parities (x, y: structs of n, sketch, bits) allow the similarity.

    ``bits`` is the odd sketch of the whole set. A bit that differs stands for at least one shingle that
    only one set has, so this bound never refuses a pair at the limit.
    """
    apart = sum((F.bit_count(x["bits"][i].bitwiseXOR(y["bits"][i])) for i in range(SET_BITS // 64)), F.lit(0))
    size = 100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])
    return size & (_differing(x, y) <= sketch_cut(percent)) & ((100 - percent) * (x["n"] + y["n"]) >= (100 + percent) * apart)


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with their root, of the buckets that hold several components."""
    rooted = members.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("held")).filter("lo <> hi")
    return rooted.join(mixed.select("bucket", "held"), "bucket")


def _slots(shingle: np.ndarray) -> np.ndarray:
    return (mix(shingle) >> np.uint64(44)).astype(np.int64) % SLOTS


def _values(sets: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All shingles, and the number of each row's."""
    return sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64), sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counters of one task."""
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        found, _ = _values(batch.column("set"))
        for lo in range(0, len(found), PASS_VALUES):
            np.add.at(total, _slots(found[lo : lo + PASS_VALUES]), 1)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])


def _rare_first(found: np.ndarray, size: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and shingle of the rarest shingles of each set, one of which any set at the limit must share."""
    row = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((found, often[_slots(found)], row))
    place = np.arange(len(found)) - np.repeat(np.cumsum(size) - size, size)
    needed = size - (percent * size + 99) // 100 + 1
    front = place < needed[row]
    return row[front], place[front], found[order][front]


def _crowded_pairs(crowd: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different roots, of all classes in ``crowd`` (rid, root, set), that can be at the limit.

    Shingles have one order, rare ones first. If the first one that two sets share stands at the places i and
    j, they share at most ``min(n - i, m - j)``; at the limit they share ``percent * (n + m) / (100 + percent)``.
    Places up to that are few, and common shingles are not among them unless both sets hold hardly others.
    """
    spark = crowd.sparkSession
    counts = crowd.select("set").mapInArrow(_counted, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows
    often = np.zeros(SLOTS, np.int64)
    often[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    shared = spark.sparkContext.broadcast(often)

    def fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = _values(batch.column("set"))
            end = np.cumsum(size)
            cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(end // PASS_VALUES)) + 1, len(size)])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                mine = found[end[lo] - size[lo] : end[hi - 1]]
                row, place, shingle = _rare_first(mine, size[lo:hi], shared.value, percent)
                at = pa.array(row + lo)
                left = [batch.column(c).take(at) for c in ("rid", "root")]
                yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), *left, pa.array(size[row + lo]), pa.array(place)], ["h", "rid", "root", "n", "i"])

    front = written(crowd.select("rid", "root", "set").mapInArrow(fronts, "h bigint, rid bigint, root bigint, n bigint, i bigint"), "fronts")
    hot = hot_values(front.groupBy("h").agg(F.count("*").alias("n")), "h")
    small = front.filter((100 + percent) * (F.col("n") - F.col("i")) >= 2 * percent * F.col("n")).withColumnsRenamed({"rid": "a", "root": "root_a", "n": "n_a", "i": "i_a"})
    large = front.withColumnsRenamed({"rid": "b", "root": "root_b", "n": "n_b", "i": "i_b"})
    left = F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
    meet = (
        (F.col("root_a") != F.col("root_b")) & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
        & (100 * F.col("n_a") >= percent * F.col("n_b")) & ((100 + percent) * left >= percent * (F.col("n_a") + F.col("n_b")))
    )
    return spread_join(small, large, "h", "a", hot).filter(meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of the full sets."""
    left = pairs.join(sets.select(F.col("rid").alias("a"), F.col("set").alias("set_a")), "a")
    both = left.join(sets.select(F.col("rid").alias("b"), F.col("set").alias("set_b")), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def near_duplicates(docs: DataFrame, keep: list[str], k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", lower: bool = True) -> DataFrame:
    """The columns ``keep`` in a struct ``row``, with n_shingles, component_id and first_row.

    ``first_row`` holds for one row of each component, one with the smallest id.
    """
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("keep"), F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    signed = annotate(wide, "text", lambda t: sign(t, k, lower), "n bigint, s1 bigint, s2 bigint, bands array<bigint>, sketch array<bigint>", wide.columns)
    signed = written(signed.select("row.*", "n", "s1", "s2", "bands", "sketch").withColumn("rid", F.monotonically_increasing_id()), "signed")

    # 1. classes of equal sets
    smallest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))
    classes = written(signed.filter("n > 0").groupBy("s1", "s2", "n").agg(smallest.alias("x")).select("s1", "s2", "n", F.col("x.rid").alias("cls"), F.col("x.id").alias("cls_id")), "classes")
    heads = signed.join(classes.select(F.col("cls").alias("rid")), "rid", "left_semi")

    # 2. links to two centers of each bucket: the smallest class and one drawn by hash
    banded = written(heads.select("rid", F.explode("bands").alias("bucket")), "bands")
    drawn = F.min(F.struct(F.xxhash64("rid", "bucket").alias("h"), "rid"))
    shared = banded.groupBy("bucket").agg(F.min("rid").alias("center"), drawn.alias("other"), F.count("*").alias("c")).filter("c > 1")
    members = written(banded.join(shared.select("bucket", "center", F.col("other.rid").alias("other")), "bucket"), "members")
    wanted = written(members.select("rid").distinct(), "wanted")
    texts = signed.select("rid", "text").join(wanted, "rid", "left_semi")
    sets = annotate(texts, "text", lambda t: _sets(t, k, lower), "set array<bigint>, bits array<bigint>", ["rid"])
    sets = written(sets.select("row.rid", "set", "bits"), "sets")
    near = written(signed.select("rid", "n", "sketch").join(sets.select("rid", "bits"), "rid").select("rid", F.struct("n", "sketch", "bits").alias("v")), "near")

    pairs = members.filter("rid <> center").select(F.col("center").alias("a"), F.col("rid").alias("b"), F.lit(True).alias("first"))
    pairs = pairs.unionByName(members.filter("rid <> other and other <> center").select(F.col("other").alias("a"), F.col("rid").alias("b"), F.lit(False).alias("first"))).distinct()
    both = pairs.join(near.select(F.col("rid").alias("a"), F.col("v").alias("x")), "a").join(near.select(F.col("rid").alias("b"), F.col("v").alias("y")), "b")
    tried = written(both.filter(_close(F.col("x"), F.col("y"), percent)).select("a", "b", "first", _differing(F.col("x"), F.col("y")).alias("d")), "tried")
    best = tried.filter("not first").groupBy("b").agg(F.min(F.struct("d", "a")).alias("c")).select("c.a", "b")
    links = written(_confirmed(tried.filter("first").select("a", "b").unionByName(best).distinct(), sets, percent), "links")
    roots = components(links)

    # 3. what the bounds allow of the pairs of different components of a bucket
    left = written(_open(members, roots).filter("rid <> center").select("bucket", "rid", "root", "held"), "open")
    few = left.filter(F.col("held") <= CROWD).join(near, "rid")
    a, b = few.alias("p"), few.alias("q")
    meet = (
        (F.col("p.bucket") == F.col("q.bucket")) & (F.col("p.rid") < F.col("q.rid")) & (F.col("p.root") != F.col("q.root"))
        & _close(F.col("p.v"), F.col("q.v"), percent)
    )
    rest = a.join(b, meet).select(F.col("p.rid").alias("a"), F.col("q.rid").alias("b"))
    crowd = left.filter(F.col("held") > CROWD).select("rid", "root").distinct()
    if not crowd.isEmpty():
        met = _crowded_pairs(written(sets.select("rid", "set").join(crowd, "rid"), "crowd"), percent)
        met = met.join(near.select(F.col("rid").alias("a"), F.col("v").alias("x")), "a").join(near.select(F.col("rid").alias("b"), F.col("v").alias("y")), "b")
        rest = rest.unionByName(met.filter(_close(F.col("x"), F.col("y"), percent)).select("a", "b"))
    more = written(_confirmed(rest.distinct(), sets, percent), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    # ids of the components, for every row; a class without links is its own
    least = F.min(F.struct(F.col("cls_id").isNull().alias("none"), F.col("cls_id").alias("id"), F.col("cls").alias("rid"))).alias("best")
    linked = written(classes.join(roots.withColumnRenamed("node", "cls"), "cls"), "linked")
    best = written(linked.groupBy("root").agg(least, F.count("*").alias("n")), "best")
    most = best.agg(F.sum("n")).scalar()
    hot = [r[0] for r in best.filter((F.col("n") >= HUB) & (200 * F.col("n") >= most)).select("root").collect()]  # at most 200
    lone = classes.join(linked.select("cls"), "cls", "left_anti").select("s1", "s2", "n", F.col("cls_id").alias("component_id"), F.col("cls").alias("first_rid"))
    named = spread_join(linked, best.drop("n"), "root", "cls", hot).select("s1", "s2", "n", F.col("best.id").alias("component_id"), F.col("best.rid").alias("first_rid")).unionByName(lone)
    out = signed.select("keep", "id", "n", "s1", "s2", "rid").join(named, ["s1", "s2", "n"], "left")
    lone = F.col("n") == 0
    return out.select(
        F.col("keep").alias("row"), F.col("n").alias("n_shingles"),
        F.when(lone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        (lone | (F.col("rid") == F.col("first_rid"))).alias("first_row"),
    )


def _sets(texts: pa.Array, k: int, lower: bool) -> list[pa.Array]:
    """The shingles of each row, and the odd sketch of all of them."""
    found, doc, rows = shingles(texts, k, lower)
    width = SET_BITS // 64
    bits = np.zeros(rows * width, np.uint64)
    place = (found >> np.uint64(32)).astype(np.int64) % SET_BITS
    np.bitwise_xor.at(bits, doc * width + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    cut = np.searchsorted(doc, np.arange(rows + 1)).astype(np.int32)
    wide = np.arange(rows + 1, dtype=np.int32) * width
    return [pa.ListArray.from_arrays(pa.array(cut), pa.array(found.view(np.int64))), pa.ListArray.from_arrays(pa.array(wide), pa.array(bits.view(np.int64)))]
