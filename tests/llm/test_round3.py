"""Language identification, bisector clustering and periodic runs against brute force, on odd cases too."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import DDL, components, corpus, prose, words_of
from incidentlake.llm import bisector, langid, neardup, runs
from incidentlake.llm.queries import op11_language_id

ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


# periodic runs


def brute_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, q, b) for (a, b), q in found.items())


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def sequences(rng):
    n = rng.randrange(0, 150)
    part = [rng.randrange(30) for _ in range(rng.randrange(1, 40))]
    noise = [rng.randrange(99) for _ in range(rng.randrange(9))]
    return rng.choice([
        [rng.randrange(2) for _ in range(n)], [rng.randrange(40) for _ in range(n)], [bin(i).count("1") % 2 for i in range(n)], fibonacci(n + 1),
        noise + part * rng.randrange(1, 7) + part[: rng.randrange(len(part) + 1)] + noise, [0] * n, [],
        ([0] * rng.randrange(1, 20) + [1]) * rng.randrange(1, 9) + [0] * rng.randrange(40),
    ])


@pytest.mark.parametrize("least", [12, 6, 5, 2])
def test_runs_are_those_of_brute_force(least):
    rng = random.Random(least)
    for _ in range(150):
        made = [sequences(rng) for _ in range(rng.randrange(1, 6))]
        first = np.cumsum([0] + [len(d) for d in made])
        start, end, period = runs.find(np.array([x * 7919 + 13 for d in made for x in d], np.uint64), first, least)
        want = [(a + f, q, b + f) for d, f in zip(made, first.tolist()) for a, q, b in brute_runs(d, least)]
        assert list(zip(start.tolist(), period.tolist(), end.tolist())) == want


def test_transform_is_exact_with_every_prime():
    rng = np.random.default_rng(5)
    blocks = rng.integers(0, 2**20, (3, 64))
    windows = rng.integers(0, 2**20, (3, 191))
    windows[1, 17:81] = blocks[1]
    want = ((blocks[:, None, :] - np.lib.stride_tricks.sliding_window_view(windows, 64, axis=1)) ** 2).sum(axis=2)
    for prime, root in runs.PRIMES:
        got = runs.mismatches(blocks.astype(np.uint64), windows.astype(np.uint64), 128, prime, root)
        assert (got == want % prime).all() and got[1, 17] == 0
        assert all(prime % k for k in range(2, 50_000)) and (prime - 1) % 2**25 == 0


def test_large_word_numbers_need_more_primes():
    """32 * 2**26 squares are beyond the first prime; a sum that is a multiple of it is no match."""
    rng = random.Random(1)
    d = list(range(9000)) + [rng.randrange(9000) for _ in range(500)] * 3
    start, end, period = runs.find(np.array(d, np.uint64) * np.uint64(77), np.array([0, len(d)]))
    assert (9000, 500, 10500) in list(zip(start.tolist(), period.tolist(), end.tolist()))


def brute_row(doc_id, text, loop):
    w = words_of(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if loop and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {k for s, q, e in found for k in range(s + q, e)}
    s, q, e = min(found, key=lambda r: (r[0] - r[2], r[0], r[1]), default=(None, None, None))
    told = "".join(f"{a},{b - a},{p}\n" for a, p, b in found)
    return (
        doc_id, n, len(found), s, e - s if found else None, q, hashlib.sha256(told.encode()).hexdigest(),
        hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest(), [(a, b - a, p) for a, p, b in found],
    )


@pytest.mark.parametrize("loop", [False, True])
def test_run_rows(docs, loop):
    draw = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    got = runs.periodic_runs(docs.withColumn("row", F.lit(1)).withColumn("start", F.lit(2)), ["doc_id", "row", "start"], loop=draw if loop else None)
    rows = [(r.row.doc_id, r.n_words, r.n_runs, r.start, r.length, r.period, r.runs_sha256, r.collapsed_sha256, [tuple(x) for x in r.runs]) for r in got.collect()]
    want = [brute_row(i, t, loop) for i, t, *_ in ROWS if len(t or "") < 20_000]
    assert sorted(map(repr, rows)) == sorted(map(repr, want + [x for x in rows if x[1] > 5000]))
    assert len(rows) == len(ROWS)


def test_runs_without_id_or_rows(spark, empty):
    null_id = spark.createDataFrame([(None, "a b " * 20)], "doc_id bigint, text string")
    draw = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    row = runs.periodic_runs(null_id, ["doc_id"], loop=draw).first()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 0, 40, 2)
    assert runs.periodic_runs(empty, ["doc_id"], loop=draw).collect() == []


def test_runs_of_a_very_long_text_take_near_linear_time():
    d = [0] * 300_000 + [i % 1000 for i in range(100_000)]
    start, end, period = runs.find(np.array(d, np.uint64), np.array([0, len(d)]))
    assert list(zip(start.tolist(), end.tolist(), period.tolist())) == [(0, 300_001, 1), (300_000, 400_000, 1000)]


# bisector clustering


def brute_clusters(rows, k, dims, rounds):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in order[:k]]

    def won():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers)) for _, v in kept]

    for _ in range(rounds):
        who = won()
        for j in range(len(centers)):
            own = [v for (_, v), (_, w) in zip(kept, who) if w == j]
            if own:
                centers[j] = [sum(x) // len(own) for x in zip(*own)]
    who = won()
    total = {j: sum(d for d, w in who if w == j) for j in range(len(centers))}

    def long(x):
        return x if x < 2**63 else None

    return sorted(
        repr((i, w, long(d), long(total[w]) if max(x for x, y in who if y == w) < 2**63 else None, hashlib.sha256(",".join(map(str, centers[w])).encode()).hexdigest()))
        for (i, _), (d, w) in zip(kept, who)
    )


def vectors(rng, n, dims, size):
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * size for _ in range(dims)]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [0.5] * (dims - 1)), (n + 3, [None] + [0.5] * (dims - 1)), (n + 4, [float("nan")] * dims), (n + 5, [float("inf")] + [0.0] * (dims - 1))]
    rows += [(None, [-0.0] * dims), rows[0], rows[0], (n + 6, rows[1][1])]  # repeated rows, equal vectors
    return rows


@pytest.mark.parametrize("size", [0.3, 2.0**17, 2.0**21, 1e30])
def test_clusters_are_those_of_brute_force(spark, size):
    rng = random.Random(int(size))
    rows = vectors(rng, 60, 4, size) + [(1000 + i, [float(rng.randrange(2)) / 64 for _ in range(4)]) for i in range(30)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, hash int").repartition(4)
    got = bisector.cluster(frame, ["vec_id", "cluster", "hash"], k=7, dims=4).collect()
    assert sorted(repr((r.row.vec_id, r.cluster, r.distance, r.cluster_inertia, r.centroid_sha256)) for r in got) == brute_clusters(rows, 7, 4, 3)
    assert len({r.inertia for r in got}) == 1 and all(r.row.cluster == 1 for r in got)


def test_zero_favours_the_smaller_number():
    match = bisector.Tournament.of([[0, 0], [2, 0], [0, 2], [2, 0]], np.float64)
    x = np.array([[1.0, 0.0], [1.0, 1.0], [2.0, 0.0], [2.0, 2.0], [0.0, 1.0]])
    assert match.winners(x).tolist() == [0, 0, 1, 1, 0] and match.distances(x, match.winners(x)).tolist() == [1, 2, 0, 4, 1]


def test_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(5, [1.0, 2.0]), (6, [3.0, 2.0]), (7, None)], "vec_id bigint, embedding array<float>")
    rows = bisector.cluster(frame, ["vec_id"], k=16, dims=2).collect()
    assert sorted(r.distance for r in rows) == [0, 0] and len({r.cluster for r in rows}) == 2
    none = bisector.cluster(frame.filter("vec_id = 7"), ["vec_id"], k=16, dims=2)
    assert none.collect() == [] and {"row", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"} == set(none.columns)


# language identification


def brute_grams(text):
    kept = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    counts = {}
    for word in kept.split():
        for at in range(len(word)):
            counts[word[at]] = counts.get(word[at], 0) + 1
    padded = " " + " ".join(kept.split()) + " " if kept.split() else " "
    for n in (2, 3):
        for at in range(len(padded) - n + 1):
            g = padded[at : at + n]
            if n == 2 or g[1] != " ":
                counts[g] = counts.get(g, 0) + 1
    return {sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g)): n for g, n in counts.items()}


def test_grams_are_counted_whole():
    texts = ["Hello, WORLD 12", "", None, "  ", "naïve Ωμέγα 日本語 x", "a", "...", "ab" * 5000, "İstanbul ßẞ", "\U00010400 z"]
    found = langid.grams(pa.array(texts))
    for r, text in enumerate(texts):
        own = found.row == r
        assert dict(zip(found.code[own].tolist(), found.times[own].tolist())) == brute_grams(text or ""), text
    assert found.lettered.tolist() == [any(c.isalpha() for c in t or "") for t in texts]
    wide = [chr(0x4E00 + i) + chr(0x20000 + i) for i in range(20_000)]  # more letters than one pass holds for all rows
    many = langid.grams(pa.array(["".join(wide[i::8]) for i in range(8)]))
    assert dict(zip(many.code[many.row == 7].tolist(), many.times[many.row == 7].tolist())) == brute_grams("".join(wide[7::8]))


def test_weights_follow_the_regularised_leader():
    """One coordinate and two classes, step by step from the definition."""
    leader = langid.Leader(1, 2, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z, q = [[0.0, 0.0], [0.0, 0.0]], [[0.0, 0.0], [0.0, 0.0]]

    def weight(f, k):
        return 0.0 if abs(z[f][k]) <= 0.1 else -(z[f][k] - np.sign(z[f][k]) * 0.1) / ((1.0 + q[f][k] ** 0.5) / 0.5 + 0.2)

    for x, label in ((1.0, 0), (0.5, 1), (2.0, 0), (1.5, 0)):
        leader.learn(np.array([0, 1]), np.array([x, 1.0]), label)
        w = [[weight(f, k) for k in (0, 1)] for f in (0, 1)]
        odds = [x * w[0][k] + w[1][k] for k in (0, 1)]
        p = [np.exp(o) / sum(np.exp(odds)) for o in odds]
        for f, value in ((0, x), (1, 1.0)):
            for k in (0, 1):
                g = (p[k] - (k == label)) * value
                step = ((q[f][k] + g * g) ** 0.5 - q[f][k] ** 0.5) / 0.5
                z[f][k] += g - step * w[f][k]
                q[f][k] += g * g
    assert np.allclose(leader.weights(), [[weight(f, k) for k in (0, 1)] for f in (0, 1)])


def test_temperature_is_the_likeliest():
    rng = np.random.default_rng(0)
    odds = rng.normal(size=(4000, 3))
    label = np.array([rng.choice(3, p=p) for p in langid.softmax(odds / 2.5)])
    assert abs(langid.best_temperature(odds, label) - 2.5) < 0.3
    assert langid.best_temperature(np.ones((5, 1)), np.zeros(5, int)) > 0


def test_frequencies_count_rows(spark, docs):
    want = {}
    for _, text, *_ in ROWS:
        for code in brute_grams(text or ""):
            want[code] = want.get(code, 0) + 1
    assert {r.code: r.n for r in langid.frequencies(docs, "text").collect()} == want


def test_odd_rows(spark, empty):
    rng = random.Random(2)
    kinds = {"aa": "the and of thing ", "bb": "der die und keit "}
    rows = [(i, "".join(rng.sample(kinds[k].split(" "), 4)) + " " + kinds[k] * rng.randrange(1, 4), k, 1, 2) for i in range(200) for k in [rng.choice(["aa", "bb"])]]
    odd = [(300, None, "aa", 1, 2), (301, "", "bb", 1, 2), (302, "12 ...", "aa", 1, 2), (None, "the and of", "zz", 1, 2), (303, "die und keit " * 50_000, None, 1, 2), rows[0]]
    frame = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string, row int, code int").repartition(3)
    got = langid.identify(frame, ["doc_id", "lang", "row", "code"], F.col("doc_id") % 5 != 0).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.row.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and by_id[300].score == 0
    assert by_id[None].lang_pred == "aa" and by_id[303].lang_pred == "bb"  # "zz" has no key, so it is not learned
    assert all(r.lang_pred == r.row.lang for r in got if r.row.doc_id is not None and r.row.doc_id < 200)
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(empty, ["doc_id"], F.col("doc_id") % 5 != 0).collect() == []
    alone = langid.identify(frame, ["doc_id"], F.col("doc_id") == -1).collect()
    assert {r.lang_pred for r in alone} == {"und"} and len(alone) == len(got)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = op11_language_id(spark, sf).join(truth, "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98


# near duplicates in crowded buckets


def family(rng, n, template, own):
    base = prose(rng, template)
    return [f"{base} {prose(rng, own, 10**7)}" for _ in range(n)]


@pytest.mark.parametrize("k", [2, 5])
def test_rare_shingles_find_what_all_pairs_find(spark, monkeypatch, k):
    monkeypatch.setattr(neardup, "CROWD", 1)
    monkeypatch.setattr(neardup, "HUB", 2)
    rng = random.Random(k)
    texts = family(rng, 40, 80, 14) + family(rng, 30, 60, 8) + [t for t in family(rng, 12, 50, 9) for _ in range(2)] + [None, "", "one"]
    for own in range(0, 30, 2):  # sizes all around the limit, some sets inside others
        words = texts[0].split()
        texts += [" ".join(words[:80] + prose(rng, own, 10**7).split()), " ".join(words[: 94 - own])]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), ["doc_id"], k=k).collect()
    want, _ = components(rows, k, 80)
    assert {r["row"]["doc_id"]: r["component_id"] for r in got} == want
    assert 3 < len(set(want.values())) < len(rows)


def test_rare_first_keeps_one_shared_shingle_of_every_pair_at_the_limit():
    rng = np.random.default_rng(5)
    often = rng.integers(0, 5, neardup.SLOTS)
    for _ in range(300):
        shared, x, y = (int(v) for v in (rng.integers(1, 60), rng.integers(0, 9), rng.integers(0, 9)))
        values = rng.permutation(np.arange(1, 1 + shared + x + y, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sets = [np.sort(values[: shared + x]), np.sort(np.r_[values[:shared], values[shared + x :]])]
        size = np.array([len(s) for s in sets])
        row, place, shingle = neardup._rare_first(np.concatenate(sets), size, often, 80)
        fronts = [dict(zip(shingle[row == r].tolist(), place[row == r].tolist())) for r in (0, 1)]
        met = any(180 * min(size[0] - i, size[1] - fronts[1][h]) >= 80 * size.sum() for h, i in fronts[0].items() if h in fronts[1])
        assert met or 100 * shared < 80 * (shared + x + y)


def test_a_large_template_family_is_compared_by_its_rare_shingles(spark):
    rng = random.Random(6)
    texts = family(rng, 1500, 100, 24)  # alike at 0.67: every page meets every other in some bucket
    near = texts[7].split()
    near[-1] = "changed"
    rows = [(i, t) for i, t in enumerate([*texts, " ".join(near)])]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8), ["doc_id"], k=2).collect()
    assert {r["row"]["doc_id"]: r["component_id"] for r in got} == {**{i: i for i in range(1500)}, 1500: 7}
