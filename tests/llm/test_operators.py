"""Every corpus operator against a brute-force version, on a corpus with all odd cases."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helpers import DDL, ascii_lower, components, corpus, prose, removed_words, words_of
from incidentlake.llm import chat, classifier, decontaminate, lm, neardup, packing, repetition, sharding, substring, urls
from incidentlake.llm.queries import TOKENIZER, url_rules
from incidentlake.llm.words import Words

ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    made.encode_special_tokens = True
    return made


# packing


def test_word_ids_are_the_tokenizers(tokenizer):
    ids = packing.word_ids(public_tokenizers.path(TOKENIZER))
    texts = [t for _, t, *_ in ROWS if t] + ["Ça va? don't STOP 12.5€ naïve ﬁ Σίσυφος ÀÉ i̇ <|endoftext|> \x1f a\u00a0b 日本 \u200b it's we'LL", "İstanbul ŉ ǅ ß"]
    words = Words(pa.array(texts))
    flat, counts = ids.ids_of(words)
    ends = np.concatenate([[0], np.cumsum(counts)])[words.first]
    for text, lo, hi in zip(texts, ends, ends[1:]):
        assert flat[lo:hi].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_every_token_is_reachable_by_its_merges(tokenizer):
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    core = packing.word_ids(public_tokenizers.path(TOKENIZER))
    letters = {c: bytes([b]) for b, c in packing._byte_letters().items()}
    for token, number in vocab.items():
        if token.endswith("</w>") and token not in special:
            body = b"".join(letters[c] for c in token[:-4])
            if b"\xff" not in body:
                assert [core.ids[x] for x in core.core.encode_single_piece(body + b"\xff")] == [number]
                assert [t.id for t in tokenizer.model.tokenize(token[:-4])] == [number]


def test_packing_is_whole_and_tight(docs, tokenizer):
    capacity = 64
    rows = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), capacity, keep_ids=True).collect()
    want = Counter()
    for i, text, *_ in ROWS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), capacity)):
            cut = ids[s : s + capacity]
            want[i, p, s, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()), tuple(cut)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in rows) == want
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= capacity
    assert len(used) <= 1.02 * sum(r["length"] for r in rows) / capacity + 2


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_each_piece_once(seed):
    rng = random.Random(seed)
    histogram = {rng.randrange(1, 257): rng.randrange(1, 400) for _ in range(rng.randrange(1, 120))}
    slots, sequences = packing.make_plan(histogram, 256, groups=rng.choice([4, 20, 500]))
    fill, count = Counter(), Counter()
    for length, rank, n, first, offset in slots.tolist():
        assert count[length] == rank
        count[length] += n
        for s in range(first, first + n):
            fill[s] += length
    assert count == Counter(histogram) and len(fill) == sequences and max(fill.values()) <= 256
    assert sequences >= sum(k * v for k, v in histogram.items()) / 256


def test_packing_nothing(empty):
    assert packing.pack_documents(empty, public_tokenizers.path(TOKENIZER)).collect() == []


# URLs


def test_url_rules(spark):
    cases = [
        (None, "", "", None, "allow"), ("no scheme/net/", "", "", None, "allow"), ("http://A.Net/x", "a.net", "/x", "net/", "block"),
        ("http://net/", "net", "/", "net/", "block"), ("http://anet/x", "anet", "/x", None, "allow"), ("http://a.net", "a.net", "", None, "allow"),
        ("http://b.example.net/en/1?q#z", "b.example.net", "/en/1", "example.net/en/", "allow"), ("http://example.net/EN/", "example.net", "/EN/", "net/", "block"),
        ("http://xexample.com/de/", "xexample.com", "/de/", None, "allow"), ("x://example.com/de/#", "example.com", "/de/", "example.com/de/", "block"),
        ("http://w.org/fr/", "w.org", "/fr/", "org/fr/", "allow"), ("http://cheap-pills.org/fr/", "cheap-pills.org", "/fr/", "org/fr/", "allow"),
        ("http://m.cheap-pills.org/en", "m.cheap-pills.org", "/en", "spam:-pills.", "block"), ("", "", "", None, "allow"),
        ("a?u=http://net/x", "net", "/x", "net/", "block"),
    ]
    df = spark.createDataFrame([(i, c[0], "mine") for i, c in enumerate(cases)], "page_id int, url string, rule string")
    for block in (50_000, 700):
        urls.BLOCK_RULES = block
        got = {r["row"]["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, url_rules()).collect()}
        assert [got[i] for i in range(len(cases))] == [c[1:] for c in cases]


def test_the_block_list(spark):
    """Families of hosts are blocked by their words, whole labels and neighbours are not; repeated, long and no urls."""
    assert len(url_rules()) > 1000
    hosts = {
        "ads-track.example.com": True, "m.casino-win.org": True, "cheap-pills.com": True, "www.free-bets.com": True, "spam-farm.example.com": True,
        "blog.adult-x.com": True, "pokerclub.com": True, "x.casino.com": True, "headset.com": False, "padsx.com": False, "betsy.com": False, "spamalot.org": False,
    }
    paths = {"/banners/1.gif": True, "/a/popunder.js?x": True, "/read/banners": False, "/free-pills.html": True, "/" + "a/" * 50_000: False}
    rows = [(f"http://{h}/", bad) for h, bad in hosts.items()] + [(f"http://plain.org{p}", bad) for p, bad in paths.items()] * 2
    df = spark.createDataFrame([(i, u, "x") for i, (u, _) in enumerate(rows)], "page_id int, url string, verdict string")
    got = {r["row"]["page_id"]: r["verdict"] for r in urls.judge(df, url_rules()).collect()}
    assert got == {i: "block" if bad else "allow" for i, (_, bad) in enumerate(rows)}
    assert urls.judge(df.limit(0), url_rules()).collect() == []


def test_rule_tokens():
    rule = urls.UrlRule("r", "||ads.example.com/*banner^", "block")
    assert rule.tokens() == ["ads", "example", "com"]
    assert urls.RuleIndex([rule, urls.UrlRule("s", "*tracker*", "block")]).best("x.ads.example.com/a-banner/1")[1].name == "r"
    assert urls.RuleIndex([urls.UrlRule("s", "*tracker*", "block")]).best("a.b/mytracker1")[1].name == "s"


# near duplicates


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, k):
    got = neardup.near_duplicates(docs, ["doc_id", "n_words"], k=k).collect()
    want, sizes = components(ROWS, k, 80)
    assert sorted((r["row"]["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted((i, sizes[i], want[i]) for i, *_ in ROWS)
    firsts = Counter(r["component_id"] for r in got if r["first_row"] and r["n_shingles"])
    assert set(firsts.values()) == {1} and set(firsts) == {want[i] for i in want if sizes[i]}


def test_near_copies_of_one_text_keep_every_link(spark):
    rng = random.Random(8)
    base, rows = prose(rng, 150).split(), []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 16)):
            words[rng.randrange(len(words))] = prose(rng, 1, 10**6)
        rows.append((i, " ".join(words)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"], k=2).collect()
    want, _ = components(rows, 2, 80)
    assert {r["row"]["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) > 1


def test_near_duplicates_of_nothing(empty):
    assert neardup.near_duplicates(empty, ["doc_id"]).collect() == []


# repetition


def longest_repeats(w):
    out = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            k = 0
            while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_repeats_are_those_of_all_pairs():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("a b c d".split()) for _ in range(rng.randrange(50))) for _ in range(40)] + ["z " * 70]
    words = Words(pa.array(texts))
    depth = repetition.repeats(words.hashes(), words.doc)
    for text, lo, hi in zip(texts, words.first, words.first[1:]):
        assert depth[lo:hi].tolist() == longest_repeats(text.split())


def test_quality_rules(docs):
    got = repetition.quality(docs, ["doc_id", "text", "n_words"]).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = r["row"]["text"] or ""
        w = words_of(text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
        lines = [x for x in text.split("\n") if words_of(x)]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["kept"] and failed)
        if len(w) > 60 and not failed and len(w) < 1000:
            longest = longest_repeats(w)
            cover = {k for i, n in enumerate(longest) if n >= 8 for k in range(i, i + n)}
            loops = len(cover) > 0.3 * len(w) or max(longest) > 50
            assert r["kept"] == (not loops)


@pytest.mark.parametrize("n,pasted,kept", [(2000, 250, False), (10_000, 1400, False), (10_000, 51, False), (10_000, 50, True), (2000, 0, True)])
def test_a_passage_pasted_twice_into_a_long_text(spark, n, pasted, kept):
    words = [f"w{i}" for i in range(n)]
    words[n // 2 : n // 2 + pasted] = words[100 : 100 + pasted]
    rows = spark.createDataFrame([(1, " ".join(words))], "doc_id int, text string")
    got = repetition.quality(rows, ["doc_id"]).first()
    assert (got["n_words"], got["longest_repeat"], got["base_failed"], got["kept"]) == (n, pasted, False, kept)


def test_quality_of_nothing(empty):
    assert repetition.quality(empty, ["doc_id"]).collect() == []


# decontamination


def test_decontamination(spark, docs):
    rng = random.Random(1)
    passage = ROWS[6][1].split()
    items = [(1, " ".join(passage[5:30])), (2, "Loop THE-loop!"), (10, prose(rng, 25)), (3, None), (4, "?!"), (5, "one"), (6, "one"), (10, " ".join(passage[40:52])), (None, " ".join(passage[33:45]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")

    def plain(text):
        return [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in ascii_lower(text or "")).split()]

    patterns = set()
    for item, text in items:
        w = plain(text)
        n = min(10, len(w))
        patterns |= {(str(item), tuple(w[i : i + n])) for i in range(len(w) - n + 1 if w else 0)}
    for block in (2_000_000, 10):
        decontaminate.BLOCK_WORDS = block
        got = decontaminate.scan(docs, bench, ["doc_id", "text", "n_words"]).collect()
        assert len(got) == len(ROWS)
        for r in got:
            w = plain(r["row"]["text"])
            hit, found = set(), set()
            for item, p in patterns:
                for i in range(len(w) - len(p) + 1):
                    if tuple(w[i : i + len(p)]) == p:
                        found.add(item)
                        hit |= set(range(i, i + len(p)))
            assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(found - {"None"}))  # an item without id hits, but has no name
    assert all(r["n_hit"] == 0 for r in decontaminate.scan(docs, bench.limit(0), ["doc_id"]).collect())


# sharding


def test_sharding(docs):
    rows = sharding.shard_documents(docs, [1.0, 2.0, 1.0], [1.0, 2.0, 1.0, 1.0]).collect()
    text = {i: t or "" for i, t, *_ in ROWS}
    slots = {}
    for r in rows:
        body = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(body) + 1, zlib.crc32(body), "key")
        assert r["grown_shard"] in (r["shard"], 3)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == len(ROWS) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_owner_is_the_smallest_draw(spark):
    """Draws made anew, from the definition, with another implementation of the hash."""
    weights = [1.0, 2.5, 0.5, 1.0]

    def owner(key):
        seed = 42 if key is None else xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
        draws = [xxhash.xxh64(struct.pack("<i", s), seed=seed).intdigest() for s in range(len(weights))]
        return min(range(len(weights)), key=lambda s: (-math.log(((draws[s] >> 11) + 0.5) / (1 << 53)) / weights[s], s))

    keys = [None, 0, -1, 2**62, *range(1, 3000, 7)]
    frame = spark.createDataFrame([(k, "x", 1) for k in keys], "id bigint, text string, slot int")
    got = sharding.assign(frame, "id", weights)
    assert {r["id"]: r["shard"] for r in got.collect()} == {k: owner(k) for k in keys}
    rows = sharding.shard_documents(frame, weights, [*weights, 1.0], key="id").collect()
    assert {r["doc_id"]: r["shard"] for r in rows} == {k: owner(k) for k in keys}
    assert sharding.shard_documents(frame.limit(0), weights, weights, key="id").collect() == []


def test_shards_are_written_as_folders(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"t{i}") for i in range(300)] + [(5, "again")] * 40, "id bigint, text string")
    sharding.write_shards(frame, "id", [1.0, 1.0], str(tmp_path / "shards"), writers=3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    want = {(r["id"], r["text"], r["shard"]) for r in sharding.assign(frame, "id", [1.0, 1.0]).collect()}
    assert {(r["id"], r["text"], r["shard"]) for r in back.collect()} == want and back.count() == 340


def test_weights_hold(spark):
    counts = sharding.assign(spark.range(20_000), "id", [1.0, 3.0]).groupBy("shard").count().collect()
    assert {r["shard"]: round(r["count"] / 20_000, 1) for r in counts} == {0: 0.2, 1: 0.8} or abs(counts[0]["count"] / 20_000 - 0.25) < 0.02 or abs(counts[0]["count"] / 20_000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.owner(F.col("id"), [0.0])


# scoring


def backoff(rows, learn, order, mass):
    """p(word, before) by the definition, from the counts of all runs of the rows to learn from."""
    count = Counter()
    for i, text, *_ in rows:
        if learn(i):
            w = [*words_of(ascii_lower(text or "")), None]
            count.update(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    single = {g[0]: c for g, c in count.items() if len(g) == 1}
    total, distinct = sum(single.values()), len(single)

    def p(word, before):
        if not before:
            return (single.get(word, 0) + 1) / (total + distinct + 1)
        return (count[(*before, word)] + mass * p(word, before[1:])) / (count[before] + mass)

    return p, single, total, distinct


@pytest.mark.parametrize("order,mass,bytes_", [(3, 20.0, {}), (1, 5.0, {}), (2, 0.5, {}), (4, 3.0, {"chunk_bytes": 3000, "part_bytes": 900})])
def test_scoring(docs, order, mass, bytes_):
    rows = lm.score(docs, ["doc_id", "text"], F.col("doc_id") % 2 == 0, order=order, mass=mass, **bytes_).collect()
    p, single, total, distinct = backoff(ROWS, lambda i: i % 2 == 0, order, mass)
    for r in rows:
        w = [*words_of(ascii_lower(r["row"]["text"] or "")), None]
        base = sum(math.log10((single.get(x, 0) + 1) / (total + distinct + 1)) for x in w)
        score = sum(math.log10(p(x, tuple(w[max(0, i - order + 1) : i]))) for i, x in enumerate(w))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in single for x in w), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-9)
    assert len(rows) == len(ROWS) and (order == 1 or sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows))


def test_scoring_learns_runs_of_three_unless_told_otherwise(docs):
    p, *_ = backoff(ROWS, lambda i: i % 2 == 0, 3, 200.0)
    for r in lm.score(docs, ["doc_id", "text"], F.col("doc_id") % 2 == 0).collect():
        w = [*words_of(ascii_lower(r["row"]["text"] or "")), None]
        assert r["score"] == pytest.approx(sum(math.log10(p(x, tuple(w[max(0, i - 2) : i]))) for i, x in enumerate(w)), rel=1e-9)


def test_each_state_is_a_distribution_and_lanes_do_not_matter():
    p, single, *_ = backoff(ROWS, lambda i: True, 3, 20.0)
    words = [w for w in single]
    for before in [(), ("loop",), ("the", "loop"), ("repeat", "me"), ("never", "seen")]:
        assert sum(p(w, before) for w in [*words, "an unknown word"]) == pytest.approx(1, abs=1e-9)
    column = pa.array([t for _, t, *_ in ROWS])
    grams = lm.Grams(column, 3)
    counts = grams.counts(np.ones(len(ROWS), bool))
    single_counts = counts[grams.length == 1]
    model = lm.Automaton(grams, counts, int(single_counts.sum()), len(single_counts), 20.0)
    long = lm.walk(model, grams.first)
    lm.LANE, kept = 5, lm.LANE
    short = lm.walk(model, grams.first)
    lm.LANE = kept
    assert np.allclose(long, short)


def test_rows_without_a_training_mark_are_scored_only(docs):
    half = F.when(F.col("doc_id") % 2 == 0, True)
    marked = {(r["row"]["doc_id"], round(r["score"], 6)) for r in lm.score(docs, ["doc_id"], half).collect()}
    assert marked == {(r["row"]["doc_id"], round(r["score"], 6)) for r in lm.score(docs, ["doc_id"], F.col("doc_id") % 2 == 0).collect()}


def test_scoring_without_training_rows(docs, empty):
    assert all(r["score"] == 0 for r in lm.score(docs, ["doc_id"], F.lit(False)).collect())
    assert lm.score(empty, ["doc_id"], F.lit(True)).collect() == []


# classifier


def labelled(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        kind = ("good", "good", "toxic", "junk")[i % 4]
        text = prose(rng, rng.randrange(30, 120))
        if kind == "toxic":
            text += " you " + rng.choice(["nasty", "vile"]) + " thing"
        if kind == "junk":
            text = "### $$$ " * rng.randrange(20, 60)
        rows.append((i, text, "en", f"s{i % 5}", None, 1))
        if i % 3:
            labels.append((i, 0 if kind == "junk" else 1, int(kind == "toxic")))
    rows += [(1000, None, None, None, None, None), (1001, "", None, "s1", None, None)]
    labels += [(1, None, 0), (None, 1, 0), (5000, 1, 0)]
    return spark.createDataFrame(rows, DDL), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), rows


def test_classifier_on_rows_without_labels(spark):
    docs, labels, rows = labelled(spark)
    got = {r["row"]["doc_id"]: r for r in classifier.classify(docs, labels, ["doc_id", "n_words"]).collect()}
    assert len(got) == len(rows)
    unseen = [i for i in range(0, 400, 3)]
    right = [got[i]["kept"] == (i % 4 < 2) for i in unseen]
    assert np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_weights_of_the_sparse_regression():
    """The gradient of the penalized likelihood is zero at the weights."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 7)) * (rng.random((300, 7)) < 0.4)
    y = (x @ np.arange(-3, 4) + rng.normal(size=300) > 0).astype(float)
    row, column = np.nonzero(x)
    w = classifier.logistic(classifier.Design(row, column, x[row, column], 300, 7), y, l2=0.5)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(x.T @ (p - y) + 0.5 * w[:-1]).max() < 1e-4 and abs((p - y).sum()) < 1e-4


def test_views_exchange_rows_that_they_are_certain_of(spark):
    """One round by brute force: the rows drawn are the certain unlabelled ones with the smallest draws."""
    docs, labels, rows = labelled(spark)
    seen = []
    train = classifier.co_train

    def spy(sample, label, certain, rounds):
        def once(model):
            every = classifier._features(docs.select(F.col("doc_id").cast("string").alias("id"), "text", "source", "lang").withColumn("draw", F.xxhash64("id", "text")))
            views = model.views(classifier.Rows.of(every))
            got = certain(model)
            seen.append((every, [v.copy() for v in views], got))
            return got

        return train(sample, label, once, 1)

    classifier.co_train = spy
    try:
        classifier.fit(docs, labels, given=20)
    finally:
        classifier.co_train = train
    (every, views, got), limit = seen[0], np.log(0.97 / 0.03)
    marked = {str(r.doc_id) for r in labels.where("quality is not null and toxic is not null and doc_id is not null").collect()}
    draws, ids = every["draw"].to_pylist(), every["id"].to_pylist()
    some = 0
    for (view, kind), found in got.items():
        sure = [i for i, z in enumerate(views[view]) if (z >= limit if kind else z <= -limit) and ids[i] not in marked]
        want = classifier.Rows.of(every).take(np.array(sorted(sorted(sure, key=lambda i: draws[i])[:20], key=lambda i: draws[i]), np.int64))
        assert found.keys.tolist() == want.keys.tolist() and found.source == want.source
        some += len(found)
    assert some >= 40


def test_every_source_has_a_weight_of_its_own():
    view = classifier.MetaView()
    rows = classifier.Rows(np.zeros(41, np.int64), np.zeros(0, np.uint64), np.zeros((40, 10)), [f"src{i % 19}" for i in range(38)] + [None, ""], ["_", " "] * 20)
    view.fit(rows, np.array([i % 2 for i in range(40)], float))
    design = view.design(rows)
    assert len(set(design.column[design.row.argsort(kind="stable")][30::32].tolist())) == 21  # 19 sources, null and the empty one
    other = view.design(classifier.Rows(np.zeros(2, np.int64), np.zeros(0, np.uint64), np.zeros((1, 10)), ["new"], [None]))
    assert other.column[-2:].tolist() == [design.width - 2, design.width - 1]


def test_null_labels_are_left_out(spark):
    docs, labels, rows = labelled(spark)
    more = spark.createDataFrame([(i, None, 1) for i in range(0, 400, 4)] + [(i, 0, None) for i in range(1, 400, 4)], labels.schema)
    plain, odd = (classifier.classify(docs, x, ["doc_id"]).collect() for x in (labels, labels.unionByName(more)))
    assert {r["row"]["doc_id"]: r["score"] for r in plain} == pytest.approx({r["row"]["doc_id"]: r["score"] for r in odd})


def test_classifier_without_labels(spark, empty):
    docs, labels, rows = labelled(spark)
    assert classifier.classify(docs, labels.limit(0), ["doc_id"]).filter("kept").count() == len(rows)
    assert classifier.classify(empty, labels, ["doc_id"]).collect() == []


# chat


HARD = ["", "plain", "\\", "<|end|>", "<\\|x|>", "<", "a<|assistant|>b\\", "\n", "### Assistant: </turn>", "é<|image:0|>|>"]


def test_every_text_comes_back():
    rng = random.Random(2)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "a|b\\:", "", "a<", "<", "<|x|>", "end", "\\<"]), "".join(rng.choice(HARD) for _ in range(rng.randrange(4)))) for _ in range(4)]
        made = [chat.format_turn(r, t) for r, t in turns]
        assert [(r, t) for r, t, *_ in chat.parse("".join(m[0] for m in made))] == turns
        for (role, text), (formatted, span, _) in zip(turns, made):
            assert (chat.unescape(formatted[slice(*span)]) == text) if role == "assistant" else span == []


@pytest.mark.parametrize("broken", ["plain", "<|user|>open", "<|user|>a<|end|>rest", "x<|user|>a<|end|>", "<|a<|>b<|end|>"])
def test_what_is_no_turn_raises(broken):
    with pytest.raises(ValueError):
        chat.parse(broken)


def test_typed_parts():
    content = '[{"type":"text","text":"see <|"},{"type":"image","ref":"i.png","width":1024,"height":600},{"type":"audio","ref":"a","seconds":2},{"type":"document","ref":"d","pages":3},{"type":"odd","x":1}]'
    formatted, _, media = chat.format_turn("user", content, typed=True)
    assert formatted == '<|user|>see <\\|<|image:0|><|audio:1|><|document:2|>{"type": "odd", "x": 1}<|end|>'
    assert [(m["kind"], m["ref"], m["tokens"]) for m in media] == [("image", "i.png", 85 + 4 * 170), ("audio", "a", 50), ("document", "d", 1200)]
    assert chat.format_turn("user", "[not json", typed=True)[0] == "<|user|>[not json<|end|>"


def test_conversations_read_back(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, None]), rng.choice(["user", "assistant", None]), rng.choice([*HARD, None]), "x") for _ in range(200)]
    rows += [(9, i, "assistant" if i % 2 else "user", HARD[i % len(HARD)] * 50, "x") for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string").repartition(5)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()) for r in rows if r[0] == conv))
        loss = b"".join(t for *_, role, t in turns if role == b"assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256(b"".join(r + b"\n" + t + b"\n" for *_, r, t in turns)).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss.decode()), hashlib.sha256(loss).hexdigest())
    assert chat.read_back(chat.format_turns(df.limit(0))).collect() == []


# substring dedup


@pytest.mark.parametrize("size", [20, 6])
def test_substring_dedup(docs, size):
    got = substring.remove_repeats(docs, ["doc_id", "n_words"], size=size).collect()
    gone = removed_words(ROWS, size)
    want = Counter()
    for r, (i, text, *_) in enumerate(ROWS):
        w = words_of(text)
        want[i, len(w), sum(gone[r, k] for k in range(len(w))), tuple(x for k, x in enumerate(w) if not gone[r, k])] += 1
    assert Counter((r["row"]["doc_id"], r["n_words"], r["n_removed"], tuple(words_of(r["text"]))) for r in got) == want
    texts = dict((i, t) for i, t, *_ in ROWS)
    assert all(r["text"] == texts[r["row"]["doc_id"]] for r in got if not r["n_removed"])


def test_substring_dedup_of_nothing(empty):
    assert substring.remove_repeats(empty, ["doc_id"]).collect() == []
