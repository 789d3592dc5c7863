"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlake.llm import bisector, chat, classifier, decontaminate, langid, lm, neardup, packing, repetition, runs, sharding, substring, urls

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"

#: Host and path rules of the URL query.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

# Words of the method's own block list. A host is blocked if a label begins with a topic, or has one between or behind
# hyphens, or is a topic and a noun in one; an address is blocked by the folders that serve advertisements.
SPAM_TOPICS = (
    "ads", "adserver", "adult", "advert", "affiliate", "banner", "bet", "bets", "betting", "bingo", "blackjack", "cams", "casino", "cashback",
    "cialis", "clickbait", "coupons", "cracked", "dating", "doorway", "escort", "erotic", "fakes", "forexbot", "gambling", "giveaway", "hacked",
    "hentai", "hookup", "jackpot", "keygen", "linkfarm", "loans", "lottery", "malware", "miner", "nude", "payday", "pharma", "phish", "pills",
    "pirated", "poker", "popunder", "porn", "roulette", "scam", "sexcam", "slots", "spam", "spyware", "streamz", "torrentz", "track", "tracker",
    "viagra", "warez", "webcams", "winnings", "xxx",
)
SPAM_NOUNS = (
    "bonus", "city", "club", "deals", "farm", "hub", "king", "land", "live", "mania", "online", "palace", "planet", "play", "plus", "pro", "rush",
    "shop", "spin", "star", "store", "win", "world", "zone",
)
AD_FOLDERS = ("adserver", "adframe", "banners", "popunder", "doubleclick", "clicktrack")

#: A conversation whose texts hold control strings of common templates.
HARD_CONVERSATION = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    placed = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), CAPACITY)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def url_rules() -> list[urls.UrlRule]:
    """The given rules, and some two thousand patterns against spam and advertisements."""
    patterns = [shape.format(t) for t in SPAM_TOPICS for shape in ("||{}.", "||{}-", "-{}.", "-{}-")]
    patterns += [f"||{t}{n}." for t in SPAM_TOPICS for n in SPAM_NOUNS]
    patterns += [shape.format(f) for f in AD_FOLDERS for shape in ("/{}/", "/{}.*^")]
    return [urls.host_rule(name, verdict) for name, verdict in URL_RULES] + [urls.UrlRule(f"spam:{p}", p, "block") for p in patterns]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(read(spark, sf_dir, "pages"), url_rules(), keep=["page_id"])
    rule = F.when(~F.col("rule").startswith("spam:"), F.col("rule"))
    return judged.select("row.page_id", "host", "path", rule.alias("rule"), "verdict")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(read(spark, sf_dir, "documents"), ["doc_id"], k=2, percent=80)
    return found.select("row.doc_id", "n_shingles", "component_id", F.col("row.doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition.quality(read(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), [1.0] * 8, [1.0] * 9)


def op7_backoff_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    scored = lm.score(docs, ["doc_id", "held_out"], ~F.col("held_out"))
    return scored.select("row.doc_id", "row.held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ["doc_id"])
    return judged.select("row.doc_id", "score", "kept")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = spark.createDataFrame(HARD_CONVERSATION, "conv_id bigint, turn bigint, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    return chat.read_back(chat.format_turns(rows))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(read(spark, sf_dir, "documents"), ["doc_id"])
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return cut.select("row.doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    fifth = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    found = langid.identify(read(spark, sf_dir, "documents"), ["doc_id"], fifth != 0)
    own = F.pmod(F.crc32(F.col("row.doc_id").cast("string").cast("binary")), F.lit(5))
    return found.select("row.doc_id", F.coalesce(own == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op12_bisector_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bisector.cluster(read(spark, sf_dir, "embeddings"), ["vec_id"])
    return found.select("row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = runs.periodic_runs(read(spark, sf_dir, "documents"), ["doc_id"], loop=draw)
    exponent = F.expr("1000 * length div period").alias("exponent_milli")
    return found.select("row.doc_id", "n_runs", "start", "length", "period", exponent, "runs_sha256", "collapsed_sha256")


_QUERIES = (
    op1_best_fit_packing, op2_url_filters, op3_minhash_near_dedup, op4_quality_rules, op5_benchmark_decontamination,
    op6_rendezvous_sharding, op7_backoff_scoring, op8_quality_classifier, op9_chat_formatting, op10_substring_dedup,
    op11_language_id, op12_bisector_clustering, op13_periodic_runs,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _QUERIES}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE_WORDS = r"[^\x20\x09-\x0D]+"

#: crc32 of the decimal doc_id: eight shifts for each byte
_CRC_OF_ID = """xor(4294967295, list_reduce(
                    list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
                    lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))))"""


def _clustering_sql(k: int = 16, dims: int = 64, rounds: int = 3) -> str:
    """Rounds of plain nearest centroids over all pairs of vector and centroid."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        won{r} as materialized (
            select n, vec_id, v, cluster, distance from (
                select kept.*, cluster, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) as distance
                from kept cross join centers{r})
            qualify row_number() over (partition by n order by distance, cluster) = 1)""")
        steps.append(f"""
        centers{r + 1} as materialized (
            select cluster, coalesce(m, c) as c from centers{r} left join (
                select cluster, list(((s - ((s % z) + z) % z) // z)::bigint order by i) as m
                from (select cluster, i, sum(v[i]) as s, count(*) as z from won{r}, range(1, {dims + 1}) t(i) group by 1, 2)
                group by 1) using (cluster))""")
    return f"""
        with kept as materialized (
            select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v
            from embeddings
            where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims}),
        centers0 as materialized (
            select row_number() over (order by h, v) - 1 as cluster, v as c
            from (select sha256('1:' || coalesce(vec_id::varchar, '')) as h, v from kept order by h, v limit {k})),{",".join(steps[:-1])}
        select vec_id, cluster::int as cluster, distance::bigint as distance,
               (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
               sha256(array_to_string(c, ',')) as centroid_sha256
        from won{rounds} join centers{rounds} using (cluster)"""


ORACLES: dict[str, str] = {
    "op2_url_filters": rf"""
        with parts as (
            select page_id, coalesce({_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') as host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
            from pages),
        ruled as (
            select *, case
                when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
                when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
                when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
                when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
            from parts)
        select page_id, host, path, rule, case
            when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
            when regexp_matches(split_part(host || path, '/', 1), '(^|[.-])({"|".join(SPAM_TOPICS)})[.-]') and host <> '' then 'block'
            when regexp_matches(path, '-({"|".join(SPAM_TOPICS)})[.-]') and host <> '' then 'block'
            when regexp_matches(host, '(^|\.)({"|".join(SPAM_TOPICS)})({"|".join(SPAM_NOUNS)})\.') then 'block'
            when regexp_matches(path, '/({"|".join(AD_FOLDERS)})(/|\.)') and host <> '' then 'block'
            else 'allow' end as verdict
        from ruled""",
    "op3_minhash_near_dedup": rf"""
        with recursive words as (
            select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACE_WORDS}') as w from documents),
        sets as (
            select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w
                else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
            from words),
        each as materialized (select doc_id, unnest(s) as x from sets),
        shared as (
            select a.doc_id as a, b.doc_id as b, count(*) as n
            from each a join each b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
        links as materialized (
            select a, b from shared join sets p on p.doc_id = a join sets q on q.doc_id = b
            where 100 * n >= 80 * (len(p.s) + len(q.s) - n)),
        ways as materialized (select a, b from links union select b, a from links),
        reach as (
            select doc_id as a, doc_id as b from documents
            union select reach.a, ways.b from reach join ways on ways.a = reach.b)
        select sets.doc_id, len(s)::bigint as n_shingles, min(b) as component_id, sets.doc_id = min(b) as kept
        from sets join reach on reach.a = sets.doc_id group by sets.doc_id, s""",
    "op5_benchmark_decontamination": rf"""
        with words as (
            select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        items as (
            select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        patterns as materialized (
            select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as p
            from items, unnest(range(1, len(w) - least(10, len(w)) + 2)) as t(i) where len(w) > 0),
        sizes as (select distinct n from patterns),
        runs as (
            select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as p
            from words, sizes, unnest(range(1, len(w) - n + 2)) as t(i)),
        found as materialized (select doc_id, i, runs.n, item_id from runs join patterns on runs.p = patterns.p and runs.n = patterns.n),
        hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from found) group by doc_id),
        named as (
            select doc_id, count(x) as n_items, string_agg(x, ',' order by x) as ids
            from (select distinct doc_id, item_id::varchar as x from found) group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
               sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from words left join hit using (doc_id) left join named using (doc_id)""",
    "op9_chat_formatting": r"""
        with rows as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '\### Assistant: </turn> ok'
            union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
        select conv_id, count(*)::bigint as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
               coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
               sum(length(replace(replace(replace(replace(role, '\', '\\'), '|', '\|'), ':', '\:'), '<', '\<')) + 4
                   + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 7)::bigint as formatted_chars
        from rows group by conv_id""",
    "op10_substring_dedup": rf"""
        with words as (
            select doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE_WORDS}') as w from documents),
        runs as materialized (
            select doc_id, i, array_to_string(w[i:i + 19], ' ') as r from words, unnest(range(1, len(w) - 18)) as t(i)),
        later as (select doc_id, i from runs qualify row_number() over (partition by r order by doc_id, i) > 1),
        gone as materialized (select distinct doc_id, unnest(range(i, i + 20)) as k from later),
        each as (select doc_id, k, w[k] as x from words, unnest(range(1, len(w) + 1)) as t(k)),
        kept as (
            select doc_id, string_agg(x, ' ' order by k) as s, count(*) as n
            from each anti join gone using (doc_id, k) group by doc_id)
        select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(s, '')) as kept_sha256
        from words left join kept using (doc_id)""",
    "op12_bisector_clustering": _clustering_sql(),
    # a run of 12 words or more shares 6 words or more with itself, one period later
    "op13_periodic_runs": rf"""
        with plain as (
            select row_number() over () as r, doc_id, crc, regexp_extract_all(coalesce(text, ''), '{_SPACE_WORDS}') as w
            from (select *, {_CRC_OF_ID} as crc from documents)),
        draws as (
            select *, len(w) as n, case when crc % 10 = 0 and len(w) > 0 then (crc // 10) % len(w) end as a, 3 + (crc // 10) % 8 as m from plain),
        texts as materialized (
            select r, doc_id, n, case when a is null then w else
                list_transform(range(0, n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // m) end]) end as w
            from draws),
        sixes as materialized (select r, n, i, array_to_string(w[i + 1:i + 6], ' ') as x from texts, range(0, n - 5) t(i)),
        pairs as (
            select a.r, a.i, b.i - a.i as q from sixes a join sixes b on a.r = b.r and a.x = b.x and b.i > a.i and 2 * (b.i - a.i) <= a.n),
        stretches as (
            select r, q, min(i) as s, max(i) + 6 + q as e
            from (select *, i - row_number() over (partition by r, q order by i) as g from pairs) group by r, q, g),
        runs as materialized (
            select r, s, e - s as len, min(q) as q from stretches where e - s >= greatest(12, 2 * q) group by r, s, e),
        gone as (select distinct r, unnest(range(s + q, s + len)) as k from runs),
        listed as (
            select r, count(*) as n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as told,
                   arg_min({{'s': s, 'len': len, 'q': q}}, (-len, s, q)) as best
            from runs group by r),
        kept as (
            select r, string_agg(w[k + 1], ' ' order by k) as body
            from (select r, w, unnest(range(0, n)) as k from texts) anti join gone using (r, k) group by r)
        select doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.s::bigint as start, best.len::bigint as length, best.q::bigint as period,
               (1000 * best.len // best.q)::bigint as exponent_milli, sha256(coalesce(told, '')) as runs_sha256,
               sha256(coalesce(body, '')) as collapsed_sha256
        from texts left join listed using (r) left join kept using (r)""",
}
