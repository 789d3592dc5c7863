"""Vulnerability to threat mapping by token rules.

Rules that fit into a broadcast go to the texts, which are searched for all tokens at once, batch by batch, and
never shuffled for it. A larger table of rules meets the texts in an equi-join: every token is filed under the
rarest of its three-character pieces, counted over all texts, and a text looks up only the pieces it has. The few
candidates are then checked in full. Pieces and tokens that many texts share are spread over tasks.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlake import fixed_values as V
from incidentlake.operators import tokensearch
from incidentlake.operators.skew import fits, hot_values, numbered, sized, spread_join
from incidentlake.session import local_table, materialized

GRAM = 3


def vulnerability_text() -> Column:
    return F.lower(F.concat_ws(" ", "asset_type", "vulnerability_code", "title", "description"))


def _hit(text: Column, tokens: list[str]) -> Column:
    found = F.lit("*" in tokens)
    for token in tokens:
        if token != "*":
            found = found | F.contains(text, F.lit(token.lower()))
    return found


def map_vulnerabilities(
    vulnerabilities: DataFrame, rules: DataFrame, fallback_threat: str | None = V.FALLBACK_THREAT, wildcard_fallback=False
) -> DataFrame:
    """Add ``matches``, the ordered list of (threat, score, reason, method) per vulnerability.

    Strategies are the rules of other threats than ``fallback_threat``; where none hits, the first rule of that
    threat is tried (with ``wildcard_fallback`` its first rule with a ``*`` token). Per threat the last rule
    that hits wins; threats are ordered by score, then the number of their first rule that hits, then name. Rules
    without a threat or number and null tokens are left out, no rule at all gives empty lists, and rules that share a
    number are ordered by a hash of their contents. A null score sorts first.
    """
    rules = rules.where("threat_id is not null").withColumn("tokens", F.array_compact(F.coalesce("tokens", F.array().cast("array<string>"))))
    rules = rules.withColumn("rule_ord", F.col("rule_ord").cast("int")).where("rule_ord is not null")
    contents = F.struct("threat_id", "tokens", "match_score", "reason", "recommendation_method")
    rules = rules.withColumn("_details", F.xxhash64(F.to_json(contents)))
    own = rules.where(F.col("threat_id") == F.lit(fallback_threat))
    if wildcard_fallback:
        own = own.where(F.array_contains("tokens", "*"))
    fallback = own.orderBy("rule_ord", "_details").take(1)
    keyed = vulnerabilities.withColumn("_text", vulnerability_text()).withColumn("_key", F.unhex(F.sha2("_text", 256)))
    rows = match_rows(keyed.select("_key", "_text").distinct(), rules.where(~F.col("threat_id").eqNullSafe(F.lit(fallback_threat))))
    found = F.struct("threat_id", "match_score", "reason", "recommendation_method")
    entry = F.struct((-F.col("match_score")).alias("by_score"), "first_ord", F.col("threat_id").alias("by_name"), found.alias("found"))
    lists = rows.groupBy("_key").agg(F.sort_array(F.collect_list(entry)).alias("_ranked"))
    df = keyed.join(lists, "_key", "left").withColumn("matches", F.col("_ranked.found"))
    for rule in fallback:
        spare = F.array(
            F.struct(
                F.lit(rule.threat_id).alias("threat_id"), F.lit(rule.match_score).cast("double").alias("match_score"),
                F.lit(rule.reason).alias("reason"), F.lit(rule.recommendation_method).alias("recommendation_method"),
            )
        )
        df = df.withColumn("matches", F.coalesce("matches", F.when(_hit(F.col("_text"), rule.tokens), spare)))
    empty = F.array().cast(df.schema["matches"].dataType)
    return df.withColumn("matches", F.coalesce("matches", empty)).drop("_text", "_key", "_ranked")


def _pieces(text: Column, sizes: list[int]) -> Column:
    """Distinct pieces of a text of the given lengths; the empty one for length 0."""
    parts = [F.array(F.lit("")) if n == 0 else F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]
    return F.array_distinct(F.concat(*parts))


def match_rows(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(_key, threat_id, match_score, reason, recommendation_method, first_ord): the rule that wins per text and threat.

    A token can only occur in a text that contains all of its pieces, so it waits under the rarest piece; a token
    with a piece that no text has is dropped. Shorter tokens are their own piece, and a ``*`` is the empty token,
    which every text contains. Texts travel by key until the check in full.
    """
    found = F.struct("threat_id", "match_score", "reason", "recommendation_method")
    said = rules.select(F.struct("rule_ord", "_details").alias("rule"), "rule_ord", "threat_id", "tokens", found.alias("found")).distinct()
    ranked_rules = materialized(numbered(said, "rule", "rank"))  # the rank is a number, so the last rule is a hash aggregate
    words = ranked_rules.select("rank", "rule_ord", "threat_id", F.explode("tokens").alias("said"))
    word = F.when(F.col("said") == "*", "").otherwise(F.lower("said"))
    listed = materialized(words.select("rank", "rule_ord", "threat_id", word.alias("token")).distinct())
    hits = _sent(texts, listed) if fits(listed) else _met(texts, listed)
    best = hits.groupBy("_key", "threat_id").agg(F.max("rank").alias("rank"), F.min("rule_ord").alias("first_ord"))
    return best.drop("threat_id").join(sized(ranked_rules.select("rank", "found")), "rank").select("_key", "found.*", "first_ord")


def _sent(texts: DataFrame, listed: DataFrame) -> DataFrame:
    """(_key, rank, rule_ord, threat_id) of the tokens found, where the rules go to every task and texts stay where they are."""
    tokens = sorted(r[0] for r in listed.select("token").distinct().collect())  # as small as a side that is broadcast
    found = texts.select("_key", "_text").mapInArrow(partial(tokensearch.search, tokens), "_key binary, places array<int>")
    numbers = local_table(texts.sparkSession, list(enumerate(tokens)), "place int, token string")
    ruled = materialized(listed.join(sized(numbers), "token").drop("token"))
    return found.select("_key", F.explode("places").alias("place")).join(F.broadcast(ruled), "place").drop("place")


def _met(texts: DataFrame, listed: DataFrame) -> DataFrame:
    """The same where the rules are a large table: tokens wait under their rarest pieces and meet the texts in joins."""
    tokens = listed.select("token").distinct().withColumn("size", F.least(F.length("token"), F.lit(GRAM)))
    sizes = sorted(r[0] for r in tokens.select("size").distinct().collect())
    of_token = F.array(F.lit(""))
    for n in (x for x in sizes if x):
        of_token = F.when(F.col("size") == n, _pieces(F.col("token"), [n])).otherwise(of_token)
    filed = tokens.select("token", F.explode(of_token).alias("piece"))
    heads = texts.select("_key", F.explode(_pieces(F.col("_text"), sizes)).alias("piece")).hint("merge")
    wanted = materialized(filed.select("piece").distinct())
    counts = materialized(heads.join(sized(wanted), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("n")))
    # no count: no text has the piece; nulls come first here, so such a token is filed nowhere
    ranked = filed.join(counts, "piece", "left").groupBy("token").agg(F.min(F.struct("n", "piece")).alias("least"))
    waiting = materialized(ranked.where("least.n is not null").select("token", F.col("least.piece").alias("piece")))
    used = counts.join(waiting.select("piece").distinct(), "piece", "left_semi")
    candidates = spread_join(heads, waiting, "piece", "_key", hot_values(used, "piece")).select("_key", "token")
    hits = materialized(candidates.join(texts.hint("merge"), "_key").where(F.contains("_text", F.col("token"))).select("_key", "token"))
    busy = hot_values(hits.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token")
    return spread_join(hits.hint("merge"), listed, "token", "_key", busy).drop("token")


def exploded(matched: DataFrame) -> DataFrame:
    """One row per match. Outer explode: the plain one would let Spark infer a filter on the
    size of ``matches`` and push the whole token search a second time below the projection."""
    rows = matched.select("*", F.posexplode_outer("matches").alias("pos", "m")).where("pos is not null")
    return rows.select(*[c for c in matched.columns if c != "matches"], "pos", "m.*")


def with_threats(matched: DataFrame, catalog: DataFrame, recommendations: DataFrame) -> DataFrame:
    """One row per match with its place, catalog entry and ordered recommendations."""
    from incidentlake.operators.scoring import with_recommendations

    rows = exploded(matched)
    threats = catalog.select("threat_id", F.struct(*catalog.columns).alias("threat"))
    return with_recommendations(rows.join(threats, "threat_id"), recommendations, "recommendation_method")


def totals(vulnerabilities: DataFrame) -> DataFrame:
    return vulnerabilities.agg(
        F.countDistinct("asset_id").alias("total_assets"), F.count(F.lit(1)).alias("total_vulnerabilities")
    )


def audit_rows(matched: DataFrame) -> DataFrame:
    return matched.select(
        F.upper("asset_name").alias("asset"), "vulnerability_code", F.size("matches").alias("threats")
    )


def report_slice(matched: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` matches of every vulnerability, as a report."""
    return matched.withColumn("matches", F.slice("matches", 1, n))


def list_threats(catalog: DataFrame, severity: str | None = None, category: str | None = None) -> DataFrame:
    kept = F.lit(True)
    if severity is not None:
        kept = kept & (F.col("severity") == severity)
    if category is not None:
        kept = kept & (F.col("category") == category)
    return catalog.where(kept)


def catalog_rows(catalog: DataFrame) -> DataFrame:
    """Catalog lists as rows (threat_id, list, pos, value), order kept."""
    lists = F.array(
        *[
            F.struct(F.lit(name).alias("list"), F.col(name).alias("items"))
            for name in ("likely_targets", "common_methods")
        ]
    )
    return catalog.select("threat_id", "severity", "category", F.inline(lists)).select(
        "threat_id", "severity", "category", "list", F.posexplode("items").alias("pos", "value")
    )


def rule_rows(rules: DataFrame) -> DataFrame:
    return rules.select("rule_ord", "threat_id", "match_score", F.posexplode("tokens").alias("pos", "token"))
