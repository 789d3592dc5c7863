"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern of literal text, ``*`` (anything), ``^`` (a separator or the end) and ``||`` in
front (the host or one of its subdomains begins here). Each rule is filed under the one of its
whole literal tokens that the fewest rules share. A URL is cut into tokens, these fetch the rules
filed under them, and only those run their regular expression. A rule without a whole token is
tried on every URL.

Patterns are matched against lower-cased host and path as it stands, ``host + path``. Among the
matching rules the one with the most literal characters wins, then allow before block, then the
smaller name. Null URLs and URLs without ``://`` have an empty host and path, which no rule matches.
Without any matching rule the verdict is ``default``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_RULES = 50_000  # rules that one pass carries to the tasks; longer lists take more passes

_TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class UrlRule:
    name: str
    pattern: str
    verdict: str
    #: A rule of lower rank gives way to any rule of higher rank that matches.
    rank: int = 0

    def expression(self) -> str:
        body, out = self.pattern, ""
        if body.startswith("||"):
            body, out = body[2:], r"\A(?:[^/]*\.)?"
        for c in body:
            out += {"*": ".*", "^": r"(?:[^a-zA-Z0-9_.%-]|\Z)"}.get(c) or re.escape(c)
        return out

    def tokens(self) -> list[str]:
        """Tokens that a matching URL must have whole: those with a literal border on both sides."""
        anchored = self.pattern.startswith("||")
        body = self.pattern[2:] if anchored else self.pattern
        found = []
        for m in _TOKEN.finditer(body):
            before, after = body[: m.start()][-1:], body[m.end() :][:1]
            if (before not in ("", "*") or (anchored and m.start() == 0)) and after not in ("", "*"):
                found.append(m[0])
        return found

    def weight(self) -> int:
        return len(self.pattern.replace("||", "").replace("*", "").replace("^", "/"))


def host_rule(name: str, verdict: str) -> UrlRule:
    """``host/path``: the host with its subdomains, and paths that start with ``/path``."""
    return UrlRule(name, "||" + name, verdict, rank=1)


class RuleIndex:
    def __init__(self, rules: list[UrlRule]):
        shared = Counter(t for r in rules for t in set(r.tokens()))
        self.filed: dict[str, list] = {}
        self.always: list = []
        for r in rules:
            entry = ((r.rank, r.weight(), r.verdict == "allow"), r, re.compile(r.expression(), re.S))
            tokens = r.tokens()
            (self.filed.setdefault(min(tokens, key=lambda t: (shared[t], t)), []) if tokens else self.always).append(entry)

    def best(self, target: str) -> tuple[tuple, UrlRule] | None:
        found = None
        tokens = set(_TOKEN.findall(target))
        for entries in (*(self.filed[t] for t in tokens if t in self.filed), self.always):
            for order, rule, expression in entries:
                if (found is None or (order, found[1].name) > (found[0], rule.name)) and expression.search(target):
                    found = order, rule
        return found


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(df: DataFrame, rules: list[UrlRule], default: str = "allow", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` in a struct ``row``, with host, path, rule and verdict; no shuffle.

    Rules go to the tasks in blocks of ``BLOCK_RULES``; each block compares its best rule with the
    best of the blocks before it.
    """
    keep = df.columns if keep is None else keep
    link = F.col(f"`{url}`").cast("string")
    out = df.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        host_of(link).alias("host"),
        path_of(link).alias("path"),
        *[F.lit(None).cast(t).alias(n) for n, t in (("rule", "string"), ("verdict", "string"), ("strength", "array<int>"))],
    )
    for at in range(0, len(rules), BLOCK_RULES):
        out = out.mapInArrow(_block(rules[at : at + BLOCK_RULES]), out.schema)
    return out.select("row", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _block(rules: list[UrlRule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules)
        for batch in batches:
            rule, verdict, strength = (batch.column(n).to_pylist() for n in ("rule", "verdict", "strength"))
            for i, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())):
                found = index.best(host + path) if host else None
                if found:
                    order = [int(x) for x in found[0]]
                    if strength[i] is None or (order, rule[i]) > (strength[i], found[1].name):
                        rule[i], verdict[i], strength[i] = found[1].name, found[1].verdict, order
            new = [pa.array(v, batch.schema.field(n).type) for n, v in (("rule", rule), ("verdict", verdict), ("strength", strength))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *new], names=batch.schema.names)

    return run
