"""URL filter rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` together with literal tokens that every
match must hold. Each rule is filed under the one of its tokens that fewest URLs hold; a
URL's tokens fetch the rules filed under them, and only those run their expression. All of
it is DataFrame expressions.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no
rule and gets the default verdict; repeated rows are judged each; an empty table gives no
rows; the caller's other columns are kept, and the added ones replace any of their names.
Rules of equal length are decided by their order in the list.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorvia.llm.common import fresh, named

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to here the index is a literal of the plan; beyond, it is a table to join.
LITERAL_RULES = 256
#: A rule's row is under 2 KB (checked when made): an index of so many rules is broadcast, a larger one is shuffled.
BROADCAST_RULES = 20_000
PATTERN_CHARS = 1000
#: So many tokens (some tens of bytes each) are broadcast, so that others aren't shuffled.
BROADCAST_TOKENS = 1_000_000
#: URLs that one copy of a token's rules is matched with; a token that more hold has several.
SPLIT_URLS = 100_000


@dataclass(frozen=True)
class Rule:
    """kind 1: a host rule, decided by length; kind 0: one of the method's own patterns."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    kind: int = 0

    def __post_init__(self):
        if len(self.pattern) > PATTERN_CHARS or len(self.name) > PATTERN_CHARS or any(not re.fullmatch("[a-z0-9]+", t) for t in self.literals):
            raise ValueError(f"not a usable rule: {self.name[:80]}")


def host_rule(text: str, verdict: str) -> Rule:
    """``example.net/en/``: that host and its subdomains, where the path starts so."""
    host, slash, path = text.partition("/")
    host = host.lower()
    # what follows the last separator may go on in a URL, so it is no whole token
    whole = re.split("[^a-z0-9]+", f"{host}/{path.lower()}".rpartition("/")[0] if not re.search("[^a-z0-9]$", path.lower()) else f"{host}/{path.lower()}")
    return Rule(text, verdict, "^(?:[^/]*[.])?" + re.escape(host) + re.escape(slash + path), tuple(sorted({t for t in whole if t})), 1)


def pattern_rule(pattern: str, *literals: str, verdict: str = "block") -> Rule:
    return Rule(pattern, verdict, pattern, literals)


#: The method's own rules for URLs that no host rule decides: hosts and paths of spam.
OWN_RULES = (
    pattern_rule("^(?:[^/]*[.])?(?:cheap|buy|discount)-pills[.]", "pills"),
    pattern_rule("^(?:[^/]*[.])?spam-farm[.]", "spam", "farm"),
    pattern_rule("^(?:[^/]*[.-])?casino(?:[.-][^/]*)?(?:/|$)", "casino"),
    pattern_rule("^(?:[^/]*[.-])?poker(?:[.-][^/]*)?(?:/|$)", "poker"),
    pattern_rule("^(?:[^/]*[.-])?viagra(?:[.-][^/]*)?(?:/|$)", "viagra"),
    pattern_rule("^(?:[^/]*[.])?link-exchange[.]", "link", "exchange"),
    pattern_rule("^(?:[^/]*[.])?adult(?:[.-][^/]*)?(?:/|$)", "adult"),
    pattern_rule("^[^/]*/(?:[^?]*/)?wp-login[.]php$", "wp", "login", "php"),
    pattern_rule("^[^/]*/cgi-bin/", "cgi", "bin"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def tokens(key: Column) -> Column:
    """Distinct tokens of ``host + path``."""
    return F.array_distinct(F.split(F.translate(key, UPPER, LOWER), "[^a-z0-9]+"))


def rarest_tokens(keys: DataFrame, rules: Sequence[Rule]) -> tuple[dict[int, str], dict[str, int]]:
    """For each rule, the literal that fewest keys hold ('' for a rule without literals), and
    how many keys hold each literal.

    The counts that come to the driver are those of the rules' own literals.
    """
    wanted = sorted({t for r in rules for t in r.literals})
    seen: dict[str, int] = {}
    if wanted:
        held = keys.select(F.explode(tokens(F.col("key"))).alias("token"))
        if len(wanted) <= 4 * LITERAL_RULES:
            held = held.where(F.col("token").isin(wanted))
        else:
            held = held.join(keys.sparkSession.createDataFrame([(t,) for t in wanted], "token string"), "token", "left_semi")
        seen = {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}
    return {i: min(r.literals, key=lambda t: (seen.get(t, 0), -len(t), t), default="") for i, r in enumerate(rules)}, seen


ROW = "kind int, size int, place int, name string, verdict string, pattern string"


def _best(found: Column) -> Column:
    return F.array_max(F.transform(found, lambda r: F.struct(r["kind"], r["size"], r["place"], r["name"], r["verdict"])))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], *, url_col: str = "url", default: str = "allow", literal_rules: int = LITERAL_RULES) -> DataFrame:
    """``pages`` with host, path, rule (of a host rule; else null) and verdict.

    literal_rules: with more rules, the index is a table joined by token; results are alike.
    """
    host, path = url_parts(F.col(url_col))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    base = pages.select(*map(named, kept), host.alias("host"), path.alias("path"))
    (own,) = fresh(pages, "best")
    index, seen = rarest_tokens(base.select(F.concat("host", "path").alias("key")), rules)
    # a smaller place wins a tie, so places count down
    rows = {i: (r.kind, len(r.name), -i, r.name, r.verdict, r.pattern) for i, r in enumerate(rules)}
    key = F.concat("host", "path")
    if not rules:
        best = F.lit(None).cast(f"struct<{ROW}>".replace(", pattern string", ""))
        judged = base.withColumn(own, best)
    elif len(rules) <= literal_rules:
        by_token = defaultdict(list)
        for i, token in index.items():
            by_token[token].append(rows[i])
        as_literal = lambda row: F.struct(*[F.lit(v).alias(f.split()[0]) for v, f in zip(row, ROW.split(", "), strict=True)])
        held = F.create_map(*[x for token, found in sorted(by_token.items()) for x in (F.lit(token), F.array(*map(as_literal, found)))])
        # the empty token stands for rules without literals
        fetched = F.flatten(F.filter(F.transform(F.array_union(tokens(key), F.array(F.lit(""))), lambda t: F.try_element_at(held, t)), lambda x: x.isNotNull()))
        judged = base.withColumn(own, _best(F.filter(fetched, lambda r: F.rlike(F.concat("host", "path"), r["pattern"]))))
    else:
        spark = pages.sparkSession
        table = spark.createDataFrame([(index[i], *row) for i, row in rows.items()], f"token string, {ROW}")
        keys = base.select("host", "path").distinct()
        held = keys.select("host", "path", F.explode(F.array_union(tokens(key), F.array(F.lit("")))).alias("token"))
        if len(rules) <= BROADCAST_RULES:
            fetched = held.join(F.broadcast(table), "token")
        else:
            filed = sorted(set(index.values()))
            if "" in filed:  # all URLs run the rules without literals
                seen[""] = keys.count()
            if len(filed) <= BROADCAST_TOKENS:
                held = held.join(F.broadcast(spark.createDataFrame([(t,) for t in filed], "token string")), "token", "left_semi")
            # rules under a token that very many URLs hold are there in several copies
            often = spark.createDataFrame([(t, -(-seen[t] // SPLIT_URLS)) for t in filed if seen.get(t, 0) > SPLIT_URLS], "token string, copies long")
            copies = F.coalesce("copies", F.lit(1))
            dealt = held.join(F.broadcast(often), "token", "left").withColumn("copy", F.pmod(F.xxhash64("host", "path"), copies)).drop("copies")
            table = table.join(F.broadcast(often), "token", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
            fetched = dealt.join(table, ["token", "copy"])
        best = fetched.where(F.rlike(key, F.col("pattern"))).groupBy("host", "path").agg(F.max(F.struct("kind", "size", "place", "name", "verdict")).alias(own))
        judged = base.join(best, ["host", "path"], "left")
    found = F.col(own)
    return judged.select(*map(named, kept), "host", "path", F.when(found["kind"] == 1, found["name"]).alias("rule"), F.coalesce(found["verdict"], F.lit(default)).alias("verdict"))
