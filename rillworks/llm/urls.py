"""URL filters: rules indexed by their rarest literal token; a URL's tokens fetch candidate rules, and only those run their regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, worker_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of rules in one index, which every Python worker holds; more rules make more indexes, and each looks at all rows.
INDEX_BYTES = 16 << 20


@dataclass(frozen=True)
class Rule:
    """name: what is reported; pattern: a regular expression (Python's) over host and path together; tokens: literals that any match holds.

    Host rules (made by ``host_rule``) come before patterns; among a kind the longest name wins, then the smaller name.
    """

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    host: bool


def host_rule(verdict: str, name: str) -> Rule:
    """``host/path``: fits that host and its subdomains, where the URL's path starts with the rule's."""
    host, _, path = name.partition("/")
    # Only tokens that end inside the rule are sure to be whole tokens of the URL: the path's last may go on.
    whole = re.findall(r"[a-z0-9]+(?![a-z0-9])", host) + [m[0] for m in re.finditer(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)]
    return Rule(name, f"^(?:[^/]*\\.)?{re.escape(host)}/{re.escape(path)}", tuple(whole), verdict, True)


def word_rule(word: str) -> Rule:
    """Blocks hosts that hold the word, between characters other than letters and digits."""
    return Rule(word, f"^(?:[^/]*[^a-z0-9/])?{word}(?:[^a-z0-9][^/]*)?(?:/|\\Z)", (word,), "block", False)


#: The contract's rules, then words of hosts that the method blocks by itself.
RULES = (
    host_rule("block", "com/en/"),
    host_rule("allow", "example.com/en/7"),
    host_rule("allow", "net/de/"),
    host_rule("block", "example.net/de/8"),
    host_rule("block", "org/es/"),
    *map(word_rule, ("casino", "bets", "poker", "adult", "xxx", "porn", "pills", "viagra")),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), F.lit(1)))


def word_rules(words: Iterable[str]) -> tuple[Rule, ...]:
    """Rules of a list of words, as a filter file has them; blanks around them and empty lines don't count."""
    return tuple(word_rule(w) for w in dict.fromkeys(x.strip().lower() for x in words) if w)


def rarest(df: DataFrame, url: str, rules: tuple[Rule, ...]) -> dict[str, list[int]]:
    """token -> the rules that it fetches. A rule stands under the one of its tokens that fewest rows of df hold.

    Counts cover all rows; only tokens of rules are counted, so what reaches the driver is bounded by the rules.
    """
    known = df.sparkSession.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.tokens})], "token string")
    token = F.explode(tokens_of(F.concat(host_of(F.col(url)), path_of(F.col(url)))))
    counted = df.select(token.alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    counts = {r["token"]: r["n"] for r in counted.join(known, "token").collect()}
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
    return index


class Index:
    """Some of the ranked rules, by token. Patterns are compiled when first fetched, and kept."""

    def __init__(self, rules: dict[int, Rule], index: dict[str, list[int]]):
        self.rules, self.index, self.compiled = rules, index, {}

    def fits(self, i: int, whole: str) -> bool:
        if i not in self.compiled:
            self.compiled[i] = re.compile(self.rules[i].pattern)
        return self.compiled[i].search(whole) is not None

    def first(self, whole: str) -> tuple[Rule | None, Rule | None]:
        """The best host rule and the best other one that fit; of what the tokens fetch, rules are tried from the best on."""
        found = {i for t in set(re.findall("[A-Za-z0-9]+", whole)) for i in self.index.get(t, ())}
        out: dict[bool, Rule] = {}
        for i in sorted(found):
            rule = self.rules[i]
            if rule.host not in out and self.fits(i, whole):
                out[rule.host] = rule
                if len(out) == 2:
                    break
        return out.get(True), out.get(False)


def indexes(rules: tuple[Rule, ...], index: dict[str, list[int]], limit: int) -> list[Index]:
    """The ranked rules in turn, so many to an index as have limit bytes (one at least)."""
    token_of = {i: t for t, found in index.items() for i in found}
    out, size = [], limit
    for i, rule in enumerate(rules):
        own = len(rule.pattern) + len(rule.name) + sum(map(len, rule.tokens)) + 200
        if size + own > limit:
            out.append(Index({}, {}))
            size = 0
        size += own
        out[-1].rules[i] = rule
        out[-1].index.setdefault(token_of[i], []).append(i)
    return out


def judge(df: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with host, path, rule (of the deciding host rule, else null), verdict (allow or block), pattern_rule (of the method, else null).

    Null URLs and such without ``://`` have empty host and path and are allowed. Columns of df with these names are replaced; all others,
    repeated rows included, pass through. Narrow: one pass over the rows, no shuffle besides the token counts. Any number of rules, each
    with a token; they reach the executors as indexes of bounded size, of which each looks at host and path alone.
    """
    if not all(r.tokens for r in rules):
        raise ValueError("each rule needs a token")
    spark = df.sparkSession
    worker_path(spark)
    order = sorted(range(len(rules)), key=lambda i: (not rules[i].host, -len(rules[i].name), rules[i].name))
    ranked = tuple(rules[i] for i in order)
    made = ("host", "path", "rule", "verdict", "pattern_rule")
    host, path = host_of(F.col(url)), path_of(F.col(url))

    def asked(sent):
        def first(whole: pd.Series) -> pd.DataFrame:
            found = [sent.value.first(w) for w in whole]
            show = lambda r: (r.name, r.verdict) if r else (None, None)
            return pd.DataFrame([(*show(a), *show(b)) for a, b in found], columns=["rule", "verdict", "pattern_rule", "pattern_verdict"], dtype=object)

        return F.pandas_udf(first, "rule string, verdict string, pattern_rule string, pattern_verdict string")(F.concat(host, path))

    found = [asked(spark.sparkContext.broadcast(i)) for i in indexes(ranked, rarest(df, url, ranked) if ranked else {}, INDEX_BYTES)]
    names = df.columns
    plain = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], host.alias("host"), path.alias("path"), *[f.alias(f"f{i}") for i, f in enumerate(found)])
    of = lambda field: F.coalesce(*[F.col(f"f{i}.{field}") for i in range(len(found))], F.lit(None).cast("string"))
    verdict = F.coalesce(of("verdict"), of("pattern_verdict"), F.lit("allow"))
    return plain.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in made], "host", "path", of("rule").alias("rule"), verdict.alias("verdict"), of("pattern_rule").alias("pattern_rule"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "pattern_rule")


def _sql() -> str:
    first = lambda kind, what, none: "CASE " + " ".join(f"WHEN regexp_matches(host || path, '{r.pattern.replace(chr(92) + 'Z', '$')}') THEN '{getattr(r, what)}'" for r in sorted((r for r in RULES if r.host == kind), key=lambda r: (-len(r.name), r.name))) + f" ELSE {none} END"
    return f"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, {first(True, 'name', 'NULL')} AS rule, {first(True, 'verdict', first(False, 'verdict', "'allow'"))} AS verdict,
       {first(False, 'name', 'NULL')} AS pattern_rule FROM parts"""


ORACLE = {"op8_url_filter": _sql()}
QUERIES = {"op8_url_filter": op8_url_filter}
