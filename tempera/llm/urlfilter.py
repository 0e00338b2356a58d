"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame functions only.

A rule is a regular expression over ``host || path`` and the literal tokens that any match holds whole,
both made from a line of text (``read_rules``). How often each of those tokens occurs is counted over
all urls; the rule is filed under its rarest. The tokens of a url fetch candidate rules; only those run
their expression.

Defined cases: a null url, or one without ``://``, has an empty host and path and meets no rule;
repeated rows, null, tied and repeated ids are judged each by itself; an empty table gives no rows; columns
other than the two asked for are ignored; of rules of equal length the one with the longer host, then the
greater text wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempera.llm.common import ascii_lower

_TOKEN = re.compile(r"[a-z0-9]+")
#: Up to this many rules travel as a literal inside the expression; more are joined as a table.
INROW_RULES = 512


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str | None  # None: a pattern of the method, which names no rule in the result
    regex: str
    tokens: tuple[str, ...]
    size: int = 0
    host_size: int = 0


def host_rule(verdict: str, text: str) -> Rule:
    """``host/path``: fits the host and its subdomains if the path starts with the rule's."""
    host, _, path = text.partition("/")
    quoted = re.sub(r"([^A-Za-z0-9/])", r"\\\1", f"{host}/{path}")
    whole = [m[0] for m in _TOKEN.finditer(text.lower()) if m.end() < len(text)]
    return Rule(verdict, text, rf"^(?:[^/]*\.)?{quoted}", tuple(whole), len(text), len(host))


_EDGE = "(?:(?<![A-Za-z0-9])|(?![A-Za-z0-9]))"
#: By part of the url: what stands before a pattern, and before one that begins with a bar; what * and ^ stand for;
#: what a final bar asks for.
_PARTS = {
    "host": ("^[^/]*?", "^", "[^/]*", "(?:(?<=[.-])|^|(?=[.-]|/|$))", "(?=/|$)"),
    "path": ("^[^/]*+.*?", "^[^/]*+", ".*", _EDGE, "$"),
    "url": ("^.*?", "^", ".*", _EDGE, "$"),
}


def pattern_rule(verdict: str, part: str, pattern: str) -> Rule:
    """A pattern for the ``host``, the ``path`` or the whole ``url``: ``*`` stands for any text, ``|`` at
    either end for that end, ``^`` for an edge of a word: in a host a dot, a hyphen or an end beside it,
    elsewhere any place that isn't inside a run of letters and digits. Its tokens are the runs of letters
    and digits that must stand whole: those with neither ``*`` nor an open end beside them."""
    before, start, any_, edge, end = _PARTS[part]
    body = pattern.removeprefix("|")
    anchored = len(body) < len(pattern)
    body, closed = (body[:-1], True) if body.endswith("|") else (body, False)
    pieces = {"*": any_, "^": edge}
    regex = "".join(pieces.get(c) or re.sub(r"([^A-Za-z0-9/])", r"\\\1", c) for c in body)
    text = ("|" if anchored else "*") + body.lower() + ("|" if closed else "*")
    tokens = tuple(m[0] for m in _TOKEN.finditer(text) if "*" not in (text[m.start() - 1], text[m.end()]))
    return Rule(verdict, None, (start if anchored else before) + regex + (end if closed else ""), tokens)


def read_rules(text: str) -> tuple[Rule, ...]:
    """Rules from lines ``verdict host/path`` (a host rule) or ``verdict part pattern`` (a pattern of the
    method); empty lines and what follows a # with a space before or at the start are skipped."""
    out = []
    for line in text.splitlines():
        words = re.sub(r"(^|\s)#.*", "", line).split()
        if not words:
            continue
        if words[0] not in ("allow", "block") or len(words) not in (2, 3) or (len(words) == 3 and words[1] not in _PARTS):
            raise ValueError(f"not a rule: {line}")
        out.append(host_rule(*words) if len(words) == 2 else pattern_rule(*words))
    return tuple(out)


HOST_RULES = (
    host_rule("allow", "org/"),
    host_rule("block", "example.org/es/"),
    host_rule("block", "example.org/en/1"),
    host_rule("allow", "com/fr/"),
    host_rule("block", "com/de/"),
)
#: What the method itself decides when no host rule fits.
METHOD_RULES = """
# words of the host, between dots, hyphens or its ends
block host ^adult^
block host ^ads^
block host ^adserver^
block host ^bets^
block host ^betting^
block host ^casino^
block host ^malware^
block host ^pharmacy^
block host ^phishing^
block host ^pills^
block host ^poker^
block host ^porn^
block host ^spam^
block host ^viagra^
block host ^xxx^
# places and kinds of files
block path |/ads/
block path ^wp-login.php^
block path .exe|
"""
PATTERN_RULES = read_rules(METHOD_RULES)


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(key: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(key), "[^a-z0-9]+"))


def rarest_tokens(keys: DataFrame, rules: tuple[Rule, ...]) -> dict[Rule, str | None]:
    """For each rule its literal token with the fewest urls (None: the rule has no token). The
    counts cover all rows; what reaches the driver is one row per token of the rules."""
    wanted = sorted({t for r in rules for t in r.tokens})
    found = keys.select(F.explode(F.array_intersect(tokens_of(F.col("_key")), F.array(*map(F.lit, wanted)))).alias("t"))
    counts = {r["t"]: r["count"] for r in found.groupBy("t").count().collect()} if wanted else {}
    return {r: min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=None) for r in rules}


def _hits_inrow(key: Column, rules: tuple[Rule, ...], index: dict[Rule, str | None]) -> Column:
    filed: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        filed.setdefault(index[r] or "", []).append(i)
    always = F.array(*map(F.lit, filed.pop("", []))).cast("array<int>")
    entries = [x for t, ids in filed.items() for x in (F.lit(t), F.array(*map(F.lit, ids)))]
    regexes = F.array(*[F.lit(r.regex) for r in rules])
    found = F.flatten(F.transform(F.array_intersect(tokens_of(key), F.array(*map(F.lit, filed))), lambda t: F.try_element_at(F.create_map(*entries), t)))
    candidates = F.concat(found, always) if entries else always
    hits = F.filter(candidates, lambda i: F.rlike(key, F.get(regexes, i)))
    table = F.array(
        *[F.struct(F.lit(r.size).alias("size"), F.lit(r.host_size).alias("host_size"), F.lit(r.name).cast("string").alias("name"), F.lit(r.verdict).alias("verdict")) for r in rules]
    )
    return F.transform(hits, lambda i: F.get(table, i))


def _hits_joined(keys: DataFrame, rules: tuple[Rule, ...], index: dict[Rule, str | None]) -> DataFrame:
    """The same for a long list of rules: distinct keys meet the rules in a join on the token, which
    Catalyst broadcasts or shuffles by the table's size. Returns ``_key, _hits``."""
    kind = "token string, regex string, size int, host_size int, name string, verdict string"
    rows = [(index[r] or "", r.regex, r.size, r.host_size, r.name, r.verdict) for r in rules]
    table = keys.sparkSession.createDataFrame(rows, kind)
    tokens = keys.select("_key").distinct().select("_key", F.explode(F.array_union(tokens_of(F.col("_key")), F.array(F.lit("")))).alias("token"))
    met = tokens.join(table, "token").where(F.rlike(F.col("_key"), F.col("regex")))
    return met.groupBy("_key").agg(F.collect_list(F.struct("size", "host_size", "name", "verdict")).alias("_hits"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES, default: str = "allow", inrow: int = INROW_RULES) -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row. The longest host rule that fits decides;
    without one, a pattern of the method (a block goes before an allow), else ``default``."""
    keys = pages.select(
        F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    ).withColumn("_key", F.concat("host", "path"))
    index = rarest_tokens(keys, rules)
    if len(rules) <= inrow:
        keys = keys.withColumn("_hits", _hits_inrow(F.col("_key"), rules, index))
    else:
        keys = keys.join(_hits_joined(keys, rules, index), "_key", "left")
    best = F.array_max(F.filter("_hits", lambda h: h["name"].isNotNull()))
    method = F.filter("_hits", lambda h: h["name"].isNull())
    keys = keys.withColumn("_best", best).withColumn("_method", method)
    verdict = (
        F.when(F.col("_best").isNotNull(), F.col("_best.verdict"))
        .when(F.exists("_method", lambda h: h["verdict"] == "block"), "block")
        .when(F.size("_method") > 0, "allow")
        .otherwise(default)
    )
    return keys.select(id_col, "host", "path", F.col("_best.name").alias("rule"), verdict.alias("verdict"))
