"""URL filters: host rules first, then pattern rules behind a token index.

The literal tokens of a pattern rule are read off its regular expression: runs of letters
and digits that every match holds as whole tokens of the lower-cased url, as they stand
between separators on both sides.  Counted over all urls, the rarest of them is the
rule's place in the index; the tokens of a url fetch the candidate rules, and only those
run their regular expression.  A rule without such a literal is kept apart and runs for
every url.

Rules come as expressions or from a rule table, one per line (``parse_rules``): ``||``
begins at a host or one of its subdomains, ``|`` is the start or the end of the url, ``*``
any run, ``^`` a separator or the end, ``/.../`` a regular expression, ``!`` a comment.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits
no host rule and, if it is null, no pattern; an empty table gives an empty table; columns
named like the added ones are replaced; blank and comment lines are no rules.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as _sre
from re import _parser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_RULES = 100_000  # the index travels with the tasks, so its size is checked
TOKEN = r"[0-9a-z]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    name: str
    pattern: str

    @property
    def literals(self) -> tuple[str, ...]:
        return literal_tokens(self.pattern)


# ---------------------------------------------------------------- literals of an expression

_TOKEN_CHARS = frozenset("0123456789abcdefghijklmnopqrstuvwxyz")
_EDGES = frozenset((_sre.AT_BEGINNING, _sre.AT_BEGINNING_STRING, _sre.AT_END, _sre.AT_END_STRING))


def _separates(item: tuple) -> bool:
    """Whether the item only matches an edge of the url or one character outside tokens."""
    op, value = item
    if op is _sre.AT:
        return value in _EDGES
    if op is _sre.LITERAL:
        return chr(value) not in _TOKEN_CHARS
    if op is _sre.IN:
        if any(kind is _sre.CATEGORY for kind, _ in value):
            return False
        held = {chr(c) for kind, v in value if kind is not _sre.NEGATE
                for c in ([v] if kind is _sre.LITERAL else range(v[0], min(v[1], 127) + 1))}
        return _TOKEN_CHARS <= held if value[0][0] is _sre.NEGATE else not held & _TOKEN_CHARS
    if op is _sre.SUBPATTERN:
        return len(value[3]) == 1 and _separates(value[3][0])
    return op is _sre.BRANCH and all(len(way) == 1 and _separates(way[0]) for way in value[1])


def _ends_apart(sequence) -> bool:
    """Whether every match of the sequence ends in a separator."""
    if not len(sequence):
        return False
    last = sequence[-1]
    return _separates(last) or (last[0] is _sre.SUBPATTERN and _ends_apart(last[1][3]))


@lru_cache(maxsize=1 << 18)
def literal_tokens(pattern: str) -> tuple[str, ...]:
    """Whole tokens that every match of the expression holds."""
    found: list[str] = []
    run, bounded = "", False      # the literal run so far, and whether a separator is before it

    def read(sequence) -> None:
        nonlocal run, bounded
        for item in sequence:
            op, value = item
            if op is _sre.LITERAL and chr(value) in _TOKEN_CHARS:
                run += chr(value)
            elif _separates(item):
                if run and bounded:
                    found.append(run)
                run, bounded = "", True
            elif op is _sre.SUBPATTERN:
                read(value[3])
            elif op in (_sre.MAX_REPEAT, _sre.MIN_REPEAT) and not run and _ends_apart(value[2]):
                bounded = bounded or value[0] > 0      # any number of parts that end in a separator
            else:
                run, bounded = "", False
                if op is _sre.LITERAL:
                    run = chr(value)

    parsed = _parser.parse(pattern)
    if not parsed.state.flags & re.IGNORECASE:
        read(parsed)
    return tuple(dict.fromkeys(found))


# ---------------------------------------------------------------- rule lines

def parse_rule(line: str) -> PatternRule | None:
    """One line of a rule table; ``None`` for blanks and comments."""
    text = line.strip().translate(str.maketrans(UPPER, LOWER))
    if not text or text.startswith("!"):
        return None
    if len(text) > 2 and text.startswith("/") and text.endswith("/"):
        return PatternRule(text, line.strip()[1:-1])
    name, head, tail = text, "", ""
    if text.startswith("||"):
        head, text = r"^[a-z][0-9a-z+.-]*://([0-9a-z_-]+[.])*", text[2:]
    elif text.startswith("|"):
        head, text = "^", text[1:]
    if text.endswith("|"):
        tail, text = "$", text[:-1]
    signs = {"*": ".*", "^": "([^0-9a-z_.%-]|$)"}
    return PatternRule(name, head + "".join(signs.get(c) or re.escape(c) for c in text) + tail)


def parse_rules(lines: DataFrame, col: str = "rule") -> list[PatternRule]:
    """Rules of a table of lines, in the order of the lines; at most ``MOST_RULES``."""
    rows = lines.where(F.col(col).isNotNull()).select(col).orderBy(col).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"the index is bounded by {MOST_RULES} rules")
    return [r for r in (parse_rule(row[0]) for row in rows) if r]


# fixed values: the host rules of the contract
HOST_RULES = (
    HostRule("net", "/", "block"),
    HostRule("example.net", "/en/", "allow"),
    HostRule("example.com", "/de/", "block"),
    HostRule("org", "/fr/", "allow"),
)

_L, _R = r"(^|[^0-9a-z])", r"([^0-9a-z]|$)"
PATTERN_RULES = (
    PatternRule("casino", _L + r"casino[-.](win|bonus|slots)" + _R),
    PatternRule("bets", _L + r"free-bets" + _R),
    PatternRule("pills", _L + r"cheap-pills" + _R),
    PatternRule("spam_farm", _L + r"spam-farm" + _R),
    PatternRule("ad_tracking", r"//([0-9a-z-]+[.])*ads-track" + _R),
    PatternRule("poker", r"//([0-9a-z-]+[.])*poker-[0-9a-z-]+[.]"),
    PatternRule("replica", _L + r"replica-(watches|bags)" + _R),
    PatternRule("loans", _L + r"payday-loans?" + _R),
    PatternRule("cracks", _L + r"(keygen|crack)-download" + _R),
    PatternRule("click_id", r"[?&](gclid|fbclid)=[^&#]*&.*" + _L + r"redirect="),
    PatternRule("numeric_host", r"^[a-z]+://[0-9]{1,3}([.][0-9]{1,3}){3}([:/?#]|$)"),
)


def _host_and_path(url):
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def index_tokens(urls: DataFrame, url_col: str, rules: Sequence[PatternRule]) -> dict[str, int]:
    """How many urls of the table hold each literal of the rules: one count per literal."""
    literals = sorted({t for r in rules for t in r.literals})
    if not literals:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(
        F.translate(F.coalesce(F.col(url_col), F.lit("")), UPPER, LOWER), F.lit(f"({TOKEN})"), F.lit(1)))
    # a few literals per rule, and the number of rules is checked
    known = urls.sparkSession.createDataFrame([(t,) for t in literals], "token string")
    held = urls.select(F.explode(tokens).alias("token")).join(F.broadcast(known), "token")
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def rule_index(rules: Sequence[PatternRule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rarest literal -> rules; the empty token stands for rules without a literal."""
    index: dict[str, list[int]] = {}
    for number, rule in enumerate(rules):
        token = min(rule.literals, key=lambda t: (counts.get(t, 0), t), default="")
        index.setdefault(token, []).append(number)
    return index


class Matcher:
    """The rules behind their index; travels with the tasks, expressions are compiled there
    when a url first needs them."""

    def __init__(self, rules: Sequence[PatternRule], index: dict[str, list[int]]) -> None:
        self.rules = [(r.name, r.pattern) for r in rules]
        self.index, self.compiled = index, {}

    def first(self, url: str) -> str | None:
        """Name of the first rule, in order, whose expression is found in the lower-cased url."""
        low = url.translate(_FOLD)
        found = set(self.index.get("", ()))
        for t in set(_TOKENS.findall(low)):
            found.update(self.index.get(t, ()))
        for n in sorted(found):
            name, pattern = self.rules[n]
            if n not in self.compiled:
                self.compiled[n] = re.compile(pattern)
            if self.compiled[n].search(low):
                return name
        return None


_FOLD, _TOKENS = str.maketrans(UPPER, LOWER), re.compile(TOKEN)


def match_patterns(spark: SparkSession, rules: Sequence[PatternRule], index: dict[str, list[int]]):
    """Arrow function: the first rule, in order, whose expression is found, else null."""
    shared = spark.sparkContext.broadcast(Matcher(rules, index))     # at most MOST_RULES rules

    @F.pandas_udf("string")
    def first_match(urls: pd.Series) -> pd.Series:
        return pd.Series([None if u is None else shared.value.first(u) for u in urls], dtype=object)

    return first_match


def judge(pages: DataFrame, host_rules: Sequence[HostRule] = HOST_RULES,
          patterns: Sequence[PatternRule] = PATTERN_RULES, url_col: str = "url") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (host rule or null), ``pattern`` (pattern rule or
    null) and ``verdict``: the host rule's, else ``block`` where a pattern was found."""
    if len(patterns) > MOST_RULES:
        raise ValueError(f"{len(patterns)} pattern rules; the index is bounded by {MOST_RULES}")
    added = ("host", "path", "rule", "pattern", "verdict")
    named = pages.drop(*[c for c in added if c in pages.columns])
    index = rule_index(patterns, index_tokens(named, url_col, patterns))
    host, path = _host_and_path(F.col(url_col))
    out = named.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(host_rules, key=lambda r: (len(r.name), r.name)):  # the longest comes last and wins
        fits = (((F.col("host") == r.host) | F.col("host").endswith("." + r.host))
                & F.col("path").startswith(r.path))
        rule = F.when(fits, F.lit(r.name)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return (out.withColumn("rule", rule)
            .withColumn("pattern", match_patterns(pages.sparkSession, patterns, index)(F.col(url_col)))
            .withColumn("verdict", F.coalesce(verdict, F.when(
                F.col("pattern").isNotNull(), "block").otherwise("allow")))
            .select(*named.columns, *added))
