"""URL filtering by token-indexed rules (DataFrame operations only).

Every rule is filed under literal tokens of which each URL it fits must contain
one: of every way to fit it, the one that is rarest over the whole table.  A
URL's own tokens fetch its candidate rules, and only those have their regular
expression run.  A token is a longest run of 0-9 and a-z in host or path.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from itertools import product
from re import _constants as _op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._graph import few

#: Rules that go into the plan itself; longer lists are joined with the URLs' tokens, for the same rows.
PLAN_RULES = 200
#: Ways to match a pattern that are told apart; a pattern of more ways is run on every URL.
WAYS = 32
_WORD = frozenset(map(ord, "0123456789abcdefghijklmnopqrstuvwxyz"))
_BREAK, _ANY = "break", "any"


def _set_breaks(members: list) -> bool:
    """Whether no member of a character set belongs to a token."""
    if members and members[0][0] is _op.NEGATE:
        inside = {c for kind, x in members[1:] for c in ([x] if kind is _op.LITERAL else range(x[0], x[1] + 1) if kind is _op.RANGE and x[1] < 256 else [])}
        return _WORD <= inside
    return all((kind is _op.LITERAL and x not in _WORD) or (kind is _op.RANGE and not any(x[0] <= c <= x[1] for c in _WORD)) for kind, x in members)


def _ways(parsed) -> list[tuple]:
    """Each way to match a parsed pattern, as letters, _BREAK (no letter of a token, or an edge) and _ANY (anything)."""
    out: list[tuple] = [()]
    for kind, x in parsed:
        if kind is _op.LITERAL:
            part = [(chr(x),)] if x in _WORD else [(_BREAK,)]
        elif kind is _op.IN:
            part = [(_BREAK,)] if _set_breaks(x) else [(_ANY,)]
        elif kind is _op.AT:
            part = [()] if x is _op.AT_NON_BOUNDARY else [(_BREAK,)]
        elif kind in (_op.ASSERT, _op.ASSERT_NOT):
            part = [()]
        elif kind is _op.SUBPATTERN and not x[1] and not x[2]:
            part = _ways(x[3])
        elif kind is _op.BRANCH:
            part = [w for branch in x[1] for w in _ways(branch)]
        elif kind in (_op.MAX_REPEAT, _op.MIN_REPEAT):
            inner = _ways(x[2])
            if x[1] != 1 and not all(w == (_BREAK,) for w in inner):
                inner = [(_ANY,)]
            part = inner if x[0] else [(), *inner]
        else:
            part = [(_ANY,)]
        out = list(dict.fromkeys(a + b for a, b in product(out, part)))
        if len(out) > WAYS:
            return [(_ANY,)]
    return out


def pattern_tokens(pattern: str) -> tuple[tuple[str, ...], ...]:
    """For each way to match the pattern, the tokens that a URL matched so has; nothing where some way has none.

    Only letters with a sure break on both sides make a token.  What is not
    understood (flags, other dialects' syntax, references) counts as anything.
    """
    if any(x in pattern for x in ("&&", "[[", "\\Q", "(?i", "(?x", "(?u", "(?U", "(?d")):
        return ()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            parsed = _parser.parse(pattern)
    except (re.error, Warning, RecursionError, OverflowError):
        return ()
    out = []
    for way in _ways(parsed):
        tokens, run, sure = [], "", False
        for x in way:
            if x in (_BREAK, _ANY):
                if x is _BREAK and sure and run:
                    tokens.append(run)
                run, sure = "", x is _BREAK
            else:
                run += x
        if not tokens:
            return ()
        out.append(tuple(dict.fromkeys(tokens)))
    return tuple(dict.fromkeys(out))


@dataclass(frozen=True)
class Rule:
    """`action` is allow or block. A host rule fits its host and all subdomains where the path starts with `path`.

    With `pattern`, the rule is a regular expression searched in `host + path`.
    """

    action: str
    host: str = ""
    path: str = "/"
    pattern: str | None = None

    @property
    def name(self) -> str:
        return self.pattern if self.pattern is not None else self.host + self.path

    @property
    def regex(self) -> str:
        return self.pattern if self.pattern is not None else rf"^(?:[^/]*\.)?\Q{self.host}\E\n\Q{self.path}\E"

    def literals(self) -> tuple[tuple[str, ...], ...]:
        """For each way to fit, whole tokens of the URL: host labels, and path words with a break on both sides."""
        if self.pattern is not None:
            return pattern_tokens(self.pattern)
        tokens = re.findall(r"[0-9a-z]+", self.host) + re.findall(r"(?<=[^0-9a-z])[0-9a-z]+(?=[^0-9a-z])", self.path)
        return (tuple(dict.fromkeys(tokens)),) if tokens else ()


#: Rules of the registered query; the last three stand for a content block list of the operator's own.
CONTRACT_RULES = (
    Rule("allow", "org"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
CONTENT_RULES = (
    Rule("block", pattern=r"(^|[^0-9a-z])cheap[-_.]?pills([^0-9a-z]|$)"),
    Rule("block", pattern=r"(^|[^0-9a-z])casino([^0-9a-z]|$)"),
    Rule("block", pattern=r"(^|[^0-9a-z])xxx([^0-9a-z]|$)"),
)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.concat(host, F.lit("/"), path), "[^0-9a-z]+"), lambda t: t != ""))


def token_frequencies(urls: DataFrame, tokens: list[str], column: str = "url") -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs, over all rows; one number for each token reaches the driver."""
    if not tokens:
        return {}
    has = _tokens(host_of(F.col(column)), path_of(F.col(column)))
    if len(tokens) <= PLAN_RULES:
        found = urls.select(F.explode(F.array_intersect(has, F.array(*map(F.lit, tokens)))).alias("t"))
    else:
        known = urls.sparkSession.createDataFrame([(t,) for t in tokens], "t string")
        found = urls.select(F.explode(has).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("count")).join(_small(known), "t")
        return {t: 0 for t in tokens} | {r[0]: r[1] for r in found.collect()}
    return {t: 0 for t in tokens} | {r[0]: r[1] for r in found.groupBy("t").count().collect()}


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if few(df) else df


def build_index(rules: tuple[Rule, ...], frequency: dict[str, int]) -> dict[str, list[int]]:
    """token -> numbers of the rules filed under it; rules without a literal token are filed under ''."""
    index: dict[str, list[int]] = {}
    for n, rule in enumerate(rules):
        for token in {min(way, key=lambda t: (frequency.get(t, 0), t)) for way in rule.literals()} or {""}:
            index.setdefault(token, []).append(n)
    return index


def read_rules(table: DataFrame) -> tuple[Rule, ...]:
    """Rules of a table (action, host, path, pattern); nulls take the defaults. The list must fit the driver, like any given one."""
    rows = table.select("action", "host", "path", "pattern").orderBy("host", "path", "pattern", "action").toLocalIterator()
    return tuple(Rule(r[0], r[1] or "", "/" if r[2] is None else r[2], r[3]) for r in rows)


def _fits(r) -> Column:
    """Host rules see host and path with a line break between them; content rules see them run together."""
    return F.when(r["host_rule"], F.regexp_like(F.concat("host", F.lit("\n"), "path"), r["regex"])).otherwise(F.regexp_like(F.concat("host", "path"), r["regex"]))


def _planned(out: DataFrame, every: tuple[Rule, ...], index: dict[str, list[int]]) -> DataFrame:
    """out with _host, _content and n_candidates; rules and index are literals of the plan."""
    index = dict(index)
    always = index.pop("", [])
    plain = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(len(r.name)).alias("size"), F.lit(r.pattern is None).alias("host_rule"), F.lit(r.regex).alias("regex"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action")) for n, r in enumerate(every)])
    none = F.array().cast("array<int>")
    filed = F.lit(none)
    if index:
        table = F.create_map(*[x for t, ns in index.items() for x in (F.lit(t), F.array(*map(F.lit, ns)))])
        filed = F.flatten(F.transform(F.array_intersect(F.col("_tokens"), F.array(*map(F.lit, index))), lambda t: F.element_at(table, t)))
    candidates = F.array_distinct(F.concat(filed, F.array(*map(F.lit, always)) if always else none))
    out = out.withColumn("_tokens", _tokens(F.col("host"), F.col("path")))
    out = out.withColumn("_candidates", F.transform(candidates, lambda n: F.element_at(plain, n + 1)))
    out = out.withColumn("_fits", F.filter("_candidates", _fits))
    best = lambda kind: F.array_min(F.transform(F.filter("_fits", lambda r: r["host_rule"] == F.lit(kind)), lambda r: F.struct((-r["size"]).alias("size"), r["n"].alias("n"), r["name"].alias("name"), r["action"].alias("action"))))
    return out.withColumns({"_host": best(True), "_content": best(False), "n_candidates": F.size("_candidates")}).drop("_tokens", "_candidates", "_fits")


def _joined(out: DataFrame, every: tuple[Rule, ...], index: dict[str, list[int]]) -> DataFrame:
    """The same for long lists: distinct (host, path) meet their candidates in a join on the token.

    Counted filed rules are broadcast if they are few, else both sides are
    shuffled by token, where the planner splits frequent ones.
    """
    rows = [(t, n, len(every[n].name), every[n].pattern is None, every[n].regex, every[n].name, every[n].action) for t, ns in index.items() for n in ns]
    filed = out.sparkSession.createDataFrame(rows, "_token string, n int, size int, host_rule boolean, regex string, name string, action string")
    own = _tokens(F.col("host"), F.col("path"))
    token = out.select("host", "path").distinct().select("host", "path", F.explode(F.concat(own, F.array(F.lit(""))) if "" in index else own).alias("_token"))
    met = token.join(_small(filed), "_token").select("host", "path", "n", "size", "host_rule", "name", "action", _fits({c: F.col(c) for c in ("host_rule", "regex")}).alias("fits"))
    order = F.struct((-F.col("size")).alias("size"), "n", "name", "action")
    best = met.groupBy("host", "path").agg(F.min(F.when(F.col("fits") & F.col("host_rule"), order)).alias("_host"), F.min(F.when(F.col("fits") & ~F.col("host_rule"), order)).alias("_content"), F.count_distinct("n").cast("int").alias("n_candidates"))
    return out.join(_small(best), ["host", "path"], "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = CONTRACT_RULES, content: tuple[Rule, ...] = CONTENT_RULES, default: str = "allow", column: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict, content_rule and n_candidates.

    The longest host rule that fits decides (equal lengths: the earlier rule);
    where none fits, `rule` is null and a fitting content rule, else `default`,
    decides.  A null url or one without `://` has empty host and path, so no host
    rule fits it.  Repeated rows get equal results; columns of the input that
    clash with the added ones are replaced.  Up to PLAN_RULES rules nothing is
    shuffled but the token counts; longer lists are joined, for the same rows.
    """
    every = tuple(rules) + tuple(content)
    index = build_index(every, token_frequencies(pages, sorted({t for r in every for way in r.literals() for t in way}), column))
    order = [c for c in pages.columns if c not in ("n_candidates", "rule", "content_rule", "verdict")]
    out = pages.select(*order).withColumns({"host": host_of(F.col(column)), "path": path_of(F.col(column))})
    if not every:
        none = F.lit(None).cast("struct<name:string,action:string>")
        out = out.withColumns({"_host": none, "_content": none, "n_candidates": F.lit(0)})
    else:
        out = (_planned if len(every) <= PLAN_RULES else _joined)(out, every, index)
    return out.select(
        *order,
        *[c for c in ("host", "path") if c not in order],
        "n_candidates",
        F.col("_host.name").alias("rule"),
        F.col("_content.name").alias("content_rule"),
        F.coalesce(F.col("_host.action"), F.col("_content.action"), F.lit(default)).alias("verdict"),
    )
