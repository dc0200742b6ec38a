"""URL filters: rules indexed by their rarest literal token.

Every rule names literal tokens (lower-case runs of letters and digits) that a
url it fits must hold as whole tokens. Of these the one that is rarest in the
corpus is its place in the index. The tokens of a url fetch candidate rules,
and only those run their regular expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Rules travel to every task; a larger list has to be split by the caller.
MAX_RULES = 200_000


@dataclass(frozen=True)
class SiteRule:
    """Fits a host and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def tokens(self) -> list[str]:
        # the last token of the path can be the start of a longer one in the url
        whole = self.path[: len(self.path) - len(re.search(r"[A-Za-z0-9]*\Z", self.path)[0])]
        return _TOKEN.findall(self.host.translate(_LOWER)) + _TOKEN.findall(whole.translate(_LOWER))

    def compiled(self) -> re.Pattern:
        return re.compile(r"(?:.*\.)?" + re.escape(self.host), re.S)


@dataclass(frozen=True)
class PatternRule:
    """Fits urls that ``pattern`` is found in; ``tokens`` stand in all of them."""

    verdict: str
    name: str
    pattern: str
    tokens: tuple[str, ...]

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern)


SITE_RULES = (
    SiteRule("block", "net", "/"),
    SiteRule("allow", "example.net", "/en/"),
    SiteRule("block", "example.com", "/de/"),
    SiteRule("allow", "org", "/fr/"),
)

#: The method's own verdicts, in order of precedence; a url that none fits is allowed.
PATTERN_RULES = (
    PatternRule("block", "deep-paging", r"[?&]page=[0-9]{3,}(&|#|$)", ("page",)),
    PatternRule("block", "session-id", r"[?&]sessionid=[0-9A-Za-z]+", ("sessionid",)),
    PatternRule("block", "php-session", r"[?&]phpsessid=[0-9A-Za-z]+", ("phpsessid",)),
    PatternRule("block", "login", r"/login(/|[?#]|$)", ("login",)),
    PatternRule("block", "cart", r"/cart(/|[?#]|$)", ("cart",)),
    PatternRule("block", "search-result", r"/search[?]q=", ("search", "q")),
    PatternRule("block", "tag-feed", r"/tag/[^/]+/feed(/|[?#]|$)", ("tag", "feed")),
    PatternRule("block", "print-view", r"[?&]print=1(&|#|$)", ("print", "1")),
    PatternRule("block", "reply", r"[?&]replytocom=[0-9]+", ("replytocom",)),
    PatternRule("block", "calendar", r"/calendar/[0-9]{4}/[0-9]{2}(/|[?#]|$)", ("calendar",)),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (ASCII lower case) and path; both empty without ``://``."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :])
    return rest[1].translate(_LOWER), rest[2]


class Index:
    """Rules by their rarest token."""

    def __init__(self, sites, patterns, frequency: dict[str, int]):
        self.by_token: dict[str, list] = {}
        self.rest: list = []  # rules without a literal token run on every url
        for rank, rule in enumerate((*sites, *patterns)):
            tokens = sorted(set(rule.tokens), key=lambda t: (frequency.get(t, 0), -len(t), t))
            (self.by_token.setdefault(tokens[0], []) if tokens else self.rest).append((rank, rule, rule.compiled()))

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        host, path = split_url(url)
        url = url or ""
        candidates = list(self.rest)
        for token in set(_TOKEN.findall(url.translate(_LOWER))):
            candidates += self.by_token.get(token, ())
        site, pattern = None, None
        for rank, rule, regex in candidates:
            if isinstance(rule, SiteRule):
                better = site is None or (-len(rule.name), rank) < (-len(site[1].name), site[0])
                if better and path.startswith(rule.path) and regex.fullmatch(host):
                    site = rank, rule
            elif (pattern is None or rank < pattern[0]) and regex.search(url):
                pattern = rank, rule
        hit = site or pattern
        return host, path, site[1].name if site else None, hit[1].verdict if hit else "allow", pattern[1].name if pattern else None


def judge(pages: DataFrame, sites=SITE_RULES, patterns=PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern for every row of ``pages``.

    ``rule`` is the longest site rule that fits (of equal lengths the first
    given), else null; without one the verdict is that of the first pattern
    rule that fits, else allow. ``pattern`` names that pattern rule either way.
    Null and empty urls have empty host and path and no rule. Rows that repeat
    are judged each; other columns are ignored; empty tables give no rows. One
    pass over the urls and one count of the rules' tokens; no row is moved."""
    if len(sites) + len(patterns) > MAX_RULES:
        raise ValueError(f"{len(sites) + len(patterns)} rules; at most {MAX_RULES} go to every task at once")
    wanted = sorted({t for rule in (*sites, *patterns) for t in rule.tokens})
    tokens = pages.select(F.explode(F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+"))).alias("t"))
    table = F.broadcast(pages.sparkSession.createDataFrame([(t,) for t in wanted], "t string"))  # at most the rules' tokens
    frequency = dict(tokens.join(table, "t", "left_semi").groupBy("t").count().collect())
    share = pages.sparkSession.sparkContext.broadcast((sites, patterns, frequency))

    @F.arrow_udf("struct<host string, path string, rule string, verdict string, pattern string>")
    def verdict(url: pa.Array) -> pa.Array:
        index = Index(*share.value)
        rows = [index.judge(u) for u in url.to_pylist()]
        names = ["host", "path", "rule", "verdict", "pattern"]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names=names)

    return pages.select("page_id", verdict("url").alias("v")).select("page_id", "v.*")
