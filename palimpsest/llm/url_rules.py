"""URL filters: rules of hosts and paths, and pattern rules that are looked up by their rarest literal token.

A pattern is literal text with ``*`` for any characters, ``^`` for a separator (none of ``a-z 0-9 _ . % -``, or the
end), ``||`` in front for the start of a host or of one of its labels, ``|`` for the start or the end of the URL, and
``@@`` in front of an exception. A token is a whole run of ``a-z 0-9``; one that a pattern is sure to have in the
URL is a literal run with another character or an anchor at either side. Each pattern lies in the index under that
of its tokens which the fewest URLs of the table have, and a URL's tokens fetch the patterns whose regular
expressions are run on it. Patterns without such a token are run on every URL.

Regular expressions take the first place of each part and don't go back (atomic groups), which finds a match if
there is one, in time that grows with the length of the URL.

The URLs' tokens are counted by Spark; only counts of the rules' own tokens reach the driver. Rules are a list of
at most MOST_RULES, which is what tasks hold; the pages are neither shuffled nor joined, so no host is hot.

Edge cases: a null URL, or one without ``://``, has an empty host and path and fits no host rule; a null URL is
allowed; letters other than A-Z keep their case; rows that repeat are judged alike; of host rules of one length
that both fit, the one that blocks wins, then the first by name; an empty table gives no rows; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)
TOKEN = re.compile("[a-z0-9]+")
#: The most rules of both kinds together: tasks hold them all.
MOST_RULES = 500_000

#: Rules of hosts and paths: (verdict, host and path).
HOST_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

#: Patterns for pages that hold no text worth keeping.
PATTERNS = """
||casino-
||casino.
-casino.
||poker.
||slots.
||bet-
||xxx.
||adult.
||porn.
||pills.
||pharma-*.
||cheap-*.
||free-*-download.
||warez.
||torrent.
||crack-
||keygen.
||track.
||click.
||ads.
||adserver.
||doubleclick.
||banner.
/ads/
/adserver/
/banners/
/popunder/
/cgi-bin/
/wp-login.php
/wp-admin/
/xmlrpc.php
/login?
/signin?
/logout^
/signup^
/register?
/cart^
/checkout^
/share?*url=
/search?*q=
/tag/*/page/
/feed/|
?replytocom=
&replytocom=
?sessionid=
&sessionid=
?phpsessid=
&phpsessid=
?print=1^
&print=1^
.exe|
.zip|
.iso|
^affiliate^
^sponsored^
.spam.
-spam.
||spam-
@@||docs.*/search?
@@||wiki*/tag/
@@/ads/about^
""".split()


@dataclass
class Pattern:
    text: str
    allows: bool
    #: Atomic form, which tasks run.
    regex: str
    #: The same without atomic groups, for other engines.
    plain: str
    tokens: list[str]


def parse(text: str) -> Pattern:
    """A pattern's regular expression, for a lower-cased URL from its start, and the tokens that it is sure to need."""
    rest = text.translate(TO_LOWER)
    allows = rest.startswith("@@")
    rest = rest[2:] if allows else rest
    host = rest.startswith("||")
    first = not host and rest.startswith("|")
    rest = rest[2 if host else 1 if first else 0 :]
    last = rest.endswith("|")
    rest = rest[:-1] if last else rest
    parts = rest.split("*")

    def literal(s: str) -> str:
        return "".join(r"(?:[^a-z0-9_.%-]|\z)" if c == "^" else re.escape(c) for c in s)

    label = r"[^:/?#]*://(?:[^/?#]*?[.@])??"
    heads = [label if host else "" if first else ".*?", *[".*?"] * (len(parts) - 1)]
    pieces = [h + literal(p) for h, p in zip(heads, parts)]
    plain = r"\A" + "".join(pieces) + (r"\z" if last else "")
    # only what must reach the end is tried at more than one place
    regex = "".join(f"(?>{p})" for p in pieces[:-1]) + (pieces[-1] + r"\z" if last else f"(?>{pieces[-1]})")
    tokens = []
    for k, p in enumerate(parts):
        for m in TOKEN.finditer(p):
            begins = m.start() > 0 or (k == 0 and (host or first))
            ends = m.end() < len(p) or (k == len(parts) - 1 and last)
            if begins and ends:
                tokens.append(m.group())
    return Pattern(text, allows, regex.replace(r"\z", r"\Z"), plain, sorted(set(tokens)))


@dataclass
class Index:
    """Host rules by host, patterns by their rarest token."""

    hosts: dict[str, list[tuple[str, str, str]]] = field(default_factory=dict)
    longest: int = 0
    by_token: dict[str, list[int]] = field(default_factory=dict)
    untold: list[int] = field(default_factory=list)
    patterns: list[Pattern] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.compiled: dict[int, re.Pattern] = {}

    def host_rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The verdict and the name of the longest rule that fits. Names longer than any rule's host aren't built."""
        best, at = None, len(host)
        while True:
            at = host.rfind(".", 0, at) if at > 0 else -1
            name = host[at + 1 :] if len(host) - at - 1 <= self.longest else None
            if name is None:
                break
            for begin, rule, verdict in self.hosts.get(name, ()):
                if path.startswith(begin):
                    found = (-len(rule), verdict != "block", rule, verdict)
                    best = found if best is None else min(best, found)
            if at < 0:
                break
        return best and (best[3], best[2])

    def candidates(self, url: str) -> list[int]:
        """Numbers of the patterns to be run on a lower-cased URL, in order."""
        found = set(self.untold)
        for t in set(TOKEN.findall(url)):
            found.update(self.by_token.get(t, ()))
        return sorted(found)

    def matches(self, k: int, url: str) -> bool:
        if k not in self.compiled:
            self.compiled[k] = re.compile(self.patterns[k].regex, re.DOTALL)
        return self.compiled[k].match(url) is not None

    def judge(self, url: str) -> tuple[str, str | None, int]:
        """Verdict, the pattern that brought it, and how many were run: an exception that matches allows, else the
        first pattern that matches blocks."""
        url = url.translate(TO_LOWER)
        tried = self.candidates(url)
        hits = [k for k in tried if self.matches(k, url)]
        for allows in (True, False):
            for k in hits:
                if self.patterns[k].allows == allows:
                    return "allow" if allows else "block", self.patterns[k].text, len(tried)
        return "allow", None, len(tried)


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    host = re.compile("[^/?#]*").match(url, at + 3)
    return host.group().translate(TO_LOWER), re.compile("[^?#]*").match(url, host.end()).group()


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many of the rows' URLs have each of the tokens."""
    lower = F.translate(F.col("url").cast("string"), UPPER, LOWER)
    each = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit("[a-z0-9]+"), F.lit(0)))).alias("token"))
    wanted = urls.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    counted = each.join(F.broadcast(wanted), "token").groupBy("token").count()  # as many as rules have tokens at most
    return {r["token"]: r["count"] for r in counted.collect()}


def build_index(pages: DataFrame, host_rules: list[tuple[str, str]], patterns: list[str]) -> Index:
    """The index of the rules, with the tokens' counts in the pages' URLs."""
    if len(host_rules) + len(patterns) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    index = Index(patterns=[parse(p) for p in patterns])
    for verdict, rule in host_rules:
        host, slash, path = rule.partition("/")
        host = host.translate(TO_LOWER)
        index.hosts.setdefault(host, []).append((slash + path, rule, verdict))
        index.longest = max(index.longest, len(host))
    tokens = sorted({t for p in index.patterns for t in p.tokens})
    counts = token_counts(pages, tokens) if tokens else {}
    for k, p in enumerate(index.patterns):
        if p.tokens:
            index.by_token.setdefault(min(p.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(k)
        else:
            index.untold.append(k)
    return index


def judge_urls(pages: DataFrame, host_rules: list[tuple[str, str]] = HOST_RULES, patterns: list[str] = PATTERNS) -> DataFrame:
    """page_id, host, path, rule, verdict, and the pattern that decided with the number of patterns that were run
    (null and 0 where a host rule decided)."""
    shared = pages.sparkSession.sparkContext.broadcast(build_index(pages, host_rules, patterns))
    schema = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("host", "path", "rule", "verdict", "pattern")), ("tried", pa.int64())])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            out = []
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                fits = index.host_rule(host, path)
                out.append((host, path, fits[1], fits[0], None, 0) if fits else (host, path, None, *index.judge(url or "")))
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return rows.mapInArrow(judged, "page_id long, host string, path string, rule string, verdict string, pattern string, tried long")


def without_blocked(pages: DataFrame, host_rules: list[tuple[str, str]] = HOST_RULES, patterns: list[str] = PATTERNS) -> DataFrame:
    """The pages that are not blocked, whole and in their own columns."""
    shared = pages.sparkSession.sparkContext.broadcast(build_index(pages, host_rules, patterns))

    @F.pandas_udf("boolean")
    def allowed(urls: pd.Series) -> pd.Series:
        index = shared.value
        return pd.Series([(index.host_rule(*split_url(u)) or index.judge(u or ""))[0] == "allow" for u in urls], dtype=bool)

    return pages.where(allowed(F.col("url").cast("string")))


def oracle() -> str:
    """DuckDB SQL of the same verdicts: every rule is tried on every URL."""
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in HOST_RULES)
    known = [parse(p) for p in PATTERNS]
    tried = ", ".join(f"({k}, {str(p.allows).lower()}, '{p.text}', '{'(?s)' + p.plain}')" for k, p in enumerate(known))
    sure = ", ".join(f"({k}, [{', '.join(repr(t) for t in p.tokens)}]::VARCHAR[])" for k, p in enumerate(known))
    lower = f"translate(url, '{UPPER}', '{LOWER}')"
    return rf"""
        WITH rules(verdict, rule, host, path) AS (VALUES {rules}), patterns(k, allows, text, regex) AS (VALUES {tried}), sure(k, tokens) AS (VALUES {sure}),
        u AS (SELECT row_number() OVER () AS n, page_id, url, {lower} AS low,
                     CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '(?s)^[^/?#]*', 0) ELSE '' END AS h FROM pages),
        p AS MATERIALIZED (SELECT n, page_id, low, translate(h, '{UPPER}', '{LOWER}') AS host,
                     CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3 + length(h)), '(?s)^[^?#]*', 0) ELSE '' END AS path,
                     list_distinct(regexp_extract_all(low, '[a-z0-9]+')) AS tokens FROM u),
        f AS (SELECT n, rule, rules.verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC, rules.verdict DESC, rule) AS nth FROM p JOIN rules
              ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path)),
        c AS (SELECT t, count(*) AS c FROM (SELECT unnest(tokens) AS t FROM p) GROUP BY 1),
        i AS (SELECT k, arg_min(t, (coalesce(c, 0), -length(t), t)) AS t FROM (SELECT k, unnest(tokens) AS t FROM sure) LEFT JOIN c USING (t) GROUP BY 1),
        q AS (SELECT n, count(*) AS tried FROM p JOIN (SELECT sure.k, i.t FROM sure LEFT JOIN i ON sure.k = i.k) x ON x.t IS NULL OR list_contains(coalesce(p.tokens, []), x.t) GROUP BY 1),
        m AS (SELECT n, text, allows, row_number() OVER (PARTITION BY n ORDER BY allows DESC, k) AS nth FROM p JOIN patterns ON regexp_matches(coalesce(low, ''), regex))
        SELECT page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN m.allows = false THEN 'block' ELSE 'allow' END) AS verdict,
               CASE WHEN f.rule IS NULL THEN m.text END AS pattern, CAST(CASE WHEN f.rule IS NULL THEN coalesce(q.tried, 0) ELSE 0 END AS BIGINT) AS tried
        FROM p LEFT JOIN f ON p.n = f.n AND f.nth = 1 LEFT JOIN m ON p.n = m.n AND m.nth = 1 LEFT JOIN q ON p.n = q.n
    """
