"""URL filters: pattern rules found by their rarest literal token.

A rule is a line of a filter list: literal text, ``*`` for anything, ``^`` for a
separator (anything but a letter, a digit, ``_``, ``.``, ``%`` or ``-``) or the
end, ``|`` at either end for that end of the URL, ``||`` before it for the
beginning of the host or of one of its parents, ``@@`` before a rule that allows.
Letters are compared lowered, unless the rule ends in ``$match-case``, the one
option that a URL alone decides; rules with others (``$image``, ``$domain=``)
are refused. ``load`` reads a list from a file or table: comments, headers and
rules that hide parts of pages are left out, repeated rules count once. A rule's tokens are the runs of letters and digits that
every match must have whole, which follows from its text: on both sides stands
other literal text, a separator or an end. Its index key is the token that is
rarest in the URLs themselves: the URLs' tokens meet the table of the rules'
tokens in a join and are counted, a row per token of a rule. A URL is cut into
its own tokens, each fetches the rules filed under it, and only those run as
regular expressions, compiled when first fetched. A rule without a whole token is
refused: no rule runs on every URL. Rules are broadcast once; more than ``MOST``
of them are refused.

On top of the patterns stand host-and-path rules, of which the longest that
fits wins over any pattern. A null URL, or one without ``://``, has an empty
host and path and gets the verdict ``allow``. Repeated rows get equal rows; an
empty table gives no rows; extra columns are left behind.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, ALLOW = "block", "allow"
SEPARATOR = "(?:[^a-z0-9_.%-]|$)"
TOKEN = "[a-z0-9]+"
#: Fixed values of filter lists: where a host or a parent of it begins, options at a rule's end, and lines that are no URL rules.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*\.)?"
OPTIONS = re.compile(r"\$(~?[a-z][a-z0-9-]*(?:=[^,$]*)?(?:,~?[a-z][a-z0-9-]*(?:=[^,$]*)?)*)$")
NO_RULE = re.compile(r"^\s*$|^!|^\[|#[@?$%]?#")
#: Rules that are broadcast, at most.
MOST = 1_000_000


@dataclass(frozen=True)
class Pattern:
    """A line of a filter list."""

    text: str

    @property
    def verdict(self) -> str:
        return ALLOW if self.text.startswith("@@") else BLOCK

    @cached_property
    def match_case(self) -> bool:
        """Whether letters are compared as they are; options that a URL does not decide are refused."""
        m = OPTIONS.search(self.text)
        names = m[1].split(",") if m else []
        if other := [n for n in names if n != "match-case"]:
            raise ValueError(f"the rule {self.text} has options that a URL alone does not decide: {', '.join(other)}")
        return bool(names)

    @cached_property
    def _pattern(self) -> str:
        own = OPTIONS.sub("", self.text) if self.match_case else self.text
        return own.removeprefix("@@")

    @cached_property
    def body(self) -> str:
        return self._pattern.lower()

    @cached_property
    def regex(self) -> str:
        """The rule as a regular expression over a lowered URL, or over the URL itself with match-case."""
        body = self._pattern if self.match_case else self.body
        first = HOST if body.startswith("||") else "^" if body.startswith("|") else ""
        inner = body.removeprefix("|").removeprefix("|") if first == HOST else body.removeprefix("|")
        last = inner.endswith("|")
        separator = SEPARATOR.replace("a-z", "A-Za-z") if self.match_case else SEPARATOR
        special = {"*": ".*", "^": separator}
        return first + "".join(special.get(c) or re.escape(c) for c in inner.removesuffix("|")) + "$" * last

    @cached_property
    def tokens(self) -> tuple[str, ...]:
        """Runs that any match has whole in the URL."""
        found = []
        for m in re.finditer(TOKEN, self.body):
            before, after = self.body[: m.start()][-1:], self.body[m.end() :][:1]
            if before not in ("", "*") and after not in ("", "*"):
                found.append(m[0])
        return tuple(dict.fromkeys(found))


@dataclass(frozen=True)
class HostPath:
    """Fits its host and all subdomains, if the URL's path starts with its own."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules that the contract names.
HOST_PATH_RULES = (
    HostPath("com", "/en/", BLOCK),
    HostPath("example.com", "/en/7", ALLOW),
    HostPath("net", "/de/", ALLOW),
    HostPath("example.net", "/de/8", BLOCK),
    HostPath("org", "/es/", BLOCK),
)

#: Advertising, tracking, shop, account and gambling pages, session copies, and files that are not text.
PATTERNS = tuple(
    Pattern(line)
    for line in """
://ads.
://adserver.
://adservice.
://banner.
://pixel.
://tracker.
://tracking.
/adclick^
/doubleclick/
/wp-login.php^
/wp-admin/
/cgi-bin/
/cart^
/checkout^
/basket^
/signin^
/signup^
/login^
/logout^
/password/reset^
?replytocom=
&replytocom=
?sessionid=
&sessionid=
?phpsessid=
&phpsessid=
;jsessionid=
?print=1^
&print=1^
://casino.
.casino-
://casino-
.poker-
.betting-
/affiliate/*/click^
/tag/*/feed^
.gif^
.jpg^
.jpeg^
.png^
.zip^
.exe^
.mp4^
.css^
@@://docs.*/cart^
@@://help.*/login^
@@/robots.txt|
""".split()
)

_TOKEN = re.compile(TOKEN)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path; both empty for null or without ://."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return _lower(host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def _lower(s: str) -> str:
    return s.encode().lower().decode()


def load(lines: DataFrame, column: str = "value") -> list[Pattern]:
    """The rules of a list, one a row (as spark.read.text gives a file)."""
    text = F.trim(F.col(column))
    rows = lines.where(text.isNotNull()).select(text.alias("t")).distinct().orderBy("t").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rules")
    return [Pattern(r["t"]) for r in rows if not NO_RULE.search(r["t"])]


class PatternIndex:
    """Patterns by their token that is rarest by often (how many URLs have it)."""

    def __init__(self, patterns: Sequence[Pattern], often: Mapping[str, int]):
        self.by_token: dict[str, list[tuple[str, str]]] = defaultdict(list)
        self.compiled: dict[str, re.Pattern] = {}
        self.cased = {p.regex for p in patterns if p.match_case}
        for p in dict.fromkeys(patterns):
            if not p.tokens:
                raise ValueError(f"the rule {p.text} has no whole token to be found by")
            key = min(p.tokens, key=lambda t: (often.get(t, 0), -len(t), t))
            self.by_token[key].append((p.regex, p.verdict))

    def fetched(self, low: str) -> list[tuple[re.Pattern, str]]:
        """The rules that a lowered URL's tokens are the keys of."""
        return [(self._compiled(regex), v) for t in {*_TOKEN.findall(low)} & self.by_token.keys() for regex, v in self.by_token[t]]

    def _compiled(self, regex: str) -> re.Pattern:
        found = self.compiled.get(regex)
        if found is None:
            found = self.compiled[regex] = re.compile(regex, re.ASCII)
        return found

    def verdict(self, url: str) -> str:
        """allow if an allowing pattern matches or none does, else block."""
        low = _lower(url)
        found = {v for r, v in self.fetched(low) if r.search(url if r.pattern in self.cased else low)}
        return BLOCK if found == {BLOCK} else ALLOW


def token_counts(urls: DataFrame, patterns: Sequence[Pattern]) -> dict[str, int]:
    """How many of the urls have each token of a pattern."""
    tokens = urls.sparkSession.createDataFrame([(t,) for t in sorted({t for p in patterns for t in p.tokens})], "token string")
    low = F.translate("url", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(f"({TOKEN})"), F.lit(1)))).alias("token"))
    counts = own.join(tokens, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    return {r["token"]: r["n"] for r in counts.collect()}  # a row per token of a rule


class HostPathIndex:
    """Rules by host; a URL looks up its host and each of its parents."""

    def __init__(self, rules: Sequence[HostPath]):
        self.by_host: dict[str, list[HostPath]] = defaultdict(list)
        for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
            self.by_host[r.host].append(r)

    def find(self, host: str, path: str) -> HostPath | None:
        labels, fits = host.split("."), []
        for i in range(len(labels)):
            fits += [r for r in self.by_host.get(".".join(labels[i:]), ()) if path.startswith(r.path)][:1]
        return max(fits, key=lambda r: len(r.text), default=None)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[HostPath] = HOST_PATH_RULES, patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    """id_col, host, path, rule (null if none fits) and verdict of each row."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    if len(patterns) > MOST:
        raise ValueError(f"more than {MOST} rules")
    often = token_counts(rows, patterns) if patterns else {}
    sent = pages.sparkSession.sparkContext.broadcast((HostPathIndex(rules), PatternIndex(patterns, often)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host, by_token = sent.value
        for b in batches:
            out = []
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                rule = by_host.find(host, path)
                pattern = ALLOW if rule or url is None or "://" not in url else by_token.verdict(url)
                out.append((host, path, rule and rule.text, rule.verdict if rule else pattern))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in out], pa.string()) for i in range(4))], ["id", "host", "path", "rule", "verdict"])

    kind = dict(pages.dtypes)[id_col]
    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
