"""URL filter: rules indexed by their rarest literal token.

A rule names a host (it fits that host and all its subdomains) and the beginning
of a path.  Its literal tokens are the runs of ASCII letters and digits that
every URL it fits must hold in full: all labels of the host, and those of the
path that a further character ends inside the rule.  The rule is indexed under
the one that the fewest rules have.  A URL's own tokens fetch the candidate
rules; only these run their regular expression, and the longest that fits
decides.  A rule without any full token is a candidate for every URL.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

#: The rule list goes to every task; longer ones are refused.
MAX_RULES = 200_000

_TOKEN = re.compile(r"[0-9A-Za-z]+")
_ENDED_TOKEN = re.compile(r"[0-9A-Za-z]+(?=[^0-9A-Za-z])")
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path

    def tokens(self) -> set[str]:
        return {f"h:{t}" for t in _TOKEN.findall(self.host)} | {f"p:{t}" for t in _ENDED_TOKEN.findall(self.path)}

    def regex(self) -> re.Pattern:
        """Over host, a line feed, and path; a host holds no slash, so the first one begins the path."""
        return re.compile(r"(?:[^\0]*\.)?" + re.escape(self.host) + r"\0" + re.escape(self.path), re.DOTALL)


class RuleIndex:
    def __init__(self, rules: list[Rule]):
        held_by = Counter(t for r in rules for t in r.tokens())
        self.by_token: dict[str, list[tuple]] = defaultdict(list)
        self.always: list[tuple] = []
        for rule in rules:
            # longest first; then the longer host; then block before allow; then by text
            entry = (-len(rule.text), -len(rule.host), rule.verdict != "block", rule.text, rule.verdict, rule.regex())
            rarest = min(rule.tokens(), key=lambda t: (held_by[t], -len(t), t), default=None)
            (self.always if rarest is None else self.by_token[rarest]).append(entry)

    def judge(self, host: str, path: str) -> tuple[str | None, str | None]:
        """Text and verdict of the rule that decides; None, None where none fits."""
        found = list(self.always)
        for kind, part in (("h:", host), ("p:", path)):
            for token in dict.fromkeys(_TOKEN.findall(part)):
                found += self.by_token.get(kind + token, ())
        key = f"{host}\0{path}"
        for entry in sorted(found, key=lambda e: e[:4]):
            if entry[5].match(key):
                return entry[3], entry[4]
        return None, None


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty for null and without ``://``."""
    m = _URL.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def judge(df: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """``df`` with host, path, rule (null if none fits) and verdict of each URL.

    Every row is judged by itself: repeated rows alike, null and empty URLs as
    host and path empty.  Input columns of those four names are replaced.  No
    shuffle; the rules travel with the task and are limited to ``MAX_RULES``.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are sent to each task")
    added = T.StructType([T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")])

    def make():
        index = RuleIndex(rules)

        def step(urls: pa.Array):
            rows = []
            for u in urls.to_pylist():
                host, path = split_url(u)
                rule, verdict = index.judge(host, path)
                rows.append((host, path, rule, verdict or default))
            return list(zip(*rows)) or [[], [], [], []]
        return step

    return add_columns(df, [url], added, make)
