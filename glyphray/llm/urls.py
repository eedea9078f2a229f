"""URL filter: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms that reject a URL alone, and terms of which several different ones do.
STRICT = ("adult-x", "casino", "porn", "spam-farm", "viagra", "warez", "xxx")
SOFT = (
    "ads", "adult", "bet", "bets", "bonus", "cheap", "farm", "free", "hot", "jackpot", "pills", "poker", "sexy", "spam",
    "track", "win",
)
SEVERAL = 2
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


class Rule(NamedTuple):
    """``verdict`` (allow or block) for a host and its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased; path: on to ``?``, ``#`` or the end.

    Both are empty where the url is null or has no ``://``. User names and ports stay in the host.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lowered(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _bounded(text: str, start: int, end: int) -> bool:
    """Whether no ASCII letter or digit and no character beyond ASCII touches ``text[start:end]``."""
    free = lambda c: c.isascii() and not c.isalnum()
    return (start == 0 or free(text[start - 1])) and (end == len(text) or free(text[end]))


def automaton(strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton | None:
    """Finds all terms in one pass; each value is the term with its kind. A term in both lists is strict."""
    kinds = {t.translate(_LOWER): False for t in soft if t} | {t.translate(_LOWER): True for t in strict if t}
    if not kinds:
        return None
    found = ahocorasick.Automaton()
    for term, is_strict in kinds.items():
        found.add_word(term, (term, is_strict))
    found.make_automaton()
    return found


def hits(found: ahocorasick.Automaton | None, url: str) -> tuple[int, int, int]:
    """Occurrences of strict and of soft terms between boundaries, and the number of different soft terms."""
    strict, soft, distinct = 0, 0, set()
    text = url.translate(_LOWER)
    for last, (term, is_strict) in found.iter(text) if found else ():
        if _bounded(text, last + 1 - len(term), last + 1):
            if is_strict:
                strict += 1
            else:
                soft += 1
                distinct.add(term)
    return strict, soft, len(distinct)


class RuleBook:
    """Rules by host; of those that fit, the one with the longest host wins, then the longest path, then block."""

    def __init__(self, rules: Sequence[Rule]):
        self.by_host: dict[str, list[Rule]] = {}
        for rule in sorted(rules, key=lambda r: (-len(r.path), r.verdict != "block")):
            self.by_host.setdefault(rule.host.translate(_LOWER), []).append(rule)
        self.longest = max(map(len, self.by_host), default=0)

    def find(self, host: str, path: str) -> Rule | None:
        """Only suffixes that are no longer than the longest host of a rule are looked up."""
        start = max(0, len(host) - self.longest - 1)
        if start:
            start = host.find(".", start) + 1 or len(host)
        while True:
            for rule in self.by_host.get(host[start:], ()):
                if path.startswith(rule.path):
                    return rule
            start = host.find(".", start) + 1
            if not start:
                return None


def judge(
    pages: DataFrame, rules: Sequence[Rule] = (), strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT,
    several: int = SEVERAL,
) -> DataFrame:
    """Every row of ``page_id, url`` with ``host, path, rule, verdict, strict_hits, soft_hits, soft_terms``.

    A fitting rule decides (``rule`` is its host and path); else a URL is blocked that has a strict term or ``several``
    different soft ones. Terms count where no letter, digit or character beyond ASCII touches them; A-Z count as a-z. One
    pass over the rows, no shuffle; rules and vocabulary are parameters and travel with the tasks. A null url has empty
    host and path, fits no rule with a host or path, and is allowed. Repeated rows are answered each, null ids stay, more
    columns are ignored. Cost is linear in a URL's length.
    """
    host, path = host_and_path(F.col("url"))
    kind = pages.schema["page_id"].dataType.simpleString()
    book = RuleBook(rules)
    terms = tuple(strict), tuple(soft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(*terms)
        for batch in batches:
            rows = []
            for url, h, p in zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path")), strict=True):
                count = hits(found, url or "")
                rule = book.find(h, p)
                blocked = rule.verdict == "block" if rule else count[0] > 0 or count[2] >= several
                rows.append((rule and rule.host + rule.path, "block" if blocked else "allow", *count))
            made = zip(*rows, strict=True) if rows else [()] * 5
            columns = [pa.array(c, t) for c, t in zip(made, [pa.string()] * 2 + [pa.int64()] * 3, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

    names = ["page_id", "url", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_terms"]
    schema = f"page_id {kind}, url string, host string, path string, rule string, verdict string, " \
        "strict_hits long, soft_hits long, soft_terms long"
    return pages.select("page_id", "url", host.alias("host"), path.alias("path")).mapInArrow(run, schema)
