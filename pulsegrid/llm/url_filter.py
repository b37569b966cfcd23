"""URL filter: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

One pass of the automaton over a url gives all terms in it. A term counts where no letter or digit stands on either
side. One strict term rejects the url; soft terms reject it when enough different ones occur.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm.common import ASCII_LOWER, map_arrow, table


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"),
)
STRICT = ("porn", "xxx", "hentai", "escort", "cheap-pills", "viagra", "casino-bonus", "warez")
SOFT = ("adult", "bet", "bonus", "casino", "cheap", "click", "crack", "download", "free", "loan", "pills", "poker", "prize", "sex", "slots", "torrent", "win")
SOFT_LIMIT = 2


def host_and_path(url: str | None) -> tuple[str, str]:
    """Null or without ``://``: both empty. A-Z in the host are lower-cased, nothing else is."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((k for c in "?#" if (k := rest.find(c)) >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    cut = end if slash < 0 else slash
    return rest[:cut].encode().translate(ASCII_LOWER).decode(), rest[cut:end]


class RuleTable:
    """Rules by host; a url looks up its host's suffixes, longest first."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.by_host: dict[str, list[Rule]] = {}
        for rule in rules:
            self.by_host.setdefault(rule.host, []).append(rule)
        for same in self.by_host.values():
            same.sort(key=lambda r: -len(r.path))

    def find(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits, by the length of its host and path together; among equals the longer host."""
        fits = []
        while host:
            fits += [r for r in self.by_host.get(host, ()) if path.startswith(r.path)][:1]
            host = host.partition(".")[2]
        return max(fits, key=lambda r: (len(r.name), len(r.host)), default=None)


class Vocabulary:
    def __init__(self, strict: Iterable[str], soft: Iterable[str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for term, kind in [(t.lower(), "soft") for t in soft] + [(t.lower(), "strict") for t in strict]:
            self.automaton.add_word(term, (term, kind))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def count(self, url: str) -> tuple[int, int]:
        """Strict occurrences and different soft terms."""
        strict, soft = 0, set()
        if self.any:
            text = url.encode().translate(ASCII_LOWER).decode()
            for end, (term, kind) in self.automaton.iter(text):
                first = end - len(term) + 1
                if (first and text[first - 1].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum()):
                    continue
                if kind == "strict":
                    strict += 1
                else:
                    soft.add(term)
        return strict, len(soft)


def judge(pages: DataFrame, rules: Iterable[Rule] = RULES, strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, n_strict, n_soft.

    A rule's verdict goes before the vocabulary's. Null urls have an empty host and path, no rule and no terms: allow.
    Repeated rows give equal rows; only page_id and url are read, so a page's html never leaves the file.
    """
    held = pages.sparkSession.sparkContext.broadcast((tuple(rules), tuple(strict), tuple(soft)))
    state: dict[str, tuple[RuleTable, Vocabulary]] = {}

    def run(batch: dict) -> dict:
        if not state:
            some, hard, mild = held.value
            state["it"] = RuleTable(some), Vocabulary(hard, mild)
        table_, vocabulary = state["it"]
        rows = []
        for url in batch["url"]:
            host, path = host_and_path(url)
            rule = table_.find(host, path)
            n_strict, n_soft = vocabulary.count(url or "")
            verdict = rule.verdict if rule else "block" if n_strict or n_soft >= soft_limit else "allow"
            rows.append((host, path, rule.name if rule else None, verdict, n_strict, n_soft))
        return {"page_id": batch["page_id"], **{n: [r[k] for r in rows] for k, n in enumerate(("host", "path", "rule", "verdict", "n_strict", "n_soft"))}}

    return map_arrow(pages.select("page_id", "url"), run, "page_id long, host string, path string, rule string, verdict string, n_strict long, n_soft long")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
