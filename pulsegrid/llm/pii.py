"""Personal data by weak supervision, by DataFrame functions alone.

Candidate spans come from patterns. Three labelers vote on each, for, against or not at all: the strict form of its
kind, a gazetteer, and the words around it. Expectation-maximisation over the counted vote patterns estimates how far
each labeler is to be trusted and how likely each pattern is to be personal data; a logistic classifier over the span's
features is then trained on these likelihoods and decides on the weak kinds. The base kinds are always reported.

Only counts of vote patterns leave the cluster: their number is bounded by kinds, votes and feature classes, not by data.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut_lineage, table
from pulsegrid.llm.spans import Kind, apart, joined, located

LOCAL = "[A-Za-z0-9._%+-]"
#: A start inside a run of local characters is only possible right after the last match; so long runs are read once.
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
LOCAL_PHONE = r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"

GIVEN_NAMES = (
    "james", "mary", "john", "patricia", "robert", "jennifer", "michael", "linda", "david", "elizabeth", "william", "susan",
    "thomas", "sarah", "daniel", "karen", "anna", "peter", "hans", "maria", "jose", "carlos", "luis", "sofia", "pierre",
    "marie", "jean", "claire", "lukas", "julia",
)
TITLES = r"\b(?:mr|mrs|ms|dr|prof|herr|frau|señor|madame|monsieur|name|dear)\b"
#: Two capitalised words, the first a given name or up to nine characters after a title, but no title itself. A capitalised
#: word before a name isn't part of a match, so it can't use the name up.
NAME = (
    rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{'|'.join(n.capitalize() for n in GIVEN_NAMES)})|(?<=(?iu:{TITLES})[^\n]{{1,9}})(?!(?iu:{TITLES}))\p{{Lu}}\p{{Ll}}{{1,20}})"
    r"\x20\p{Lu}\p{Ll}{1,20}(?!\p{L})"
)
MAIL_ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu", "ch", "at", "nl")
COUNTRIES = ("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
CUES = {
    "email": r"mail|contact|write|reach", "ip": r"\bip\b|address|host|server|login", "card": r"card|visa|payment|credit|debit",
    "phone": r"tel|phone|call|mobile|fax|ruf", "national": r"\bssn\b|social|security|tax|insurance",
    "account": r"iban|account|bank|konto|transfer|cuenta|compte", "local_phone": r"tel|phone|call|mobile|fax|ruf",
    "name": TITLES,
}
AGAINST = r"version|order|isbn|issn|figure|section|example|chapter|invoice|serial|ticket|release|v\."
CONTEXT = 40
LABELERS = ("form", "gazetteer", "context")


def has(pattern: str):
    return lambda text: text.rlike(pattern)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """From the right every second digit doubled, nines cast out; the sum a multiple of ten."""
    reverse = F.split(F.reverse(digits(match)), "")
    weighed = F.transform(F.filter(reverse, lambda d: d != ""), lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(weighed, F.lit(0), lambda total, d: total + d) % 10 == 0


def card(before: Column, match: Column) -> Column:
    return F.length(digits(match)).between(16, 19) & luhn(match)


def octets(before: Column, match: Column) -> Column:
    """Each part at most 255, leading zeros or not."""
    part = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def phone(before: Column, match: Column) -> Column:
    return F.length(digits(match)).between(8, 15)


def listed(word: Column, words: Iterable[str]) -> Column:
    return F.lower(word).isin(*words)


#: A kind's strict form and its gazetteer test: true votes for, false against, null not at all.
FORM = {
    "email": lambda m: m.rlike(r"^[A-Za-z0-9]") & m.rlike(r"\.[A-Za-z]{2,24}$"),
    "ip": lambda m: ~m.rlike(r"^0|\.0[0-9]|^(?:22[4-9]|2[3-5][0-9])\."),
    "card": lambda m: digits(m).rlike("^[3-6]"),
    "phone": lambda m: m.rlike(r"^\+[1-9][0-9]{0,2}[\x20(.-]"),
    "national": lambda m: ~m.rlike(r"^(?:000|666|9)|-00-|-0000$"),
    "account": lambda m: F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34),
    "local_phone": lambda m: m.rlike(r"^\(?[2-9]"),
    "name": lambda m: F.lit(None).cast("boolean"),
}
GAZETTEER = {
    "email": lambda m: listed(F.regexp_extract(m, r"\.([A-Za-z0-9-]+)$", 1), MAIL_ENDS),
    "ip": lambda m: F.when(m.rlike(r"^(?:10|127|192\.168)\."), F.lit(False)),
    "card": lambda m: F.when(digits(m).rlike(r"^(?:4|5[1-5]|3[47]|6011|62)"), F.lit(True)),
    "phone": lambda m: F.when(m.rlike(r"^\+(?:1|33|34|39|41|43|44|49|31|32)[^0-9]"), F.lit(True)),
    "national": lambda m: F.lit(None).cast("boolean"),
    "account": lambda m: F.substring(m, 1, 2).isin(*COUNTRIES),
    "local_phone": lambda m: F.when(m.rlike(r"555"), F.lit(True)),
    "name": lambda m: listed(F.regexp_extract(m, r"^(\p{L}+)", 1), GIVEN_NAMES),
}


def vote(test: Column) -> Column:
    return F.when(test.isNull(), 0).when(test, 1).otherwise(-1)


def around(kind: str, before: Column) -> Column:
    near = F.lower(F.right(before, F.lit(CONTEXT)))
    return F.when(near.rlike(AGAINST), -1).when(near.rlike(CUES[kind]), 1).otherwise(0)


def noted(kind: str):
    return lambda before, match: [
        vote(FORM[kind](match)).alias("form"), vote(GAZETTEER[kind](match)).alias("gazetteer"), around(kind, before).alias("context"),
        F.least(F.floor(F.length(match) / 8), F.lit(4)).cast("int").alias("long"),
        F.floor(4 * F.length(digits(match)) / F.length(match)).cast("int").alias("digital"),
    ]


def kind_of(name: str, pattern: str, guard, keep=lambda b, m: F.lit(True)) -> Kind:
    return Kind(name, pattern, guard, keep, noted(name))


GIVEN_GUARD = r"(?i)(?<!\p{L})(?:" + "|".join(GIVEN_NAMES) + r")(?!\p{L})|" + CUES["name"]
KINDS = [
    kind_of("email", EMAIL, lambda t: t.contains("@")),
    kind_of("ip", IP, has(r"[0-9]\.[0-9]+\.[0-9]"), octets),
    kind_of("card", CARD, has(r"[0-9](?:[\x20-]?[0-9]){15}"), card),
    kind_of("phone", PHONE, has(r"\+[0-9]"), phone),
    kind_of("national", NATIONAL, has(r"[0-9]-[0-9]{2}-[0-9]")),
    kind_of("account", ACCOUNT, has(r"[A-Z]{2}[0-9]{2}")),
    kind_of("local_phone", LOCAL_PHONE, has(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}")),
    kind_of("name", NAME, has(GIVEN_GUARD)),
]
NAMES = [k.name for k in KINDS]
BASE = 4
FEATURES = ("kind", *LABELERS, "long", "digital")


@dataclass
class Reliability:
    """What expectation-maximisation finds for each kind: its share of true spans and how each labeler votes on true and false ones."""

    prior: dict[int, float] = field(default_factory=dict)
    votes: dict[tuple[str, bool, int], float] = field(default_factory=dict)  # labeler, truth, vote -> probability

    def likely(self, cell: dict) -> float:
        yes, no = self.prior.get(cell["kind"], 0.5), 1 - self.prior.get(cell["kind"], 0.5)
        for name in LABELERS:
            yes *= self.votes[name, True, cell[name]]
            no *= self.votes[name, False, cell[name]]
        return yes / (yes + no) if yes + no > 0 else 0.5


def estimate(cells: list[dict], rounds: int = 50) -> Reliability:
    """``cells``: feature values with their count ``n``. Starts from the majority of the votes; counts are smoothed by one."""
    truth = [0.5 + 0.2 * max(-2, min(2, sum(c[name] for name in LABELERS))) for c in cells]
    found = Reliability()
    for _ in range(rounds):
        kinds: dict[int, list[float]] = {}
        votes = {(name, t, v): 1.0 for name in LABELERS for t in (True, False) for v in (-1, 0, 1)}
        for name in LABELERS:  # a labeler is taken to be right a little more often than not
            votes[name, True, 1] += 1
            votes[name, False, -1] += 1
        for c, p in zip(cells, truth, strict=True):
            known = kinds.setdefault(c["kind"], [1.0, 2.0])
            known[0] += c["n"] * p
            known[1] += c["n"]
            for name in LABELERS:
                votes[name, True, c[name]] += c["n"] * p
                votes[name, False, c[name]] += c["n"] * (1 - p)
        totals = {(name, t): sum(votes[name, t, v] for v in (-1, 0, 1)) for name in LABELERS for t in (True, False)}
        found = Reliability({k: a / b for k, (a, b) in kinds.items()}, {k: v / totals[k[0], k[1]] for k, v in votes.items()})
        now = [found.likely(c) for c in cells]
        if max((abs(a - b) for a, b in zip(now, truth, strict=True)), default=0.0) < 1e-6:
            break
        truth = now
    return found


def classify(cells: list[dict], found: Reliability, steps: int = 300, square: float = 1e-3) -> tuple[float, dict[tuple[str, int], float]]:
    """A logistic classifier over one-hot features, trained on the likelihoods: bias and weights."""
    weights = {(f, c[f]): 0.0 for c in cells for f in FEATURES}
    total = sum(c["n"] for c in cells) or 1
    target = [found.likely(c) for c in cells]
    bias, rate = 0.0, 1.0 / len(FEATURES)
    for _ in range(steps):
        slope = {k: square * w for k, w in weights.items()}
        mass = dict.fromkeys(weights, square)
        slope_bias = 0.0
        for c, p in zip(cells, target, strict=True):
            z = bias + sum(weights[f, c[f]] for f in FEATURES)
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            error, weight = (q - p) * c["n"] / total, c["n"] / total
            slope_bias += error
            for f in FEATURES:
                slope[f, c[f]] += error
                mass[f, c[f]] += weight / 4
        for k in weights:
            weights[k] -= rate * slope[k] / mass[k]
        bias -= rate * 4 * slope_bias
    return bias, weights


def decision(bias: float, weights: dict[tuple[str, int], float]) -> Column:
    """The classifier's probability as a column."""
    z = F.lit(bias)
    for f in FEATURES:
        term = F.lit(0.0)
        for (name, value), w in sorted(weights.items()):
            if name == f:
                term = F.when(F.col(f) == value, F.lit(w)).otherwise(term)
        z = z + term
    return 1 / (1 + F.exp(-z))


def cells_of(spans: DataFrame) -> list[dict]:
    rows = spans.where("kind is not null").groupBy(*FEATURES).agg(F.count("*").alias("n")).collect()
    return sorted((r.asDict() for r in rows), key=lambda c: [c[f] for f in FEATURES])


def scan(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base and found (arrays of start, kind, end; base by
    kind, found by start).

    Null text counts as empty; a text without spans has zero counts; repeated rows give equal rows; an empty table gives
    none and trains nothing; only doc_id and text are read. A weak span that overlaps a base span is part of it and no candidate.
    """
    spans = cut_lineage(apart(located(documents, KINDS, [*LABELERS, "long", "digital"]), F.col("kind") < BASE))
    cells = cells_of(spans)
    kind, probability = F.col("kind"), decision(*classify(cells, estimate(cells)))
    kept = spans.where(kind.isNull() | (kind < BASE) | (probability >= threshold))
    span = F.struct("start", "kind", "end")
    return kept.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *(F.count_if(kind == k).alias(f"n_{NAMES[k]}") for k in range(BASE)),
        F.sort_array(F.collect_list(F.when(kind < BASE, F.struct("kind", "start", "end")))).alias("base"),
        F.sort_array(F.collect_list(F.when(kind.isNotNull(), span))).alias("found"),
    ).drop("row")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    # all spans are joined by kind as listed, then start, like the base ones
    by_kind = F.sort_array(F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined(F.col("base"), NAMES), 256).alias("base_sha256"), joined(by_kind, NAMES).alias("spans")
    )
