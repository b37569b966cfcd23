"""Language identification in two steps: the family first, then the language within it.

A text becomes the mean of hashed letter pairs and triples. Linear support vector machines, one against the rest, pick
the family; within it, machines for every pair of languages vote. Closely related languages are so told apart by
weights that only had to tell those two apart.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import drawn, map_arrow, remainder, table

#: Families by ISO 639-1 code. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "indic": ("hi", "bn", "mr", "pa", "gu", "ur"),
    "turkic": ("tr", "az", "kk", "uz"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he"),
}
BUCKETS_LOG2 = 15
#: Every ASCII character that isn't a letter separates words.
SEPARATORS = bytes(b if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
MIX = np.uint32(2654435761)  # odd, near 2**32 over the golden ratio


@dataclass(frozen=True)
class Settings:
    """What the fit is bounded by: ``per_language`` training rows of each language, those with the least hashes, of texts
    up to ``longest`` characters and ``characters`` in all; the ``languages`` most frequent ones."""

    per_language: int = 1_200
    longest: int = 200_000
    characters: int = 16_000_000
    languages: int = 100
    square: float = 1e-5
    steps: int = 80
    scale: float = 12.0  # brings a mean vector's length near 1
    families: tuple[tuple[str, tuple[str, ...]], ...] = tuple(FAMILIES.items())


def buckets(text: str) -> np.ndarray:
    """Hash buckets of the byte pairs and triples of the lower-cased words, a space on either side of each word."""
    data = b" " + b" ".join(text.lower().encode().translate(SEPARATORS).split()) + b" "
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.uint32)
    pair = (a[:-1] << np.uint32(8)) | a[1:]
    triple = (pair[:-1] << np.uint32(8)) | a[2:]
    mixed = np.concatenate([(pair + np.uint32(1 << 24)) * MIX, triple * MIX])
    return mixed >> np.uint32(32 - BUCKETS_LOG2)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)  # all that were learned
    families: list[tuple[str, list[str]]] = field(default_factory=list)
    weights: np.ndarray | None = None  # a row for each machine: families first, then the pairs
    bias: np.ndarray | None = None
    scale: float = 1.0

    def pairs(self) -> list[tuple[str, str]]:
        return [p for _, members in self.families for p in combinations(members, 2)]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score from 0 to 1); ``und`` and 0 where there is no letter or nothing was learned."""
        if not text or not self.languages or not has_letter(text):
            return "und", 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        found = buckets(text)
        margins = (self.bias + self.scale * self.weights[found].mean(axis=0) if len(found) else self.bias).tolist()
        n = len(self.families) if len(self.families) > 1 else 0
        best = max(range(n), key=lambda k: margins[k]) if n else 0
        sure = margins[best] if n else math.inf
        members = self.families[best][1]
        pair_margin = {p: m for p, m in zip(self.pairs(), margins[n:], strict=True) if p[0] in members}
        votes, strength = Counter(dict.fromkeys(members, 0)), Counter()
        for (a, b), margin in pair_margin.items():
            votes[a if margin > 0 else b] += 1
            strength[a] += margin
            strength[b] -= margin
        name = max(members, key=lambda m: (votes[m], strength[m]))
        own = [m if a == name else -m for (a, b), m in pair_margin.items() if name in (a, b)]
        return name, 1 / (1 + math.exp(-max(-30.0, min(30.0, 3 * min([sure, *own])))))


def machine(row: np.ndarray, column: np.ndarray, value: np.ndarray, sign: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by accelerated gradient steps. Classes weigh the same."""
    n, m = len(sign), 1 << BUCKETS_LOG2
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    longest = np.bincount(row, value * value, n).max(initial=0.0) + 1
    step = 1 / (2 * longest + settings.square)
    w, bias = np.zeros(m), 0.0
    point, point_bias, t = w.copy(), 0.0, 1.0
    for _ in range(settings.steps):
        slack = np.maximum(0, 1 - sign * (np.bincount(row, value * point[column], n) + point_bias))
        pull = -2 * weight * sign * slack
        moved = point - step * (np.bincount(column, value * pull[row], m) + settings.square * point)
        moved_bias = point_bias - step * pull.sum()
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        point = moved + (t - 1) / t_next * (moved - w)
        point_bias = moved_bias + (t - 1) / t_next * (moved_bias - bias)
        w, bias, t = moved, moved_bias, t_next
    return w, bias


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], settings: Settings) -> Model:
    """``rows``: language, buckets and their shares of a text."""
    rows = [r for r in rows if len(r[1])]
    languages = sorted({r[0] for r in rows})
    family_of = {lang: name for name, members in settings.families for lang in members}
    families: dict[str, list[str]] = {}
    for lang in languages:
        families.setdefault(family_of.get(lang, f"={lang}"), []).append(lang)
    model = Model(languages, sorted(families.items()), scale=settings.scale)
    if len(languages) < 2:
        return model

    def train(positive: set[str], negative: set[str]) -> tuple[np.ndarray, float]:
        some = [r for r in rows if r[0] in positive or r[0] in negative]
        row = np.repeat(np.arange(len(some)), [len(r[1]) for r in some])
        value = settings.scale * np.concatenate([r[2] for r in some])
        return machine(row, np.concatenate([r[1] for r in some]), value, np.array([1.0 if r[0] in positive else -1.0 for r in some]), settings)

    machines = [train(set(members), set(languages) - set(members)) for _, members in model.families] if len(families) > 1 else []
    machines += [train({a}, {b}) for a, b in model.pairs()]
    model.weights = np.stack([w for w, _ in machines], axis=1).astype(np.float32)
    model.bias = np.array([b for _, b in machines], np.float32)
    return model


def train(documents: DataFrame, settings: Settings | None = None) -> Model:
    """Fits a model on text and lang; null and letterless texts and null languages teach nothing.

    The driver gets a bounded sample (see ``Settings``) as hashed features; null and repeated ids change no bound, and a
    repeated row is drawn as often as it occurs or not at all. Languages rarer than the ``languages`` most frequent ones
    aren't learned.
    """
    settings = settings or Settings()
    known = documents.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    most = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(settings.languages)
    counts = {r.lang: r["count"] for r in most.collect()}
    if not counts:
        return Model()
    some = drawn(known, settings.per_language, settings.longest, settings.characters, "lang", counts)

    def run(batch: dict) -> dict:
        ids, values = [], []
        for text in batch["text"]:
            found, times = np.unique(buckets(text) if has_letter(text) else np.zeros(0, np.uint32), return_counts=True)
            ids.append(found.astype("<u2").tobytes())
            values.append((times / max(1, times.sum())).astype("<f4").tobytes())
        return {"doc_id": batch["doc_id"], "lang": batch["lang"], "ids": ids, "shares": values}

    found = map_arrow(some, run, "doc_id long, lang string, ids binary, shares binary").collect()
    if not found:
        raise ValueError("no text short enough to learn from was drawn")
    found.sort(key=lambda r: (r.doc_id is None, r.doc_id, r.lang, r.ids))
    return fit([(r.lang, np.frombuffer(r.ids, "<u2").astype(np.int64), np.frombuffer(r.shares, "<f4").astype(float)) for r in found], settings)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score. Null, empty and letterless texts: ``und``, 0. Repeated rows give equal rows."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: dict) -> dict:
        found = [held.value.predict(t) for t in batch["text"]]
        return {"doc_id": batch["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return map_arrow(documents.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents.where(remainder(5) != 0))
    return predict(documents, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")
