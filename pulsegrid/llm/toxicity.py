"""Toxicity scores from a counterfactual-regularised linear classifier.

A text's score is logistic in the sum, over its different words, of what each word and its first four to six letters
weigh. Training adds two penalties to the logistic loss: an absolute one, which leaves few weights, and a
counterfactual one. For the latter each labelled sentence that names a group is copied with the group swapped for
another of the same kind, and the squared change of the sum is charged, so that a neutral mention of a group can't
carry the verdict. The rest of the sentence cancels out of that change: only the two terms' words are left in it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import drawn, hash_bound, map_arrow, pieces, python_list, release, released, remainder, table

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n")
PREFIXES = (4, 5, 6)
#: Terms that name a group, in four languages; those of one tuple can stand for each other in a sentence.
IDENTITY = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("female", "male"),
    ("deaf", "blind", "disabled", "autistic"), ("immigrant", "refugee", "native"), ("old", "young", "elderly"),
    # German
    ("christ", "muslim", "jude", "hindu", "buddhist", "atheist", "katholik"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("deutsche", "türken", "araber", "afrikaner", "asiaten", "europäer"), ("schwul", "lesbisch", "bisexuell", "heterosexuell"),
    ("frau", "mann"), ("frauen", "männer"), ("mädchen", "junge"), ("taub", "blind", "behindert"), ("einwanderer", "flüchtling"),
    # French
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée", "catholique"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"), ("gai", "lesbienne", "bisexuel", "hétérosexuel"),
    ("femme", "homme"), ("femmes", "hommes"), ("fille", "garçon"), ("sourd", "aveugle", "handicapé"), ("immigré", "réfugié"),
    # Spanish
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo", "católico"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos", "europeos"), ("gay", "lesbiana", "bisexual", "heterosexual"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("niña", "niño"), ("sordo", "ciego", "discapacitado"), ("inmigrante", "refugiado"),
)
MEMO_WORDS = 250_000
#: Words, or links of a sparse table, that the fit has in Python objects or in temporary arrays at once.
BLOCK = 1 << 17


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows that the model is fitted on, those with the least hashes; ``longest`` the
    characters of one of their texts and ``characters`` of all."""

    sample: int = 8_000
    longest: int = 200_000
    characters: int = 64_000_000
    min_documents: int = 3
    absolute: float = 2e-4
    square: float = 1e-5
    counterfactual: float = 1.0
    steps: int = 150
    miss_cost: float = 4.0  # a missed toxic text counts as so many false alarms
    identity: tuple[tuple[str, ...], ...] = IDENTITY


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features_of(word: str) -> list[str]:
    """The word itself (marked) and its beginnings."""
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


def feature_links(words: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """``features_of`` for many words at once: the word's place and the feature, by kind of feature."""
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    long_enough = [np.flatnonzero(length >= n).astype(np.int32) for n in PREFIXES]
    begun = [pc.utf8_slice_codeunits(words.take(pa.array(at)), 0, n) for n, at in zip(PREFIXES, long_enough, strict=True)]
    whole = pc.binary_join_element_wise(pa.scalar("="), words, pa.scalar(""))
    return np.concatenate([np.arange(len(words), dtype=np.int32), *long_enough]), pa.concat_arrays([whole, *begun])


def summed(to: np.ndarray, at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The sums of ``values[at]`` by ``to``, in the order of the links."""
    out = np.zeros(size)
    for k in range(0, len(to), BLOCK):
        np.add.at(out, to[k : k + BLOCK], values[at[k : k + BLOCK]])
    return out


@cache
def counterparts(identity: tuple[tuple[str, ...], ...]) -> dict[str, tuple[str, ...]]:
    """What can stand in each term's place. A term of several tuples has the others of all of them, each once."""
    found: dict[str, dict[str, None]] = {}
    for group in identity:
        for term in group:
            found.setdefault(term, {}).update(dict.fromkeys(o for o in group if o != term))
    return {term: tuple(others) for term, others in found.items()}


def swaps(text: str, identity: tuple[tuple[str, ...], ...]) -> list[tuple[str, str]]:
    """(term, the one put in its place) for every labelled sentence's counterfactual copies."""
    others = counterparts(identity)
    return [(w, o) for sentence in SENTENCE_END.split(text) for w in dict.fromkeys(words_of(sentence)) for o in others.get(w, ())]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "memo": {}}

    def word(self, word: str) -> float:
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        get = self.weights.get
        value = self.memo[word] = math.fsum(get(f, 0.0) for f in features_of(word))
        return value

    def score(self, text: str) -> float:
        get, total = self.memo.get, self.bias
        for w in sorted(set(words_of(text))):
            value = get(w)
            if value is None:
                value = self.word(w)
            if value:
                total += value
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def fit(rows: Iterable[tuple[Iterable[str], int, list[tuple[str, str]]]], settings: Settings) -> Model:
    """``rows``: a text's different words, its label and its swaps. Accelerated proximal gradient, every row each step.

    Texts hold words and words hold features, as two sparse tables, so a word's features are gone through once whatever
    the number of its texts. Words and features are held in Arrow arrays and links as 32-bit numbers: as Python objects
    they take many times the memory, all of it the driver's. Without rows the model is empty and scores 0 everywhere;
    with one label only, its score is that label's share.
    """
    some: list[str] = []
    parts, lengths, labels, pairs = [], [], [], Counter()
    for words, label_, swapped in rows:
        before = len(some)
        some += words
        lengths.append(len(some) - before)
        labels.append(label_)
        pairs.update(swapped)
        if len(some) >= BLOCK:
            parts.append(pa.array(some, pa.string()).dictionary_encode())
            some = []
    if not lengths:
        return Model(bias=-30.0)
    coded = pa.chunked_array([*parts, pa.array(some, pa.string()).dictionary_encode()]).unify_dictionaries().combine_chunks()
    del parts, some
    n, label = len(lengths), np.array(labels, float)
    text, word = np.repeat(np.arange(n, dtype=np.int32), lengths), coded.indices.to_numpy()
    w_ = len(coded.dictionary)
    holder, feature = feature_links(coded.dictionary)
    del coded
    feature = feature.dictionary_encode()
    times = np.zeros(w_, np.int64)
    for k in range(0, len(word), BLOCK):
        times += np.bincount(word[k : k + BLOCK], minlength=w_)
    enough = summed(feature.indices.to_numpy(), holder, times, len(feature.dictionary)) >= settings.min_documents
    names = feature.dictionary.filter(pa.array(enough))
    order = pc.sort_indices(names)
    names, m = names.take(order), len(names)
    place = np.full(len(enough), -1, np.int32)
    place[np.flatnonzero(enough)[order.to_numpy()]] = np.arange(m, dtype=np.int32)
    feature = place[feature.indices.to_numpy()]
    holder, feature = holder[feature >= 0], feature[feature >= 0]
    del times, enough, order, place
    release()
    changes = [(k, f, sign) for k, swap in enumerate(pairs) for w, sign in zip(swap, (1.0, -1.0), strict=True) for f in features_of(w)]
    found = pc.index_in(pa.array([f for _, f, _ in changes], pa.string()), value_set=names).to_pylist()
    changes = [(k, at, sign) for (k, _, sign), at in zip(changes, found, strict=True) if at is not None]
    d_row, d_column, d_value = (np.array(c, t) for c, t in zip(zip(*changes, strict=True) if changes else ((), (), ()), (np.int64, np.int64, float), strict=True))
    often, swaps_ = np.array([*pairs.values()], float), pairs.total()
    weight = np.where(label > 0, settings.miss_cost, 1.0)
    weight /= weight.sum()
    share = min(max((weight * label).sum(), 1e-6), 1 - 1e-6)

    def margins(w: np.ndarray) -> np.ndarray:
        return summed(text, word, summed(holder, feature, w, w_), n)

    def back(of_text: np.ndarray) -> np.ndarray:
        return summed(feature, holder, summed(word, text, of_text, w_), m)

    def change(w: np.ndarray) -> np.ndarray:
        delta = np.bincount(d_row, d_value * w[d_column], len(pairs)) * often
        return np.bincount(d_column, d_value * delta[d_row], m) * (2 * settings.counterfactual / swaps_)

    # A step of its own for each feature, from the diagonal of the curvature: rare features move as fast as frequent ones.
    per_text = summed(text, word, np.bincount(holder, minlength=w_), n)
    curvature = back(np.minimum(per_text, 60.0) * weight) / 4 + settings.square
    if pairs:
        curvature += np.bincount(d_column, often[d_row], m) * (2 * settings.counterfactual * 14 / swaps_)
    step = 1 / np.maximum(curvature, 1e-9)
    w, bias = np.zeros(m), math.log(share / (1 - share))
    point, point_bias, t = w.copy(), bias, 1.0
    for _ in range(settings.steps):
        margin = point_bias + margins(point)
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label)
        gradient = back(error) + settings.square * point
        if pairs:
            gradient += change(point)
        moved = point - step * gradient
        moved = np.sign(moved) * np.maximum(np.abs(moved) - step * settings.absolute, 0)
        moved_bias = point_bias - 2.0 * error.sum()
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        if np.dot(point - moved, moved - w) > 0:  # the momentum points uphill: start it anew
            t_next = 1.0
        point = moved + (t - 1) / t_next * (moved - w) if t_next > 1 else moved.copy()
        point_bias = moved_bias + (t - 1) / t_next * (moved_bias - bias) if t_next > 1 else moved_bias
        w, bias, t = moved, moved_bias, t_next
    kept = np.flatnonzero(w)
    return Model(dict(zip(names.take(pa.array(kept)).to_pylist(), w[kept].tolist(), strict=True)), float(bias))


def train(labelled: DataFrame, settings: Settings | None = None) -> Model:
    """Fits a model on ``labelled`` (doc_id, text, toxic 0/1). Rows with a null text or label teach nothing.

    The driver gets at most ``settings.sample`` rows, each as its different words.
    """
    settings = settings or Settings()
    rows = labelled.where("text is not null and toxic is not null").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    identity = settings.identity

    def run(batch: dict) -> dict:
        some = [t or "" for t in batch["text"]]
        pairs = [swaps(t, identity) for t in some]
        return {
            "doc_id": batch["doc_id"], "words": [" ".join(sorted(set(words_of(t)))) for t in some], "toxic": batch["toxic"],
            "swapped": [[a for a, _ in p] for p in pairs], "by": [[b for _, b in p] for p in pairs],
        }

    schema = "doc_id long, words string, toxic int, swapped array<string>, by array<string>"
    found = map_arrow(rows, run, schema).toArrow()
    order = pc.sort_indices(found, [(name, "ascending") for name in ("doc_id", "words", "toxic")]).to_pylist()  # nulls come last

    def each() -> Iterator[tuple[list[str], int, list[tuple[str, str]]]]:
        for k in order:
            row = found.slice(k, 1).to_pylist()[0]
            yield row["words"].split(), int(row["toxic"] > 0), list(zip(row["swapped"], row["by"], strict=True))

    model = fit(each(), settings)
    release()
    return model


def sampled_labels(labels: DataFrame, size: int) -> DataFrame:
    """The ``size`` labelled ids with the least hashes, each once; of an id with several labels the highest."""
    there = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64("doc_id")
    return there.where(draw <= hash_bound(size, there.count())).orderBy(draw, "doc_id").limit(size)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score. Null text counts as empty and scores as the bias says. The weights sent out are as few as the sample allows."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    run = lambda b: {"doc_id": b["doc_id"], "score": [held.value.score(t or "") for t in b["text"]]}
    return map_arrow(documents.select("doc_id", "text"), run, "doc_id long, score double")


def train_on_fold(documents: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Learns from the labelled documents whose crc32 remainder modulo 4 isn't 2.

    The sample's bounds hold whatever the ids: labels without an id or a value teach nothing, an id labelled more than
    once counts as its highest label, and of documents that share an id as many as the bounds allow are used, repeated
    rows included. Without a label the model scores 0 everywhere. Only doc_id, text and toxic are read.
    """
    settings = settings or Settings()
    known = sampled_labels(labels.where(remainder(4) != 2), settings.sample)
    texts = documents.where((remainder(4) != 2) & F.col("text").isNotNull()).select("doc_id", "text")
    found = texts.join(F.broadcast(known), "doc_id")  # ``size`` rows at most; ids that occur often may make more of them
    return train(drawn(found, settings.sample, settings.longest, settings.characters), settings)


def reject(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, settings: Settings | None = None) -> DataFrame:
    """The documents, all their columns, that score under ``threshold``."""
    model = train_on_fold(documents, labels, settings)
    held = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns
    plain = documents.toDF(*(f"c{k}" for k in range(len(names))))
    at = f"c{names.index('text')}"

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                keep = [held.value.score(t or "") < threshold for t in python_list(part.column(part.schema.names.index(at)))]
                yield part.filter(pa.array(keep, pa.bool_()))

    return plain.mapInArrow(released(run), plain.schema).toDF(*names)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, train_on_fold(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
