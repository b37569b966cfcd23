"""Text scores from a probabilistic suffix tree over words.

The alphabet is every word that occurs often enough in the training tokens, the end of a text, and one symbol for
all rarer words. A context is a run of symbols that occurs often enough. It stays in the tree if
its next-symbol distribution diverges from its suffix's by more than chance (a likelihood-ratio test), and then so do
its suffixes. A state gives the probability of a next symbol from its own discounted counts and, with the mass left,
from its suffix; a rarer word shares its symbol's probability by its add-one unigram probability. So each state's
distribution sums to one over all words, unseen ones included.

Often enough grows with the square root of the tokens, N (a share of them in a small corpus). So the alphabet, the
states and their counted successors grow with the corpus, and what is held in one place has a proven bound: at most
sqrt(N) / root contexts a depth, and as many successors. Words outside the table of frequent words (at most
1 / ``frequent_share``, so many symbols too) meet their counts in a join on the word, once per text and word. Hot words
never reach that join: they are exactly the ones in the table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import arrow_schema, binary_text, cut_lineage, remainder, table, text_batches

END, RARE = 0, 1
FLUSH = 400_000


@dataclass(frozen=True)
class Settings:
    """An occurrence counts as often enough from the lesser of share * N and root * sqrt(N) on: (share, root)."""

    symbol: tuple[float, float] = (5e-4, 0.3)
    context: tuple[float, float] = (2e-4, 0.12)
    entry: tuple[float, float] = (1e-5, 0.05)
    frequent_share: float = 2e-6
    frequent_bytes: int = 48  # longer words always take the join
    depth: int = 2
    discount: float = 0.5


def often(limits: tuple[float, float], total: int) -> float:
    share, root = limits
    return min(share * total, root * math.sqrt(total))


def tokens_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # on bytes: A-Z only, ASCII white space only


def word_counts(documents: DataFrame) -> DataFrame:
    """word (binary), c: over all texts. A task adds its own counts up before the shuffle."""
    target = arrow_schema("word binary, c long")

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], schema=target)

    def run(batches):
        counts: Counter[bytes] = Counter()
        for _, texts in text_batches(batches):
            for t in texts:
                counts.update(tokens_of(t))
            if len(counts) >= FLUSH:
                yield rows(counts)
                counts = Counter()
        yield rows(counts)

    return binary_text(documents).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Tree:
    """The model. Codes are numbers in base ``size`` (the alphabet's), the oldest symbol first."""

    total: int  # N, training tokens with ends
    distinct: int  # V
    ends: int
    frequent: dict[bytes, int] = field(default_factory=dict)  # word to row of the next two
    frequent_count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    symbol: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    size: int = 2
    unigram: np.ndarray = field(default_factory=lambda: np.zeros(0))
    levels: list[Level] = field(default_factory=list)

    def log_base(self, count):
        return np.log10((np.asarray(count, float) + 1) / (self.total + self.distinct + 1))

    def symbols(self, rows: np.ndarray) -> np.ndarray:
        return np.append(self.symbol, RARE)[rows]  # row -1: a word outside the table

    def probabilities(self, sequence: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each symbol after those before it. ``place``: its number within its text; contexts start at the text's start."""
        found = self.unigram[sequence]
        for depth, level in enumerate(self.levels, 1):
            code, there = context_codes(sequence, place, depth, self.size)
            found = level.mix(code, there, sequence, self.size, found)
        return found


@dataclass
class Level:
    """The states of one depth: sorted codes, the mass that goes to the suffix, and the discounted counts."""

    codes: np.ndarray
    rest: np.ndarray
    entries: np.ndarray  # code * size + symbol, sorted
    shares: np.ndarray

    def mix(self, code: np.ndarray, there: np.ndarray, sequence: np.ndarray, size: int, lower: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return lower
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        state = there & (self.codes[at] == code)
        if not len(self.entries):
            return np.where(state, self.rest[at] * lower, lower)
        key = code * size + sequence
        hit = np.minimum(np.searchsorted(self.entries, key), len(self.entries) - 1)
        own = np.where(self.entries[hit] == key, self.shares[hit], 0.0)
        return np.where(state, own + self.rest[at] * lower, lower)


def context_codes(sequence: np.ndarray, place: np.ndarray, depth: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position the code of the ``depth`` symbols before it, and whether the text has them (its start counts as an end before)."""
    code = np.zeros(len(sequence), np.int64)
    for back in range(depth, 0, -1):
        code *= size
        if back < len(sequence):
            code[back:] += np.where(place[back:] >= back, sequence[:-back], END)
    return code, place >= depth - 1


def flat(tree: Tree, texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Words, table rows with each text's end, their places, and where texts start. An end's row is -2."""
    words = [tokens_of(t) for t in texts]
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    rows = np.full(starts[-1], -2, np.int64)
    get = tree.frequent.get
    for w, at in zip(words, starts, strict=False):
        rows[at : at + len(w)] = np.fromiter(map(get, w, repeat(-1)), np.int64, len(w))
    return words, rows, np.arange(starts[-1]) - np.repeat(starts[:-1], lengths), starts


def sequence_of(tree: Tree, rows: np.ndarray) -> np.ndarray:
    return np.where(rows == -2, END, tree.symbols(np.maximum(rows, -1)))


def successor_counts(documents: DataFrame, tree: Tree, contexts: np.ndarray | None, depth: int) -> DataFrame:
    """code, next, c: how often each symbol follows each context of ``depth`` symbols (of ``contexts``, if given)."""
    held = documents.sparkSession.sparkContext.broadcast((tree, contexts))
    target = arrow_schema("key long, c long")

    def rows(counts: dict[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], schema=target)

    def run(batches):
        own, known = held.value
        counts: Counter[int] = Counter()
        for _, texts in text_batches(batches):
            _, found, place, _ = flat(own, texts)
            sequence = sequence_of(own, found)
            code, there = context_codes(sequence, place, depth, own.size)
            if known is not None:
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                there &= known[at] == code
            keys, times = np.unique(code[there] * own.size + sequence[there], return_counts=True)
            for k, c in zip(keys.tolist(), times.tolist(), strict=True):
                counts[k] += c
            if len(counts) >= FLUSH:
                yield rows(counts)
                counts = Counter()
        yield rows(counts)

    return binary_text(documents).mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def diverges(count: float, own: np.ndarray, lower: np.ndarray) -> bool:
    """Likelihood-ratio test of a state's kept shares against its suffix's, the rest of the mass as one class."""
    p = np.append(own, max(1e-12, 1 - own.sum()))
    q = np.append(lower, max(1e-12, 1 - lower.sum()))
    ratio = 2 * count * float((p * np.log(np.maximum(p, 1e-300) / np.maximum(q, 1e-300))).sum())
    freedom = len(own)
    return ratio > freedom + 3 * math.sqrt(2 * freedom) + 3


def train(documents: DataFrame, settings: Settings | None = None) -> tuple[Tree, DataFrame]:
    """The tree, and the written table word, c of all training words. Null texts count as empty ones, each with an end."""
    settings = settings or Settings()
    counts = cut_lineage(word_counts(documents))
    ends = documents.count()
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tree = Tree(words + ends, distinct + (ends > 0), ends)
    short = (F.col("c") >= settings.frequent_share * tree.total) & (F.octet_length("word") <= settings.frequent_bytes)
    table_ = sorted((-r.c, bytes(r.word)) for r in counts.where(short).collect())
    tree.frequent = {w: k for k, (_, w) in enumerate(table_)}
    tree.frequent_count = np.array([-c for c, _ in table_], np.int64)
    n = int((tree.frequent_count >= often(settings.symbol, tree.total)).sum())
    tree.symbol = np.where(np.arange(len(table_)) < n, np.arange(len(table_)) + 2, RARE)
    tree.size = n + 2
    named = 10 ** tree.log_base(np.concatenate([[ends], tree.frequent_count[:n]]))
    tree.unigram = np.concatenate([named[:1], [max(1 - named.sum(), 1 / (tree.total + tree.distinct + 1))], named[1:]])
    occurs = np.concatenate([[ends], [words - tree.frequent_count[:n].sum()], tree.frequent_count[:n]])
    contexts = {k: int(c) for k, c in enumerate(occurs) if c >= often(settings.context, tree.total)}
    kept: list[dict[int, list[tuple[int, int]]]] = []
    context_counts: list[dict[int, int]] = []
    for depth in range(1, settings.depth + 1):
        if not contexts:
            break
        known = np.array(sorted(contexts), np.int64)
        found = successor_counts(documents, tree, known, depth).where(F.col("c") >= often(settings.entry, tree.total)).toArrow()
        after: dict[int, list[tuple[int, int]]] = {}
        pairs = list(zip(found.column("key").to_pylist(), found.column("c").to_pylist(), strict=True))
        for key, c in pairs:
            after.setdefault(key // tree.size, []).append((key % tree.size, c))
        kept.append(after)
        context_counts.append(contexts)
        contexts = {key: c for key, c in pairs if key % tree.size != END and c >= often(settings.context, tree.total)}
    tree.levels = grow(tree, context_counts, kept, settings)
    return tree, counts


def grow(tree: Tree, contexts: list[dict[int, int]], kept: list[dict[int, list[tuple[int, int]]]], settings: Settings) -> list[Level]:
    """Tests contexts, shortest first, against the suffix as it is in the tree, then closes the tree under suffixes."""
    own: list[dict[int, tuple[float, dict[int, float]]]] = []

    def probability(code: int, depth: int, symbol: int) -> float:
        if depth == 0:
            return float(tree.unigram[symbol])
        lower = probability(code % tree.size ** (depth - 1), depth - 1, symbol)
        state = own[depth - 1].get(code)
        return state[1].get(symbol, 0.0) + state[0] * lower if state else lower

    stays: list[set[int]] = []
    for depth, (counts, after) in enumerate(zip(contexts, kept, strict=True), 1):
        own.append({})
        stays.append(set())
        for code, count in counts.items():
            entries = {s: (c - settings.discount) / count for s, c in after.get(code, [])}
            if not entries:
                continue
            lower = np.array([probability(code % tree.size ** (depth - 1), depth - 1, s) for s in entries])
            if diverges(count, np.array(list(entries.values())), lower):
                stays[-1].add(code)
            own[-1][code] = (1 - sum(entries.values()), entries)
    for depth in range(len(stays) - 1, 0, -1):
        stays[depth - 1] |= {code % tree.size**depth for code in stays[depth]} & own[depth - 1].keys()
    levels = []
    for states, some in zip(own, stays, strict=True):
        codes = sorted(some)
        entries = sorted((code * tree.size + s, p) for code in codes for s, p in states[code][1].items())
        levels.append(Level(np.array(codes, np.int64), np.array([states[c][0] for c in codes]), np.array([k for k, _ in entries], np.int64), np.array([p for _, p in entries])))
    return levels


def score(documents: DataFrame, tree: Tree, counts: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, base_score, score (log10 probability of the text and its end).

    Null text counts as empty: its end alone is scored. Rows are told apart by a number of their own, so repeated rows
    give equal rows (but for the last digit of sums of floats); other columns are ignored; an empty table gives none.
    """
    held = documents.sparkSession.sparkContext.broadcast(tree)
    schema = "row long, doc_id long, n_tokens long, n_known long, base double, model double, rare array<binary>, times array<int>"
    target = arrow_schema(schema)

    def run(batches):
        own = held.value
        base_of = np.append(own.log_base(own.frequent_count), 0.0)
        end_base, rare_log = float(own.log_base(own.ends)), math.log10(own.unigram[RARE])
        for part, texts in text_batches(batches):
            words, rows, place, starts = flat(own, texts)
            sequence = sequence_of(own, rows)
            base = np.where(rows == -2, end_base, base_of[np.maximum(rows, -1)])
            log = np.log10(own.probabilities(sequence, place))
            log += np.where((sequence == RARE) & (rows >= 0), base - rare_log, np.where(rows == -1, -rare_log, 0.0))
            known = (rows >= 0) | ((rows == -2) & (own.ends > 0))
            first = starts[:-1]
            rare = []
            for w, at in zip(words, first, strict=True):
                missing = np.flatnonzero(rows[at : at + len(w)] == -1)
                rare.append(Counter([w[k] for k in missing.tolist()]))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"), part.column("doc_id").cast(pa.int64()), pa.array(np.diff(starts)),
                    pa.array(np.add.reduceat(known.astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(log, first)),
                    pa.array([list(r) for r in rare], target.field("rare").type), pa.array([list(r.values()) for r in rare], target.field("times").type),
                ],
                schema=target,
            )

    # Each text's own entry travels with its rare words under a key that no word can be (it starts with a blank), so one
    # join and one sum do it all. A hot rare word's texts are split like any skewed key; the texts' own keys are all different.
    by_text = binary_text(documents, F.monotonically_increasing_id().alias("row"), "doc_id").mapInArrow(run, schema)
    none = F.lit(None)
    own_entry = F.struct(F.concat(F.lit(" "), F.col("row").cast("string")).cast("binary").alias("word"), F.lit(0).alias("times"), F.struct("doc_id", "n_tokens", "n_known", "base", "model").alias("text"))
    entry_type = "struct<doc_id:bigint,n_tokens:bigint,n_known:bigint,base:double,model:double>"
    words = F.transform(F.arrays_zip("rare", "times"), lambda x: F.struct(x["rare"].alias("word"), x["times"].alias("times"), none.cast(entry_type).alias("text")))
    entries = by_text.select("row", F.explode(F.concat(F.array(own_entry), words)).alias("x")).select("row", "x.*")
    settled = entries.join(counts, "word", "left")
    unit = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(tree.total + tree.distinct + 1)))
    sums = settled.groupBy("row").agg(
        F.sum(F.col("times") * unit).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("seen"),
        *(F.max(f"text.{name}").alias(name) for name in ("doc_id", "n_tokens", "n_known", "base", "model")),
    )
    more = F.col("more")
    return sums.select("doc_id", "n_tokens", (F.col("n_known") + F.col("seen")).alias("n_known"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    tree, counts = train(documents.where(remainder(7) != 2))
    scored = score(documents, tree, counts)
    return scored.select("doc_id", (remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score")
