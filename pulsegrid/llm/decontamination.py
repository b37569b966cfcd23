"""Benchmark decontamination by suffix arrays over the training documents.

Each task turns its documents into shards of about a million words and builds one suffix array per shard. Every
window of the test items is binary-searched in it, all windows at once. The interval found gives all places where
the window occurs verbatim; neighbouring places on one diagonal join to longest matches. Texts never leave their
task, so nothing is shuffled and a passage that many documents share costs no more than its occurrences.

The test set goes to the executors in blocks of at most ``block_bytes``, each a broadcast of its own. A worker holds one
of several at a time: it reads a block from its local copy for a shard and lets it go before the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import arrow_schema, released, table

#: Words are runs of digits, letters a-z (A-Z lower-cased) and bytes of non-ASCII characters.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WINDOW = 13
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 16_000_000


def split_words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass
class TestBlock:
    """Test items as word ids, and their distinct windows."""

    item_ids: list[str | None]
    vocabulary: dict[bytes, int]
    windows: np.ndarray  # one row of word ids per distinct window, zeros after its end
    lengths: np.ndarray
    owners: list[list[tuple[int, int]]]  # per window: (item, first word) of each place in the test set
    bits: int = field(init=False)

    def __post_init__(self) -> None:
        self.bits = max(1, (len(self.vocabulary) + 1).bit_length())
        self.per_key = 62 // self.bits
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        width = self.windows.shape[1]
        self.keys, self.masks = [], []
        for first in range(0, width, self.per_key):
            key = np.zeros(len(self.windows), np.int64)
            mask = np.zeros(len(self.windows), np.int64)
            for j in range(first, first + self.per_key):
                inside = (j < self.lengths) if j < width else np.zeros(len(self.windows), bool)
                key = (key << self.bits) | (np.where(inside, self.windows[:, j], 0) if j < width else 0)
                mask = (mask << self.bits) | np.where(inside, (1 << self.bits) - 1, 0)
            self.keys.append(key)
            self.masks.append(mask)


def test_block(items: list[tuple[str, bytes]], window: int) -> TestBlock:
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for number, (_, text) in enumerate(items):
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in split_words(text)]
        for first in range(max(1, len(ids) - window + 1) if ids else 0):
            found.setdefault(tuple(ids[first : first + window]), []).append((number, first))
    rows = np.zeros((len(found), window), np.int64)
    for k, ids in enumerate(found):
        rows[k, : len(ids)] = ids
    return TestBlock([i for i, _ in items], vocabulary, rows, np.array([len(k) for k in found], np.int64), list(found.values()))


def suffix_array(text: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
    """Start positions sorted by the words that follow, to the windows' width, and the packed words at each position.

    A suffix whose first words, as many as the shortest window has, aren't all in the test vocabulary can't match and
    is left out. Positions past the width in common stay in any order.
    """
    width = block.windows.shape[1]
    padded = np.concatenate([text, np.zeros(width + block.per_key, np.int64)])
    packed = np.zeros(len(padded) - block.per_key, np.int64)
    for j in range(block.per_key):
        packed = (packed << block.bits) | padded[j : j + len(packed)]
    gaps = np.flatnonzero(padded == 0)
    known = gaps[np.searchsorted(gaps, np.arange(len(text)))] - np.arange(len(text))  # words up to the next unknown one
    start = np.flatnonzero(known >= block.shortest)
    order = start[np.argsort(packed[start], kind="stable")]
    tied = np.zeros(len(order) + 1, bool)
    tied[1:-1] = packed[order][1:] == packed[order][:-1]
    depth = block.per_key
    while depth < width and tied.any():
        some = np.flatnonzero(tied[:-1] | tied[1:])
        group = np.cumsum(~tied[:-1])[some]
        key = packed[order[some] + depth]
        by = np.lexsort((key, group))
        order[some] = order[some][by]
        key = key[by]
        tied[some[1:]] &= (group[1:] == group[:-1]) & (key[1:] == key[:-1])
        depth += block.per_key
    return order, packed


def search(order: np.ndarray, packed: np.ndarray, block: TestBlock, after: bool) -> np.ndarray:
    """For every window the first place in the array whose suffix isn't less (``after``: is greater)."""
    low = np.zeros(len(block.lengths), np.int64)
    high = np.full(len(block.lengths), len(order), np.int64)
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        at = order[np.minimum(middle, len(order) - 1)]
        less = np.zeros(len(low), bool)
        equal = np.ones(len(low), bool)
        for k, (key, mask) in enumerate(zip(block.keys, block.masks, strict=True)):
            value = packed[np.minimum(at + k * block.per_key, len(packed) - 1)] & mask
            less |= equal & (value < key)
            equal &= value == key
        right = open_ & (less | (equal if after else False))
        low = np.where(right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)
    return low


def occurrences(text: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
    """(position, window) of every verbatim occurrence of a test window in a shard, by position."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(block.lengths):
        return nothing
    order, packed = suffix_array(text, block)
    if not len(order):
        return nothing
    first = search(order, packed, block, False)
    count = search(order, packed, block, True) - first
    hit = np.flatnonzero(count)
    if not len(hit):
        return nothing
    each = count[hit]
    place = np.repeat(first[hit] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
    position, window = order[place], np.repeat(hit, each)
    by = np.argsort(position, kind="stable")
    return position[by], window[by]


@dataclass
class Found:
    """What a document has of the test set."""

    n_words: int
    n_hit: int
    item_ids: set[str]
    matches: list[tuple[str, int, int, int]]  # item, first word in the item, first word in the document, words


def scan(texts: list[bytes], blocks: Iterator[TestBlock], detail: bool) -> list[Found]:
    """Looks a shard's texts up; with ``detail`` lists the longest matches too."""
    words = [split_words(t) for t in texts]
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    covered = np.zeros(starts[-1] + 1, np.int64)
    out = [Found(len(w), 0, set(), []) for w in words]
    for block in blocks:
        get = block.vocabulary.get
        text = np.zeros(starts[-1], np.int64)
        for w, at in zip(words, starts, strict=False):
            text[at : at + len(w)] = np.fromiter(map(get, w, repeat(0)), np.int64, len(w))
        position, window = occurrences(text, block)
        np.add.at(covered, position, 1)
        np.add.at(covered, position + block.lengths[window], -1)
        document = np.searchsorted(starts, position, "right") - 1
        for d, k in set(zip(document.tolist(), window.tolist(), strict=True)):
            out[d].item_ids.update(name for item, _ in block.owners[k] if (name := block.item_ids[item]) is not None)
        if detail:
            _join(out, block, (position - starts[document]).tolist(), document.tolist(), window.tolist())
    hit = np.concatenate([[0], np.cumsum(np.cumsum(covered) > 0)])
    for d, found in enumerate(out):
        found.n_hit = int(hit[starts[d + 1]] - hit[starts[d]])
    return out


def _join(out: list[Found], block: TestBlock, position: list[int], document: list[int], window: list[int]) -> None:
    """Window occurrences that follow each other in both texts become one longest match."""
    running: dict[tuple[int, int, int], list[int]] = {}
    for p, d, k in zip(position, document, window, strict=True):
        n = int(block.lengths[k])
        for item, first in block.owners[k]:
            run = running.get((d, item, p - first))
            if run and run[0] + run[2] - n + 1 == p:
                run[2] += 1
            else:
                if run:
                    out[d].matches.append((block.item_ids[item], run[1], run[0], run[2]))
                running[d, item, p - first] = [p, first, n]
    for (d, item, _), (p, first, n) in running.items():
        out[d].matches.append((block.item_ids[item], first, p, n))


def blocks_of(benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """Broadcasts of the test set, none larger than about ``block_bytes``. Items without words never occur; those without an id are
    searched like the others but have no place in a list of ids."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    each = (items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n))
    return [context.broadcast(test_block([(r.i, bytes(r.t)) for r in part.collect()], window)) for part in each]


def _in_turn(blocks: list) -> Iterator[TestBlock]:
    """The blocks in a worker. ``value`` would keep each for as long as the worker lives; that is only done for a single one."""
    for b in blocks:
        path = getattr(b, "_path", None)
        yield b.value if len(blocks) == 1 or path is None else b.load_from_path(path)


def _scanned(documents: DataFrame, blocks: list, columns: list[str], schema: str, shard_words: int, detail: bool, rows) -> DataFrame:
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index("__text"))
            first, size = 0, 0
            for k in range(batch.num_rows):
                size += len(texts[k].as_buffer() or b"") if texts[k].is_valid else 0
                if size >= 6 * shard_words or k + 1 == batch.num_rows:
                    part = batch.slice(first, k + 1 - first)
                    found = scan([t or b"" for t in part.column("__text").to_pylist()], _in_turn(blocks), detail)
                    yield from rows(part, found, target)
                    first, size = k + 1, 0

    return documents.select(*columns, F.col("text").cast("binary").alias("__text")).mapInArrow(released(run), schema)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted ids of the items found), contaminated.

    ``window`` words in a row, or a whole shorter item, make an occurrence; a document is contaminated if at least one
    word in twenty is inside one. Null and empty texts have no words and are clean; repeated rows give equal rows; an
    empty benchmark finds nothing; only doc_id and text (item_id and text) are read.
    """

    def rows(part, found, target):
        items = [sorted(f.item_ids) for f in found]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id").cast(pa.int64()),
                pa.array([f.n_words for f in found], pa.int64()),
                pa.array([f.n_hit for f in found], pa.int64()),
                pa.array(items, target.field("items").type),
                pa.array([f.n_hit > 0 and 20 * f.n_hit >= f.n_words for f in found], pa.bool_()),
            ],
            schema=target,
        )

    schema = "doc_id long, n_words long, n_hit long, items array<string>, contaminated boolean"
    return _scanned(documents, blocks_of(benchmark, window, block_bytes), ["doc_id"], schema, shard_words, False, rows)


def longest_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The longest verbatim matches: doc_id, item_id, item_start, doc_start, n_words (places in words)."""

    def rows(part, found, target):
        flat = [(i, *m) for i, f in zip(part.column("doc_id").to_pylist(), found, strict=True) for m in f.matches]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat, strict=True) if flat else [[]] * 5, target, strict=True)], schema=target)

    schema = "doc_id long, item_id string, item_start long, doc_start long, n_words long"
    return _scanned(documents, blocks_of(benchmark, window, block_bytes), ["doc_id"], schema, shard_words, True, rows)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents, all their columns, without the contaminated ones (see ``contamination``).

    The verdict is taken where the row is, so repeated rows and null ids need no join; a column named like one of
    the work columns is an ordinary column.
    """
    names = documents.columns
    plain = documents.toDF(*(f"c{k}" for k in range(len(names))))
    text = f"c{names.index('text')}"

    def rows(part, found, target):
        keep = pa.array([not (f.n_hit and 20 * f.n_hit >= f.n_words) for f in found], pa.bool_())
        yield pa.RecordBatch.from_arrays([part.column(f.name).cast(f.type) for f in target], schema=target).filter(keep)

    source = plain.withColumn("text", F.col(text))
    kept = _scanned(source, blocks_of(benchmark, window, block_bytes), plain.columns, plain.schema, shard_words, False, rows)
    return kept.toDF(*names)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )
