"""Texts whose sets of word shingles have at least a given Jaccard similarity, found exactly.

Two sets that similar share a shingle among the first of each in any one order (prefix filter). The order is by hash,
with shingles that a sample of the texts repeats put last: it makes fewer candidates and loses none. Texts that share
a first shingle form a group. A group isn't compared pair by pair: its members are held against pivots, for each step of
size one that the others may have been made from, the links found so far are followed, and only members that are still
in different components are compared with each other. No pair is left out whose link would change a component.

A shingle's place in the order bounds a pair as well (positional filter): if it is the first that two sets share, they
share no more than what each has from there on. So a member can't meet larger sets than that bound lets it, and one
that can't even meet its group's smallest set leaves the group. That is what happens to the copies in a large group
which are changed too much to be near any other: they are left out in time linear in them.

A pair goes through three tests, each on fewer pairs than the one before: the sizes, a sketch of the sets' parities,
and the sets themselves, made anew from the two texts.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import arrow_schema, map_arrow, pieces, released, stored, text_batches

SEED = 42
WORDS = 5
SAMPLED = 16  # one text in so many shows which shingles are common
COMMON = 200_000
HOT = 32  # times in the sample; the texts of such a shingle aren't sorted in one place
SEEN = 1_000_000
SKETCH_BITS = 2048


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included; a shorter text is one run; no words, no hashes."""
    words = text.lower().split()  # on bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-width]]
    return np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)), np.uint64, len(starts))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def needed(size: int, similarity: float) -> int:
    """The least number of shingles that a set of ``size`` shares with any set that similar."""
    return max(1, math.ceil(similarity * size - 1e-9))


def prefix(hashes: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a sorted set, ``common`` (sorted) ones last. Sets that similar share one of their firsts."""
    if len(common):
        late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[: len(hashes) - needed(len(hashes), similarity) + 1] if len(hashes) else hashes


def sketch(hashes: np.ndarray) -> bytes:
    """How many hashes fall to each of SKETCH_BITS places, odd or even. Two sets differ in as many shingles at least as places do."""
    odd = np.bincount((hashes % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def keyed(documents: DataFrame) -> DataFrame:
    """key (a hash of the text), text as binary; null counts as empty."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return documents.select(F.xxhash64(text).alias("key"), text.alias("text"))


def common_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """At most COMMON hashes that occur more than once in a sample of ``texts``, sorted, and which of them are hot."""

    def run(batch):
        sets = [shingle_set(t, width).view(np.int64) for t in batch["text"]]
        return {"key": np.repeat(np.array(batch["key"], np.int64), [len(s) for s in sets]), "h": np.concatenate([np.zeros(0, np.int64), *sets])}

    some = map_arrow(texts.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLED)) == 0), run, "key long, h long").distinct()
    found = some.groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    hashes, times = found.column("h").to_numpy().astype(np.int64).view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], times[order] >= HOT


def prefixes(texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """h, key, n, pos, salt: the first shingles of every text, its number of shingles and their places. A task gives a
    text's only once, as long as it can remember it. ``salt`` is null but for hot shingles."""
    held = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, width))
    schema = "h long, key long, n int, pos int, salt long"
    target = arrow_schema(schema)

    def run(batches):
        common, hot = held.value
        seen: set[int] = set()
        for part, some in text_batches(batches):
            first, keys, sizes = [np.zeros(0, np.uint64)], [], []
            for key, text in zip(part.column("key").to_pylist(), some, strict=True):
                if key not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    found = shingle_set(text, width)
                    first.append(prefix(found, common, similarity))
                    keys.append(key)
                    sizes.append(len(found))
            each = [len(f) for f in first[1:]]
            h, key = np.concatenate(first), np.repeat(np.array(keys, np.int64), each)
            place = np.concatenate([np.zeros(0, np.int32), *(np.arange(k, dtype=np.int32) for k in each)])
            many = np.zeros(len(h), bool)
            if len(common):
                at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                many = (common[at] == h) & hot[at]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key), pa.array(np.repeat(np.array(sizes, np.int32), each)), pa.array(place), pa.array(key, mask=~many)], schema=target)

    return texts.mapInArrow(released(run), schema)


def groups(texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """The written table h, key, n, pos, hot, times, least of texts that share a first shingle with a different text: how
    many do, and the size of the smallest.

    Rows of a shingle that isn't hot are dealt once, by the shingle; what is asked of its group is answered there. Those of
    hot ones are spread out, and their groups' figures (COMMON at most) are broadcast.
    """
    dealt = prefixes(texts, similarity, width).repartition("h", "salt").select("h", "salt", "key", "n", "pos").distinct()
    same = Window.partitionBy("h", "salt")
    hot = F.col("salt").isNotNull()
    met = dealt.select("h", "key", "n", "pos", hot.alias("hot"), F.count("*").over(same).alias("times"), F.min("n").over(same).alias("least"))
    met = stored(met.where("hot or times > 1"))
    figures = met.where("hot").groupBy("h").agg(F.count("*").alias("times"), F.min("n").alias("least"))
    spread = met.where("hot").drop("times", "least").join(F.broadcast(figures), "h")
    return met.where("not hot").unionByName(spread)


def largest(similarity: float):
    """The size of the largest set that a set of ``n`` can be that similar to, if they share nothing before ``pos``."""
    return (F.col("n") - F.col("pos")) * ((1 + similarity) / similarity) - F.col("n") + 1e-6


def fits(a: str, b: str, similarity: float):
    """Whether the sizes of two sets and what each can meet (columns named like the sizes, and ``upto``) allow it."""
    near = F.least(a, b) >= F.greatest(a, b) * similarity - 1e-9
    return near & (F.col(a) <= F.col(b.replace("n", "upto"))) & (F.col(b) <= F.col(a.replace("n", "upto")))


def weighed(met: DataFrame, similarity: float) -> DataFrame:
    """``met`` without members that can meet no size in their group; with ``upto``, the largest they can, and ``weight``: how often others have a text's first shingles. What an edited copy changed is rare and
    stands first in it, so of a group of near copies the one that the others were made from weighs most."""
    counted = met.withColumns({"upto": largest(similarity), "weight": F.sum("times").over(Window.partitionBy("key"))})
    return stored(counted.where("upto >= least").select("h", "key", "n", "upto", "hot", "weight"))


def undecided(met: DataFrame, roots: DataFrame) -> DataFrame:
    """The written rows of ``met`` whose group has members in different components by ``roots`` (key, root), with root
    and ``main``, the group's largest component. Groups of hot shingles (COMMON at most) aren't put in one place."""
    known = stored(met.join(roots, "key"))
    same, part = Window.partitionBy("h"), Window.partitionBy("h", "root")
    cold = known.where("not hot").repartition("h").withColumn("c", F.count("*").over(part))
    cold = cold.withColumns({"main": F.max(F.struct("c", "root")).over(same)["root"], "__low": F.min("root").over(same), "__high": F.max("root").over(same)})
    parts = known.where("hot").groupBy("h", "root").agg(F.count("*").alias("c"))
    main = parts.groupBy("h").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.count("*").alias("parts")).where("parts > 1").select("h", "main")
    return stored(cold.where("__low != __high").drop("c", "__low", "__high").unionByName(known.where("hot").join(F.broadcast(main), "h")))


def to_pivots(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, of each member of an undecided group and the group's pivots in other components.

    A pivot is one member of the largest component, and one of the rest, for every step of size, the weightiest; members
    are held against those of their own step and the next ones. A group has two pivots a step at most, so they are
    joined as one array of a length that only the sizes of texts bound, by their logarithm.
    """
    sized = rows.withColumn("level", F.floor(F.log("n") / -math.log(similarity)))
    best = sized.groupBy("h", "level", (F.col("root") == F.col("main")).alias("inner")).agg(F.max(F.struct("weight", "key", "n", "upto", "root")).alias("p"))
    pivots = best.groupBy("h").agg(F.collect_list(F.struct("level", "p")).alias("pivots"))
    near = F.filter("pivots", lambda x: (F.abs(x["level"] - F.col("level")) <= 1) & (x["p"]["root"] != F.col("root")))
    star = sized.select("h", "key", "n", "upto", "root", "level").join(pivots, "h").select("key", "n", "upto", F.explode(near).alias("x"))
    star = star.select("key", "n", "upto", F.col("x.p").alias("p")).where(fits("n", "p.n", similarity))
    return star.select(F.least("key", "p.key").alias("a"), F.greatest("key", "p.key").alias("b")).distinct()


def across(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, of members of one undecided group that are in different components.

    Of two such members one at least is outside the group's largest component, so only those are held against the others.
    """
    few = rows.where("root != main").select("h", F.col("key").alias("x"), F.col("n").alias("n_x"), F.col("upto").alias("upto_x"), F.col("root").alias("root_x"))
    pairs = few.join(rows, "h").where((F.col("root") != F.col("root_x")) & fits("n", "n_x", similarity))
    return pairs.select(F.least("key", "x").alias("a"), F.greatest("key", "x").alias("b")).distinct()


def keys_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()


def attached(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the other columns of ``rows`` (key, ...) for each side."""
    for side in "ab":
        pairs = pairs.join(rows.select(F.col("key").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in rows.columns if c != "key")), side)
    return pairs


def sketches(texts: DataFrame, width: int) -> DataFrame:
    """The written table key, n, bits of all texts. Joins move these few bytes of a text, not the text."""

    def run(batch):
        sets = [shingle_set(t, width) for t in batch["text"]]
        return {"key": batch["key"], "n": [len(s) for s in sets], "bits": [sketch(s) for s in sets]}

    return stored(map_arrow(texts, run, "key long, n int, bits binary").dropDuplicates(["key"]))


def verified(texts: DataFrame, bits: DataFrame, pairs: DataFrame, similarity: float, width: int) -> DataFrame:
    """The written pairs (a, b) whose texts are that similar. ``bits``: the texts' sketches."""
    pairs = stored(pairs)
    if pairs.isEmpty():
        return pairs
    target = arrow_schema("a long, b long")

    def may_be(batches):
        for batch in batches:
            bits = [np.frombuffer(b"".join(batch.column(f"bits_{side}").to_pylist()), np.uint64).reshape(batch.num_rows, SKETCH_BITS // 64) for side in "ab"]
            apart = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)
            both = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            keep = apart * (1 + similarity) <= both * (1 - similarity) + 1e-6  # |A - B| + |B - A| <= (1 - s) / (1 + s) (|A| + |B|)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=target).filter(pa.array(keep))

    def compare(batches):
        for batch in batches:
            for part in pieces(batch):
                sets, found = {}, []
                for r in part.to_pylist():
                    for side in "ab":
                        if r[side] not in sets:
                            sets[r[side]] = shingle_set(r[f"text_{side}"], width)
                    if similar(sets[r["a"]], sets[r["b"]], similarity):
                        found.append((r["a"], r["b"]))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], schema=target)

    wanted = bits.join(stored(keys_of(pairs)), "key", "left_semi")
    close = stored(attached(pairs, wanted).select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(released(may_be), "a long, b long"))
    once = texts.join(stored(keys_of(close)), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be put in one task
    return stored(attached(close.repartition(tasks, "a", "b"), once).select("a", "b", "text_a", "text_b").mapInArrow(released(compare), "a long, b long"))

