"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A 64-bit fingerprint maps to the bit counts of its sixteen 4-bit segments. Counts of two fingerprints differ, summed
over the segments (Manhattan distance), by no more than their bits do, so points farther apart than the limit can't
link. Two lattice points at Manhattan distance 2 or less always have a lattice point within 1 of both. So every
fingerprint goes to its own grid cell and the 32 next to it, fingerprints that meet in a cell are compared bit by bit,
and no other pair is looked at.

A cell with many fingerprints isn't joined with itself: fingerprints from such cells are linked through the values one
bit away (two fingerprints within 2 bits share such a value), each to the least that shares it. That is exact too and
makes at most 65 rows for a fingerprint whatever the cell holds.

Copies collapse to one fingerprint before any of this; components come from alternating stars over the links.

With ``similarity`` the links of another rule are added, a Jaccard similarity of word-shingle sets (``near_copies``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm import near_copies
from pulsegrid.llm.common import cut_lineage, map_arrow, marked, stored, table
from pulsegrid.llm.near_copies import shingle_hashes

SHINGLE_WORDS = 3
DISTANCE = 2
CROWDED = 64
SEGMENTS = 16
ONES = 0x1111111111111111
BLOCK = 1 << 15


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """Bit k is set if it is in over half the hashes. As a signed 64-bit integer."""
    hashes = shingle_hashes(text, width)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        part = hashes[k : k + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, key (a hash of the text), fp. Null and wordless texts have fingerprint 0."""
    run = lambda b: {"doc_id": b["doc_id"], "key": b["key"], "fp": [fingerprint(t, width) for t in b["text"]]}
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return map_arrow(documents.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text")), run, "doc_id long, key long, fp long")


def bit_counts(fp: Column) -> Column:
    """The bit count of each 4-bit segment, in that segment's place of a long."""
    ones = F.lit(ONES)
    parts = [F.shiftrightunsigned(fp, k) if k else fp for k in range(4)]
    return sum((p.bitwiseAND(ones) for p in parts[1:]), parts[0].bitwiseAND(ones))


def cells(fps: DataFrame, distance: int) -> DataFrame:
    """``fps`` (fp) once for each grid cell within half the distance: cell, fp."""
    point = F.col("point")
    near = [point]
    if distance:
        for k in range(SEGMENTS):
            count = F.shiftrightunsigned(point, 4 * k).bitwiseAND(F.lit(7))
            near += [F.when(count < 4, point + F.lit(1 << 4 * k)), F.when(count > 0, point - F.lit(1 << 4 * k))]
    return fps.select("fp", bit_counts(F.col("fp")).alias("point")).select(F.explode(F.array(*near)).alias("cell"), "fp").where("cell is not null")


def links(fps: DataFrame, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b), a < b, between the different values in ``fps`` (fp) whose connected components are those of all
    pairs within ``distance`` (0 to 2) bits. All pairs but those from crowded cells are themselves in it."""
    if not 0 <= distance <= 2:
        raise ValueError("the grid has cells for a distance of 0 to 2 bits")
    members = cells(fps, distance)
    shared = stored(members.groupBy("cell").count().where("count > 1"))
    # most cells hold one fingerprint: their rows aren't shuffled again
    met = stored(marked(members, F.xxhash64("cell"), shared.select(F.xxhash64("cell"))).where("__may").drop("__may").join(shared, "cell"))
    few, many = met.where(F.col("count") <= crowded), met.where(F.col("count") > crowded)
    a, b = few.select("cell", F.col("fp").alias("a")), few.select("cell", F.col("fp").alias("b"))
    point_a, point_b = bit_counts(F.col("a")), bit_counts(F.col("b"))
    same_cell_once = (point_a != point_b) | (F.col("cell") == point_a)
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & same_cell_once
    pairs = a.join(b, "cell").where(close).select("a", "b").distinct()
    one_off = [F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)]
    single = many.select("fp").distinct()
    if distance == 2:  # all that share a value are within 2 bits of each other
        shares = single.select("fp", F.explode(F.array(F.col("fp"), *one_off)).alias("value"))
        group = shares.groupBy("value").agg(F.collect_set("fp").alias("all"))  # 65 at most
        star = group.where(F.size("all") > 1).select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a < b")
    elif distance == 1:  # the value itself has to be there
        shares = single.select(F.col("fp").alias("other"), F.explode(F.array(*one_off)).alias("fp"))
        star = shares.join(single, "fp").select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    else:
        star = pairs.limit(0)
    return pairs.unionByName(star).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): node, root, root the least of the component; roots aren't listed.

    Large and small stars in turn: each round hangs neighbours onto the least node they can see. Minima are combined
    before the shuffle and joined back, so Spark can split a node with many neighbours. It ends when every node hangs
    on one root and no root on another. The rounds meet in written tables: a checkpoint would hand its plan's
    constraints on, which double from round to round.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node != root").distinct())
    while True:
        ends = now.select("node", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("root").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty():
            return now
        both = now.unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("least"))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("least").alias("root"))
        # a node that hangs onto itself is gone; every other edge goes on from its upper to its lower end
        large = stored(large.where("node != root").distinct())
        least = large.groupBy("node").agg(F.min("root").alias("least"))
        small = large.join(least, "node").select(F.col("root").alias("node"), F.col("least").alias("root")).where("node != root")
        now = stored(least.select("node", F.col("least").alias("root")).unionByName(small).distinct())


def near_links(documents: DataFrame, fp_of: DataFrame, hung: DataFrame, similarity: float) -> DataFrame:
    """``hung`` (node, root: components of fingerprints) with those merged that hold texts of five-word shingle sets that similar.

    ``fp_of`` has the fingerprint of each text's key.
    """

    def roots(trees: DataFrame) -> DataFrame:
        return stored(fp_of.join(trees, fp_of.fp == trees.node, "left").select("key", F.coalesce("root", "fp").alias("root")))

    def merged(trees: DataFrame, root: DataFrame, links_: DataFrame) -> DataFrame:
        sides = near_copies.attached(links_, root).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        return stars(trees.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(sides))

    texts, root = near_copies.keyed(documents), roots(hung)
    bits = near_copies.sketches(texts, near_copies.WORDS)
    met = near_copies.weighed(near_copies.groups(texts, similarity, near_copies.WORDS), similarity)
    for candidates in (near_copies.to_pivots, near_copies.across):
        pairs = candidates(near_copies.undecided(met, root), similarity)
        found = near_copies.verified(texts, bits, pairs, similarity, near_copies.WORDS)
        if not found.isEmpty():
            hung = merged(hung, root, found)
            root = roots(hung)
    return hung


def grouped(documents: DataFrame, width: int, distance: int, crowded: int, similarity: float | None) -> tuple[DataFrame, DataFrame]:
    """Of every row doc_id, fp and key (a hash of its text); and the components: node, root, for fingerprints that aren't roots."""
    of = cut_lineage(fingerprints(documents, width))
    hung = stars(links(of.select("fp").distinct(), distance, crowded))
    if similarity is not None:
        hung = near_links(documents, stored(of.select("key", "fp").distinct()), hung, similarity)
    return of, hung


def components(documents: DataFrame, width: int = SHINGLE_WORDS, distance: int = DISTANCE, crowded: int = CROWDED, similarity: float | None = None) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the least doc_id reachable over links, its own included).

    Null and empty texts have fingerprint 0 and link like any other; repeated rows give equal rows; rows without an id
    take part, and only a component of nothing else has no component_id; an empty table gives none. Only doc_id and
    text are read. With ``similarity`` texts whose five-word shingles are that similar (Jaccard) are linked as well.
    """
    of, hung = grouped(documents, width, distance, crowded, similarity)
    least = cut_lineage(of.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = least.join(hung.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = cut_lineage(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = cut_lineage(rooted.join(whole, "root").select("fp", "component_id"))
    return of.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def deduplicate(documents: DataFrame, width: int = SHINGLE_WORDS, distance: int = DISTANCE, crowded: int = CROWDED, similarity: float | None = None) -> DataFrame:
    """The documents, all their columns, with one of each component: the one with the least id.

    Rows without an id come after all that have one. Of rows that share that id the one with the least hash of its text
    stays, of equal rows one. Null and empty texts are copies of each other; an empty table gives none.
    """
    names = documents.columns
    plain = documents.toDF(*(f"c{k}" for k in range(len(names))))
    ident, text = F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}")
    of, hung = grouped(documents, width, distance, crowded, similarity)
    rows = of.groupBy("doc_id", "key").agg(F.first("fp").alias("fp"), F.count("*").alias("rows"))
    known = rows.join(hung, F.col("fp") == F.col("node"), "left").select("doc_id", "key", "rows", F.coalesce("root", "fp").alias("root"))
    known = stored(known.withColumn("place", F.struct(F.col("doc_id").isNull(), "doc_id", "key")))
    best = stored(known.groupBy("root").agg(F.min("place").alias("best")))
    gone = stored(known.join(best, "root").where("place != best or rows > 1").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), (F.col("place") == F.col("best")).alias("__first")))
    may, same = suspects(plain, ident, F.xxhash64(F.coalesce(text.cast("binary"), F.lit(b""))), gone)
    joined = may.where("__may").join(gone, same, "left")
    once = F.row_number().over(Window.partitionBy("__id", "__key").orderBy("__key"))
    again = joined.where("__first").withColumn("__at", once).where("__at = 1")
    stay = may.where("not __may").unionByName(joined.where("__first is null").select(*may.columns)).select(*plain.columns)
    return stay.unionByName(again.select(*plain.columns)).toDF(*names)


def suspects(plain: DataFrame, ident: Column, key: Column, gone: DataFrame) -> tuple[DataFrame, Column]:
    """``plain`` with ``__may``, true for all rows that ``gone`` (__id, __key, written) lists and few others: the rest stays
    without its texts being shuffled. And the condition that joins the two exactly."""
    value = lambda i, k: F.xxhash64(i.cast("long"), k)
    listed = gone.select(value(F.col("__id"), F.col("__key")))
    return marked(plain, value(ident, key), listed), ident.eqNullSafe(F.col("__id")) & (key == F.col("__key"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
