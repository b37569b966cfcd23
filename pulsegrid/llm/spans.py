"""Where patterns match in a text, in code points, by DataFrame functions alone.

Spark tells what a pattern matches but not where. Splitting the text at the pattern gives the gaps between the matches,
and gaps and matches added up in order give the places. The adding is a window over the exploded matches, so it takes
time in proportion to them whatever a text holds; only lengths are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """A kind of span. ``keep`` says of the text before a match and the match whether it counts; one that doesn't still
    takes its place. ``guard`` is a cheap test that holds for every text with a match. ``notes`` are further columns."""

    name: str
    pattern: str
    guard: Callable[[Column], Column]
    keep: Callable[[Column, Column], Column] = lambda before, match: F.lit(True)
    notes: Callable[[Column, Column], list[Column]] = lambda before, match: []


def matches(text: Column, number: int, kind: Kind) -> Column:
    """Array of struct(kind, at, gap, size, keep, notes...) of the leftmost non-overlapping matches."""
    pieces = F.arrays_zip(F.split(text, kind.pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("match"))

    def one(x: Column, at: Column) -> Column:
        before, match = x["before"], x["match"]
        return F.struct(
            F.lit(number).alias("kind"), at.alias("at"), F.length(before).alias("gap"), F.length(match).alias("size"),
            kind.keep(before, match).alias("keep"), *kind.notes(before, match),
        )

    # The piece after the last match has none itself.
    return F.when(kind.guard(text), F.transform(F.filter(pieces, lambda x: x["match"].isNotNull()), one))


def parts_of(rows: DataFrame, kinds: list[Kind]) -> DataFrame:
    """row, doc_id, kind, at, gap, size, keep, notes: all matches of ``rows`` (row, doc_id, text); and for each row one with a null kind."""
    found = rows.select("row", "doc_id", *(matches(F.col("text"), k, kind).alias(f"m{k}") for k, kind in enumerate(kinds)))
    empty = F.transform(F.array(F.lit(1)), lambda x: F.lit(None))  # one null: the row's own entry
    all_ = F.concat(empty, *(F.coalesce(f"m{k}", F.array()) for k in range(len(kinds))))
    return found.select("row", "doc_id", F.explode(all_).alias("p")).select("row", "doc_id", "p.*")


def placed(parts: DataFrame, notes: list[str] = []) -> DataFrame:  # noqa: B006
    """row, doc_id, kind (a number), start, end, the notes: the kept spans, and the rows' own entries. All of a row is in one partition."""
    so_far = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = parts.repartition("row").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far))
    return ends.where("kind is null or keep").select("row", "doc_id", "kind", (F.col("end") - F.col("size")).alias("start"), "end", *notes)


def located(documents: DataFrame, kinds: list[Kind], notes: list[str] = []) -> DataFrame:  # noqa: B006
    """``placed`` matches of ``documents``; ``row`` tells rows apart, equal ones too. Null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return placed(parts_of(documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", text), kinds), notes)


def nearest(name: str, test: Column) -> dict[str, Column]:
    """{name}_end and {name}_start: the furthest end before and the nearest start after a span, of those for which ``test`` holds.

    Both ways look at what came before only: Spark adds such a frame up as it goes, while a frame up to the end is gone
    through anew for every span.
    """
    order = ("start", "end", "kind")
    forward = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    backward = Window.partitionBy("row").orderBy(*(F.col(c).desc() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    return {f"{name}_end": F.max(F.when(test, F.col("end"))).over(forward), f"{name}_start": F.min(F.when(test, F.col("start"))).over(backward)}


def within(name: str, far: int) -> Column:
    """Whether one of those found by ``nearest`` begins or ends less than ``far`` code points away, or overlaps."""
    return F.coalesce(F.col(f"{name}_end") > F.col("start") - far, F.lit(False)) | F.coalesce(F.col(f"{name}_start") < F.col("end") + far, F.lit(False))


def apart(spans: DataFrame, sure: Column) -> DataFrame:
    """``spans`` (of ``placed``) without those that overlap a span for which ``sure`` holds, unless they are such themselves.

    A sweep in order of the starts, once forward and once backward.
    """
    near = spans.withColumn("sure", F.coalesce(sure, F.lit(False))).withColumns(nearest("sure", F.col("sure")))
    return near.where(F.col("kind").isNull() | F.col("sure") | ~within("sure", 0)).select(*spans.columns)


def joined(spans: Column, names: list[str]) -> Column:
    """kind:start:end, comma-joined, of an array of struct(start, kind, end) in the array's order."""
    label = F.array(*map(F.lit, names))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", label[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))
