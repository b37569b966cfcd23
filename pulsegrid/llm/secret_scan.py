"""Secret scans with multipart credential linking, by DataFrame functions alone.

Three kinds of strong span are reported wherever they stand. Weak parts - an identifier given by name, a random-looking
token, an endpoint - say little alone, so an interval join looks for what would complete them to a credential within
their scope, ``reach`` code points on either side. The join is a sweep over a text's parts in order of their starts:
the furthest end before and the nearest start after, of each role, decide, so no pairs are ever made.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import stored, table
from pulsegrid.llm.spans import Kind, joined, located, nearest, parts_of, placed, within

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
IDENTIFIER = r"""(?i:access[_-]?key[_-]?id|client[_-]?id|account[_-]?id|user[_-]?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}+"""
BLOB = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"""(?i:https?|s3|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+"""
REACH = 240
MASK = "[SECRET]"
BLOCK = 4096

ASSIGN_, ACCESS, HEX, IDENT, TOKEN, PLACE = range(6)
STRONG = (ASSIGN_, ACCESS, HEX)


def has(pattern: str):
    return lambda text: text.rlike(pattern)


KINDS = [
    Kind("assign", ASSIGN, has(r"[pPsStTaA](?i:assw|ecret|oken|pi_?key)"), lambda b, m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6),
    Kind("access", r"AKIA[A-Z0-9]+", lambda t: t.contains("AKIA"), lambda b, m: F.length(m) >= 20),
    Kind("hex", r"[0-9a-f]{24,}", has(r"[0-9a-f]{24}")),
    Kind("identifier", IDENTIFIER, has(r"[aAcCuUlL](?i:ccess[_-]?key|lient[_-]?id|ccount[_-]?id|ser[_-]?name|ogin)")),
    Kind("token", BLOB, has(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}"), lambda b, m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")),
    Kind("endpoint", ENDPOINT, lambda t: t.contains("://")),
]
NAMES = [k.name for k in KINDS]


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Of ``placed`` parts those that are reported, and the rows' own entries with a null kind: row, doc_id, kind, start, end.

    A named identifier needs a secret (assign, hex or token) in its scope, a token an identifier (access or named), an
    endpoint both. A token or identifier that overlaps a strong span or an endpoint, or a token that overlaps an
    identifier, is part of that span and no candidate.
    """
    kind = F.col("kind")
    first = parts.withColumns(nearest("sure", kind.isin(*STRONG, PLACE)) | nearest("named", kind == IDENT))
    part_of = (kind.isin(IDENT, TOKEN) & within("sure", 0)) | ((kind == TOKEN) & within("named", 0))
    candidates = first.where(kind.isNull() | ~part_of)
    second = candidates.withColumns(nearest("secret", kind.isin(ASSIGN_, HEX, TOKEN)) | nearest("ident", kind.isin(ACCESS, IDENT)))
    # Ends and starts count as in reach if at most ``reach`` code points lie between.
    secret, ident = within("secret", reach + 1), within("ident", reach + 1)
    complete = kind.isin(*STRONG) | ((kind == IDENT) & secret) | ((kind == TOKEN) & ident) | ((kind == PLACE) & secret & ident)
    return second.where(kind.isNull() | complete).select("row", "doc_id", "kind", "start", "end")


def scan(documents: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_linked, strong and found (arrays of start, kind, end).

    Null text counts as empty; a text without secrets has zero counts; repeated rows give equal rows; an empty table
    gives none; only doc_id and text are read.
    """
    of = linked(located(documents, KINDS), reach).groupBy("row")
    span = F.struct("start", "kind", "end")
    kind = F.col("kind")
    return of.agg(
        F.first("doc_id").alias("doc_id"),
        *(F.count_if(kind == k).alias(f"n_{NAMES[k]}") for k in STRONG),
        F.count_if(kind > HEX).alias("n_linked"),
        F.sort_array(F.collect_list(F.when(kind.isin(*STRONG), span))).alias("strong"),
        F.sort_array(F.collect_list(F.when(kind.isNotNull(), span))).alias("found"),
    ).drop("row")


def cuts(spans: DataFrame, mask: str = MASK) -> DataFrame:
    """For each row of ``spans`` (row, start, end) what a mask does to its text: row, cuts - a map from the number of a
    block of BLOCK code points to an array of struct(from, to, mask): ``to`` is where the text goes on.

    Overlapping spans are masked together; a span over several blocks has its mask in the first.
    """
    order = Window.partitionBy("row").orderBy("start", "end")
    apart = spans.withColumn("__new", F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True)))
    number = F.sum(F.col("__new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = apart.withColumn("__n", number).groupBy("row", "__n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    blocks = F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))
    each = whole.withColumn("block", F.explode(blocks)).withColumn("first", F.col("block") * BLOCK)
    inside = F.struct(
        F.greatest(F.col("start") - F.col("first"), F.lit(0)).cast("int").alias("from"),
        F.least(F.col("end") - F.col("first"), F.lit(BLOCK)).cast("int").alias("to"),
        F.when(F.col("start") >= F.col("first"), mask).otherwise("").alias("mask"),
    )
    by_block = each.groupBy("row", "block").agg(F.sort_array(F.collect_list(inside)).alias("cuts"))
    return by_block.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("block", "cuts"))).alias("cuts"))


def masked(text: Column, cuts_: Column) -> Column:
    """``text`` with its ``cuts`` made. Places are looked up within a block, so the time is in proportion to text and cuts."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def one(block: Column, number: Column) -> Column:
        own = F.element_at(cuts_, number.cast("long"))
        last = F.element_at(own, -1)["to"]

        def until(cut: Column, k: Column) -> Column:
            begin = F.when(k > 0, F.get(own, k - 1)["to"]).otherwise(0)
            return F.concat(F.substring(block, begin + 1, cut["from"] - begin), cut["mask"])

        return F.when(own.isNull(), block).otherwise(F.concat(F.array_join(F.transform(own, until), ""), F.substring(block, last + 1, F.lit(BLOCK))))

    return F.array_join(F.transform(blocks, one), "")


def redact(documents: DataFrame, reach: int = REACH, mask: str = MASK) -> DataFrame:
    """The documents, all their columns, with every reported span masked and ``n_chars``, where there is one, counted anew.

    A text is known by its id and two hashes, which a task that runs again finds the same; equal rows share their spans,
    rows without an id too. Null and empty texts pass as they are; an empty table gives none; columns may have any names.
    Only texts that some pattern may match are shuffled, where there are too many spans to send to every task.
    """
    names = documents.columns
    plain = documents.toDF(*(f"c{k}" for k in range(len(names))))
    at = f"c{names.index('text')}"
    ident, text = F.col(f"c{names.index('doc_id')}"), F.col(at)
    suspect = F.coalesce(reduce(or_, (k.guard(text) for k in KINDS)), F.lit(False))
    key = F.struct(ident.alias("id"), F.xxhash64(text).alias("hash"), F.xxhash64(F.lit(1), text).alias("other"))
    parts = parts_of(plain.where(suspect).select(key.alias("row"), ident.alias("doc_id"), text.alias("text")), KINDS).where("kind is not null")
    spans = linked(placed(parts.dropDuplicates(["row", "kind", "at"])), reach)
    found = stored(cuts(spans, mask).select(F.col("row.id").alias("__id"), F.col("row.hash").alias("__hash"), F.col("row.other").alias("__other"), "cuts"))
    same = ident.eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")) & (F.xxhash64(F.lit(1), text) == F.col("__other"))
    some = plain.where(suspect).join(found, same, "left")
    out = some.withColumn(at, F.when(F.col("cuts").isNotNull(), masked(text, F.col("cuts"))).otherwise(text))
    if "n_chars" in names:
        n = f"c{names.index('n_chars')}"
        out = out.withColumn(n, F.when(F.col("cuts").isNotNull(), F.length(text)).otherwise(F.col(n)).cast(plain.schema[n].dataType))
    return out.select(*plain.columns).unionByName(plain.where(~suspect)).toDF(*names)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("strong"), NAMES), 256).alias("base_sha256"),
        joined(F.col("found"), NAMES).alias("spans"), "n_linked",
    )
