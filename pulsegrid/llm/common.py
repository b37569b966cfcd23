"""Plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Maps A-Z to a-z and leaves every other byte alone.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


PIECE_BYTES = 2_000_000
#: Of the filter that ``marked`` broadcasts: a million words.
MOST_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``.

    Only on one machine (a local master, as in tests) a temporary folder is set where neither that setting nor a
    checkpoint directory exists; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("a cluster must name a folder that driver and executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pulsegrid-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it from there, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``, as a Parquet table: Spark knows its size, so it can check whether a broadcast is small enough.

    Without the marker of success, which nobody reads: on a local file system the driver starts two processes to write it.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def marked(rows: DataFrame, value: Column, among: DataFrame) -> DataFrame:
    """``rows`` with ``__may``: true wherever ``value`` (a hash, not null) is one of ``among`` (one column, written), and for about one in 32 others.

    A Bloom filter with one bit a hash, broadcast as 64-bit words, so that of many rows only few have to be shuffled for an
    exact join. It has 32 bits for each row of ``among``, MOST_BITS at most; beyond that more of the others are true.
    """
    bits, wanted = 64, min(32 * among.count(), MOST_BITS)
    while bits < wanted:
        bits *= 2
    word = lambda h: F.shiftright(h.bitwiseAND(F.lit(bits - 1)), 6)
    held = among.toDF("__h").select(word(F.col("__h")).alias("__word"), F.expr("shiftleft(1L, int(__h & 63))").alias("__bit"))
    words = stored(held.groupBy("__word").agg(F.bit_or("__bit").alias("__bits")))
    joined = rows.withColumn("__h", value).join(F.broadcast(words), word(F.col("__h")) == F.col("__word"), "left")
    return joined.withColumn("__may", F.expr("coalesce(shiftrightunsigned(__bits, int(__h & 63)) & 1L, 0L) = 1L")).drop("__h", "__word", "__bits")


def hash_bound(most: int, n: int) -> int:
    """The 64-bit hash up to which about half as many again as ``most`` of ``n`` rows lie; the greatest where that is all."""
    return min((1 << 63) - 1, ((1 << 64) * (3 * most + 200)) // (2 * max(1, n)) - (1 << 63))


def drawn(rows: DataFrame, most: int, longest: int, characters: int, by: str | None = None, counts: dict[str, int] | None = None) -> DataFrame:
    """At most ``most`` rows of ``rows`` (text and others), for each value of ``by`` if given: those with the least hashes of the whole row.

    The bound holds whatever the ids are, nulls and repeats included. Texts of more than ``longest`` characters aren't
    drawn, and rows are taken in order of their hashes until their texts have ``characters`` in all. ``counts``: the
    rows of each value of ``by``; values that it lacks aren't drawn. By the counts a first cut leaves little to sort.
    """
    bound: Column = F.lit(hash_bound(most, 0))
    if counts:
        bound = F.element_at(F.create_map(*(F.lit(x) for value, n in counts.items() for x in (value, hash_bound(most, n)))), F.col(by))
    some = rows.withColumn("__draw", F.xxhash64(*rows.columns)).where((F.col("__draw") <= bound) & (F.length("text") <= longest))
    order = Window.partitionBy(by if by else F.lit(0)).orderBy("__draw")
    first = some.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= most)
    so_far = first.withColumn("__sum", F.sum(F.length("text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return so_far.where(F.col("__sum") <= characters).drop("__draw", "__at", "__sum")


def arrow_schema(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema, prefers_large_types=False)


def pieces(batch: pa.RecordBatch, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` cut after every ``most`` bytes of strings, so that what Python holds at once doesn't depend on how long texts are."""
    if batch.nbytes <= most or batch.num_rows < 2:
        yield batch
        return
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // most, prepend=0)).tolist()
    for first, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if end > first:
            yield batch.slice(first, end - first)


def python_list(column: pa.Array) -> list:
    """``to_pylist``, but a string's bytes that aren't UTF-8 become U+FFFD."""
    if not pa.types.is_string(column.type):
        return column.to_pylist()
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if v is None else v.decode("utf-8", "replace") for v in column.cast(pa.binary()).to_pylist()]


@cache
def trimmer() -> Callable[[int], int]:
    """The C library's ``malloc_trim``, or where it has none nothing."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return lambda pad: 0


def release() -> None:
    """Gives memory that this process has free back to the system."""
    pa.default_memory_pool().release_unused()
    trimmer()(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, but a worker gives free memory back to the system with each batch and at the end. It lives on after its task,
    and the allocators would keep what the largest batch of any stage took."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                release()

        try:
            yield from run(each())
        finally:
            release()

    return whole


def map_arrow(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Runs ``fn`` over pieces of Arrow batches as dicts of Python lists; it returns a dict of lists in the order of ``schema``."""
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                out = fn({name: python_list(part.column(i)) for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(released(run), schema)


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of batches with a binary column ``text``, and their texts; null counts as empty."""
    for batch in batches:
        for part in pieces(batch):
            yield part, [t or b"" for t in part.column(part.schema.names.index("text")).to_pylist()]


def binary_text(documents: DataFrame, *columns) -> DataFrame:
    return documents.select(*columns, F.col("text").cast("binary").alias("text"))


def remainder(modulus: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo ``modulus``: the fold of a document. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
