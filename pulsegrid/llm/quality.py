"""Quality rules: counted features of a text, and compression bands.

A text's zstandard ratio (bytes before / after) says how much it repeats itself. The whole text and its fixed chunks
each have a band that depends on their length, since short texts compress less: a ratio above the band means
repetition, one below means noise such as encoded data.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm.common import map_arrow, table

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5
WORDY_LINE = re.compile(r"[^\x20\x09-\x0D]")
ASCII_SPACE = " \t\n\v\f\r"


@dataclass(frozen=True)
class Bands:
    """From ``least`` bytes on, up to the next entry, a whole text's ratio lies between ``low`` and ``high``."""

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 2.5), (128, 0.85, 3.0), (256, 1.0, 3.0), (512, 1.2, 3.5), (1024, 1.36, 4.0),
        (2048, 1.5, 5.0), (4096, 1.6, 6.0), (8192, 1.6, 7.0), (32768, 1.6, 10.0),
    )
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (1.4, 5.0)
    bad_chunks: float = 0.25
    level: int = 3

    def limits(self, size: int) -> tuple[float, float]:
        return next((low, high) for least, low, high in reversed(self.whole) if size >= least)


@dataclass(frozen=True)
class Verdict:
    ratio: float
    bad_chunks: float
    within: bool


def compression(data: bytes, bands: Bands, compressor: zstandard.ZstdCompressor) -> Verdict:
    """An empty text has no ratio (0) and lies within any band. ``bad_chunks`` is the share of the bytes in bad chunks;
    a last chunk shorter than the others is judged by the whole text's band for its length."""
    if not data:
        return Verdict(0.0, 0.0, True)
    ratio = len(data) / len(compressor.compress(data))
    bad = 0
    for k in range(0, len(data), bands.chunk_bytes):
        part = data[k : k + bands.chunk_bytes]
        low, high = bands.chunk if len(part) == bands.chunk_bytes else bands.limits(len(part))
        bad += 0 if low <= len(part) / len(compressor.compress(part)) <= high else len(part)
    bad /= len(data)
    low, high = bands.limits(len(data))
    return Verdict(ratio, bad, low <= ratio <= high and bad <= bands.bad_chunks)


def repeated_words(words: list, width: int = REPEAT_WINDOW) -> int:
    """Words inside a window of ``width`` words that occurs more than once."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, end = 0, 0
    for k, w in enumerate(windows):
        if times[w] > 1:
            covered += k + width - max(k, end)
            end = k + width
    return covered


def repeated_lines(text: str) -> int:
    """Lines that have a word and equal an earlier line."""
    lines = [line for line in text.split("\n") if WORDY_LINE.search(line)]
    return len(lines) - len(set(lines))


def judge(documents: DataFrame, bands: Bands | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, bad_chunks,
    base_failed, kept.

    Null text counts as empty; an empty text has no words and so fails the base rules. Repeated rows give equal rows;
    an empty table gives none; columns other than doc_id and text are ignored. Nothing is shuffled.
    """
    bands = bands or Bands()
    symbols = re.compile(f"[{re.escape(SYMBOLS)}]+")

    def run(batch: dict) -> dict:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        rows = []
        for text in batch["text"]:
            text = text or ""
            data = text.encode()
            words = data.split()
            repeats = repeated_words(words)
            found = compression(data, bands, compressor)
            failed = len(words) < 10 or 100 * repeats > 20 * len(words)
            chars = len(text) - sum(map(text.count, ASCII_SPACE))
            rows.append((len(words), chars, sum(map(len, symbols.findall(text))), repeated_lines(text), repeats, found.ratio, found.bad_chunks, failed, not failed and found.within))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "bad_chunks", "base_failed", "kept")
        return {"doc_id": batch["doc_id"], **{n: [r[k] for r in rows] for k, n in enumerate(names)}}

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_chunks double, base_failed boolean, kept boolean"
    return map_arrow(documents.select("doc_id", "text"), run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
