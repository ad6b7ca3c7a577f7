"""Quality rules by compression: zstandard ratios of whole documents and fixed chunks.

Chunks cover the whole text: the last one is aligned to its end and counts with the bytes it
adds. Texts shorter than a chunk are cut into short chunks.

Repetitive text compresses far better than prose, random text hardly at all. A ratio is
compressed size by size. Every length class has a band of ratios it may have, as short texts
compress less; whole documents and chunks have bands of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from airsift.llm.common import map_rows, texts

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Ratios allowed for texts of at least `from_bytes` (up to the next band)."""

    from_bytes: int
    low: float
    high: float


@dataclass(frozen=True)
class Bands:
    """Limits of the rule.

    `documents`: bands by length of the whole text. `chunk`: the band of chunks of
    `chunk_bytes`; `short`: that of the chunks of `short_bytes` that shorter texts are cut
    into. Each `high` lies between prose and base64. A text is rejected if more than
    `odd_share` of its bytes lie in chunks outside the band. Under `short_bytes` a text has
    no chunks.
    """

    documents: tuple[Band, ...] = (
        Band(0, 0.0, float("inf")),
        Band(128, 0.30, 1.10),
        Band(512, 0.28, 0.85),
        Band(2048, 0.25, 0.75),
        Band(8192, 0.20, 0.70),
    )
    chunk: Band = Band(2048, 0.25, 0.66)
    chunk_bytes: int = 2048
    short: Band = Band(512, 0.28, 0.76)
    short_bytes: int = 512
    odd_share: float = 0.25
    level: int = 3

    def of(self, size: int) -> Band:
        return [b for b in self.documents if size >= b.from_bytes][-1]


def compression(data: bytes, bands: Bands, packer) -> tuple[float, int, int, str]:
    """Ratio, chunks, chunks outside the band, and the reason to reject ('' for none)."""
    size = len(data)
    if not data:
        return 0.0, 0, 0, ""
    ratio = len(packer.compress(data)) / size
    short = size < bands.chunk_bytes
    step = bands.short_bytes if short else bands.chunk_bytes
    limits = bands.short if short else bands.chunk
    ends = list(range(step, size + 1, step))
    if ends and ends[-1] < size:
        ends.append(size)
    chunks, odd, odd_bytes, before = len(ends), 0, 0, 0
    for end in ends:
        part = len(packer.compress(data[end - step : end])) / step
        if not limits.low <= part <= limits.high:
            odd += 1
            odd_bytes += end - before
        before = end
    band = bands.of(len(data))
    if ratio < band.low:
        reason = "repetitive"
    elif ratio > band.high:
        reason = "incompressible"
    else:
        reason = "chunks" if odd_bytes > bands.odd_share * size else ""
    return ratio, chunks, odd, reason


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words inside windows of n words that occur twice or more, first ones included."""
    if len(words) <= n:
        return 0
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    code = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    window, distinct = code[: len(code) - n + 1], len(ids)
    for k in range(1, n):
        if distinct * len(ids) >= 1 << 62:
            found, window = np.unique(window, return_inverse=True)
            distinct = len(found)
        window = window * len(ids) + code[k : len(code) - n + 1 + k]
        distinct *= len(ids)
    _, at, count = np.unique(window, return_inverse=True, return_counts=True)
    starts = count[at] > 1
    covered = np.zeros(len(code), bool)
    for k in range(n):
        covered[k : len(starts) + k] |= starts
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(lines) - len(set(lines))


def measure(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode()
    words = data.split()
    # A code point is any byte but a continuation; words hold all but the separators.
    separators = len(data) - sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    return (
        len(words),
        len(text) - separators,
        symbols,
        duplicate_lines(text) if "\n" in text else 0,
        repeated_words(words),
    )


RESULT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, "
    "n_chunks bigint, n_odd_chunks bigint, reason string"
)


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    bands: Bands = Bands(),
    min_words: int = 50,
    repeat_percent: int = 50,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add the measures, `base_failed`, the compression figures and `kept` to every row.

    A null text counts as empty: no words, so it fails the base rule and is not kept. An
    empty text has ratio 0 and no chunks. Every text is read whole, repeated rows are judged
    one by one, and an input column with the name of a result column is replaced. An empty
    table gives an empty table. One narrow pass: no shuffle, memory of one Arrow batch.
    """

    def judge(batch: pa.RecordBatch) -> list:
        packer = zstandard.ZstdCompressor(level=bands.level)
        rows = []
        for value in texts(batch, text):
            found = measure(value)
            n_words, repeats = found[0], found[4]
            failed = n_words < min_words or 100 * repeats > repeat_percent * n_words
            figures = compression(value.encode(), bands, packer)
            rows.append((*found, failed, not failed and not figures[3], *figures))
        return list(zip(*rows, strict=True)) if rows else [[]] * 11

    return map_rows(docs, RESULT, judge, keep)
