"""Quality rules: plain counts, then bands on zstandard ratios.

The ratio is compressed size over raw UTF-8 size.  Repetitive text compresses too well, noise
too badly; how well clean text compresses depends on its length, so each length class has its own band (``BANDS``, for
whole texts, and ``CHUNK_BANDS``, for chunks of ``CHUNK`` bytes).  A text is rejected if its
whole ratio leaves its band, or if over ``BAD_SHARE`` of its bytes lie in chunks that leave theirs.

Cases: a null or blank text has zero counts, fails the base rules and has ratio null; texts of
any length are read whole; rows that repeat all stay; columns other than doc_id and text are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from treeline.llm.common import id_text, prepare

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
LEVEL = 3
CHUNK = 4096
BAD_SHARE = 0.5
#: (up to so many bytes, lowest ratio, highest ratio) for whole texts: percentiles 0.1 and 99.9 of the texts of sf0.1 and
#: check_s that pass the base rules, with a margin of about 0.02.  From 8 KB on the lowest is that of plain text of few word parts.
BANDS = (
    (64, 0.95, 1.23), (96, 0.745, 1.16), (128, 0.69, 1.11), (192, 0.36, 0.97), (256, 0.265, 0.88), (384, 0.275, 0.78), (512, 0.505, 0.75),
    (768, 0.46, 0.71), (1024, 0.445, 0.665), (1536, 0.42, 0.615), (2048, 0.395, 0.58), (3072, 0.385, 0.566), (4096, 0.37, 0.534), (6144, 0.355, 0.515),
    (8192, 0.345, 0.495), (12288, 0.27, 0.483), (16384, 0.27, 0.472), (32768, 0.27, 0.46), (65536, 0.27, 0.453), (1 << 62, 0.27, 0.43),
)
#: A text's last chunk is of any size, the others are whole.
CHUNK_BANDS = ((64, 0.00, 11.00), *BANDS[1:12], (1 << 62, 0.28, 0.52))
MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20


def in_band(size: int, ratio: float, bands) -> bool:
    low, high = next((lo, hi) for most, lo, hi in bands if size <= most)
    return low <= ratio <= high


def repeated_words(words: list[str], width: int = REPEAT_WINDOW) -> int:
    """Words inside windows of *width* words that the text holds twice or more."""
    windows = list(zip(*(words[k:] for k in range(width))))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    n = end = 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            n += at + width - max(at, end)
            end = at + width
    return n


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words)


def compression_verdict(raw: bytes, compress) -> tuple[float | None, float, bool]:
    """Whole ratio, share of bytes in chunks outside their band, and whether the text passes."""
    if not raw:
        return None, 0.0, False
    ratio = len(compress(raw)) / len(raw)
    if len(raw) <= CHUNK:
        return ratio, 0.0, in_band(len(raw), ratio, BANDS)
    bad = 0
    for at in range(0, len(raw), CHUNK):
        part = raw[at : at + CHUNK]
        if not in_band(len(part), len(compress(part)) / len(part), CHUNK_BANDS):
            bad += len(part)
    return ratio, bad / len(raw), in_band(len(raw), ratio, BANDS) and bad <= BAD_SHARE * len(raw)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_share double"


def quality(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of ``SCHEMA`` for each document."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = base_counts(text or "")
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
                ratio, bad, passes = compression_verdict((text or "").encode(), compress)
                rows.append((d, *counts, failed, passes and not failed, ratio, bad))
            types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)

    return id_text(docs).mapInArrow(run, SCHEMA)
