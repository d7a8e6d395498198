"""Quality rules by compression bands.

zstandard compresses each whole text, and each of its fixed-size chunks by itself; the last chunk ends with the text. Repetitive text compresses far below what
prose of that length does and noise hardly at all, so a text is rejected when a ratio leaves the band for its length, or when too many
chunks leave the chunk band. Counting rules (length, repeated word windows) come first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import SPACE, arrow_map, table, utf8

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """``limits``: (least bytes, lowest ratio, highest ratio), rising; a text takes the last row that it reaches, none below the first.

    From 256 bytes on limits are fitted on texts labelled good that pass the counting rules, half of them (even crc32 of the id, sf0.1):
    the 0.5 % quantile of the ratio less 1 % (less 5 % from 16384 bytes on, where texts are few) and the 99.5 % quantile plus 5 %; chunks
    likewise. Shorter texts had no labels, and their limits aren't fitted. Fit anew for tables of other prose.

    ``chunk`` bytes a chunk (a shorter text is judged as a whole alone), ``chunk_limits`` its ratios, ``chunk_share`` of chunks outside that rejects."""

    limits: tuple[tuple[int, float, float], ...] = ((128, 0.30, 1.00), (256, 0.551, 0.750), (512, 0.510, 0.695), (1024, 0.475, 0.591), (2048, 0.451, 0.541), (4096, 0.425, 0.494), (8192, 0.413, 0.472), (16384, 0.393, 0.450))
    chunk: int = 4096
    chunk_limits: tuple[float, float] = (0.443, 0.500)
    chunk_share: float = 0.5
    level: int = 3
    least_words: int = 50
    most_repeated_percent: int = 50


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    v = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    if len(ids) == n:
        return 0
    if len(ids) < 1 << 21:
        key = v[:-2] << 42 | v[1:-1] << 21 | v[2:]
    else:  # wider than 63 bits: number the pairs first
        pair = np.unique(v[:-1] << 32 | v[1:], return_inverse=True)[1]
        key = pair[:-1] << 32 | v[2:]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.isin(key, twice)
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= at
    return int(covered.sum())


def measures(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()
    solid = raw.translate(None, SPACE)
    chars = len(solid) - int(((a := np.frombuffer(solid, np.uint8)) & 0xC0 == 0x80).sum()) if len(solid) else 0
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def ratios(raw: bytes, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple[float | None, int, int, bool]:
    """Ratio of the whole (None if empty), chunks, chunks outside their band, whether all bands hold."""
    if not raw:
        return None, 0, 0, True
    ratio, good = len(compressor.compress(raw)) / len(raw), True
    for least, low, high in reversed(bands.limits):
        if len(raw) >= least:
            good = low <= ratio <= high
            break
    starts = [*range(0, len(raw) - bands.chunk, bands.chunk), len(raw) - bands.chunk] if len(raw) >= bands.chunk else []
    low, high = bands.chunk_limits
    bad = sum(not low <= len(compressor.compress(raw[i : i + bands.chunk])) / bands.chunk <= high for i in starts)
    return ratio, len(starts), bad, good and not (bad and bad >= bands.chunk_share * len(starts))


def judge(docs: DataFrame, bands: Bands = Bands(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per document: measures, compression ratios and verdicts.

    Null and empty texts have no words: every count is 0, ``ratio`` is null, ``base_failed`` is true. Repeated rows give repeated
    results; other columns are not read, so their names cannot clash. An empty table gives an empty result. Python works on one
    batch of whole texts at a time; nothing is shuffled.
    """

    def function(batch: pa.RecordBatch) -> dict:
        compressor = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
        rows = [(*measures(raw), *ratios(raw, bands, compressor)) for raw in (x or b"" for x in utf8(batch, text))]
        columns = list(zip(*rows, strict=True))
        failed = [r[0] < bands.least_words or 100 * r[4] > bands.most_repeated_percent * r[0] for r in rows]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        out = {key: batch.column(key)} | {k: pa.array(columns[i], pa.int64()) for i, k in enumerate(names)}
        out |= {"base_failed": failed, "kept": [not f and r[8] for f, r in zip(failed, rows, strict=True)], "ratio": pa.array(columns[5], pa.float64())}
        return out | {"n_chunks": pa.array(columns[6], pa.int64()), "n_bad_chunks": pa.array(columns[7], pa.int64())}

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
    return arrow_map(docs.select(key, text), schema, function)


def op8_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts of every document."""
    return judge(table(spark, sf_dir, "documents"))
