"""Importance resampling towards a target distribution, over hashed features read by a vectorised byte automaton.

The bytes of many texts are classified at once with a lookup table, words begin and end where the class changes, and one step of a
table-driven CRC advances the checksums of all words by a byte each, the longest words going on last; a run of several words goes on
from the run that is a word shorter. Bucket counts are summed within a task before they are shuffled, so what moves is bounded by tasks
times buckets. A document's weight is the floored mean of its features' log ratios of target to corpus; keyed Gumbel noise turns the
highest scores into a draw without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featstab.functions.prefix import running

from .common import keep, small_batches, table
from .words import _flat as flat

#: Bytes of texts that are looked at together (a longer text by itself), and from which length on a word's checksum is ended by zlib.
TOGETHER, WIDE = 1 << 18, 64
#: Reversed polynomial of CRC-32, and what eight steps of it make of each byte.
POLYNOMIAL, ALL_ONES = np.uint32(0xEDB88320), np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), t >> np.uint32(1) ^ POLYNOMIAL, t >> np.uint32(1))
    return t


CRC = _crc_table()
#: Byte to itself, A-Z to a-z; byte to whether words hold it: digits, letters and every byte beyond ASCII.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
SOLID = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


@dataclass(frozen=True)
class Settings:
    """Runs of 1 to ``longest`` words are features, in ``buckets``; documents of ``least_words`` or more take part, ``percent`` of
    them are drawn with noise keyed by ``seed``; log ratios and noise are counted in 1/``scale``."""

    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024
    scale: int = 1000


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of the words of texts data[offsets[i]:offsets[i + 1]], and how many begin before each offset."""
    solid = SOLID[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]  # texts that meet don't share a word
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start = np.nonzero(begins)[0]
    return start, np.nonzero(ends)[0] + 1 - start, np.searchsorted(start, offsets)


def advanced(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC states after the bytes data[start:start + length] of each, all states a byte a step."""
    order = np.argsort(-length, kind="stable")
    s, own, rising = start[order], state[order], length[order][::-1]
    for k in range(min(WIDE, int(rising[-1]) if len(rising) else 0)):
        m = len(rising) - int(np.searchsorted(rising, k, "right"))
        now = own[:m]
        own[:m] = CRC[(now ^ data[s[:m] + k]) & np.uint32(255)] ^ now >> np.uint32(8)
    for i in range(len(rising) - int(np.searchsorted(rising, WIDE, "right"))):
        a, n = int(s[i]), int(rising[len(rising) - 1 - i])
        own[i] = np.uint32(zlib.crc32(data[a + WIDE : a + n], int(own[i] ^ ALL_ONES))) ^ ALL_ONES
    out = np.empty_like(own)
    out[order] = own
    return out


def features(column: pa.Array, settings: Settings) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, words of each row, bucket of each feature, row of each feature from the first) of a few texts at a time."""
    data, offsets = flat(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        behind = max(row + 1, int(np.searchsorted(offsets, offsets[row] + TOGETHER, "right")) - 1)
        own = LOWER[data[offsets[row] : offsets[behind]]]
        start, length, first = word_spans(own, offsets[row : behind + 1] - offsets[row])
        words = np.diff(first)
        text = np.repeat(np.arange(behind - row), words)
        state = np.full(len(start), ALL_ONES)
        begun, buckets, rows = np.arange(len(start)), [], []  # the words with which runs of k + 1 words begin
        for k in range(settings.longest):
            if k:  # runs that do not end with their text go on with a blank and a word
                goes_on = begun + k < first[1:][text[begun]]
                begun, state = begun[goes_on], state[goes_on]
                state = CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ state >> np.uint32(8)
            state = advanced(state, own, start[begun + k], length[begun + k])
            buckets.append((state ^ ALL_ONES).astype(np.int64) % settings.buckets)
            rows.append(text[begun])
        yield row, behind, words, np.concatenate(buckets), np.concatenate(rows)
        row = behind


def bucket_counts(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """bucket, n: features of all texts in each bucket that has any. Null texts have none. A task sends at most a row a bucket."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(settings.buckets, dtype=np.int64)
        for batch in batches:
            for _, _, _, bucket, _ in features(batch.column(0), settings):
                n += np.bincount(bucket, minlength=settings.buckets)
        some = np.nonzero(n)[0]
        if len(some):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(some), "n": pa.array(n[some])})

    return docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """bucket, corpus_n, target_n, gain of every bucket; ``corpus`` and ``target`` are what bucket_counts() gives."""
    every = corpus.sparkSession.range(settings.buckets).withColumnRenamed("id", "bucket")
    both = corpus.select("bucket", F.col("n").alias("corpus_n"), F.lit(0).cast("long").alias("target_n")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("corpus_n"), F.col("n").alias("target_n")))
    both = both.unionByName(every.select("bucket", F.lit(0).cast("long").alias("corpus_n"), F.lit(0).cast("long").alias("target_n"))).groupBy("bucket").agg(F.sum("corpus_n").alias("corpus_n"), F.sum("target_n").alias("target_n"))
    all_of = [x.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).first()[0] for x in (corpus, target)]
    ratio = (F.col("target_n") + 1.0) * F.lit(all_of[0] + settings.buckets) / ((F.col("corpus_n") + 1.0) * F.lit(all_of[1] + settings.buckets))
    return both.withColumn("gain", F.floor(settings.scale * F.log(ratio)).cast("long"))


def weighed(docs: DataFrame, gain: np.ndarray, settings: Settings = Settings(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key, n_words, n_features and weight of every row; ``gain`` has one entry a bucket."""
    small_batches(docs.sparkSession)
    gain = np.asarray(gain, dtype=np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n, total = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for a, b, w, bucket, row in features(batch.column(text), settings):
                words[a:b], n[a:b] = w, np.bincount(row, minlength=b - a)
                order = np.argsort(row, kind="stable")
                through = np.append(0, np.cumsum(gain[bucket[order]]))
                ends = np.cumsum(n[a:b])
                total[a:b] = through[ends] - through[ends - n[a:b]]
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({key: batch.column(key), "n_words": pa.array(words), "n_features": pa.array(n), "weight": pa.array(total // np.maximum(n, 1))})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, n_features long, weight long")


def noise(key: str, settings: Settings) -> Column:
    """Gumbel noise of a key, floored: the first 8 hexadecimal digits of the SHA-256 of seed and key; a null key is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    return F.floor(-float(settings.scale) * F.log(-F.log(uniform))).cast("long")


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), text: str = "text", key: str = "doc_id", target_text: str = "text") -> DataFrame:
    """A row per document: key, n_features, weight, score and, for the drawn, rank (1 is the highest score; else null).

    Null and empty texts and texts without words have no features and weight 0. Documents under ``least_words`` words get a score and no
    rank. Ties in score go to the smaller key, null last, then to fewer features and the smaller weight; rows equal in all of these have
    the ranks that follow each other. An empty table gives an empty result, an empty target leaves weights that favour rare features.
    Other columns are not read, so their names cannot clash. Texts are read twice, once to count, once to weigh; what is gathered from
    them is a row a bucket. Weights are written to the shared folder; ranks come from a range sort of those small rows, partition by
    partition, and no task sees more than its range. Memory is a batch of texts, or some thirty bytes for each byte of the longest text."""
    counted = [keep(bucket_counts(*x), "buckets") for x in ((docs, settings, text), (target, settings, target_text))]
    found = gains(*counted, settings)
    gain = np.zeros(settings.buckets, dtype=np.int64)
    for r in found.select("bucket", "gain").collect():  # a row a bucket, whatever the input
        gain[r["bucket"]] = r["gain"]
    rows = keep(weighed(docs, gain, settings, text, key).withColumn("score", F.col("weight") + noise(key, settings)), "weights")
    enough = F.col("n_words") >= settings.least_words
    drawn = rows.where(enough).count() * settings.percent // 100
    ranked = running(rows.where(enough), [F.desc("score"), F.asc_nulls_last(key), F.asc("n_features"), F.asc("weight")], position="rank")
    rest = rows.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest).select(key, "n_features", "weight", "score", "rank")


def op11_byte_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's texts."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH bytes AS (SELECT range AS b, list_reduce(range(8), lambda acc, i: CASE WHEN acc % 2 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END, range) AS v FROM range(256)),
crc AS (SELECT list(v ORDER BY b) AS t FROM bytes),
texts AS (
  SELECT 'd' AS kind, doc_id, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT 't', NULL, row_number() OVER (), text FROM benchmark),
words AS (SELECT kind, doc_id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (SELECT kind, r, unnest(w) AS f FROM words),
hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(1, (length(h) // 2 + 1)::BIGINT), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT), lambda acc, b: xor(t[(xor(acc, b) & 255) + 1], acc >> 8), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)), crc),
counted AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 't') AS t FROM features JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM counted),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM counted, totals),
weights AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (r) WHERE kind = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n_all FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n_all // 100 THEN place END AS rank FROM ranked
"""
