"""Features, weights and draws against one text, one word and one byte at a time; the query against DuckDB."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featstab.llm import resample as R
from featstab.llm.queries import ORACLE_SQL, QUERIES

from .helpers import AWKWARD, DOCS, documents, write

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def features_of(text, s):
    w = words_of(text)
    return [zlib.crc32(b" ".join(w[i : i + k])) % s.buckets for k in range(1, s.longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, s):
    """{(key, text): (n_features, weight, score)} and the ranks."""
    corpus, wanted = ([b for t in texts for b in features_of(t, s)] for texts in ([t for _, t in docs], target))
    gain = [math.floor(s.scale * math.log((wanted.count(b) + 1) * (len(corpus) + s.buckets) / ((corpus.count(b) + 1) * (len(wanted) + s.buckets)))) for b in range(s.buckets)]
    rows = []
    for key, text in docs:
        f = features_of(text, s)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{s.seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(f), weight, weight + math.floor(-s.scale * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    enough = sorted((r for r in rows if r[5] >= s.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(enough[: len(enough) * s.percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def made(n, draw):
    parts = ["the", "The", "a1", "É", "漢字", "zebra", "x" * 70, "y" * 300, "\x00", "_", "-", "\n", "ﷺ", "Q9", " "]
    return [" ".join(draw.choice(parts) for _ in range(draw.randrange(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("longest", [1, 2, 3])
@pytest.mark.parametrize("together", [1, 200, 1 << 18])
def test_features_equal_single_checksums(monkeypatch, longest, together):
    monkeypatch.setattr(R, "TOGETHER", together)
    s = R.Settings(longest=longest, buckets=997)
    texts = [None, "", "word", "A", *made(60, random.Random(longest)), "no-break\xa0space", "q" * 5000]
    got = [[] for _ in texts]
    for a, b, words, bucket, row in R.features(pa.array(texts, pa.string()).slice(0), s):
        assert words.tolist() == [len(words_of(t)) for t in texts[a:b]]
        for x, i in zip(bucket.tolist(), row.tolist(), strict=True):
            got[a + i].append(x)
    assert [sorted(g) for g in got] == [sorted(features_of(t, s)) for t in texts]


def test_states_go_on_where_others_end():
    data = np.frombuffer(b"abcdefgh" * 40, np.uint8)
    start, length = np.array([0, 3, 5, 1]), np.array([0, 1, 300, 64])
    got = R.advanced(np.full(4, R.ALL_ONES), data, start, length) ^ R.ALL_ONES
    assert got.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(start, length, strict=True)]


@pytest.mark.parametrize("settings", [R.Settings(buckets=50, least_words=3, percent=30), R.Settings(longest=2, buckets=64, least_words=1, percent=100, seed=7)])
def test_resample_equals_brute_force(spark, settings):
    draw = random.Random(5)
    docs = [*((k, t) for k, t in enumerate(made(50, draw))), *((r[0], r[1]) for r in AWKWARD if len(r[1] or "") < 1000), (3, "same row here now"), (3, "same row here now")]
    target = ["the zebra", None, "", "A1 a1 the the"]
    clash = documents(spark, docs).withColumn("weight", F.lit("x")).withColumn("score", F.lit(1)).withColumn("rank", F.lit(1)).repartition(3)
    got = R.resample(clash, documents(spark, list(enumerate(target))), settings).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, target, settings)


def test_empty_tables_and_long_texts(spark):
    none, some = spark.createDataFrame([], DOCS), documents(spark, AWKWARD)
    assert R.resample(none, some).collect() == []
    rows = R.resample(some, none, R.Settings(percent=100)).collect()
    assert len(rows) == len(AWKWARD) and sum(r["rank"] is not None for r in rows) == 1


def test_query_equals_sql(spark, sf, tmp_path):
    awkward = write(spark, documents(spark, [*AWKWARD, (8, "many words " * 30), (9, "many words " * 30)]), tmp_path)
    write(spark, spark.createDataFrame([(1, "many fox words"), (2, None)], "item_id long, text string"), tmp_path, "benchmark")
    for folder, suffix in ((sf, ""), (awkward, "/*.parquet")):
        with duckdb.connect() as con:
            for name in ("documents", "benchmark"):
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet{suffix}')")
            want = con.execute(ORACLE_SQL["op11_byte_automaton"]).fetchall()
        got = QUERIES["op11_byte_automaton"](spark, folder)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
