"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, memory-mapped by workers.

1. Words are counted and dealt into buckets by hash; a bucket is a sorted array of word hashes with an array of counts. A word's id
   is its place in the buckets' order.
2. Bigrams of ids are counted within tasks, dealt into buckets by a hash of both words, so that no word's bigrams meet in one, and
   stored as sorted hashes with counts. Each bucket's part of what contexts and continuations need is summed by word bucket.
3. Workers map the arrays and look up the different words and bigrams of a whole run of texts, sorted, by binary search.

Counts travel as compressed, sorted runs that tasks have summed already, so a frequent word or pair is one entry per task. The number
of buckets follows from the size of the input and the number of tokens.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, fold, shared_dir, small_batches, table
from .files import OpenArrays, put_array
from .words import END, token_stream

#: Tokens that a task counts before it hands them on, and looks up at a time; bytes of input for a word bucket and bigram tokens for a
#: bigram bucket, about.
HELD, RUN, INPUT, BUCKET = 4_000_000, 400_000, 64 << 20, 2_000_000


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays, the first sorted, as one compressed blob."""
    out = [struct.pack("<I", len(arrays[0]))]
    for k, a in enumerate(arrays):
        a = np.diff(a.astype(np.uint64), prepend=np.uint64(0)) if k == 0 else a.astype(np.uint64)
        out.append(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<I", raw)[0]
    arrays = [np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, i).reshape(8, n).T).view("<u8").ravel() for i in range(4, len(raw), 8 * n)] if n else []
    return [np.cumsum(a, dtype=np.uint64) if k == 0 else a for k, a in enumerate(arrays)]


def summed(blobs: Iterable[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct keys of all blobs, and the sums of their ``width`` counts."""
    parts = [p for b in blobs if (p := unpack(b))]
    if not parts:
        return [np.empty(0, dtype=np.uint64)] * (1 + width)
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    return [keys[first], *(np.add.reduceat(np.concatenate([p[k + 1] for p in parts])[order], first) for k in range(width))]


def scattered(x: np.ndarray) -> np.ndarray:
    """A bijection; its upper bits depend on all others."""
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ x >> np.uint64(29)


def range_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are equal ranges of the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def runs(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of a sorted array."""
    edges = np.nonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))[0] if len(bucket) else np.zeros(1, dtype=np.int64)
    yield from zip(bucket[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def dealt(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Non-empty buckets and their part of the arrays, in the arrays' order."""
    small = bucket.astype(np.uint16) if len(bucket) and bucket.min() >= 0 and bucket.max() < 1 << 16 else bucket  # sorted faster
    order = np.argsort(small, kind="stable")
    for b, i, j in runs(bucket[order]):
        yield b, [x[order[i:j]] for x in arrays]


def discounts(counts: np.ndarray) -> np.ndarray:
    """D(0), D(1), D(2), D(3+) of the numbers of entries with count 1 to 4.

    Each is over 0 and at most its count, so every context keeps mass for words that it has not seen: where the estimate is outside
    (counts of counts of repetitive texts can be anything) the single discount n1 / (n1 + 2 n2) is taken, or a half if that is 0."""
    n = [float(x) for x in counts]
    single = n[0] / (n[0] + 2 * n[1]) if n[0] > 0 else 0.5
    out = [0.0]
    for k in (1, 2, 3):
        estimate = k - (k + 1) * single * n[k] / n[k - 1] if n[k - 1] > 0 else 0.0
        out.append(estimate if 0 < estimate <= k else single)
    return np.array(out)


@dataclass
class Model:
    """Where the arrays are, and the totals. ``offsets``: the first id of each word bucket, then the number of words."""

    path: str
    offsets: list[int]
    bigram_buckets: int
    n_tokens: int
    n_bigrams: int
    by_bigrams: list[int]  # bigrams seen 1 to 4 times
    by_words: list[int]  # words with 1 to 4 different words before them; then with 3 or more
    open: OpenArrays = field(default_factory=OpenArrays, repr=False)

    def array(self, name: str, bucket: int) -> np.ndarray:
        return self.open(f"{self.path}/{name}-{bucket:06d}.npy")

    @property
    def n_words(self) -> int:
        return self.offsets[-1]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted word hashes; -1 for words that training has not seen."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        for b, i, j in runs(range_bucket(hashes, len(self.offsets) - 1)):
            if self.offsets[b + 1] > self.offsets[b]:
                known = self.array("words", b)
                at = np.minimum(np.searchsorted(known, hashes[i:j]), len(known) - 1)
                out[i:j] = np.where(known[at] == hashes[i:j], at + self.offsets[b], -1)
        return out

    def of_ids(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Rows of a per-word array for sorted ids."""
        out = [self.array(name, b)[ids[i:j] - self.offsets[b]] for b, i, j in runs(np.searchsorted(np.array(self.offsets), ids, "right") - 1)]
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)

    def bigram_counts(self, keys: np.ndarray) -> np.ndarray:
        """How often training has seen each (u << 32 | v)."""
        hashes = scattered(keys)
        order = np.argsort(hashes)
        hashes, found = hashes[order], np.zeros(len(keys), dtype=np.int64)
        for b, i, j in runs(range_bucket(hashes, self.bigram_buckets)):
            known = self.array("bigrams", b)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[i:j]), len(known) - 1)
                found[i:j] = np.where(known[at] == hashes[i:j], self.array("times", b)[at], 0)
        out = np.empty_like(found)
        out[order] = found
        return out

    def of_words(self, hashes: np.ndarray) -> Words:
        """What scoring needs of sorted, different words."""
        d1, d2 = discounts(np.array(self.by_words[:4])), discounts(np.array(self.by_bigrams))
        ids = self.ids(hashes)
        known = ids >= 0
        free = (d1[1] * self.by_words[0] + d1[2] * self.by_words[1] + d1[3] * self.by_words[4]) / self.n_bigrams
        times, low, total, gamma = np.zeros(len(ids)), np.full(len(ids), free / (self.n_words + 1)), np.zeros(len(ids)), np.ones(len(ids))
        if known.any():
            own = ids[known]
            times[known] = self.of_ids("counts", own)
            continued, context = self.of_ids("continued", own).astype(np.int64), self.of_ids("contexts", own).astype(np.float64)
            low[known] += np.maximum(continued - d1[np.minimum(continued, 3)], 0) / self.n_bigrams
            total[known] = context[:, 0]
            gamma[known] = np.where(context[:, 0] > 0, context[:, 1:] @ d2[1:] / np.maximum(context[:, 0], 1), 1.0)
        return Words(ids, times, low, total, gamma)

    def measures(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known, log10 of the smoothed unigram and of the model's probability of each token behind the first, given the one before."""
        if not self.n_words:
            return np.zeros(len(hashes) - 1, dtype=np.int64), np.zeros(len(hashes) - 1), np.zeros(len(hashes) - 1)
        different, place = np.unique(hashes, return_inverse=True)
        w = self.of_words(different)
        base = np.log10((w.times + 0.1) / (self.n_tokens + 0.1 * (self.n_words + 1)))
        u, v = place[:-1], place[1:]
        p = w.low[v] * w.gamma[u]
        rows = np.nonzero((w.total[u] > 0) & (w.ids[v] >= 0))[0]
        u, v = u[rows], v[rows]
        keys = w.ids[u].astype(np.uint64) << np.uint64(32) | w.ids[v].astype(np.uint64)
        times, d2 = self.bigram_counts(keys), discounts(np.array(self.by_bigrams))
        p[rows] += np.maximum(times - d2[np.minimum(times, 3)], 0) / w.total[u]
        return (w.ids >= 0).astype(np.int64)[place[1:]], base[place[1:]], np.log10(p)


@dataclass
class Words:
    """Arrays over different words: id (-1: unknown), count, lower-order probability, times as a context, mass left to the lower order."""

    ids: np.ndarray
    times: np.ndarray
    low: np.ndarray
    total: np.ndarray
    gamma: np.ndarray


def token_runs(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, bool]]:
    """(batch, row, hash of the token before the first and of all, whether the batch ends) in runs of about RUN tokens."""
    before = END
    for batch in batches:
        rows, hashes, n = [], [np.array([before])], 0
        for r, h in token_stream(batch.column(text)):
            rows.append(r)
            hashes.append(h)
            n += len(h)
            if n >= RUN:
                yield batch, np.concatenate(rows), np.concatenate(hashes), False
                rows, hashes, n = [], [hashes[-1][-1:]], 0
        if batch.num_rows:
            yield batch, np.concatenate(rows) if rows else np.empty(0, dtype=np.int64), np.concatenate(hashes), True
            before = END


def _rows(found: Iterable[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for bucket, blob in found:
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "blob": pa.array([blob], pa.binary())})


def _reduced(rows: DataFrame, function: Callable[[int, list[bytes]], dict], schema: str) -> DataFrame:
    """``function`` of each bucket and its blobs; buckets have a bounded size."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(function(int(key[0]), group["blob"].tolist()))

    return rows.groupBy("bucket").applyInPandas(run, schema)


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count the texts of ``docs`` (all of them, whole) and store the model in the shared folder.

    Null and empty texts are an end alone. An empty table gives a model without words, for which every text has probability 1."""
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession, "lm")
    small_batches(spark)
    docs = docs.select(text)
    buckets = buckets_for(docs, INPUT)

    def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            hashes, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            yield from _rows((b, pack(hashes[i:j], times[i:j])) for b, i, j in runs(range_bucket(hashes, buckets)))

        for _, _, hashes, _ in token_runs(batches, text):
            held.append(hashes[1:])
            n += len(hashes) - 1
            if n >= HELD:
                yield from flush()
                n = 0
        if held:
            yield from flush()

    def store_words(bucket: int, blobs: list[bytes]) -> dict:
        hashes, times = summed(blobs, 1)
        put_array(f"{path}/words-{bucket:06d}.npy", hashes)
        put_array(f"{path}/counts-{bucket:06d}.npy", times.astype(np.uint64))
        return {"bucket": [bucket], "n": [len(hashes)], "total": [int(times.sum())]}

    rows = _reduced(docs.mapInArrow(count_words, "bucket long, blob binary"), store_words, "bucket long, n long, total long").collect()  # a row per bucket
    sizes = {r["bucket"]: r["n"] for r in rows}
    offsets = [0, *np.cumsum([sizes.get(b, 0) for b in range(buckets)]).tolist()]
    if offsets[-1] >= 1 << 32:
        raise ValueError("over 2**32 different words")
    n_tokens = sum(r["total"] for r in rows)
    model = Model(path, offsets, max(buckets, n_tokens // BUCKET), n_tokens, 0, [0] * 4, [0] * 5)
    if not n_tokens:
        return model

    def count_bigrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            yield from _rows((b, pack(*x)) for b, x in dealt(range_bucket(scattered(keys), model.bigram_buckets), keys, times))

        for _, _, hashes, _ in token_runs(batches, text):
            different, place = np.unique(hashes, return_inverse=True)
            ids = model.ids(different).astype(np.uint64)[place]
            held.append(ids[:-1] << np.uint64(32) | ids[1:])
            n += len(ids) - 1
            if n >= HELD:
                yield from flush()
                n = 0
        if held:
            yield from flush()

    edges = np.array(offsets)

    def store_bigrams(bucket: int, blobs: list[bytes]) -> dict:
        keys, times = summed(blobs, 1)
        hashes = scattered(keys)
        order = np.argsort(hashes)
        put_array(f"{path}/bigrams-{bucket:06d}.npy", hashes[order])
        put_array(f"{path}/times-{bucket:06d}.npy", times[order].astype(np.min_scalar_type(int(times.max()))))
        u, v = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out = []
        first = np.nonzero(np.concatenate([[True], u[1:] != u[:-1]]))[0]
        parts = [np.add.reduceat(x.astype(np.uint64), first) for x in (times, times == 1, times == 2, times >= 3)]
        for b, i, j in runs(np.searchsorted(edges, u[first], "right") - 1):
            out.append((b, b"c" + pack(u[first][i:j], *(x[i:j] for x in parts))))
        v, n = np.unique(v, return_counts=True)
        for b, i, j in runs(np.searchsorted(edges, v, "right") - 1):
            out.append((b, b"w" + pack(v[i:j], n[i:j])))
        out.append((-1, b"t" + struct.pack("<5q", len(keys), *(int((times == k).sum()) for k in range(1, 5)))))
        return {"bucket": [b for b, _ in out], "blob": [x for _, x in out]}

    def store_contexts(bucket: int, blobs: list[bytes]) -> dict:
        if bucket < 0:
            return {"kind": ["bigrams"], "n": [np.sum([struct.unpack("<5q", x[1:]) for x in blobs], axis=0).tolist()]}
        first, n = offsets[bucket], offsets[bucket + 1] - offsets[bucket]
        contexts, continued = np.zeros((n, 4), dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        ids, *parts = summed((x[1:] for x in blobs if x[:1] == b"c"), 4)
        contexts[ids.astype(np.int64) - first] = np.stack(parts, axis=1)
        ids, times = summed((x[1:] for x in blobs if x[:1] == b"w"), 1)
        continued[ids.astype(np.int64) - first] = times
        put_array(f"{path}/contexts-{bucket:06d}.npy", contexts)
        put_array(f"{path}/continued-{bucket:06d}.npy", continued)
        return {"kind": ["words"], "n": [[*(int((continued == k).sum()) for k in range(1, 5)), int((continued >= 3).sum())]]}

    pairs = _reduced(docs.mapInArrow(count_bigrams, "bucket long, blob binary"), store_bigrams, "bucket long, blob binary")
    found = _reduced(pairs, store_contexts, "kind string, n array<long>").groupBy("kind").agg(*(F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(5))).collect()
    by = {r["kind"]: [r[f"n{k}"] for k in range(5)] for r in found}
    model.n_bigrams, model.by_bigrams, model.by_words = by["bigrams"][0], by["bigrams"][1:], by["words"]
    missing = set(range(model.bigram_buckets)) - set(_stored(model))
    for b in missing:  # buckets that no bigram fell into
        put_array(f"{path}/bigrams-{b:06d}.npy", np.empty(0, dtype=np.uint64))
    return model


def _stored(model: Model) -> Iterator[int]:
    from pyarrow import fs

    from .files import of

    system, path = of(model.path)
    for f in system.get_file_info(fs.FileSelector(path)):
        if f.base_name.startswith("bigrams-") and f.base_name.endswith(".npy"):
            yield int(f.base_name[8:-4])


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", held_out: str | None = None) -> DataFrame:
    """A row per document: n_tokens, n_known, train_tokens, base_score (smoothed unigrams), score (log10 probability).

    Null and empty texts are an end alone. Repeated rows give repeated results; other columns are not read; an empty table gives an
    empty result. Texts are scored whole, a run of tokens at a time. ``held_out`` names a boolean column to carry."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = None, None
        for batch, rows, hashes, ended in token_runs(batches, text):
            if sums is None:
                sums, n = np.zeros((3, batch.num_rows)), np.zeros(batch.num_rows, dtype=np.int64)
            n += np.bincount(rows, minlength=len(n))
            for total, x in zip(sums, model.measures(hashes), strict=True):
                total += np.bincount(rows, weights=x, minlength=len(n))
            if ended:
                carried = {held_out: batch.column(held_out)} if held_out else {}
                yield pa.RecordBatch.from_pydict({key: batch.column(key)} | carried | {"n_tokens": n, "n_known": sums[0].astype(np.int64), "train_tokens": np.full(len(n), model.n_tokens), "base_score": sums[1], "score": sums[2]})
                sums = None

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + (f"`{held_out}` boolean, " if held_out else "") + "n_tokens long, n_known long, train_tokens long, base_score double, score double"
    small_batches(docs.sparkSession)
    return docs.select(key, text, *([held_out] if held_out else [])).mapInArrow(run, schema)


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document under a model of the nine folds that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 10) == 0).alias("held_out"))
    return score(docs, train(docs.where(~F.col("held_out"))), held_out="held_out")
