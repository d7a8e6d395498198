"""Removal of long repeated byte strings, exact, over a run-compressed Burrows-Wheeler index.

Every string of ``length`` bytes contains an anchor that its content alone decides: the k-gram of least hash in it. The strings of a
text that share an anchor's place form a segment. Equal strings lie in segments of equal anchors, so:

1. segments are counted by (anchor, content), summed within tasks first, and dealt by a hash of both;
2. a segment seen twice repeats wholly. Anchors with several contents need a closer look: their distinct segments, dealt by anchor,
   become a run-length index (BWT runs with the suffix array sampled at run ends), from which matching statistics are streamed;
   starts of matches of ``length`` or more are stored. An anchor of very many contents is not dealt to one task: the strings of its
   segments are counted by hash over all buckets, which is exact as well;
3. texts are read again, look up their segments in the stored, memory-mapped arrays, and drop what is covered.

No text is shuffled but the distinct segments of step 2; nothing is collected but a row per bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, buckets_for, shared_dir, small_batches, table, utf8
from .files import OpenArrays, put_array
from .lm import dealt, pack, scattered, unpack

#: Bytes of the k-grams that can be anchors; positions taken at a time; contents from which on an anchor counts as frequent;
#: bytes of distinct segments in an index, about; entries that a task holds before it hands them on; bytes
#: of input for a bucket of segments, about.
GRAM, STRETCH, FREQUENT, INDEX, HELD, INPUT = 24, 1 << 20, 1024, 1 << 20, 500_000, 32 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64((1 << 24) - 1)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return scattered(scattered(a) + b * PRIME)


def segments(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, start, end) of the segments of a text: all strings of ``length`` with one anchor, as one stretch."""
    found = []
    for base in range(0, max(0, len(raw) - length + 1), STRETCH):
        found.append([base, *_stretch(raw[base : base + STRETCH + length - 1], length)])
    if not found:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate([f[1] for f in found]), np.concatenate([f[0] + f[2] for f in found]), np.concatenate([f[0] + f[3] for f in found])


def _stretch(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        h = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
        power, by = PRIME, {1: h}
        for k in (1, 2, 4, 8):
            h = h[:-k] * power + h[k:]
            power, by[2 * k] = power * power, h
        n = len(raw) - GRAM + 1
        gram = scattered(by[16][:n] * PRIME ** np.uint64(8) + by[8][16 : 16 + n])
    least, span, width = gram & ~LOW | np.arange(n, dtype=np.uint64), 1, length - GRAM + 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if width > span:
        least = np.minimum(least[: span - width], least[width - span :])
    own = (least & LOW).astype(np.int64)
    first = np.nonzero(np.concatenate([[True], own[1:] != own[:-1]]))[0]
    return gram[own[first]], first, np.append(first[1:], len(own)) - 1 + length


def contents(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    digest, view = xxhash.xxh3_64_intdigest, memoryview(raw)
    return np.fromiter((digest(view[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), dtype=np.uint64, count=len(start))


def strings(raw: bytes, start: int, end: int, length: int) -> np.ndarray:
    """Hashes of all strings of ``length`` in a stretch."""
    digest, view = xxhash.xxh3_64_intdigest, memoryview(raw)
    return np.fromiter((digest(view[i : i + length]) for i in range(start, end - length + 1)), dtype=np.uint64, count=end - start - length + 1)


@dataclass
class RunIndex:
    """A run-compressed Burrows-Wheeler transform of texts, with the suffix array at both ends of each run.

    Each text ends in a separator of its own, smaller than any byte and than later separators; a separator is never part of a run.
    ``symbol``, ``length``: the transform itself, run by run; ``head``, ``tail``: text positions sampled at the first and last row of
    each run; ``before``, ``after``: lengths of the match with the row above the head and below the tail."""

    n: int
    symbol: np.ndarray
    length: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    before: np.ndarray
    after: np.ndarray

    @classmethod
    def build(cls, texts: list[bytes]) -> RunIndex:
        n = sum(len(t) + 1 for t in texts)
        symbol = np.zeros(n, dtype=np.uint64)
        ends = np.cumsum([len(t) + 1 for t in texts])
        inside = np.ones(n, dtype=bool)
        inside[ends - 1] = False
        symbol[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
        left = np.repeat(ends, np.diff(ends, prepend=0)) - 1 - np.arange(n)  # bytes up to the separator

        def shifted(x: np.ndarray, by: int) -> np.ndarray:
            out = np.zeros_like(x)
            out[: n - by] = np.where(left[: n - by] >= by, x[by:], 0) if by < n else 0
            return out

        two = symbol << np.uint64(9) | shifted(symbol, 1)
        four = two << np.uint64(18) | shifted(two, 2)
        seven = four << np.uint64(27) | shifted(two, 4) << np.uint64(9) | shifted(symbol, 6)
        order = np.argsort(seven)
        rank, depth, longest = cls._ranks(seven, order), 7, int(np.diff(ends, prepend=0).max())
        while depth < longest and int(rank.max()) < n - 1:
            if n < 1 << 21:  # three ranks fit a key
                more = rank + np.uint64(1)
                key, depth = rank << np.uint64(42) | shifted(more, depth) << np.uint64(21) | shifted(more, 2 * depth), 3 * depth
            else:
                key, depth = rank << np.uint64(32) | shifted(rank + np.uint64(1), depth), 2 * depth
            order = np.argsort(key)
            rank = cls._ranks(key, order)
        order = np.argsort(rank << np.uint64(32) | np.arange(n, dtype=np.uint64))  # what is left equal ends in different separators
        last = np.where(order > 0, symbol[order - 1], 0)
        breaks = np.concatenate([[True], (last[1:] != last[:-1]) | (last[1:] == 0)])
        heads = np.nonzero(breaks)[0]
        tails = np.append(heads[1:], n) - 1
        lcp = cls._matches(seven, left, order[heads[1:] - 1], order[heads[1:]])
        return cls(n, last[heads], np.diff(np.append(heads, n)), order[heads], order[tails], np.append(0, lcp), np.append(lcp, 0))

    @staticmethod
    def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
        by = key[order]
        rank = np.empty(len(key), dtype=np.uint64)
        rank[order] = np.concatenate([[0], np.cumsum(by[1:] != by[:-1])]).astype(np.uint64)
        return rank

    @staticmethod
    def _matches(seven: np.ndarray, left: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at x and y, seven bytes at a time."""
        most, out = np.minimum(left[x], left[y]), np.zeros(len(x), dtype=np.int64)
        rows, at = np.arange(len(x)), 0
        while len(rows):
            differ = seven[x[rows] + at] ^ seven[y[rows] + at]
            width = np.zeros(len(rows), dtype=np.int64)  # bits of the difference
            for bit in (32, 16, 8, 4, 2, 1):
                big = differ >> np.uint64(bit) > 0
                width[big] += bit
                differ = np.where(big, differ >> np.uint64(bit), differ)
            width += differ > 0
            out[rows] = np.minimum(at + (63 - width) // 9, most[rows])
            at += 7
            rows = rows[(width == 0) & (most[rows] > at)]
        return out

    def occurrences(self, pattern: bytes) -> int:
        """How often the texts hold a pattern: backward search over the runs, without the texts."""
        start, totals = np.cumsum(np.append(0, self.length)), np.zeros(258, dtype=np.int64)
        np.add.at(totals, self.symbol.astype(np.int64) + 1, self.length)
        smaller, low, high = np.cumsum(totals), 0, self.n

        def rank(symbol: int, row: int, own: np.ndarray, before: np.ndarray) -> int:
            run = int(np.searchsorted(own, np.searchsorted(start, row, "right") - 1))  # runs of the symbol before the row's run
            inside = row - int(start[own[run]]) if run < len(own) and start[own[run]] < row else 0
            return int(before[run]) + inside

        for byte in reversed(pattern):
            own = np.nonzero(self.symbol == byte + 1)[0]
            before = np.cumsum(np.append(0, self.length[own]))
            low, high = (int(smaller[byte + 1]) + rank(byte + 1, x, own, before) for x in (low, high))
            if low >= high:
                return 0
        return high - low

    def matching(self) -> np.ndarray:
        """For each text position the length of its longest match elsewhere in the texts, streamed from the run ends.

        Within a run the match with a neighbouring row shrinks by one with each step to the right."""

        def stream(at: np.ndarray, length: np.ndarray) -> np.ndarray:
            place = np.full(self.n, -1, dtype=np.int64)
            place[at] = at
            np.maximum.accumulate(place, out=place)
            value = np.zeros(self.n, dtype=np.int64)
            value[at] = length
            return np.where(place >= 0, value[place] - (np.arange(self.n) - place), 0)

        return np.maximum(np.maximum(stream(self.head, self.before), stream(self.tail, self.after)), 0)


@dataclass
class Stored:
    """Sorted arrays in the shared folder, by name and bucket."""

    path: str
    buckets: int
    index_buckets: int = 0
    held: dict[str, set[int]] = field(default_factory=dict)
    open: OpenArrays = field(default_factory=OpenArrays, repr=False)

    def put(self, name: str, bucket: int, *arrays: np.ndarray) -> None:
        for k, a in enumerate(arrays):
            put_array(f"{self.path}/{name}-{bucket:06d}-{k}.npy", a)

    def array(self, name: str, bucket: int, k: int = 0) -> np.ndarray:
        return self.open(f"{self.path}/{name}-{bucket:06d}-{k}.npy")

    def found(self, name: str, keys: np.ndarray, buckets: int) -> np.ndarray:
        """Where the keys are in their bucket's array, -1 if they aren't."""
        out, there = np.full(len(keys), -1, dtype=np.int64), self.held.get(name, set())
        for b, (rows, k) in dealt(bucket_of(keys, buckets), np.arange(len(keys)), keys):
            if b in there:
                known = self.array(name, b)
                at = np.minimum(np.searchsorted(known, k), len(known) - 1)
                out[rows] = np.where(known[at] == k, at, -1)
        return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (scattered(keys) % np.uint64(buckets)).astype(np.int64)


def _row(kind: int, bucket: int, blob: bytes, anchor: int = 0, key: int = 0) -> tuple:
    return kind, bucket, anchor, key, blob


SCHEMA = "kind int, bucket long, anchor long, key long, blob binary"
TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
SEGMENT, PART, FULL_PART, STRING = 0, 1, 2, 3


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=["kind", "bucket", "anchor", "key", "blob"])


def signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _joined(blobs: Iterable[bytes]) -> list[np.ndarray]:
    """The arrays of all blobs one after the other, in the order of their first array."""
    parts = [p for b in blobs if (p := unpack(b))]
    order = np.argsort(np.concatenate([p[0] for p in parts]))
    return [np.concatenate([p[k] for p in parts])[order] for k in range(len(parts[0]))]


def _starts(x: np.ndarray) -> np.ndarray:
    return np.nonzero(np.concatenate([[True], x[1:] != x[:-1]]))[0]


def index(docs: DataFrame, length: int = 200, text: str = "text") -> Stored:
    """Count the segments of ``docs`` and store which repeat, and where the others match elsewhere."""
    if length < GRAM:
        raise ValueError(f"length is under {GRAM}")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(text)
    stored = Stored(shared_dir(spark, "repeats"), buckets_for(docs, INPUT))
    buckets = stored.buckets

    def count_segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, anchor, size = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(key)
            key, anchor, size = key[order], anchor[order], size[order]
            first = _starts(key)
            times = np.diff(np.append(first, len(key)))
            yield _batch([_row(SEGMENT, b, pack(*x)) for b, x in dealt(bucket_of(key[first], buckets), key[first], anchor[first], size[first], times)])

        for batch in batches:
            for raw in utf8(batch, text):
                anchor, start, end = segments(raw or b"", length)
                if len(anchor):
                    held.append((mixed(anchor, contents(raw, start, end)), anchor, end - start))
                    n += len(anchor)
            if n >= HELD:
                yield from flush()
                n = 0
        if held:
            yield from flush()

    def store_full(pair: tuple, group: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pair[0])
        key, anchor, size, times = _joined(group["blob"])
        first = _starts(key)
        total = np.add.reduceat(times, first)
        full = key[first][total > 1]
        if len(full):
            stored.put("full", bucket, full)
        anchor, size = anchor[first], size[first]
        order = np.argsort(anchor)
        anchor, size = anchor[order], size[order]
        first = _starts(anchor)
        parts = np.diff(np.append(first, len(anchor))), np.add.reduceat(size, first)
        rows = [_row(PART, b, pack(*x)) for b, x in dealt(bucket_of(anchor[first], buckets), anchor[first], *parts)]
        return pd.DataFrame([*rows, _row(FULL_PART, bucket, str(len(full)).encode())], columns=["kind", "bucket", "anchor", "key", "blob"])

    def store_anchors(pair: tuple, group: pd.DataFrame) -> pd.DataFrame:
        kind, bucket = (int(x) for x in pair)
        if kind == FULL_PART:
            return pd.DataFrame({"name": ["full"], "bucket": [bucket], "n": [int(group["blob"].iloc[0])], "size": [0]})
        anchor, n, size = _joined(group["blob"])
        first = _starts(anchor)
        anchor, n, size = anchor[first], np.add.reduceat(n, first), np.add.reduceat(size, first)
        many = n > 1
        if many.any():
            stored.put("anchors", bucket, anchor[many], n[many] > FREQUENT)
        rare = many & (n <= FREQUENT)
        return pd.DataFrame({"name": ["anchors"], "bucket": [bucket], "n": [int(many.sum())], "size": [int(size[rare].sum())]})

    counted = docs.mapInArrow(count_segments, SCHEMA).groupBy("bucket").applyInPandas(store_full, SCHEMA)
    rows = counted.groupBy("kind", "bucket").applyInPandas(store_anchors, "name string, bucket long, n long, size long").collect()  # two rows per bucket
    for name in ("full", "anchors"):
        stored.held[name] = {r["bucket"] for r in rows if r["name"] == name and r["n"]}
    stored.index_buckets = max(buckets, sum(r["size"] for r in rows) // INDEX)

    def spread_segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            key, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            yield _batch([_row(STRING, b, pack(*x)) for b, x in dealt(bucket_of(key, buckets), key, times)])

        for batch in batches:
            rows = []
            for raw, anchor, start, end, key, state in states(utf8(batch, text), stored, length):
                for i in np.nonzero(state >= EDGE)[0].tolist():
                    if state[i] & REPEATED:  # one copy of a repeated segment per task is enough
                        if int(key[i]) in seen:
                            continue
                        if len(seen) >= HELD:
                            seen.clear()
                        seen.add(int(key[i]))
                    if state[i] & OFTEN:
                        held += [strings(raw, start[i], end[i], length)] * (2 if state[i] & REPEATED else 1)
                    else:
                        b = int(bucket_of(anchor[i : i + 1], stored.index_buckets)[0])
                        rows.append(_row(PART if not state[i] & REPEATED else FULL_PART, b, raw[start[i] : end[i]], *signed(np.array([anchor[i], key[i]]))))
            if rows:
                yield _batch(rows)
            if sum(map(len, held)) >= HELD:
                yield from flush()
        if held:
            yield from flush()

    def store_marks(pair: tuple, group: pd.DataFrame) -> pd.DataFrame:
        strings_only, bucket = int(pair[0]), int(pair[1])
        if strings_only:
            key, times = _joined(group["blob"])
            first = _starts(key)
            key = key[first][np.add.reduceat(times, first) > 1]
            if len(key):
                stored.put("strings", bucket, key)
            return pd.DataFrame({"name": ["strings"], "bucket": [bucket], "n": [len(key)]})
        group = group.drop_duplicates("key").sort_values("key")
        texts, edge = group["blob"].tolist(), (group["kind"] == PART).tolist()
        long = RunIndex.build(texts).matching() >= length
        keys, low, high, at = [], [], [], 0
        for key, raw, own in zip(group["key"].to_numpy().view(np.uint64), texts, edge, strict=True):
            if own:
                change = np.diff(np.concatenate([[False], long[at : at + len(raw)], [False]]).astype(np.int8))
                up, down = np.nonzero(change == 1)[0], np.nonzero(change == -1)[0]
                keys += [key] * len(up)
                low += up.tolist()
                high += (down - 1 + length).tolist()
            at += len(raw) + 1
        if keys:
            order = np.argsort(np.array(keys, dtype=np.uint64), kind="stable")
            stored.put("marks", bucket, np.array(keys, dtype=np.uint64)[order], np.array(low)[order], np.array(high)[order])
        return pd.DataFrame({"name": ["marks"], "bucket": [bucket], "n": [len(keys)]})

    spread = docs.mapInArrow(spread_segments, SCHEMA)
    grouped = spread.groupBy((F.col("kind") == STRING).cast("int").alias("strings"), "bucket")
    rows = grouped.applyInPandas(store_marks, "name string, bucket long, n long").collect()  # a row per bucket
    for name in ("strings", "marks"):
        stored.held[name] = {r["bucket"] for r in rows if r["name"] == name and r["n"]}
    return stored


#: Bits of a segment's state: its content repeats; its anchor has other contents; very many of them.
REPEATED, EDGE, OFTEN = 1, 2, 4


def states(raws: list[bytes | None], stored: Stored, length: int) -> list[tuple]:
    """(text, anchor, start, end, key, state) of each text with segments, looked up for all texts at once."""
    found = []
    for raw in raws:
        anchor, start, end = segments(raw or b"", length)
        found.append((raw or b"", anchor, start, end, mixed(anchor, contents(raw, start, end)) if len(anchor) else anchor))
    if not found:
        return []
    anchor, key = np.concatenate([f[1] for f in found]), np.concatenate([f[4] for f in found])
    state = np.where(stored.found("full", key, stored.buckets) >= 0, REPEATED, 0)
    at = stored.found("anchors", anchor, stored.buckets)
    rows = np.nonzero(at >= 0)[0]
    state[rows] |= EDGE
    for b, (r,) in dealt(bucket_of(anchor[rows], stored.buckets), rows):
        state[r] |= np.where(stored.array("anchors", b, 1)[at[r]], OFTEN, 0)
    ends = np.cumsum([len(f[1]) for f in found])
    return [(*f, state[e - len(f[1]) : e]) for f, e in zip(found, ends.tolist(), strict=True)]


def covered(raws: list[bytes | None], stored: Stored, length: int) -> list[np.ndarray]:
    """The bytes of each text that a repeated string covers, as a mask."""
    out = []
    for raw, anchor, start, end, key, state in states(raws, stored, length):
        step = np.zeros(len(raw) + 1, dtype=np.int64)
        full = (state & REPEATED) > 0
        np.add.at(step, start[full], 1)
        np.add.at(step, end[full], -1)
        edge = np.nonzero(~full & (state >= EDGE))[0]
        often = (state[edge] & OFTEN) > 0
        for b, (rows,) in dealt(bucket_of(anchor[edge[~often]], stored.index_buckets), edge[~often]):
            if b in stored.held["marks"]:
                known = stored.array("marks", b)
                for i, p, q in zip(rows.tolist(), np.searchsorted(known, key[rows]).tolist(), np.searchsorted(known, key[rows], "right").tolist(), strict=True):
                    np.add.at(step, start[i] + stored.array("marks", b, 1)[p:q], 1)
                    np.add.at(step, start[i] + stored.array("marks", b, 2)[p:q], -1)
        for i in edge[often].tolist():
            again = start[i] + np.nonzero(stored.found("strings", strings(raw, start[i], end[i], length), stored.buckets) >= 0)[0]
            np.add.at(step, again, 1)
            np.add.at(step, again + length, -1)
        out.append(np.cumsum(step[:-1]) > 0)
    return out


def deduplicated(docs: DataFrame, length: int = 200, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per document: key, ``n_bytes``, ``spans`` (removed runs, start and end in bytes) and ``kept`` (the other bytes).

    Removed is each byte covered by a string of ``length`` bytes that starts at another place too, in the same text (overlaps count)
    or in another; matches never cross documents, and strings are judged on the input. Null texts are empty. Texts under ``length``
    bytes stay whole. Rows that repeat are documents of their own, so each is removed as a copy of the other. Other columns are not
    read. An empty table gives an empty result. What is kept need not be valid UTF-8, as a span may end within a character."""
    stored = index(docs, length, text)

    def function(batch: pa.RecordBatch) -> dict:
        raws = utf8(batch, text)
        spans, kept = [], []
        for raw, mask in zip(raws, covered(raws, stored, length), strict=True):
            change = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
            spans.append([{"start": a, "end": b} for a, b in zip(np.nonzero(change == 1)[0].tolist(), np.nonzero(change == -1)[0].tolist(), strict=True)])
            kept.append(np.frombuffer(raw or b"", np.uint8)[~mask].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return {key: batch.column(key), "n_bytes": pa.array([len(r or b"") for r in raws], pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())}

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return arrow_map(docs.select(key, text), schema, function)


def op4_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 200 bytes, as digests."""
    found = deduplicated(table(spark, sf_dir, "documents"), 200)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
