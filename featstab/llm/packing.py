"""Order-preserving packing of tokenised documents into fixed windows by dynamic programming.

Documents follow each other in their order. Windows may be cut at document ends, at sentence ends and, where neither comes for long,
at grid points; the cuts minimise padding plus a penalty for each cut inside a document. The cost of a window is linear in its start,
so the best start is the head of a monotone queue; windows of a power-of-two length need no padding and are looked up by position.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table


@dataclass(frozen=True)
class Settings:
    """``window`` tokens; costs, in tokens of padding, of a cut at a sentence's end, of any other cut inside a document and of a window;
    ``gap``: a candidate is set at least so often; ``short``: least power of two that stands without padding; ``block``: tokens that
    are held at a time, of which the cuts of the last ``ahead`` are left open until more tokens are known."""

    window: int = 1024
    sentence_cost: float = 1.0
    cut_cost: float = 4.0
    window_cost: float = 1.0
    gap: int = 32
    short: int = 128
    block: int = 1 << 18
    ahead: int = 1 << 14


#: Bytes after which a sentence may end.
ENDERS = (".", "!", "?", "\n")
#: Characters on which both tokenizer libraries' patterns agree whatever Unicode version they were built with.
PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]")
#: White space that the faster library's pattern would go back over character by character, on a bounded stack.
WIDE_SPACE = re.compile(r"\s{8192}")


class ByteTokenizer:
    """Ids of a byte-level BPE file. Plain texts go through a faster library over the same vocabulary, with the same ids."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        own = {x["content"] for x in model.get("added_tokens", ())}
        self.special = re.compile("|".join(map(re.escape, sorted(own)))) if own else None
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]  # bytes written as themselves; the rest from U+0100 on
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte[c] for c in piece): rank for piece, rank in model["model"]["vocab"].items() if piece not in own}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.enders = np.array([ranks[e.encode()] for e in ENDERS if e.encode() in ranks], dtype=np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        if PLAIN.search(text) or WIDE_SPACE.search(text) or self.special and self.special.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.fast.encode_to_numpy(text)


def best_cuts(where: np.ndarray, penalty: np.ndarray, settings: Settings) -> list[int]:
    """Cut positions, first and last candidate included, of least total cost.

    ``where``: candidate positions, rising, no two further apart than a window; ``penalty``: cost of a cut at each."""
    window, place, cost = settings.window, where.tolist(), (penalty + settings.window_cost).tolist()
    n, end = len(place), place[-1]
    at = [-1] * (end + 1)
    at[0] = 0
    best, back = [0.0] * n, [0] * n
    powers = [1 << k for k in range(window.bit_length()) if settings.short <= 1 << k < window]
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # (best + position, position, index), rising
    for j in range(1, n):
        p = place[j]
        while queue[0][1] < p - window:
            queue.popleft()
        value, _, i = queue[0]
        value += window - p
        for q in powers:
            if q <= p and (k := at[p - q]) >= 0 and best[k] < value:
                value, i = best[k], k
        best[j], back[j], at[p] = value + cost[j], i, j
        key = best[j] + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    cuts, j = [end], n - 1
    while j:
        j = back[j]
        cuts.append(place[j])
    return cuts[::-1]


def candidates(ids: np.ndarray, ends: np.ndarray, enders: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may be cut, and what a cut costs there."""
    cost = np.full(len(ids) + 1, np.inf, dtype=np.float32)
    cost[np.nonzero(np.isin(ids, enders))[0] + 1] = settings.sentence_cost
    cost[0] = 0
    cost[ends] = 0
    where = np.nonzero(cost < np.inf)[0]
    wide = np.nonzero(np.diff(where) > settings.gap)[0]
    for i in wide.tolist():
        grid = np.arange(where[i] + settings.gap, where[i + 1], settings.gap)
        cost[grid] = settings.cut_cost
    if len(wide):
        where = np.nonzero(cost < np.inf)[0]
    return where, cost[where]


@dataclass
class Held:
    """A document, or what is left of it from ``start`` on: arrays of ids, ``n`` in all; ``total`` of the whole document."""

    key: object
    start: int
    total: int
    ids: list[np.ndarray]
    n: int


def pack_block(docs: list[Held], enders: np.ndarray, settings: Settings, last: bool) -> tuple[dict[str, np.ndarray], list[Held]]:
    """Pieces of consecutive documents: doc (index), start, length, crc, window (from 0), offset, doc_tokens, first id here; then the rest.

    Unless ``last``, windows in the last ``ahead`` tokens are not fixed, and those tokens are the rest."""
    ids = np.concatenate([x for d in docs for x in d.ids])
    behind = np.cumsum([d.n for d in docs])
    first = behind - [d.n for d in docs]
    whole = np.array([d.start + d.n == d.total for d in docs])
    cuts = np.array(best_cuts(*candidates(ids, np.append(behind[whole], len(ids)), enders, settings), settings))
    if not last:
        cuts = cuts[: max(2, int(np.searchsorted(cuts, len(ids) - settings.ahead, "right")))]
    stop = int(cuts[-1])
    begin = np.union1d(first[first < stop], cuts[:-1])
    length = np.diff(np.append(begin, stop))
    doc, window = np.searchsorted(first, begin, "right") - 1, np.searchsorted(cuts, begin, "right") - 1
    view = memoryview(ids.astype("<u4").tobytes())
    crc = np.array([zlib.crc32(view[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)], dtype=np.int64)
    before, total = np.array([d.start for d in docs]), np.array([d.total for d in docs])
    found = {"doc": doc, "start": begin - first[doc] + before[doc], "length": length, "crc": crc, "window": window, "offset": begin - cuts[window], "doc_tokens": total[doc], "ids": ids, "begin": begin}
    rest = []
    for d, a, b in zip(docs, first.tolist(), behind.tolist(), strict=True):
        if b > stop:
            cut = max(a, stop)
            rest.append(Held(d.key, d.start + cut - a, d.total, [ids[cut:b].copy()], b - cut))
    return found, rest


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, settings: Settings = Settings(), text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """A row per piece of a document in a window.

    A document is its text's ids and ``end_id``; null and empty texts are that id alone. Each task packs the documents of its input
    partition in the order in which it reads them, ``block`` tokens at a time; no block ends in a cut of its own, as what its last
    windows hold is looked at again with the next. ``sequence_id`` is the partition's number in the upper
    bits and a count in the lower 32. Repeated rows are packed as separate documents with the same key. A null key stays null. Other
    columns are not read. An empty table gives an empty result. No shuffle; memory is bounded by a block, and the longest text and its ids.
    ``tokenizer`` is a path that every worker can open. ``with_ids`` adds the piece's token ids."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = ByteTokenizer(tokenizer), TaskContext.get()
        base, kind, held, n = (context.partitionId() if context else 0) << 32, None, [], 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal base, held, n
            got, rest = pack_block(held, encode.enders, settings, last)
            named = pa.array([d.key for d in held], kind).take(pa.array(got["doc"]))
            out = {key: named, "start": got["start"], "length": got["length"], "ids_crc32": got["crc"], "doc_tokens": got["doc_tokens"], "sequence_id": got["window"] + base, "offset": got["offset"]}
            if with_ids:
                out["ids"] = pa.array([got["ids"][b : b + m].tolist() for b, m in zip(got["begin"].tolist(), got["length"].tolist(), strict=True)], pa.list_(pa.int32()))
            base += int(got["window"][-1]) + 1
            held, n = rest, sum(d.n for d in rest)
            return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v.astype(np.int64)) for k, v in out.items()})

        for batch in batches:
            kind = batch.schema.field(key).type
            for k, t in zip(batch.column(key).to_pylist(), batch.column(text), strict=True):
                ids = np.append(encode(t.as_py() or ""), np.uint32(end_id))
                for at in range(0, len(ids), settings.block):
                    part = ids[at : at + settings.block]
                    if at and held:
                        held[-1].ids.append(part)
                        held[-1].n += len(part)
                    else:
                        held.append(Held(k, at, len(ids), [part], len(part)))
                    n += len(part)
                    if n >= settings.block:
                        yield flush(False)
        if held:
            yield flush(True)

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(key, text).mapInArrow(run, schema)


def op5_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into windows of 1024 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
