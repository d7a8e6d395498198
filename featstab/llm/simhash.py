"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints are compared in tiles with numpy exclusive-or and bit counts. Within a tile rows are ordered by population count, and
pairs of blocks whose counts differ beyond the radius are skipped. Which rows meet in a tile loses no pair: for a small radius the
fingerprint is cut into radius + 2 blocks, of which two linked fingerprints share at least two; for a large one, tiles hold texts of
like size, as texts of a given similarity have. Large tiles are split into sub-tiles that meet pairwise in tasks of their own. A task
returns the links as a forest, never all pairs. In similar() tiles hold texts that share a band of least hashes, so comparisons grow
with the texts that are alike and not with their square, and fingerprints only propose: a pair links once the sets of shingles of both
texts, read from the shared folder, are as similar as asked.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import arrow_map, keep, shared_dir, small_batches, table, utf8
from .components import components, spread_join

#: Rows of a sub-tile, of a block within a tile, and of the runs that are compared by shifting.
TILE, BLOCK, SMALL = 8192, 1024, 48
#: Shingle hashes that a task of similar() holds.
HELD = 1 << 22
SEED = 42
#: Bands of least hashes, hashes in a band, and the bands of the first round. A pair of similarity J shares no band in (1 - J^4)^22 of all
#: cases: 9 in a million at 0.8, 1 in a million at 0.83.
BANDS, WIDTH, FIRST = 22, 4, 4
#: Where a text lies: the number of its file, its first byte there and its bytes.
PLACE = ("file", "at", "bytes")


def shingle_hashes(raw: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words, in lower case (A-Z), joined by single spaces; fewer words: of the whole sequence."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    line, ends = b" ".join(words), [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts, digest = [0, *(e + 1 for e in ends[:-1])], xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[min(size, len(words)) - 1 :], strict=False)), dtype=np.uint64)


def fingerprint(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Majority bits of the hashes, ``parts`` words of 64; from the second part on, hashes are remixed."""
    out = np.zeros(parts, dtype=np.uint64)
    for part in range(parts if len(hashes) else 0):
        x = hashes
        if part:
            x = x + np.uint64(0x9E3779B97F4A7C15 * part & (1 << 64) - 1)
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            x = x ^ x >> np.uint64(31)
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(x), 1 << 16):
            ones += np.unpackbits(x[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[part] = np.packbits(2 * ones > len(x), bitorder="little").view(np.uint64)[0]
    return out


MULTIPLY, ADD = (np.array([xxhash.xxh64_intdigest(b"%s%d" % (name, k), SEED) | odd for k in range(BANDS * WIDTH)], dtype=np.uint64) for name, odd in ((b"multiply", 1), (b"add", 0)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: of the least values that WIDTH permutations (an odd factor and a summand each) give the hashes."""
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[i : i + (1 << 12), None] * MULTIPLY + ADD).min(0))
    return ((least * MULTIPLY[::-1]).reshape(BANDS, WIDTH).sum(1, dtype=np.uint64) + ADD[:BANDS]).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int, parts: int = 1, text: str = "text", carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carried`` columns, ``fp`` (binary, big-endian words, repeated shingles counted) and ``shingles`` (distinct). Null and empty
    texts: zero and 0."""

    def function(batch: pa.RecordBatch) -> dict:
        fps, sizes = [], []
        for raw in utf8(batch, text):
            hashes = shingle_hashes(raw or b"", shingle)
            fps.append(fingerprint(hashes, parts).astype(">u8").tobytes())
            sizes.append(len(np.unique(hashes)))
        return {k: batch.column(k) for k in carried} | {"fp": fps, "shingles": pa.array(sizes, pa.int64())}

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return arrow_map(docs.select(*carried, text), ", ".join(f"`{k}` {kinds[k]}" for k in carried) + ", fp binary, shingles long", function)


class Forest:
    """Union-find over row numbers, fed with arrays of links; rows of equal ``joined`` are joined from the start."""

    def __init__(self, n: int, joined: np.ndarray | None = None):
        self.root = np.arange(n)
        if joined is not None:
            _, first, which = np.unique(joined, return_index=True, return_inverse=True)
            self.root = first[which]

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        ra, rb = self.root[a], self.root[b]
        apart = ra != rb
        if not apart.any():
            return
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                parent[x] = parent.get(y, y)
                x = y
            return x

        for x, y in set(zip(ra[apart].tolist(), rb[apart].tolist(), strict=True)):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        old = np.array(list(parent), dtype=np.int64)
        to = np.arange(len(self.root))
        to[old] = [find(x) for x in old.tolist()]
        self.root = to[self.root]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        own = np.nonzero(self.root != np.arange(len(self.root)))[0]
        return own, self.root[own]


def near(x: np.ndarray, y: np.ndarray, radius: int, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of two blocks within ``radius``; ``upper``: the blocks are one and each pair counts once."""
    d = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
    seen = x.shape[1] if radius > 48 else min(2, x.shape[1])  # two words leave few pairs only if the radius is far under their 64 bits
    for word in range(1, seen):
        d = np.add(d, np.bitwise_count(x[:, None, word] ^ y[None, :, word]), dtype=np.uint8 if word < 3 else np.uint16)
    i, j = np.nonzero(d <= radius)
    if upper:
        i, j = i[i < j], j[i < j]
    if x.shape[1] > seen and len(i):
        close = np.bitwise_count(x[i] ^ y[j]).sum(1, dtype=np.int64) <= radius
        i, j = i[close], j[close]
    return i, j


class Texts:
    """The shingle sets of a task's rows, from their texts in the shared folder; at most HELD hashes (or one pair's) stay in memory."""

    def __init__(self, folder: str, shingle: int, similarity: float, rows: dict[str, np.ndarray]):
        self.folder, self.shingle, self.similarity, self.rows = folder, shingle, similarity, rows
        self.sets: dict[int, np.ndarray] = {}
        self.open: dict[int, object] = {}
        self.held = 0

    def set_of(self, k: int) -> np.ndarray:
        if (found := self.sets.pop(k, None)) is None:
            file = int(self.rows["file"][k])
            if file not in self.open:
                if len(self.open) >= 256:
                    self.open.pop(next(iter(self.open))).close()
                system, path = files.of(f"{self.folder}/{file}")
                self.open[file] = system.open_input_file(path)
            raw = self.open[file].read_at(int(self.rows["bytes"][k]), int(self.rows["at"][k]))
            found = np.unique(shingle_hashes(zstandard.decompress(raw), self.shingle))
            self.held += len(found)
            while self.held > HELD and self.sets:
                self.held -= len(self.sets.pop(next(iter(self.sets))))
        self.sets[k] = found  # last, as the one used last
        return found

    def alike(self, a: int, b: int) -> bool:
        x, y = self.set_of(a), self.set_of(b)
        both = np.concatenate([x, y])
        both.sort()
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        return common >= self.similarity * (len(both) - common) - 1e-9

    def add(self, forest: Forest, a: np.ndarray, b: np.ndarray, start: int = 0) -> None:
        """Add to the forest those of the links (a, b) whose sets are alike; rows that verified links join already aren't read."""
        n, s = self.rows["shingles"], self.similarity
        fit = np.minimum(n[a + start], n[b + start]) >= s * np.maximum(n[a + start], n[b + start]) - 1e-9
        a, b, step = a[fit], b[fit], 64
        while len(a):
            apart = forest.root[a] != forest.root[b]
            a, b = a[apart], b[apart]
            ok = np.array([self.alike(i, j) for i, j in zip((a[:step] + start).tolist(), (b[:step] + start).tolist(), strict=True)], dtype=bool)
            forest.add(a[:step][ok], b[:step][ok])
            a, b = a[step:], b[step:]
            step = 64 if ok.any() else min(2 * step, 4096)


def tile_links(fps: np.ndarray, side: np.ndarray, radius: int, add: Callable | None = None, joined: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within a tile; if it has two sides, of those across. ``add`` says which links count, all if None.

    With ``joined``, rows of equal values are joined from the start and blocks of joined rows alone are not compared."""
    ones = np.bitwise_count(fps).sum(1, dtype=np.int64)
    forest, two = Forest(len(fps), joined), bool(side.any())
    add = add or Forest.add
    left, right = (np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]) if two else (np.arange(len(fps)),) * 2
    left, right = left[np.argsort(ones[left], kind="stable")], right[np.argsort(ones[right], kind="stable")]
    for p in range(0, len(left), BLOCK):
        rows = left[p : p + BLOCK]
        low, high = ones[rows[0]] - radius, ones[rows[-1]] + radius
        for q in range(0 if two else p, len(right), BLOCK):
            others = right[q : q + BLOCK]
            if ones[others[-1]] < low or ones[others[0]] > high:
                continue
            if joined is not None and (forest.root[rows] == forest.root[rows[0]]).all() and (forest.root[others] == forest.root[rows[0]]).all():
                continue
            i, j = near(fps[rows], fps[others], radius, not two and p == q)
            if len(j) > 4 * BLOCK:  # a dense block: first one link for each column, which joins nearly all
                once = np.unique(j, return_index=True)[1]
                add(forest, rows[i[once]], others[j[once]])
            if len(i):
                add(forest, rows[i], others[j])
    return forest.links()


def links_of_sorted(t: np.ndarray, u: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int, texts: Texts | None = None, joined: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links, as row pairs, within the runs of equal (t, u); with ``texts``, of those that are alike. ``joined``: as in tile_links()."""
    edge = np.concatenate([[True], (t[1:] != t[:-1]) | (u[1:] != u[:-1]), [True]])
    starts = np.nonzero(edge)[0]
    length = np.diff(starts)
    a, b = [], []
    for k in np.nonzero(length > SMALL)[0].tolist():
        s, e = starts[k], starts[k + 1]
        i, j = tile_links(fps[s:e], side[s:e], radius, texts and partial(texts.add, start=s), joined if joined is None else joined[s:e])
        a.append(i + s)
        b.append(j + s)
    run, small = np.repeat(np.arange(len(length)), length), np.repeat(length <= SMALL, length)
    forest = Forest(len(t), None if joined is None else np.unique(joined, return_inverse=True)[1] + run * len(t))
    rest = np.nonzero(small & (np.repeat(length, length) > 1))[0]
    for d in range(1, SMALL):
        rest = rest[rest + d < len(t)]
        rest = rest[run[rest] == run[rest + d]]
        if not len(rest):
            break
        close = np.bitwise_count(fps[rest] ^ fps[rest + d]).sum(1, dtype=np.int64) <= radius
        two = np.zeros(len(length), dtype=bool)
        np.logical_or.at(two, run[rest], (side[rest] == 1) | (side[rest + d] == 1))
        hit = rest[close & (~two[run[rest]] | (side[rest] != side[rest + d]))]
        (texts.add if texts else Forest.add)(forest, hit, hit + d)
    i, j = forest.links()
    return np.concatenate([*a, i]).astype(np.int64), np.concatenate([*b, j]).astype(np.int64)


def compare(tiles: DataFrame, parts: int, radius: int, node: str = "fp", stored: tuple[str, int, float] | None = None) -> DataFrame:
    """Links (a, b) between the ``node`` of fingerprints that share a tile (t, u), each tile within one sorted partition, a run at a time.

    ``stored``: folder of texts, words of a shingle, least similarity of the sets; without, fingerprints within ``radius`` link. Rows of
    equal ``joined``, if there is that column, are known to be linked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            got = pa.Table.from_batches(held).combine_chunks()
            t, u, side = (got.column(c).to_numpy() for c in ("t", "u", "side"))
            cut = len(t) if last else int(np.nonzero((t != t[-1]) | (u != u[-1]))[0][-1]) + 1 if ((t != t[-1]) | (u != u[-1])).any() else 0
            if cut:
                raw = got.column("fp").slice(0, cut).to_pylist()
                fps = np.frombuffer(b"".join(raw), dtype=">u8").astype(np.uint64).reshape(-1, parts)
                texts = Texts(*stored, {c: got.column(c).to_numpy() for c in (*PLACE, "shingles")}) if stored else None
                joined = got.column("joined").slice(0, cut).to_numpy() if "joined" in got.column_names else None
                a, b = links_of_sorted(t[:cut], u[:cut], side[:cut], fps, radius, texts, joined)
                if len(a):
                    ends = got.column(node)
                    yield pa.RecordBatch.from_pydict({"a": ends.take(pa.array(a)).cast(pa.binary()).combine_chunks(), "b": ends.take(pa.array(b)).cast(pa.binary()).combine_chunks()})
            held[:] = got.slice(cut).to_batches()

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
                if size >= 1 << 16:
                    yield from done(False)
                    size = sum(x.num_rows for x in held) // 2  # a run that goes on is looked at again once it has doubled
        if held:
            yield from done(True)

    return tiles.repartition("t", "u").sortWithinPartitions("t", "u").mapInArrow(run, "a binary, b binary")


def block_tiles(distinct: DataFrame, parts: int, radius: int) -> DataFrame:
    """Tiles by two equal blocks of radius + 2; those over TILE rows are split into pairs of sub-tiles."""
    bits, blocks = 64 * parts, radius + 2
    bounds = [bits * k // blocks for k in range(blocks + 1)]
    pairs = list(combinations(range(blocks), 2))

    def function(batch: pa.RecordBatch) -> dict:
        raw = batch.column("fp").to_pylist()
        bit = np.unpackbits(np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), -1), axis=1).astype(np.int64)
        value = [bit[:, a:b] @ (1 << np.arange(b - a)) for a, b in zip(bounds, bounds[1:], strict=False)]
        keys = np.stack([(k << 48) + (value[x] << 24) + value[y] for k, (x, y) in enumerate(pairs)], axis=1)
        return {"t": keys.ravel(), "fp": pa.array(raw, pa.binary()).take(pa.array(np.repeat(np.arange(len(raw)), len(pairs))))}

    keyed = arrow_map(distinct.select("fp"), "t long, fp binary", function)
    shared = keyed.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    split = F.ceil(F.col("n") / TILE)
    rows = keyed.join(shared, "t").select("t", "fp", split.alias("k"), F.pmod(F.xxhash64("fp"), split).alias("s"))
    rows = rows.select("t", "fp", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("o"))
    return rows.select("t", (F.least("s", "o") * (1 << 32) + F.greatest("s", "o")).alias("u"), (F.col("s") > F.col("o")).cast("int").alias("side"), "fp")


def size_tiles(distinct: DataFrame, similarity: float, carried: tuple[str, ...] = ()) -> DataFrame:
    """Tiles of texts whose shingle counts allow ``similarity``: powers of 1 / similarity, each met with itself and the next."""
    level = F.floor(F.log(F.greatest("shingles", F.lit(1))) / F.log(F.lit(1 / similarity)) + 1e-9)
    rows = distinct.select("fp", *carried, level.alias("c")).distinct()
    split = {r["c"]: -(-r["count"] // TILE) for r in rows.groupBy("c").count().collect()}  # a row per power: bounded
    of = F.create_map(*(F.lit(x).cast("long") for kv in (split or {0: 1}).items() for x in kv))
    many = {d: F.coalesce(F.try_element_at(of, F.col("c") + d), F.lit(0).cast("long")) for d in (-1, 0, 1)}
    rows = rows.select("fp", *carried, "c", F.pmod(F.xxhash64("fp"), many[0]).alias("s"), *(many[d].alias(f"k{d + 1}") for d in (-1, 0, 1)))

    def met(k: str, make):
        spans = F.when(F.col(k) > 0, F.sequence(F.lit(0).cast("long"), F.col(k) - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(spans, lambda o: F.struct(*(x.alias(n) for n, x in zip(("t", "u", "side"), make(o), strict=True))))

    s, c, wide = F.col("s"), F.col("c").cast("long"), 1 << 32
    own = met("k1", lambda o: (2 * c, F.least(s, o) * wide + F.greatest(s, o), (s > o).cast("int")))
    above = met("k2", lambda o: (2 * c + 1, s * wide + o, F.lit(0)))
    below = met("k0", lambda o: (2 * c - 1, o * wide + s, F.lit(1)))
    return rows.select("fp", *carried, F.explode(F.concat(own, above, below)).alias("x")).select("x.t", "x.u", "x.side", "fp", *carried)


def band_tiles(rows: DataFrame, first: int, count: int) -> DataFrame:
    """Tiles (t, u, side) of ``rows`` that share one of ``count`` bands from number ``first`` on, if they are not all of one ``joined``.

    Tiles over TILE rows are split into pairs of sub-tiles. Only keys of 64 bits are counted and matched; the other columns join the few
    rows that share a key with a row of another ``joined``, by a hash of the node: two nodes of one hash only meet more rows."""
    rows = rows.withColumn("id", F.xxhash64("node"))
    keyed = rows.select("id", "joined", F.explode(F.slice("bands", first + 1, count)).alias("t"))
    per = keyed.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("joined").alias("lo"), F.max("joined").alias("hi"))
    per = keep(per.where("lo < hi").select("t", "n", F.ceil(F.col("n") / TILE).alias("k")), "tiles")
    met = spread_join(keyed.select("id", "t"), per, "t", per.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    met = met.join(rows.drop("bands"), "id").withColumn("s", F.pmod(F.xxhash64("id", F.lit(1)), F.col("k")))
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    return met.select("t", (F.least("s", "o") * (1 << 32) + F.greatest("s", "o")).alias("u"), (F.col("s") > F.col("o")).cast("int").alias("side"), *(c for c in rows.columns if c not in ("id", "bands")))


def stored(docs: DataFrame, shingle: int, parts: int, text: str, carried: tuple[str, ...], folder: str) -> DataFrame:
    """``carried``, ``node`` (128 bits of the set of shingles), ``fp`` and ``bands`` of that set, ``shingles`` (its size) and where the text lies in ``folder``.

    A task writes its texts, compressed one by one, to a file named by its attempt; rows of a lost attempt name no file."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        file = context.taskAttemptId() if context else uuid.uuid4().int >> 66
        system, path = files.of(f"{folder}/{file}")
        system.create_dir(path.rpartition("/")[0], recursive=True)
        compressor, at = zstandard.ZstdCompressor(level=1), 0
        with system.open_output_stream(path) as out:
            for batch in batches:
                found: dict[str, list] = {k: [] for k in kinds_of}
                for raw in utf8(batch, text):
                    own = np.unique(shingle_hashes(raw or b"", shingle))
                    packed = compressor.compress(raw or b"")
                    out.write(packed)
                    row = (xxhash.xxh3_128_digest(own.tobytes()), fingerprint(own, parts).astype(">u8").tobytes(), bands(own), len(own), file, at, len(packed))
                    at += len(packed)
                    for column, value in zip(found.values(), row, strict=True):
                        column.append(value)
                if batch.num_rows:
                    yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in carried} | {k: pa.array(v, kinds_of[k]) for k, v in found.items()})

    kinds_of = {"node": pa.binary(), "fp": pa.binary(), "bands": pa.list_(pa.int64()), "shingles": pa.int64()} | dict.fromkeys(PLACE, pa.int64())
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in carried) + ", node binary, fp binary, bands array<long>, shingles long, " + ", ".join(f"{c} long" for c in PLACE)
    return docs.select(*carried, text).mapInArrow(run, schema)


def similar(docs: DataFrame, shingle: int = 5, parts: int = 4, radius: int = 72, similarity: float = 0.8, text: str = "text", carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per document: ``carried`` and ``label``, the same for documents joined by chains of similar pairs.

    A pair is similar if the Jaccard similarity of its sets of shingles (64-bit hashes) is ``similarity`` or more. That is computed for
    pairs of unequal sets that share a band and whose fingerprints, over distinct shingles, are within ``radius`` bits, unless links found
    so already join them; equal sets always link. At 0.8, 9 in a million pairs share no band, and fingerprints of 256 bits differ in 39
    bits (48 for sets of four or five shingles), 6 bits of standard error: 72 bits are four of them and more. A first round takes FIRST
    bands, which join most of what is alike; the second takes the others, for texts that the first has not joined, so large groups are
    compared once. Sets too small to be similar without being equal are not compared. Texts without words are alike. Texts are written to
    the shared folder once, compressed. An empty table gives an empty result."""
    folder = shared_dir(docs.sparkSession, "texts")
    found = keep(stored(docs, shingle, parts, text, carried, folder), "fingerprints")
    every = keep(found.groupBy("node").agg(F.min(F.struct("fp", "shingles", *PLACE, "bands")).alias("x"), F.count(F.lit(1)).alias("n")).select("node", "x.*", "n"), "sets")
    distinct = every.where(F.col("shingles") * (1 - similarity) >= similarity - 1e-9).drop("n")
    against = partial(compare, parts=parts, radius=radius, stored=(folder, shingle, similarity))
    labels = keep(components(against(band_tiles(distinct.withColumn("joined", F.xxhash64("node")), 0, FIRST), node="node")), "labels")
    rows = distinct.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).withColumn("joined", F.xxhash64("label"))
    later = components(against(band_tiles(rows, FIRST, BANDS - FIRST), node="label")).select(F.col("node").alias("label"), F.col("label").alias("last"))
    per = keep(labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(later, "label", "full").select("label", F.coalesce("last", "label").alias("last"), "n"), "labels")
    both = spread_join(labels, per.where("n is not null"), "label", labels.count()).select("node", F.col("last").alias("label"))
    both = both.unionByName(per.where("n is null").select(F.col("label").alias("node"), F.col("last").alias("label")))  # linked by the second round alone
    of = keep(every.select("node", "n").join(both, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "n"), "labels")
    return spread_join(found.select(*carried, "node"), of, "node", found.count()).select(*carried, "label")


def groups(docs: DataFrame, shingle: int = 5, parts: int = 4, radius: int = 44, similarity: float = 0.8, text: str = "text", key: str = "doc_id", carried: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: key, ``carried``, ``fp`` (binary) and ``group``, the smallest key among the documents reachable by links.

    Fingerprints of 64 * ``parts`` bits over word shingles link at ``radius`` or fewer differing bits. With four parts, 44 bits are
    the expected distance at Jaccard similarity 0.8 plus a standard error, so that few pairs of 0.8 are missed. A radius under
    8 * ``parts`` takes tiles of equal blocks, which ignore sizes; a larger one takes tiles of texts whose numbers of distinct shingles
    allow ``similarity``. Texts without words have the zero fingerprint and link like any other. Equal fingerprints always link, so
    repeated rows and copies share a group. Null keys are ignored in the minimum: a group of null keys alone has a null id. Other
    columns are not read; an empty table gives an empty result. Fingerprints are written to the shared folder once."""
    found = keep(fingerprints(docs, shingle, parts, text, (key, *carried)), "fingerprints")
    distinct = found.select("fp", "shingles").distinct()
    tiles = block_tiles(found.select("fp").distinct(), parts, radius) if radius < 8 * parts else size_tiles(distinct, similarity)
    labels = components(compare(tiles, parts, radius))
    least = keep(found.groupBy("fp").agg(F.min(key).alias("m")).join(labels.withColumnRenamed("node", "fp"), "fp", "left"), "labels")
    linked = least.where("label is not null")
    per = linked.groupBy("label").agg(F.min("m").alias("group"), F.count(F.lit(1)).alias("n"))
    ids = spread_join(linked.select("fp", "label"), per, "label", least.count()).select("fp", "group")
    ids = ids.unionByName(least.where("label is null").select("fp", F.col("m").alias("group")))
    return found.select(key, *carried, "fp").join(ids, "fp")


def op9_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document over 4-word shingles, and its component at 4 or fewer differing bits."""
    found = groups(table(spark, sf_dir, "documents"), shingle=4, parts=1, radius=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("group").alias("component_id"))
