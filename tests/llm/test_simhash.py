import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from featstab.llm import simhash
from featstab.llm.common import table
from featstab.llm.components import components

from .helpers import AWKWARD, documents


def brute_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, k, radius):
    fps = [brute_fingerprint(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    arr = np.array(fps, dtype=np.uint64)
    for i in range(len(rows)):
        for j in np.nonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= radius)[0].tolist():
            a, b = find(i), find(i + 1 + j)
            root[max(a, b)] = min(a, b)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    least = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    return sorted((str(d), f"{fps[i]:016x}", str(least[find(i)])) for i, (d, _) in enumerate(rows))


def found(df):
    return sorted((str(r.doc_id), r.fp.hex(), str(r.group)) for r in df.collect())


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.op9_simhash_tiles(spark, sf).collect())
    assert got == brute_groups(rows, 4, 4)


@pytest.mark.parametrize("tile", [4, 8192])
def test_awkward_rows_and_split_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "SMALL", 3)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    base = [f"w{i}" for i in range(60)]
    near = [(100 + i, " ".join([*base[:i], "changed", *base[i + 1 :]])) for i in range(40)]
    rows = [r[:2] for r in AWKWARD] + near + [(200, " ".join(base))]
    got = simhash.groups(documents(spark, rows), shingle=4, parts=1, radius=4)
    assert found(got) == brute_groups(rows, 4, 4)


def test_empty_table(spark):
    assert simhash.groups(documents(spark, [(1, "x")]).where("false")).count() == 0


def test_wide_fingerprints_find_near_copies_and_leave_others(spark):
    rng = np.random.default_rng(1)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    originals = [words(300) for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(originals)]
    for i, w in enumerate(originals[:10]):
        changed = list(w)
        changed[50], changed[200] = "edited", "too"
        rows.append((100 + i, " ".join(changed)))
    got = {r.doc_id: r.group for r in simhash.groups(documents(spark, rows)).collect()}
    assert got == {i: i for i in range(30)} | {100 + i: i for i in range(10)}


@pytest.mark.parametrize("tile", [2, 8192])
def test_size_tiles_lose_no_pair_of_like_size(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = [(bytes([i]) * 8, n) for i, n in enumerate([1, 1, 5, 6, 20, 24, 25, 30, 31, 37, 38])]
    got = simhash.size_tiles(spark.createDataFrame(rows, "fp binary, shingles long"), 0.8).collect()
    met = {}
    for r in got:
        met.setdefault((r.t, r.u), []).append((r.side, r.fp))
    pairs = {frozenset((a, b)) for v in met.values() for s, a in v for z, b in v if a != b and (not any(q for q, _ in v) or s != z)}
    for a, n in rows:
        for b, m in rows:
            if a != b and min(n, m) / max(n, m) >= 0.8:
                assert frozenset((a, b)) in pairs


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (None, 3), (5, 4)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(edges.where("false")).count() == 0


def shingle_sets(texts, k=5):
    words = [t.lower().split() for t in texts]
    return [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in words]


def test_similar_pairs_link_by_their_exact_similarity(spark):
    """Texts edited to just over or under 0.8: the fingerprint alone errs on both sides."""
    rng = np.random.default_rng(3)
    texts = []
    for k in range(60):
        base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        changed, order = list(base), iter(rng.permutation(400).tolist())
        while True:
            before, at = list(changed), next(order)
            changed[at] = f"edited{at}"
            a, b = shingle_sets([" ".join(base), " ".join(changed)])
            if len(a & b) < 0.8 * len(a | b):
                break
        texts += [" ".join(base), " ".join(changed if k % 2 else before)]
    sets = shingle_sets(texts)
    alike = [len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert alike == [k % 2 == 0 for k in range(60)]
    label = {r.doc_id: r.label for r in simhash.similar(documents(spark, list(enumerate(texts)))).collect()}
    assert [label[2 * k] == label[2 * k + 1] for k in range(60)] == alike
    assert len(set(label.values())) == 90


def test_repeated_lines_do_not_count_in_similar(spark):
    """A line that is repeated counts once: unlike texts stay apart, texts of one set stay together."""
    line, own = " ".join(f"common{i}" for i in range(10)), lambda k: " ".join(f"own{k}x{i}" for i in range(60))
    rows = [(k, f"{own(k)}\n" + f"{line}\n" * times) for k, times in enumerate([10, 10, 20, 20, 40, 40])]
    base = [f"w{i}" for i in range(400)]
    edited = " ".join([*base[:200], "edited", *base[201:]])
    rows += [(10, " ".join(base) + f"\n{line}" * 2), (11, edited + f"\n{line}" * 40)]
    label = {r.doc_id: r.label for r in simhash.similar(documents(spark, rows)).collect()}
    assert len({label[k] for k in range(6)}) == 6 and label[10] == label[11] not in {label[k] for k in range(6)}


def test_heavy_keys_join_like_others(spark, monkeypatch):
    from featstab.llm import components as module

    rows = spark.createDataFrame([(k, i) for k, n in (("a", 1500), ("b", 40), ("c", 1), (None, 1200)) for i in range(n)], "k string, x int")
    per = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("m"))
    got = {(r.k, r.m): r.n for r in module.spread_join(rows, per, "k", rows.count()).groupBy("k", "m").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("a", 0): 1500, ("b", 0): 40, ("c", 0): 1}
    monkeypatch.setattr(module, "LEAST", 3)
    edges = spark.createDataFrame([(50, i) for i in range(100, 140)] + [(7, 100), (139, 60), (200, 201)], "a long, b long")
    label = {r.node: r.label for r in components(edges).collect()}
    assert label == {n: 7 for n in (7, 50, 60, *range(100, 140))} | {200: 200, 201: 200}


def test_bands_lose_no_pair_of_random_sets():
    """Of 4000 pairs of similarity 0.80 to 0.85, of small and large sets, some 0.02 are expected to share no band."""
    rng = np.random.default_rng(7)
    for k in range(4000):
        own = int(rng.integers(3, 40))  # of each side alone
        size = round(own * rng.uniform(9, 12.3))
        hashes = rng.integers(0, 1 << 64, size + own, dtype=np.uint64)
        a, b = simhash.bands(hashes[:size]), simhash.bands(hashes[own:])
        assert 0.79 < (size - own) / (size + own) < 0.86
        assert (a == b).any()


def test_bands_of_empty_and_long_sets():
    assert (simhash.bands(np.empty(0, np.uint64)) == simhash.bands(np.empty(0, np.uint64))).all()
    rng = np.random.default_rng(2)
    long = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
    assert (simhash.bands(long) == simhash.bands(rng.permutation(long))).all()
    assert len(set(simhash.bands(long).tolist())) == simhash.BANDS


def banded(spark, texts):
    rows = [(k.to_bytes(4, "big"), bytes(32), simhash.bands(np.unique(simhash.shingle_hashes(t.encode(), 5))).tolist()) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "node binary, fp binary, bands array<long>").withColumn("joined", F.xxhash64("node"))


def test_tiles_grow_with_alike_texts_and_not_with_their_square(spark):
    """Texts of like size that share a passage meet hardly ever; groups of copies meet within themselves."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"shared{i}" for i in range(40))
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    pairs = []
    for n in (200, 800):
        texts = [f"{words(160)} {passage}" for _ in range(n)]
        texts += [f"{t} again" for t in texts[: n // 10]]
        sizes = simhash.band_tiles(banded(spark, texts), 0, simhash.BANDS).groupBy("t", "u").count().collect()
        pairs.append(sum(r["count"] * (r["count"] - 1) // 2 for r in sizes) / n)
    assert pairs[1] < 2 * pairs[0] and pairs[1] < 20


def test_tiles_of_joined_rows_are_left_out(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = banded(spark, [text, f"{text} a", f"{text} b", "other words that nothing else has here"])
    assert simhash.band_tiles(rows, 0, simhash.BANDS).select("node").distinct().count() == 3
    assert simhash.band_tiles(rows.withColumn("joined", F.lit(1).cast("long")), 0, simhash.BANDS).count() == 0


def brute_similar(texts, similarity=0.8):
    sets = shingle_sets(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= similarity * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {frozenset(i for i in range(len(texts)) if find(i) == r) for r in {find(i) for i in range(len(texts))}}


@pytest.mark.parametrize(("tile", "first"), [(4, 1), (8192, 4), (8192, 0)])
def test_chains_groups_and_singles_equal_brute_force(spark, monkeypatch, tile, first):
    """Chains of which only neighbours are alike, groups of many copies (over SMALL in a tile), copies that only a late band joins."""
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "SMALL", 6)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "FIRST", first)
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(3):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        for step in range(8):  # each replaces 20 words more than the one before
            texts.append(" ".join([*(f"new{step}x{i}" for i in range(20 * step)), *base[20 * step :]]))
    group = [f"g{x}" for x in rng.integers(0, 10**6, 200)]
    texts += [" ".join([*group[:i], "edited", *group[i + 1 :]]) for i in range(0, 200, 5)] + [" ".join(group)] * 5
    texts += [" ".join(f"s{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(10)]
    label = {r.doc_id: r.label for r in simhash.similar(documents(spark, list(enumerate(texts)))).collect()}
    got = {}
    for k, v in label.items():
        got.setdefault(v, set()).add(k)
    assert set(map(frozenset, got.values())) == brute_similar(texts)
