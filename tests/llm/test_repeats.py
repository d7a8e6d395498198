import hashlib
from collections import Counter

import numpy as np
import pytest

from featstab.llm import repeats
from featstab.llm.common import table

from .helpers import AWKWARD, documents, write


def brute(rows, length):
    raws = [(d, (t or "").encode()) for d, t in rows]
    counts = Counter(r[i : i + length] for _, r in raws for i in range(len(r) - length + 1))
    out = []
    for d, r in raws:
        mask = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - length + 1):
            if counts[r[i : i + length]] > 1:
                mask[i : i + length] = True
        mask = mask[:-1]
        kept = bytes(b for b, m in zip(r, mask.tolist(), strict=True) if not m)
        spans = int((np.diff(np.concatenate([[False], mask]).astype(int)) == 1).sum())
        out.append((str(d), len(r), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op4_run_length_index(spark, sf).collect())
    assert got == brute(rows, 200)


def passages(rng):
    """Texts that share passages with different surroundings, shifted, nested and at their edges."""
    noise = lambda n: "".join(chr(c) for c in rng.integers(97, 123, n))
    shared, other = noise(500), noise(260)
    rows = [(i, noise(int(rng.integers(0, 300))) + shared[int(rng.integers(0, 200)) : int(rng.integers(300, 500))] + noise(int(rng.integers(0, 300)))) for i in range(60)]
    rows += [(100 + i, other + noise(40)) for i in range(20)] + [(200 + i, noise(40) + other) for i in range(20)]
    return rows + [(300, noise(50) + "ab" * 300 + noise(50)), (301, other), (302, shared + shared), (303, "é" * 150)]


@pytest.mark.parametrize("frequent", [2, 2048])
def test_passages_and_frequent_anchors(spark, tmp_path, monkeypatch, frequent):
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    monkeypatch.setattr(repeats, "STRETCH", 331)
    rows = passages(np.random.default_rng(3)) + [r[:2] for r in AWKWARD if r[1] is None or len(r[1]) < 1000]
    folder = write(spark, documents(spark, rows).repartition(3), tmp_path)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op4_run_length_index(spark, folder).collect())
    assert got == brute(rows, 200)


def test_repeated_rows_other_lengths_and_empty_table(spark):
    docs = documents(spark, [(1, "same text, long enough to hold an anchor"), (1, "same text, long enough to hold an anchor"), (2, "short"), (3, None)]).selectExpr("*", "1 AS spans", "2 AS kept")
    got = {(r.doc_id, r.n_bytes, bytes(r.kept)) for r in repeats.deduplicated(docs, 30).collect()}
    assert got == {(1, 40, b""), (2, 5, b"short"), (3, 0, b"")}
    assert repeats.deduplicated(docs.where("false")).count() == 0


def test_very_long_text(spark):
    got = repeats.deduplicated(documents(spark, [(1, AWKWARD[6][1]), (2, "x" * 100_000)])).collect()
    assert [bytes(r.kept) for r in got] == [b"", b""]


@pytest.mark.parametrize("seed", range(4))
def test_matching_statistics_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    texts = [bytes(rng.integers(0, 2 if seed % 2 else 256, int(rng.integers(1, 60))).astype(np.uint8)) for _ in range(12)]
    texts += [texts[0], texts[1][:5], texts[2] + texts[3]]
    got, at = repeats.RunIndex.build(texts).matching(), 0
    for i, t in enumerate(texts):
        for p in range(len(t)):
            best = 0
            for j, o in enumerate(texts):
                for q in range(len(o)):
                    if (i, p) != (j, q):
                        k = 0
                        while p + k < len(t) and q + k < len(o) and t[p + k] == o[q + k]:
                            k += 1
                        best = max(best, k)
            assert got[at + p] == best, (i, p)
        at += len(t) + 1


def test_runs_are_the_transform():
    """Backward search over the stored runs counts what the texts hold, and repetitive texts have few runs."""
    rng = np.random.default_rng(3)
    base = bytes(rng.integers(97, 101, 300).astype(np.uint8))
    texts = [base[: int(rng.integers(1, 300))] + bytes([int(rng.integers(97, 101))]) for _ in range(12)] + [b"", b"\xff\x00\xff", base]
    index = repeats.RunIndex.build(texts)
    assert index.length.sum() == index.n == sum(len(t) + 1 for t in texts) and len(index.symbol) < index.n / 2
    patterns = [base[i : i + k] for i, k in ((0, 1), (5, 3), (10, 9), (200, 40), (0, 300))] + [b"e", b"\xff", b"\x00\xff", b"abcdabcdabcd", b""]
    for p in patterns:
        want = sum(t[i : i + len(p)] == p for t in texts for i in range(len(t) - len(p) + 1)) if p else index.n
        assert index.occurrences(p) == want
