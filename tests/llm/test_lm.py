import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from featstab.llm import lm, words
from featstab.llm.common import table

from .helpers import AWKWARD, documents, write


def brute(train, test):
    """(n_tokens, n_known, N, base, score) of each test text, by dictionaries."""
    split = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    words, pairs = Counter(), Counter()
    for t in train:
        x = split(t)
        words.update(x)
        pairs.update(zip([b"\n", *x], x, strict=False))
    n, v = sum(words.values()), len(words)
    before, context = Counter(w for _, w in pairs), defaultdict(list)
    for (u, _), c in pairs.items():
        context[u].append(c)
    coc = lambda c: np.array([sum(1 for x in c.values() if x == k) for k in range(1, 5)])
    d1, d2 = lm.discounts(coc(before)), lm.discounts(coc(pairs))
    free = sum(d1[min(c, 3)] for c in before.values()) / max(1, len(pairs))

    def p(u, w):
        c = before.get(w, 0)
        low = max(c - d1[min(c, 3)], 0) / len(pairs) + free / (v + 1)
        if u not in context:
            return low
        total, c = sum(context[u]), pairs.get((u, w), 0)
        return max(c - d2[min(c, 3)], 0) / total + sum(d2[min(x, 3)] for x in context[u]) / total * low

    out = []
    for t in test:
        x = split(t)
        base = sum(math.log10((words.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in x)
        out.append((len(x), sum(w in words for w in x), n, base, sum(math.log10(p(u, w)) for u, w in zip([b"\n", *x], x, strict=False))))
    total = sum(p(b"\n", w) for w in words) + p(b"\n", b"never seen")
    assert total == pytest.approx(1, abs=1e-9)
    return out


def compare(rows, train, got):
    want = sorted(((str(d), *r) for (d, _), r in zip(rows, brute(train, [t for _, t in rows]), strict=True)))
    found = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(found, want, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    compare(rows, [t for d, t in rows if zlib.crc32(str(d).encode()) % 10], lm.op10_kneser_ney(spark, sf).collect())


def test_held_out_texts_are_likelier_than_under_unigrams(spark):
    got = lm.op10_kneser_ney(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_awkward_rows_and_small_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 50)
    monkeypatch.setattr(lm, "RUN", 7)
    monkeypatch.setattr(lm, "BUCKET", 100)
    rows = [r[:2] for r in AWKWARD] + [(i, "a b c a b d A B") for i in range(20, 40)]
    folder = write(spark, documents(spark, rows), tmp_path)
    compare(rows, [t for d, t in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 10], lm.op10_kneser_ney(spark, folder).collect())


def test_empty_tables(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    model = lm.train(docs.where("false"))
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score(docs, model).orderBy("doc_id").collect()] == [(3, 0, 0, 0), (1, 0, 0, 0)]
    assert lm.score(docs.where("false"), lm.train(docs)).count() == 0


def test_blobs_round_trip():
    keys, counts = np.array([0, 5, 1 << 63, (1 << 64) - 1], dtype=np.uint64), np.array([1, 2, 3, 1 << 40])
    a, b = lm.unpack(lm.pack(keys, counts))
    assert (a == keys).all() and (b == counts).all()
    x, y = lm.summed([lm.pack(keys, counts), lm.pack(keys[1:], counts[1:])], 1)
    assert (x == keys).all() and y.tolist() == [1, 4, 6, 1 << 41]


def test_counts_of_counts_of_repetitive_texts_leave_mass_in_every_context(spark):
    assert (0 < lm.discounts(np.array([9, 3, 90, 0]))[1:]).all() and (0 < lm.discounts(np.array([0, 0, 0, 0]))[1:]).all()
    assert (0 < lm.discounts(np.array([5, 0, 7, 1]))[1:]).all() and (lm.discounts(np.array([1, 50, 90, 9]))[1:] <= [1, 2, 3]).all()
    train = [" ".join(f"w{k}" for k in range(40))] * 3 + ["a b a b c c"] * 2 + ["d", "e f"]
    rows = [(k, t) for k, t in enumerate([*train, "w0 c b unseen d", "unseen", "w3 w4 w5 a"])]
    model = lm.train(documents(spark, list(enumerate(train))))
    got = lm.score(documents(spark, rows), model).collect()
    assert all(np.isfinite(r.score) for r in got)
    compare(rows, train, got)


def test_token_hashes_tell_words_apart_at_every_cut(monkeypatch):
    texts = [None, "", "  ", "a b", "a\x00b c", "x" * 1000 + " y", "x" * 300, "abcdefgh abcdefghi ABCDEFGHI", "\xe9 \xfc\xa0z", "end", "start", "\t\x08\x0e\x1f a@[`{Z z"] * 2
    want = [(i, w) for i, t in enumerate(texts) for w in [*(t or "").encode().lower().split(), b"\n"]]
    for stretch in (1, 16, 50, 1000):
        monkeypatch.setattr(words, "STRETCH", stretch)
        got = [x for r, h in words.token_stream(pa.array(["before", *texts]).slice(1)) for x in zip(r.tolist(), h.tolist(), strict=True)]
        assert [i for i, _ in got] == [i for i, _ in want]
        known = dict(zip((w for _, w in want), (h for _, h in got), strict=True))
        assert [known[w] for _, w in want] == [h for _, h in got] and len(set(known.values())) == len(known)
    assert list(words.token_stream(pa.array([], pa.string()))) == []
