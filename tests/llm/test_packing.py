import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from featstab.llm import packing
from featstab.llm.common import table

from .helpers import AWKWARD, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, pieces, window=1024):
    """Every id lies in one piece, windows are gapless and short enough; returns the share of padding."""
    tokenizer, want = Tokenizer.from_file(PATH), defaultdict(list)
    for d, t in rows:
        want[d].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4"))
    by, length = defaultdict(list), defaultdict(int)
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == length[r.sequence_id]
        length[r.sequence_id] += r.length
        by[r.doc_id].append(r)
    assert max(length.values()) <= window and by.keys() == want.keys()
    for d, texts in want.items():
        left = [(len(ids), ids) for ids in texts]
        assert sum(r.length for r in by[d]) == sum(n for n, _ in left)
        for r in by[d]:
            assert any(r.doc_tokens == n and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for n, ids in left)
        if len(texts) == 1:
            spans = sorted((r.start, r.length) for r in by[d])
            assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    pad = sum(0 if n & (n - 1) == 0 else window - n for n in length.values())
    return pad / sum(length.values())


def test_query_round_trip(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert check(rows, packing.op5_order_preserving_packing(spark, sf).collect()) < 0.02


def test_awkward_rows(spark):
    rows = [r[:2] for r in AWKWARD] + [(30, "ends <|endoftext|> within"), (31, "\x1c\x85  odd spaces \u0000"), (32, "a" * 5000), (33, "Good. " * 3000)]
    docs = documents(spark, rows).selectExpr("*", "1 AS start", "2 AS length")
    check(rows, packing.pack(docs, PATH).collect())
    assert packing.pack(docs.where("false"), PATH).count() == 0


def test_ids_and_order(spark):
    rows = [(i, f"Document {i} has a few words. " * (1 + i % 40)) for i in range(120)]
    got = packing.pack(documents(spark, rows).coalesce(1), PATH, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in got)
    placed = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    assert [(r.doc_id, r.start) for r in placed] == sorted((r.doc_id, r.start) for r in placed)


def cost(where, penalty, settings, cuts):
    total = 0.0
    for a, b in zip(cuts, cuts[1:], strict=False):
        n = where[b] - where[a]
        if n > settings.window:
            return np.inf
        free = n >= settings.short and n & (n - 1) == 0
        total += (0 if free else settings.window - n) + penalty[b] + settings.window_cost
    return total


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    settings = packing.Settings(window=16, short=4)
    where = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 11))])
    penalty = rng.choice([0.0, 1.0, 4.0], 12)
    got = packing.best_cuts(where, penalty, settings)
    at = {p: i for i, p in enumerate(where.tolist())}
    best = min(cost(where, penalty, settings, [0, *inner, 11]) for n in range(11) for inner in combinations(range(1, 11), n))
    assert cost(where, penalty, settings, [at[p] for p in got]) == pytest.approx(best)


def test_runs_of_white_space(spark):
    rows = [(1, " " * 1_000_000 + "end"), (2, "a" + "\n" * 300_000), (3, "b " + " \n\t" * 3000 + "c d"), (4, " " * 8191 + "x")]
    check(rows, packing.pack(documents(spark, rows), PATH).collect())


def test_blocks_leave_no_cuts_of_their_own(spark):
    """Long documents go through in bounded blocks, and the pieces cost what those of one block do."""
    rows = [(1, "Some words make a sentence of their own. " * 3000), (2, "short"), (3, "no end in sight " * 2000), *((k, f"Text {k}. " * (k % 97)) for k in range(4, 200))]
    docs = documents(spark, rows).coalesce(1)
    small, large = (packing.pack(docs, PATH, settings=packing.Settings(window=64, short=16, block=b, ahead=512)).collect() for b in (2048, 1 << 18))
    a, b = check(rows, small, 64), check(rows, large, 64)
    assert a <= b + 0.002 and len(small) <= 1.01 * len(large)
    order = [(r.doc_id, r.start) for r in sorted(small, key=lambda r: (r.sequence_id, r.offset))]
    assert order == sorted(order)
