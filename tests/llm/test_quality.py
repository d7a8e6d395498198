import re
from collections import Counter

import numpy as np
import zstandard

from featstab.llm import quality
from featstab.llm.common import table

from .helpers import AWKWARD, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, bands=quality.Bands()):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    raw, kept = text.encode(), not failed
    size = lambda b: len(zstandard.ZstdCompressor(level=bands.level, write_content_size=False).compress(b)) / len(b)
    fits = [(low, high) for least, low, high in bands.limits if len(raw) >= least]
    if kept and fits:
        kept = fits[-1][0] <= size(raw) <= fits[-1][1]
    chunks = [raw[i : i + bands.chunk] for i in range(0, len(raw), bands.chunk)]
    if len(chunks) > 1 and len(chunks[-1]) < bands.chunk:
        chunks[-1] = raw[-bands.chunk :]  # the last one ends with the text
    if kept and len(raw) >= bands.chunk and (bad := sum(not bands.chunk_limits[0] <= size(c) <= bands.chunk_limits[1] for c in chunks)):
        kept = bad < bands.chunk_share * len(chunks)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed, kept


def compare(rows, got):
    want = sorted(str((d, *brute(t))) for d, t in rows)
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)) for r in got.collect()) == want


def test_query_equals_brute_force(spark, sf):
    compare([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()], quality.op8_compression_bands(spark, sf))


def test_awkward_rows_and_empty_table(spark):
    rows = [*AWKWARD, (10, "a\n\na\n \na b c\na b c\n a\n"), (11, "  wide   spaces #*$%&|<>")]
    docs = documents(spark, [r[:2] for r in rows]).selectExpr("*", "1 AS ratio", "2 AS kept")
    compare([r[:2] for r in rows], quality.judge(docs))
    assert quality.judge(docs.where("false")).count() == 0


def test_bands_reject_repetition_and_noise_and_keep_prose(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(chr(97 + int(i)) for i in rng.integers(0, 26, int(rng.integers(2, 9))))
    vocabulary = [word() for _ in range(800)]
    prose = [" ".join(vocabulary[int(799 * rng.random() ** 2)] for _ in range(n)) for n in (60, 200, 3000)]
    noise = " ".join(bytes(rng.integers(33, 127, 30).astype(np.uint8)).decode() for _ in range(400))
    repeated = "\n".join(f"row {i % 7} of the same few words {i % 3} {i}" for i in range(3000))
    rows = [(i, t) for i, t in enumerate([*prose, noise, repeated])]
    assert {r.doc_id: r.kept for r in quality.judge(documents(spark, rows)).collect()} == {0: True, 1: True, 2: True, 3: False, 4: False}


def test_many_different_words():
    words = [str(i % 5).encode() for i in range(20)]
    assert quality.repeated_words(words) == 20 and quality.repeated_words([b"a", b"b", b"c", b"d"]) == 0


def test_bands_decide_beyond_the_counting_rules(spark):
    """Of labelled texts that pass those, nearly all good ones stay and half of the bad ones go; so does random base64."""
    sf = "/root/testdata/sf0.01"
    found = quality.op8_compression_bands(spark, sf).where("not base_failed").join(table(spark, sf, "labels"), "doc_id").groupBy("quality", "kept").count().collect()
    n = Counter({(r["quality"], r.kept): r["count"] for r in found})
    assert n[1, False] <= 0.01 * n[1, True] and n[0, False] >= n[0, True]
    rng = np.random.default_rng(0)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    noise = [(k, " ".join("".join(rng.choice(letters, 12)) for _ in range(size // 13))) for k, size in enumerate((700, 1500, 3000, 6000, 8000, 12000, 40000))]
    assert [(r.base_failed, r.kept) for r in quality.judge(documents(spark, noise)).collect()] == [(False, False)] * len(noise)


def test_the_end_of_a_text_is_judged(spark):
    rng = np.random.default_rng(1)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    vocabulary = ["".join(rng.choice(letters, int(rng.integers(2, 9)))) for _ in range(300)]
    prose = lambda n: " ".join(vocabulary[int(299 * rng.random() ** 2)] for _ in range(n))[: n * 4]
    bands = quality.Bands(limits=((1, 0.0, 2.0),), chunk_limits=(0.2, 0.7))
    packer = zstandard.ZstdCompressor(level=3, write_content_size=False)
    good = prose(2000)[:5000].encode()
    assert quality.ratios(good, bands, packer)[1:] == (2, 0, True)
    assert quality.ratios(good[:4096] + b"z" * 4000, bands, packer)[1:] == (2, 1, False)
    assert quality.ratios(b"z" * 4096, bands, packer)[1:] == (1, 1, False) and quality.ratios(b"z" * 4095, bands, packer)[1:] == (0, 0, True)
