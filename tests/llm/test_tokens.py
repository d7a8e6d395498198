"""Prefix counts against the tokenizer library, prefix by prefix; truncation and budgets against brute force."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from featstab.llm import tokens
from featstab.llm.common import table

from .helpers import AWKWARD, DOCS, documents, write

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'", "s", "ll", "'re", "'v", "e", "é", "漢", "ß", "1", "23", "½", "!", "<|endoftext|>", "<|end", "|>", "\xa0", "　", "\u0085", "\x1c", "\x0b", "The", " quick", "ing", "ﷺ", "😀", "́", "xx", "==", "٣", "᠎", "​", "'S"]


def of_prefixes(text):
    return [len(e.ids) for e in LIBRARY.encode_batch([text[:k] for k in range(1, len(text) + 1)], add_special_tokens=False)]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), st.text(max_size=20)))
def test_every_prefix(text):
    assert tokens.counter(PATH)(text).tolist() == of_prefixes(text)


def test_long_runs_and_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "UNITS", 3)
    monkeypatch.setattr(tokens, "PAIRS", 500)
    count, draw = tokens.PrefixCounter(PATH), random.Random(7)
    for text in ["x" * 50_000, " " * 50_000, "\n" * 50_000 + "a", "=" * 50_000, "ab" * 20_000 + "c", "".join(draw.choice("etaoin shrdlu") for _ in range(5000))]:
        assert int(count(text)[-1]) == len(LIBRARY.encode(text, add_special_tokens=False).ids)
        assert count(text)[:60].tolist() == of_prefixes(text[:60])
    assert len(count.units) <= 3 and count.n_pairs <= 500


def test_whole_table_and_query(spark, sf):
    got = {r["doc_id"]: r for r in __import__("featstab.llm.queries", fromlist=["QUERIES"]).QUERIES["op12_prefix_tokens"](spark, sf).collect()}
    docs = table(spark, sf, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        n = len(LIBRARY.encode(d["text"] or "", add_special_tokens=False).ids)
        assert tuple(got[d["doc_id"]]) == (d["doc_id"], len((d["text"] or "").encode()), n, n > 1024)


def test_awkward_documents(spark, tmp_path):
    docs = documents(spark, AWKWARD).withColumn("n_tokens", F.lit("clash")).withColumn("counts", F.lit(0))
    rows = tokens.prefix_counts(docs, PATH, limits=(0, 3)).collect()
    want = sorted(((k, len((t or "").encode()), len(t or ""), len(LIBRARY.encode(t or "", add_special_tokens=False).ids)) for k, t in [r[:2] for r in AWKWARD]), key=str)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_chars"], r["n_tokens"]) for r in rows), key=str) == want
    assert all(len(r["counts"]) == r["n_chars"] and r["chars_0"] == 0 for r in rows)
    folder = write(spark, documents(spark, AWKWARD), tmp_path)
    assert tokens.op12_prefix_tokens(spark, folder).where("over_limit").count() == 2
    none = spark.createDataFrame([], DOCS)
    assert tokens.prefix_counts(none, PATH).collect() == [] and tokens.within_budget(tokens.prefix_counts(none, PATH), 5, [F.col("doc_id")]).collect() == []


def test_truncation_from_stored_counts(spark):
    texts = ["one two three four", "a  b\n\nc", "don't 'll x", "漢字かな and more", "", "<|endoftext|>a<|endoftext|>"]
    stored = tokens.prefix_counts(documents(spark, list(enumerate(texts))), PATH, limits=(3,))
    shown = stored.select("doc_id", "chars_3", tokens.longest_within(F.col("counts"), F.lit(3)).alias("again"), tokens.tokens_in(F.col("counts"), F.lit(2)).alias("two"), tokens.tokens_in(F.col("counts"), F.lit(0)).alias("none"))
    for r in shown.collect():
        counts = of_prefixes(texts[r["doc_id"]])
        assert r["chars_3"] == r["again"] == max([i + 1 for i, c in enumerate(counts) if c <= 3], default=0)
        assert r["two"] == (counts[1] if len(counts) > 1 else None) and r["none"] == 0


@pytest.mark.parametrize("budget", [0, 1, 17, 10_000])
def test_budget(spark, budget):
    draw = random.Random(3)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randrange(0, 9))) for _ in range(40)]
    got = tokens.within_budget(tokens.prefix_counts(documents(spark, list(enumerate(texts))), PATH), budget, [F.col("doc_id").desc()]).collect()
    left, want = budget, []
    for k in reversed(range(40)):
        counts = [0, *of_prefixes(texts[k])]
        cut = len(texts[k]) if counts[-1] <= left else max(i for i, c in enumerate(counts) if c <= max(left, 0)) if left > 0 else 0
        want.append((k, counts[-1], budget - left, cut, counts[cut]))
        left -= counts[-1]
    assert sorted(map(tuple, got)) == sorted(want)


def test_files_of_other_kinds_are_refused():
    with pytest.raises(ValueError):
        tokens.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))
