import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from featstab.llm import stages
from featstab.llm.common import keep, table

from .helpers import AWKWARD, documents


def shingles(text, k=5):
    w = text.encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.fixture(scope="module")
def steps(spark, sf):
    """The rows after each stage but the last, and the pieces."""
    docs, out = table(spark, sf, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append([r.asDict() for r in docs.collect()])
        docs = stage(spark, docs, sf).cache()
    return [*out, [r.asDict() for r in docs.collect()]]


def test_names_and_columns(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "personal_data", "mix", "pack"]
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_keeps_clean_documents(steps):
    before, after = {r["doc_id"]: r for r in steps[0]}, {r["doc_id"]: r for r in steps[1]}
    assert all(before[k] == r for k, r in after.items())
    gone = [r for k, r in before.items() if k not in after]
    assert len(gone) < 0.03 * len(before) and all(len(r["text"]) < 40 for r in gone if re.search("[a-z]{3}", r["text"]))


def test_near_copies_equal_brute_force(steps):
    sets = {r["doc_id"]: shingles(r["text"]) for r in steps[1]}
    ids, root = sorted(sets), {}
    by = defaultdict(set)
    for d in ids:
        for s in sets[d]:
            by[s].add(d)
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    for d in ids:
        for o in {o for s in sets[d] for o in by[s] if o > d}:
            if len(sets[d] & sets[o]) >= 0.8 * len(sets[d] | sets[o]):
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
    want = {d for d in ids if find(d) == d}
    got = {r["doc_id"] for r in steps[2]}
    assert got <= set(ids) and len(want ^ got) <= 0.02 * len(ids), (want - got, got - want)


def test_personal_data_is_gone_and_nothing_else_changes(steps):
    before, after = {r["doc_id"]: r for r in steps[2]}, {r["doc_id"]: r for r in steps[3]}
    assert before.keys() == after.keys()
    private = re.compile(r"\b[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}")
    found = 0
    for k, r in before.items():
        for m in private.findall(r["text"]):
            found += 1
            assert m not in after[k]["text"]
        assert len(after[k]["text"]) == after[k]["n_chars"] and len(after[k]["text"].split()) == len(r["text"].split())
    assert found


def test_mix_and_packing(steps):
    words = lambda rows: sum(len(r["text"].encode().split()) for r in rows)
    assert words(steps[4]) == pytest.approx(1.5 * words(steps[3]), rel=0.001)
    assert {r["doc_id"] for r in steps[5]} == {r["doc_id"] for r in steps[4]}
    length = defaultdict(int)
    for r in sorted(steps[5], key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == length[r["sequence_id"]]
        length[r["sequence_id"]] += r["length"]
    assert max(length.values()) <= 1024


def test_awkward_rows_and_empty_tables(spark, sf):
    docs = documents(spark, [(*r[:2], "en", None) for r in AWKWARD] + [(i, f"some words in a text of its own, number {i}", "en", "s") for i in range(10, 20)])
    docs = docs.selectExpr("*", "1 AS fp", "2 AS _row", "3 AS rejected", "4 AS n_card")
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, sf).count() == 0
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns and got.count() > 0
    assert stages.packed(spark, docs, sf).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert stages.packed(spark, empty, sf).count() == 0
    assert stages.by_language(spark, docs.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars"), sf).count() == 0


def test_one_survivor_of_each_component_whatever_the_ids(spark, sf):
    """Unlike documents of one id both stay; near copies of null ids merge."""
    text = lambda k, n=80: [f"{k}word{i}" for i in range(n)]
    near = lambda k: " ".join([*text(k)[:-1], "changed"])
    rows = [(1, " ".join(text("a"))), (2, near("a")), (1, " ".join(text("b"))), (3, near("b")), (None, " ".join(text("c"))), (None, near("c")), (None, " ".join(text("d"))), (4, near("d")), (5, " ".join(text("e"))), (5, " ".join(text("e")))]
    got = stages.without_near_copies(spark, documents(spark, [(*r, "en", "s") for r in rows]), sf).collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in got) == [("1", "a"), ("1", "b"), ("4", "d"), ("5", "e"), ("None", "c")]


def test_packing_follows_the_training_order_of_written_tables(spark, sf):
    """Spark reads large files first; sequence ids follow the order in which the mix wrote its rows."""
    rows = [(i, " ".join(["word"] * (40 + 400 * (i // 100))) + f" {i}") for i in range(800)]
    written = keep(documents(spark, rows).repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id"), "ordered")
    assert len(written.inputFiles()) == 8
    first = stages.packed(spark, written, sf).groupBy("doc_id").agg(F.min(F.struct("sequence_id", "offset")).alias("at")).collect()
    assert [r.doc_id for r in sorted(first, key=lambda r: r["at"])] == list(range(800))
