import zlib

import zstandard
from pyspark.sql import functions as F

from featstab.llm import language
from featstab.llm.common import table

from .helpers import AWKWARD, documents


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = language.op6_compression_language(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) < 0.02 * len(got)


def test_held_out_labels_and_sources_change_nothing(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    shown = lambda folder: sorted(map(str, language.op6_compression_language(spark, folder).collect()))
    assert shown(sf) == shown(str(tmp_path))


TEXTS = {"aa": "wun tuu srii foor faif siks sevn eit nain ten ", "bb": "eins zwei drei vier fuenf sechs sieben acht neun "}


def test_awkward_rows(spark):
    labelled = documents(spark, [(i, TEXTS[k] * (1 + i), k) for i in range(3) for k in TEXTS] + [(9, None, "cc"), (10, "123", "cc"), (11, "text", None)])
    known = language.learn(labelled)
    assert set(known) == {"aa", "bb"}
    docs = documents(spark, [r[:2] for r in AWKWARD] + [(20, "FUENF SECHS SIEBEN ACHT NEUN"), (21, "123 !?"), (22, "tuu srii foor faif")]).selectExpr("*", "1 AS score", "2 AS rejected")
    got = language.identify(docs, known).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[20].lang_pred == "bb" and by[22].lang_pred == "aa"
    for k in (1, 2, 3, 21):
        assert (by[k].lang_pred, by[k].score, by[k].rejected) == ("und", 0.0, True)
    assert all(r.lang_pred in ("aa", "bb", "und") for r in got)
    kept = language.accepted(docs, known)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.rejected)


def test_nothing_learned_and_empty_table(spark):
    docs = documents(spark, [(1, "some words", None)])
    assert language.learn(docs) == {} and [r.lang_pred for r in language.identify(docs, {}).collect()] == ["und"]
    one = language.identify(docs, {"aa": b"some"}).first()
    assert (one.lang_pred, one.score, one.rejected) == ("aa", 1.0, False)
    assert language.identify(docs.where("false"), {"aa": b"x"}).count() == 0


def test_sample_is_bounded_and_repeats(spark, sf):
    docs = table(spark, sf, "documents")
    small = language.Settings(pieces=5, piece=300)
    a, b = language.learn(docs, small), language.learn(docs.repartition(7).withColumn("doc_id", F.lit(None)), small)
    assert a == b and a and all(len(v.decode()) <= 5 * 301 for v in a.values())


def test_copies_teach_once_and_all_of_a_text_is_sampled(spark):
    long = " ".join(f"wort{k}" for k in range(4000))
    docs = documents(spark, [(1, "kopie einer kopie " * 20, "de")] * 3000 + [(k, f"nummer {k} von vielen", "de") for k in range(40)] + [(9, long, "en")])
    known = language.learn(docs, language.Settings(pieces=30, piece=100))
    assert known["de"].count(b"\n") == 29 and sum(known["de"].count(f"nummer {k} ".encode()) for k in range(40)) > 15
    places = [long.encode().find(p) for p in known["en"].split(b"\n")]
    assert len(places) == 30 and min(places) >= 0 and max(places) > len(long) / 2


def test_numbers_are_no_letters(spark):
    docs = documents(spark, [(1, "\u00b2"), (2, "\u00bd \u2462"), (3, "\u216b \u0663 _"), (4, "\u00aa"), (5, "\u4e00")])
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, {"aa": b"some", "bb": b"words"}).collect()}
    assert [got[k] for k in (1, 2, 3)] == ["und"] * 3 and "und" not in (got[4], got[5])
    letters = {r.doc_id for r in docs.where(F.col("text").rlike(r"\p{L}")).collect()}
    assert letters == {4, 5}


def test_query_equals_brute_force(spark, sf):
    """Sizes by plain calls of the compressor, whole texts, for every document."""
    docs = table(spark, sf, "documents")
    known = language.learn(docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1))
    want = {}
    for r in docs.collect():
        text = (r.text or "").lower().encode()
        if not any(c.isalpha() for c in r.text or ""):
            want[r.doc_id] = "und"
            continue
        sizes = []
        for rank, (name, raw) in enumerate(known.items()):
            packer = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sizes.append((sum(len(packer.compress(text[i : i + 2048])) for i in range(0, len(text), 2048)), rank, name))
        want[r.doc_id] = min(sizes)[2]
    got = {r.doc_id: r.lang_pred for r in language.op6_compression_language(spark, sf).collect()}
    assert got.keys() == want.keys() and sum(got[k] == want[k] for k in got) >= 0.99 * len(got)
