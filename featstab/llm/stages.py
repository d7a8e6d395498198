"""Stages of a corpus pipeline: each takes documents and returns documents, by one of the operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import language, mixing, packing, pii, simhash
from .common import fold


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identifiable language. Null, empty and letterless texts go, and those between two languages.

    Learned from the labelled texts among ``docs``; without any, no language can be identified and no document stays."""
    del spark, sf_dir
    return language.accepted(docs, language.learn(docs.where(fold("doc_id", 3) != 1)))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (sets of five-word shingles, similarity 0.8): that of the least id, ties by content.

    Documents of a null id alone form a group as others do; of equal rows one stays."""
    del spark, sf_dir
    names = docs.columns
    marks = [c for n in names for c in (F.col(n), F.col(n).isNull())]
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"), F.col("doc_id").alias("_id"), F.xxhash64(*marks).alias("_a"), F.xxhash64(F.lit(1), *marks).alias("_b"))
    found = simhash.similar(rows.drop("_row"), shingle=5, similarity=0.8, text="_text", carried=("_id", "_a", "_b"))
    first = found.groupBy("label").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_a", "_b")).alias("x")).select("x._a", "x._b")
    # equal rows meet here before their texts are dealt out, and join where they lie
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_a", "_b").orderBy("_id"))).where("_n = 1")
    return rows.join(first, ["_a", "_b"], "left_semi").select(*(F.col("_row")[c].alias(c) for c in names))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data pseudonymised under the configured key and its length set anew.

    Null and empty texts stay as they are, repeated rows stay equal, an empty table stays empty; columns keep names, types and order,
    also those named like a count of the operator's."""
    del sf_dir
    names = docs.columns
    found = pii.pseudonymised(docs.select(F.struct("*").alias("_kept"), F.col("text").alias("_own")), pii.configured_key(spark), text="_own")
    made = {"text": F.col("_own")} | ({"n_chars": F.length("_own").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return found.select(*(made.get(c, F.col("_kept")[c]).alias(c) for c in names))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, in training order: some repeatedly, some not, at most one of a source cut.

    Null and empty texts have no words and are never taken; null sources are one source; rows that repeat a key are documents of their
    own, ties are ordered by content. An empty table stays empty."""
    del spark, sf_dir
    return mixing.mix(docs)


def in_written_order(docs: DataFrame) -> DataFrame:
    """The rows in the order in which they were written, range-sorted: files by their part number, rows by their place in the file.

    Spark deals files out by size. Tables that are not read from files are in order as they are."""
    try:
        file, row = (docs.metadataColumn("_metadata")[c] for c in ("file_name", "row_index"))
        return docs.select(*docs.columns, F.regexp_extract(file, r"part-(\d+)", 1).try_cast("long").alias("_part"), file.alias("_file"), row.alias("_row")).orderBy("_part", "_file", "_row").select(*docs.columns)
    except AnalysisException:
        return docs


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens, in the order in which the documents were written: sequence ids rise with it.

    Null and empty texts are their end alone, rows that repeat a key are packed each, a null key stays null; other columns are not read.
    An empty table gives no pieces."""
    del spark, sf_dir
    import public_tokenizers

    return packing.pack(in_written_order(docs.select("doc_id", "text")), public_tokenizers.path("byte_bpe_50k.json"))
