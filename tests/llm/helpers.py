"""Small document tables with the awkward cases."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


LONG = "the quick brown fox jumps over the lazy dog again and again. " * 5000
AWKWARD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (None, "a null key"), (5, LONG, "en", "s"), (6, "Ünïcödé ﷽ 漢字   words"), (7, "x" * 100_000)]


def write(spark: SparkSession, df: DataFrame, folder, name: str = "documents") -> str:
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
