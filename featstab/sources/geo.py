"""Series matrices and platform annotations as a Spark data source.

``spark.read.format("geo_text")`` reads the line-oriented text files of public expression archives, gzipped or not, one partition per
file, as rows (file, section, key, occurrence, cells): header lines, the table's column names, and its lines between the begin and end
marks. A line stays one row, in Arrow batches; cells are taken apart by Spark's own expressions, with the names of a file's columns
broadcast to its lines."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, section string, key string, occurrence int, cells array<string>"
ARROW = pa.schema([("file", pa.string()), ("section", pa.string()), ("key", pa.string()), ("occurrence", pa.int32()), ("cells", pa.list_(pa.string()))])
#: Marks of the tables.
TABLES = {"series": ("!series_matrix_table_begin", "!series_matrix_table_end"), "platform": ("!platform_table_begin", "!platform_table_end")}
#: Lines of a batch.
BATCH = 512


class FormatError(ValueError):
    """A file without a table."""


class OrderError(ValueError):
    """The columns of a matrix aren't the samples of its header, in their order."""


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def lines(path: str) -> Iterator[str]:
    """Text lines of a path or URI; broken UTF-8 is replaced."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_stream(inner, compression="gzip" if path.endswith(".gz") else None) as stream:
        yield from (line.rstrip("\r\n") for line in io.TextIOWrapper(stream, encoding="utf-8", errors="replace"))


def parsed(path: str, kind: str, ids_only: bool) -> Iterator[tuple[str, str, str, int, list[str]]]:
    """Rows of one file; ``ids_only`` gives the table's first column alone."""
    begin, end = TABLES[kind]
    seen: dict[str, int] = {}
    row, quoting = -1, csv.QUOTE_MINIMAL if kind == "series" else csv.QUOTE_NONE
    for line in lines(path):
        if line.lower() == begin:
            row = 0
        elif line.lower() == end:
            if row < 2:
                break
            return
        elif row < 0:
            if line.startswith("!") and not ids_only:
                key, *cells = line.split("\t") if "\t" in line else line.split(" = ", 1)
                n = seen.get(key, 0)
                seen[key] = n + 1
                yield path, "header", key[1:], n, [c.strip().strip('"') for c in cells]
        elif cells := next(csv.reader([line], delimiter="\t", quoting=quoting)):
            yield path, "table" if row else "columns", cells[0], max(0, row - 1), [] if ids_only else cells[1:]
            row += 1
    if row < 2:
        raise FormatError(f"no table in {path}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_File(p) for p in self.options["path"].split(",")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)
        for found in parsed(partition.path, self.options.get("kind", "series"), str(self.options.get("idsonly", self.options.get("idsOnly", "false"))).lower() == "true"):
            held.append(found)
            if len(held) == BATCH:
                yield batch()
                held.clear()
        if held:
            yield batch()


class GeoText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geo_text"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def rows(spark: SparkSession, path: str, kind: str = "series", ids_only: bool = False) -> DataFrame:
    spark.dataSource.register(GeoText)
    return spark.read.format("geo_text").option("kind", kind).option("idsOnly", str(ids_only).lower()).load(path)


def _table(found: DataFrame) -> DataFrame:
    """file, occurrence, key, cells, names of every line of a table: the names are one row per file."""
    names = found.where("section = 'columns'").select("file", F.col("cells").alias("names"), F.col("key").alias("first_name"))
    return found.where("section = 'table'").select("file", "occurrence", "key", "cells").join(F.broadcast(names), "file")


def read_series_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header: key, occurrence, pos, value; values: probe_id, sample_id, x). Empty cells are null."""
    found = rows(spark, path)
    header = found.where("section = 'header'").select("key", "occurrence", F.posexplode("cells").alias("pos", "value"))
    cells = _table(found).select(F.col("key").alias("probe_id"), "names", F.posexplode("cells").alias("pos", "value"))
    return header, cells.select("probe_id", F.get("names", F.col("pos")).alias("sample_id"), F.expr("try_cast(value AS double)").alias("x"))


def misplaced(spark: SparkSession, path: str) -> DataFrame:
    """pos, column, sample where a matrix's column isn't the header's sample of that place: must be empty."""
    found = rows(spark, path)
    columns = found.where("section = 'columns'").select(F.posexplode("cells").alias("pos", "column"))
    samples = found.where("section = 'header' and key = 'Sample_geo_accession' and occurrence = 0").select(F.posexplode("cells").alias("pos", "sample"))
    return columns.join(samples, "pos", "full_outer").where(~F.col("column").eqNullSafe(F.col("sample")))


def read_probe_ids(spark: SparkSession, path: str) -> DataFrame:
    """The first column, without looking at the values."""
    return rows(spark, path, ids_only=True).where("section = 'table'").select(F.col("key").alias("probe_id"))


def read_platform(spark: SparkSession, path: str, symbol: str = "Gene symbol", entrez: str = "Gene ID") -> DataFrame:
    """probe_id, symbol, entrez: text as it stands, quotes and empty cells included. The first column holds the ids."""
    lines_of = _table(rows(spark, path, "platform"))
    cell = lambda name: F.coalesce(F.get("cells", (F.array_position("names", F.lit(name)) - 1).cast("int")), F.lit(""))
    return lines_of.select(F.col("key").alias("probe_id"), cell(symbol).alias("symbol"), cell(entrez).alias("entrez"))


def sample_table(header: DataFrame) -> DataFrame:
    """A row per sample: sample_id, title, source_name, description, and a column for each characteristic.

    Characteristics are ``key: value``; where the samples of a row differ in the key, the column is named by all of its keys."""
    one = lambda key, name: header.where((F.col("key") == key) & (F.col("occurrence") == 0)).select("pos", F.col("value").alias(name))
    table = one("Sample_geo_accession", "sample_id")
    for key, name in (("Sample_title", "title"), ("Sample_source_name_ch1", "source_name"), ("Sample_description", "description")):
        table = table.join(one(key, name), "pos", "left")
    part = F.split("value", ":", 2)
    facts = header.where((F.col("key") == "Sample_characteristics_ch1") & F.col("value").contains(":")).select("occurrence", "pos", F.trim(part[0]).alias("k"), F.trim(part[1]).alias("v"))
    names = facts.groupBy("occurrence").agg(F.array_join(F.array_sort(F.collect_set("k")), "|").alias("name"))
    wide = facts.join(names, "occurrence").groupBy("pos").pivot("name").agg(F.first("v"))
    return table.join(wide, "pos", "left").withColumn("description", F.coalesce("description", F.lit(""))).drop("pos")
