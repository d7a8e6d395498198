"""Tables written once and read often: lineage ends in the folder that all executors share, so a lost executor loses nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a temporary folder serves a session of one machine, as in tests; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="featstab-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def contents_of(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of the files of a folder's tables, two levels deep: other contents, another identity."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for entry in system.listStatus(path):
        for f in system.listStatus(entry.getPath()) if entry.isDirectory() else [entry]:
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


_MEMORY: dict = {}


def forget() -> None:
    """Compute every shared step anew from here on."""
    _MEMORY.clear()


def shared(make: Callable) -> Callable:
    """``make(spark, sf_dir, ...)`` of an application once for each state of the folder's files and arguments; a DataFrame is kept().

    A table that is rewritten under its path is another state, so nothing stale is ever read."""

    @wraps(make)
    def run(spark: SparkSession, sf_dir: str, *args, **how):
        key = (make.__module__, make.__name__, spark.sparkContext.applicationId, sf_dir, contents_of(spark, sf_dir), args, tuple(sorted(how.items())))
        if key not in _MEMORY:
            found = make(spark, sf_dir, *args, **how)
            _MEMORY[key] = kept(found) if isinstance(found, DataFrame) else found
        return _MEMORY[key]

    return run
