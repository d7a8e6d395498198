"""From raw documents to packed training windows.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), where docs is what the stage before has kept, and returns
documents, the last one pieces of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featstab.llm import stages
from featstab.llm.common import keep, table

STAGES = [
    ("language", stages.by_language),
    ("near_copies", stages.without_near_copies),
    ("personal_data", stages.without_personal_data),
    ("mix", stages.mixed),
    ("pack", stages.packed),
]

#: SQL has no fingerprint groups, compression or token ids; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
