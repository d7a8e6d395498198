"""Runs from the command line, over a folder of tables: ``python -m featstab.cli matrix --tables DIR --config FILE --folder DIR``.

matrix runs the configuration, null the same on permuted labels, grid regularisation strengths, report writes what is stored as
Markdown (with --null and --external, of those too). A command that was stopped goes on where it was.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .plans import report, runs
from .plans.provenance import Folder
from .session import session
from .sources import tables

log = logging.getLogger(__name__)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="featstab.cli", description="Runs of the study.")
    out.add_argument("command", choices=("matrix", "null", "grid", "report"))
    out.add_argument("--folder", required=True, help="where the run is, or will be")
    out.add_argument("--tables", help="folder of the input tables")
    out.add_argument("--config", help="YAML file")
    out.add_argument("--tree", default=".", help="working tree whose state the manifest records")
    out.add_argument("--replicates", type=int, default=30)
    out.add_argument("--strengths", type=float, nargs="+", default=[0.01, 0.1, 1.0, 10.0, 100.0])
    out.add_argument("--reference", type=float, default=1.0)
    out.add_argument("--least-auc", type=float, default=0.9)
    out.add_argument("--k", type=int, default=25)
    out.add_argument("--null", help="folder of the null, for the report")
    out.add_argument("--external", help="folder of the second cohort's analysis, for the report")
    return out


def execute(spark: SparkSession, given: argparse.Namespace) -> object:
    """One command in a session; returns what it made."""
    if given.command == "report":
        null = runs.compare_with_null(spark, given.folder, given.null) if given.null else None
        return report.write_report(spark, given.folder, given.k, null=null, external=Folder.of(given.external) if given.external else None)
    if not given.tables or not given.config:
        raise SystemExit("--tables and --config are needed")
    values, config = tables.cohort(spark, given.tables), runs.load_config(given.config)
    log.info("%s %s over %s into %s", given.command, config["name"], given.tables, given.folder)
    titles = tables.vector_titles(spark, given.tables) if config.get("subset") else None
    if given.command == "matrix":
        return runs.run_matrix(values, config, given.folder, given.tree, titles)
    if given.command == "null":
        return runs.run_null(values, config, given.folder, given.replicates, given.tree)
    return runs.run_regularisation(values, config, given.strengths, given.reference, given.least_auc, given.folder, given.k, given.tree)


def main(args: list[str] | None = None) -> None:
    given = parser().parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session()
    try:
        execute(spark, given)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
