"""What the jobs share: configuration from a small JSON file, logging, and a session for the command line alone."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def configured(kind: type, path: str | None, given: dict) -> object:
    """A configuration of class ``kind``: the file's settings, over which those given on the command line go. Unknown ones are errors."""
    found = {}
    if path:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    found |= {k: v for k, v in given.items() if v is not None}
    known = {f.name for f in fields(kind)}
    if strange := set(found) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(strange))}")
    return kind(**found)


def main(kind: type, run: Callable, args: list[str] | None = None) -> None:
    """The command line of a job: ``--config FILE`` and an option for each setting."""
    parser = argparse.ArgumentParser(description=run.__doc__)
    parser.add_argument("--config")
    for f in fields(kind):
        parser.add_argument(f"--{f.name.replace('_', '-')}", type=int if "int" in str(f.type) else str)
    given = vars(parser.parse_args(args))
    config = configured(kind, given.pop("config"), given)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, config)
    finally:
        spark.stop()
