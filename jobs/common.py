"""What the jobs share: settings from a small file, a command line, a folder that all executors see."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields, replace
from pathlib import Path
from typing import TypeVar

from pyspark.sql import SparkSession

S = TypeVar("S")


def settings_from(path: str, default: S) -> S:
    """``default`` with what the JSON file at ``path`` says otherwise; a name that it does not have is an error."""
    said = json.loads(Path(path).read_text())
    unknown = set(said) - {f.name for f in fields(default)}
    if unknown:
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return replace(default, **said)


def command_line(about: str, config: str, default: S, run: Callable[..., dict], *paths: str) -> None:
    """``--config`` and an option for each path; makes a session, runs the job and stops the session."""
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", default=str(Path(__file__).with_name(config)))
    for name in paths:
        parser.add_argument(f"--{name}", required=True, help="a path that Spark reads or writes")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    settings = settings_from(args.config, default)
    spark = SparkSession.builder.appName(config.partition(".")[0]).getOrCreate()
    try:
        run(spark, *(getattr(args, p) for p in paths), settings)
    finally:
        spark.stop()
