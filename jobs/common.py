"""What the jobs share: their settings, log and marks."""

from __future__ import annotations

import json
import logging
from dataclasses import fields
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def settings(kind: type, path: str | None, default: str) -> Any:
    """kind filled from a JSON file, by default the one beside the job. ValueError for a key that the job hasn't got."""
    given = json.loads(Path(path or Path(__file__).with_name(default)).read_text())
    if unknown := sorted(set(given) - {f.name for f in fields(kind)}):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return kind(**given)


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"cladeframe.{name}")


def show_log() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")


def if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The Parquet table at path; None if nothing was written there."""
    try:
        return spark.read.option("basePath", path).schema(schema).parquet(path)
    except AnalysisException:
        return None
