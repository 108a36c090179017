"""``python -m kinfold FILE FOLDER [--config JSON] [--decisions REVIEW_CSV]``: one lead file, linked.

Writes ``cleaned.csv``, ``review.csv`` and ``audit.json`` to FOLDER and prints a line of counts.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from kinfold.config import Config
from kinfold.plans.clean import clean
from kinfold.sources import csv, sinks


def main() -> None:
    parser = argparse.ArgumentParser(prog="kinfold", description=__doc__)
    parser.add_argument("file")
    parser.add_argument("folder", type=Path)
    parser.add_argument("--config", type=json.loads, default={}, help="settings as JSON")
    parser.add_argument("--decisions", help="a review file with its decision column filled in")
    asked = parser.parse_args()
    spark = SparkSession.builder.appName("kinfold").getOrCreate()
    decided = None
    if asked.decisions:
        decided = sinks.decided(spark, spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(asked.decisions))
    result = clean(csv.read_file(spark, asked.file).rows, Config().with_changes(asked.config), decided)
    asked.folder.mkdir(parents=True, exist_ok=True)
    for name, text in (("cleaned.csv", sinks.csv_text(sinks.cleaned(result))), ("review.csv", sinks.csv_text(sinks.review(result))), ("audit.json", sinks.audit(result))):
        (asked.folder / name).write_text(text, encoding="utf-8", newline="")
    print(result.summary())


if __name__ == "__main__":
    main()
