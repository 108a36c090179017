"""Rows and decisions as a service hands them over, checked before they run."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from kinfold.config import Config
from kinfold.schema import CONSTRAINTS, MAPPED, ROWS
from kinfold.sources.csv import read_text


def request(spark: SparkSession, body: dict[str, Any]) -> tuple[DataFrame, Config, DataFrame]:
    """(rows, config, constraints) of ``{"rows" or "csv", "config", "constraints"}``; ValueError if it is none."""
    if not isinstance(body, dict) or not (body.get("rows") or body.get("csv")):
        raise ValueError("a request needs rows or csv")
    if body.get("rows"):
        rows = from_objects(spark, body["rows"])
    else:
        file = read_text(spark, body["csv"])
        if not file.mapping or file.rows.isEmpty():
            raise ValueError("the file has no rows or no column that is known")
        rows = file.rows
    return rows, Config().with_changes(body.get("config")), decisions(spark, body.get("constraints") or [])


def from_objects(spark: SparkSession, objects: list[dict[str, Any]]) -> DataFrame:
    """Objects with ``id``, and optionally ``mapped``, ``raw`` and ``true_person_id``."""
    out = []
    for i, o in enumerate(objects):
        if not isinstance(o, dict) or not isinstance(o.get("id"), str) or not o["id"]:
            raise ValueError(f"row {i}: id must be a text that is not empty")
        mapped, raw = o.get("mapped") or {}, o.get("raw") or {}
        if unknown := set(mapped) - set(MAPPED):
            raise ValueError(f"row {i}: unknown columns {sorted(unknown)}")
        out.append((o["id"], *(mapped.get(c) for c in MAPPED), {k: str(v) for k, v in raw.items()}, o.get("true_person_id")))
    return spark.createDataFrame(out, ROWS)


def decisions(spark: SparkSession, objects: list[dict[str, Any]]) -> DataFrame:
    out = []
    for i, o in enumerate(objects):
        if o.get("kind") not in ("link", "must-not-link") or o.get("by", "human") not in ("human", "derived"):
            raise ValueError(f"constraint {i}: kind must be link or must-not-link, and by human or derived")
        if not o.get("a") or not o.get("b"):
            raise ValueError(f"constraint {i}: a and b must be row ids")
        out.append((o["kind"], o["a"], o["b"], o.get("by", "human"), o.get("note")))
    return spark.createDataFrame(out, CONSTRAINTS)
