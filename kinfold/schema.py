"""Schemas of the tables that go in and come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a lead row that the engine reads; all strings, all nullable.
MAPPED = ("full_name", "first_name", "last_name", "email", "phone", "company", "website", "title", "source", "updated_at")
ROWS = "id string, " + ", ".join(f"{c} string" for c in MAPPED) + ", raw map<string,string>, true_person_id string"
CONSTRAINTS = "kind string, a string, b string, by string, note string"
REASONS = "array<struct<rule:string,verdict:string,detail:string,weight:double>>"
EDGES = f"a string, b string, kind string, score double, reasons {REASONS}"
#: Fields of a surviving record, in the order of the output.
FIELDS = ("full_name", "email", "phone", "company", "domain", "title")


def as_rows(df: DataFrame) -> DataFrame:
    """``df`` as lead rows: the columns that are missing as nulls, all but ``id`` optional."""
    if "id" not in df.columns:
        raise ValueError("rows need a column id")
    columns = [F.col("id").cast("string").alias("id")]
    columns += [(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in MAPPED]
    columns.append((F.col("raw") if "raw" in df.columns else F.lit(None)).cast("map<string,string>").alias("raw"))
    columns.append((F.col("true_person_id") if "true_person_id" in df.columns else F.lit(None)).cast("string").alias("true_person_id"))
    return df.select(*columns)


def as_constraints(df: DataFrame | None, like: DataFrame) -> DataFrame:
    """Decisions as (kind, a, b, by, note); ``by`` is ``human`` where it is not given."""
    if df is None:
        return like.sparkSession.createDataFrame([], CONSTRAINTS)
    given = {c: F.col(c) if c in df.columns else F.lit(None).cast("string") for c in ("kind", "a", "b", "by", "note")}
    return df.select(*(given[c].alias(c) for c in ("kind", "a", "b")), F.coalesce(given["by"], F.lit("human")).alias("by"), given["note"].alias("note"))
