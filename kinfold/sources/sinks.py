"""The three files of a run: people, open questions, and the audit trail."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.plans.clean import Result
from kinfold.schema import FIELDS

# The columns of the output files.
CLEANED = ("person_id", "status", "row_count", "merged_from", "full_name", "email", "phone", "company", "domain", "title", "conflicts", "match_strength", "quarantine_reason")
REVIEW = ("score", "decision", "row_a", "name_a", "email_a", "phone_a", "company_a", "row_b", "name_b", "email_b", "phone_b", "company_b", "reasons")


def _shown_name(row: str = "row") -> Column:
    return F.coalesce(F.col(f"{row}.full_name"), F.concat_ws(" ", F.nullif(F.col(f"{row}.first_name"), F.lit("")), F.nullif(F.col(f"{row}.last_name"), F.lit(""))))


def conflict_summary() -> Column:
    """What each field kept, over what, and from which rows; the wording is a fixed value."""

    def one(field: str) -> Column:
        proof = F.col(f"provenance.{field}")
        lost = F.array_join(F.transform(proof["conflicts"], lambda c: F.concat(F.lit('"'), c["value"], F.lit('" ('), c["id"], F.lit(")"))), ", ")
        return F.when(F.size(proof["conflicts"]) > 0, F.concat(F.lit(f'{field}: kept "'), proof["value"], F.lit('" over '), lost))

    return F.concat_ws(" | ", *map(one, FIELDS))


def cleaned(result: Result) -> DataFrame:
    """One row for each person, then the rows held back with their values as they came."""
    blank = F.lit("")
    people = result.clusters.select(
        F.col("id").alias("person_id"), F.when(F.col("row_count") > 1, F.lit("merged")).otherwise(F.lit("unique")).alias("status"),
        F.col("row_count").cast("string").alias("row_count"), F.array_join("member_ids", " ").alias("merged_from"), *FIELDS,
        conflict_summary().alias("conflicts"), F.col("strength").alias("match_strength"), blank.alias("quarantine_reason"), F.lit(0).alias("_part"),
    )
    row = result.records.join(result.quarantined, "id")
    held = row.select(
        F.col("id").alias("person_id"), F.lit("quarantined").alias("status"), F.lit("1").alias("row_count"), F.col("id").alias("merged_from"),
        _shown_name().alias("full_name"), "row.email", "row.phone", "row.company", F.col("row.website").alias("domain"), "row.title",
        blank.alias("conflicts"), blank.alias("match_strength"), F.col("reason").alias("quarantine_reason"), F.lit(1).alias("_part"),
    )
    return people.unionByName(held).orderBy("_part", "person_id").select(*CLEANED)


def review(result: Result) -> DataFrame:
    """Open pairs with both rows as they came; ``decision`` is for the reviewer to fill in."""

    def side(s: str) -> DataFrame:
        values = {f"name_{s}": _shown_name(), **{f"{c}_{s}": F.col(f"row.{c}") for c in ("email", "phone", "company")}}
        return result.records.select(F.col("id").alias(f"row_{s}"), *(v.alias(k) for k, v in values.items()))

    edges = result.review.select("score", F.col("a").alias("row_a"), F.col("b").alias("row_b"), "reasons")
    full = edges.join(side("a"), "row_a", "left").join(side("b"), "row_b", "left").orderBy(F.col("score").desc(), "row_a", "row_b")
    said = F.array_join(F.transform("reasons", lambda r: F.concat_ws(": ", r["rule"], r["detail"])), " | ")
    return full.select(F.format_string("%.3f", "score").alias("score"), F.lit("").alias("decision"), *REVIEW[2:-1], said.alias("reasons"))


def decided(spark: SparkSession, filled: DataFrame) -> DataFrame:
    """A review file that came back, as constraints; rows without a decision are still open."""
    kind = F.lower(F.trim("decision"))
    return filled.filter(kind.isin("link", "must-not-link")).select(kind.alias("kind"), F.col("row_a").alias("a"), F.col("row_b").alias("b"), F.lit("human").alias("by"), F.lit(None).cast("string").alias("note"))


def audit(result: Result) -> str:
    """Everything, as JSON with two spaces of indent and no time of day. For runs that fit a file."""
    tables = {name: [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()] for name, df in (("clusters", result.clusters.drop("cluster")), ("review", result.review), ("refused", result.refused), ("quarantined", result.quarantined))}
    decisions = [{k: v for k, v in r.asDict().items() if v is not None} for r in result.constraints.collect()]
    return json.dumps({"runHash": result.run_hash, "config": result.config.described(), "constraints": decisions, "metrics": result.metrics, **tables}, indent=2, ensure_ascii=False)


def response(result: Result) -> dict:
    """All that one request is answered with, ready to be sent as JSON. For runs that fit a file."""
    return json.loads(audit(result)) | {"summary": result.summary(), "files": {"cleaned.csv": csv_text(cleaned(result)), "review.csv": csv_text(review(result))}}


def write_audit(result: Result, folder: str) -> None:
    """The same for runs of any size: a folder of JSON lines for each table."""
    for name, df in (("clusters", result.clusters), ("review", result.review), ("refused", result.refused), ("quarantined", result.quarantined), ("constraints", result.constraints)):
        df.write.mode("overwrite").json(f"{folder}/{name}")


def csv_cell(value: str | None) -> str:
    text = value or ""
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\r\n') else text


def csv_text(df: DataFrame) -> str:
    """One CSV file, quoted only where needed, with CRLF after every row. For results that fit a file."""
    lines = [df.columns, *(list(r) for r in df.toLocalIterator())]
    return "".join(",".join(csv_cell(c) for c in line) + "\r\n" for line in lines)


def write_csv(df: DataFrame, folder: str) -> None:
    """The same for results of any size: part files, each with a header."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("lineSep", "\n").csv(folder)
