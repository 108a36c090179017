"""Rows to normalized records, and which of them can be matched at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.config import Config
from kinfold.functions import normalize as N
from kinfold.schema import as_rows


def normalized(rows: DataFrame, config: Config) -> DataFrame:
    """One record of nested fields for each row; ``row`` keeps the row as it came."""
    given = as_rows(rows)
    columns = [c for c in given.columns if c not in ("id", "true_person_id")]
    record = given.select(
        "id",
        "true_person_id",
        F.struct(*columns).alias("row"),
        N.name(F.col("full_name"), F.col("first_name"), F.col("last_name"), config.nicknames).alias("name"),
        N.given(F.col("company")).alias("_given"),
        N.fold(N.given(F.col("company"))).alias("_plain"),
    )
    record = N.EMAIL.on(record, "email", raw=F.col("row.email"))
    record = N.phone_of(config.default_phone_region).on(record, "phone", raw=F.col("row.phone"))
    record = N.COMPANY.on(record, "company", given=F.col("_given"), plain=F.col("_plain")).drop("_given", "_plain")
    record = N.TITLE.on(record, "title", raw=F.col("row.title"))
    record = N.DATE.on(record, "updated_at", raw=F.col("row.updated_at"))
    record = record.withColumns({"source": N.source(F.col("row.source")), "last_key": N.last_key(F.col("name.last")), "_site": N.host(F.col("row.website"))})
    return record.withColumn("domain", N.domain_of(F.col("_site"), F.col("email"))).drop("_site")


def notes(records: DataFrame) -> DataFrame:
    """(id, field, rule, from, to) of all changes that normalizing made."""
    tagged = map(_tagged, ("name", "email", "phone", "company"))
    return records.select("id", F.posexplode(F.concat(*tagged)).alias("place", "note")).select("id", "place", "note.*")


def _tagged(field: str) -> Column:
    return F.transform(F.col(f"{field}.notes"), lambda n: F.struct(F.lit(field).alias("field"), n["rule"].alias("rule"), n["from"].alias("from"), n["to"].alias("to")))


def has_mailbox(email: str = "email") -> Column:
    return F.col(f"{email}.canonical").isNotNull() & N.identifies_person(F.col(f"{email}.kind"))


def held_reason() -> Column:
    """Why a record cannot be matched; null if it can."""
    last, company, kind = F.col("name.last"), F.col("company.key"), F.col("email.kind")
    matchable = has_mailbox() | F.col("phone.valid") | (last.isNotNull() & company.isNotNull())
    found = F.concat_ws(
        "; ",
        F.when(kind == "role", F.lit("a shared inbox is all there is")),
        F.when(kind == "invalid", F.lit("an address that cannot be read")),
        F.when(last.isNotNull(), F.lit("a name without a company")),
        F.when(company.isNotNull(), F.lit("a company without a name")),
        F.when(F.col("title.tidied").isNotNull(), F.lit("nothing but a job title")),
    )
    said = F.when(found == "", F.lit("nobody to identify: no mailbox, no phone, no name with a company")).otherwise(F.concat(F.lit("nobody to identify: "), found))
    return F.when(~matchable, said)


def triaged(records: DataFrame) -> DataFrame:
    return records.withColumn("held_reason", held_reason())


def require_unique(records: DataFrame) -> None:
    """Ids must be there and differ, as all that follows is keyed by them."""
    twice = records.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 OR id IS NULL OR id = ''").limit(5).collect()
    if twice:
        raise ValueError("ids must be unique and not empty: " + ", ".join(repr(r.id) for r in twice))
