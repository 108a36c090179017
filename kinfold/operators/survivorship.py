"""The surviving value of each field of a cluster, why it won, and what lost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import normalize as N
from kinfold.schema import FIELDS

CANDIDATES = "cluster string, field string, id string, value string, valid boolean, source string, updated_at string"


def candidates(records: DataFrame, membership: DataFrame) -> DataFrame:
    """(cluster, field, id, value, valid, source, updated_at) of all values there are."""
    phone = F.concat_ws(" x", F.col("phone.e164"), F.col("phone.extension"))
    offered = {
        "full_name": (F.col("name.display"), F.col("name.last").isNotNull()),
        "email": (F.col("email.normalized"), N.identifies_person(F.col("email.kind"))),
        "phone": (F.when(F.col("phone.e164").isNotNull(), phone), F.col("phone.valid")),
        "company": (F.col("company.normalized"), F.col("company.key").isNotNull()),
        "domain": (F.col("domain.value"), F.lit(True)),
        "title": (F.col("title.tidied"), F.lit(True)),
    }
    each = F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value"), ok.alias("valid")) for f, (v, ok) in offered.items()))
    long = records.join(membership, "id").select("cluster", "id", "source", "updated_at", F.explode(each).alias("o"))
    return long.select("cluster", "o.field", "id", "o.value", "o.valid", "source", "updated_at").filter("value <> ''")


def trust_rank(source: Column, trust: Sequence[str]) -> Column:
    """Place in ``trust``; sources that are not listed come after, missing ones last."""
    out = F.when(source.isNull(), F.lit(len(trust) + 1))
    for i, name in enumerate(trust):
        out = out.when(source == name, F.lit(i))
    return out.otherwise(F.lit(len(trust)))


def winners(offered: DataFrame, trust: Sequence[str]) -> DataFrame:
    """(cluster, field, winner_id, value, rule, conflicts): one row for each field that has a value.

    Usable values come before others, then trusted sources, later dates and smaller ids.
    ``rule`` names the first of these that set the winner apart from any rival.
    """
    ranked = offered.withColumns({
        "unusable": (~F.coalesce("valid", F.lit(True))).cast("int"),
        "rank": trust_rank(F.col("source"), trust),
        "date": F.coalesce("updated_at", F.lit("")),
    })
    best = Window.partitionBy("cluster", "field").orderBy("unusable", "rank", F.col("date").desc(), "id")
    placed = ranked.withColumn("place", F.row_number().over(best))
    first = F.col("place") == 1
    per_value = placed.groupBy("cluster", "field", "value").agg(
        F.min("id").alias("id"),
        F.min(F.when(first, F.struct("id", "unusable", "rank", "date", "source"))).alias("won"),
        F.count("*").alias("n"), F.max("unusable").alias("unusable"), F.max("rank").alias("rank"), F.min("date").alias("date"),
    )
    lost = F.collect_list(F.when(F.col("won").isNull(), F.struct("id", "value")))
    fields = per_value.groupBy("cluster", "field").agg(
        F.max("won").alias("won"), F.max(F.when(F.col("won").isNotNull(), F.col("value"))).alias("value"), F.array_sort(lost).alias("conflicts"),
        F.sum("n").alias("n"), F.max("unusable").alias("unusable"), F.max("rank").alias("rank"), F.min("date").alias("date"),
    )
    rule = (
        F.when(F.col("n") == 1, F.lit("the only value"))
        .when((F.col("unusable") == 1) & (F.col("won.unusable") == 0), F.lit("the others could not be read as this field"))
        .when(F.col("rank") > F.col("won.rank"), F.concat(F.lit("the most trusted source, "), F.coalesce("won.source", F.lit("unnamed"))))
        .when(F.col("date") < F.col("won.date"), F.concat(F.lit("the latest of equally trusted rows, "), F.col("won.date")))
        .otherwise(F.lit("the smallest row id"))
    )
    return fields.select("cluster", "field", F.col("won.id").alias("winner_id"), "value", rule.alias("rule"), "conflicts")


def canonical(won: DataFrame) -> DataFrame:
    """(cluster, the fields of ``FIELDS``, provenance, conflict_count), a row for each cluster."""
    proof = F.struct("winner_id", "value", "rule", "conflicts")
    fields = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS]
    proofs = F.struct(*(F.first(F.when(F.col("field") == f, proof), ignorenulls=True).alias(f) for f in FIELDS))
    return won.groupBy("cluster").agg(*fields, proofs.alias("provenance"), F.count_if(F.size("conflicts") > 0).alias("conflict_count"))
