"""Candidate pairs: records that share a key, or all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import normalize as N
from kinfold.operators.cut import cut
from kinfold.operators.records import has_mailbox


def block_keys() -> Column:
    """Up to seven keys of a record, each named by its kind."""
    canonical, last_key, company = F.col("email.canonical"), F.col("last_key"), F.col("company.key")
    first, last, domain = F.col("name.first"), F.col("name.last"), F.col("domain.value")
    initial = F.substring(first, 1, 1)
    known = F.coalesce(F.col("name.first_canonical"), first, F.lit("?"))

    def key(when: Column, kind: str, *parts: Column) -> Column:
        return F.when(when, F.concat(F.lit(f"{kind}:"), *parts))

    bar = F.lit("|")
    return F.array_compact(
        F.array(
            key(has_mailbox(), "email", canonical),
            key(has_mailbox(), "local", F.substring_index(canonical, "@", 1)),
            key(N.last_seven(F.col("phone.e164")).isNotNull(), "phone7", N.last_seven(F.col("phone.e164"))),
            key(last_key.isNotNull() & company.isNotNull(), "sound-company", last_key, bar, company),
            key(last_key.isNotNull() & domain.isNotNull(), "domain-name", domain, bar, F.coalesce(initial, F.lit("?")), last_key),
            key(company.isNotNull() & first.isNotNull(), "company-initial", company, bar, initial),
            key(last.isNotNull(), "name", known, bar, last),
        )
    )


def keyed(records: DataFrame) -> DataFrame:
    """(key, id), a row for each key of each record."""
    return records.select("id", F.explode(F.array_distinct(block_keys())).alias("key"))


def block_sizes(keys: DataFrame) -> DataFrame:
    """(key, size) of keys that more than one record has."""
    return keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")


def skipped(sizes: DataFrame, most: int) -> DataFrame:
    """Blocks too large to compare, as they are reported."""
    return sizes.filter(F.col("size") > most).orderBy("key")


def blocked_pairs(keys: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Distinct (a, b), a before b, of records that share a key of at most ``most`` records.

    Sizes are known before the join, so no key brings more than ``most`` rows to it and
    keys of one record bring none. A pair that shares several keys comes from the one with
    the least hash alone, so pairs need not be dealt out again to be told apart.
    """
    held = keys.join(sizes.filter(F.col("size") <= most).select("key"), "key")
    of_id = cut(held.groupBy("id").agg(F.collect_set("key").alias("keys")))
    rows = of_id.select("id", F.transform("keys", lambda k: F.xxhash64(k)).alias("hashes"), F.explode("keys").alias("key"))
    left, right = rows.select("key", F.col("id").alias("a"), F.col("hashes").alias("of_a")), rows.select("key", F.col("id").alias("b"), F.col("hashes").alias("of_b"))
    met = left.join(right, "key").filter(F.col("a") < F.col("b"))
    return met.filter(F.xxhash64("key") == F.array_min(F.array_intersect("of_a", "of_b"))).select("a", "b")


def all_pairs(records: DataFrame, limit: int) -> DataFrame:
    """Every pair: a check on blocking for small inputs, refused for more than ``limit`` rows."""
    n = records.count()
    if n > limit:
        raise ValueError(f"comparing all pairs of {n} rows is off limits; the limit is {limit}")
    left, right = records.select(F.col("id").alias("a")), records.select(F.col("id").alias("b"))
    return left.join(right, F.col("a") < F.col("b"))
