"""The one way through the engine: rows in, people, questions and refusals out.

    normalize -> triage -> block -> refuse -> score -> decide -> cluster -> survive -> count
"""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.config import Config
from kinfold.operators import blocking, clustering, metrics, records, scoring, survivorship
from kinfold.operators.cut import cut
from kinfold.schema import FIELDS, as_constraints, as_rows


class Result:
    """A run, each table of which is worked out when first asked for, and then kept.

    ``records`` (all rows, normalized), ``quarantined``, ``pairs``, ``skipped_blocks``, ``edges``
    (every pair's kind, score and route), ``membership``, ``clusters``, ``review``, ``refused``, ``below``.
    """

    def __init__(self, rows: DataFrame, config: Config, constraints: DataFrame | None):
        self.config = config
        self.rows = as_rows(rows)
        self.constraints = as_constraints(constraints, self.rows)
        self.records = cut(records.triaged(records.normalized(self.rows, config)))
        records.require_unique(self.records)

    @cached_property
    def quarantined(self) -> DataFrame:
        return self.records.filter(F.col("held_reason").isNotNull()).select("id", F.col("held_reason").alias("reason")).orderBy("id")

    @cached_property
    def matchable(self) -> DataFrame:
        return self.records.filter(F.col("held_reason").isNull())

    @cached_property
    def _keys(self) -> DataFrame:
        return cut(blocking.keyed(self.matchable))

    @cached_property
    def _sizes(self) -> DataFrame:
        return cut(blocking.block_sizes(self._keys))

    @cached_property
    def pairs(self) -> DataFrame:
        if self.config.blocking:
            return cut(blocking.blocked_pairs(self._keys, self._sizes, self.config.max_block_size))
        return cut(blocking.all_pairs(self.matchable, self.config.exhaustive_limit))

    @cached_property
    def skipped_blocks(self) -> DataFrame:
        if self.config.blocking:
            return blocking.skipped(self._sizes, self.config.max_block_size)
        return self.rows.sparkSession.createDataFrame([], "key string, size long")

    @cached_property
    def edges(self) -> DataFrame:
        return cut(scoring.routed(self.pairs, self._sides, self.constraints, self.config))

    @cached_property
    def _sides(self) -> DataFrame:
        """What pairs need of records, by themselves: small enough to be sent where the pairs are, more often."""
        return cut(scoring.sides(self.matchable))

    def explained(self, edges: DataFrame) -> DataFrame:
        """Some of ``edges`` with their reasons."""
        return scoring.explained(edges, self._sides, self.config).select("a", "b", "kind", "score", "reasons")

    @cached_property
    def _clustered(self) -> tuple[DataFrame, DataFrame]:
        apart = scoring.oriented(self.constraints, "must-not-link")
        if self.config.strict_refusals:
            apart = apart.unionByName(self.edges.filter("route = 'refused'").select("a", "b")).distinct()
        membership, blocked = clustering.clustered(self.matchable, self.edges.filter("route = 'accepted'"), apart)
        return cut(membership), blocked

    @cached_property
    def membership(self) -> DataFrame:
        return self._clustered[0]

    def _placed(self, edges: DataFrame) -> DataFrame:
        of_a, of_b = (self.membership.select(F.col("id").alias(c), F.col("cluster").alias(f"of_{c}")) for c in "ab")
        return edges.join(of_a, "a").join(of_b, "b")

    @cached_property
    def refused(self) -> DataFrame:
        """Pairs that a rule or a decision refused, and accepted ones that a decision kept apart."""
        by_rule = self.explained(self.edges.filter("route = 'refused'"))
        told = F.struct(F.lit("kept apart by a decision").alias("rule"), F.lit("refuse").alias("verdict"), F.concat(F.lit("the clusters would unite "), "against").alias("detail"), F.lit(None).cast("double").alias("weight"))
        blocked = self._clustered[1]
        stopped = self.explained(self.edges.filter("route = 'accepted'").join(blocked.select("a", "b"), ["a", "b"], "left_semi")).join(blocked, ["a", "b"])
        stopped = stopped.select("a", "b", F.lit("refused").alias("kind"), "score", F.concat("reasons", F.array(told)).alias("reasons"))
        return by_rule.unionByName(stopped).orderBy("a", "b")

    @cached_property
    def review(self) -> DataFrame:
        """Pairs for a person to decide, those left out whose rows are in one cluster by now."""
        still = self._placed(self.edges.filter("route = 'review'")).filter("of_a <> of_b").drop("of_a", "of_b")
        return self.explained(still).orderBy(F.col("score").desc(), "a", "b")

    @cached_property
    def below(self) -> DataFrame:
        return self.explained(self.edges.filter("route = 'below'")).orderBy(F.col("score").desc(), "a", "b")

    @cached_property
    def clusters(self) -> DataFrame:
        """People: rows, edges that hold them together, and the surviving fields with their proof."""
        linked = scoring.oriented(self.constraints, "link").withColumn("by_hand", F.lit(True))
        inside = self._placed(self.edges.filter("route = 'accepted'")).filter("of_a = of_b").select("a", "b", F.col("of_a").alias("cluster"))
        inside = self.explained(self.edges.filter("route = 'accepted'")).join(inside, ["a", "b"]).join(linked, ["a", "b"], "left")
        edge = F.struct("a", "b", "kind", "score", "reasons")
        of_cluster = inside.groupBy("cluster").agg(F.array_sort(F.collect_list(edge)).alias("edges"), F.max(F.coalesce("by_hand", F.lit(False))).alias("by_hand"))
        members = self.membership.groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("member_ids"), F.count("*").alias("row_count"))
        won = survivorship.canonical(survivorship.winners(survivorship.candidates(self.matchable, self.membership), self.config.source_trust))
        strength = F.when(F.col("row_count") == 1, F.lit("singleton")).when(F.coalesce("by_hand", F.lit(False)), F.lit("human-linked")).otherwise(F.lit("authoritative"))
        found = members.join(of_cluster, "cluster", "left").join(won, "cluster", "left")
        found = found.select(F.concat(F.lit("c-"), "cluster").alias("id"), "cluster", "member_ids", "row_count", strength.alias("strength"), "edges", *FIELDS, "provenance", F.coalesce("conflict_count", F.lit(0)).alias("conflict_count"))
        return cut(found).orderBy("id")

    @cached_property
    def merged(self) -> DataFrame:
        """Only the people that more than one row told of."""
        return self.clusters.filter("row_count > 1")

    @cached_property
    def metrics(self) -> dict:
        """Counts, rates, and, with labels, precision and recall."""
        n, held = self.records.agg(F.count("*"), F.count("held_reason")).first()
        people = self.clusters.agg(F.count("*").alias("clusters"), F.count_if(F.col("row_count") > 1).alias("merged"), F.sum("row_count").alias("rows"), F.sum(F.expr("row_count * (row_count - 1) div 2")).alias("pairs"), F.sum("conflict_count").alias("conflicts")).first()
        matchable, compared = people.rows or 0, self.pairs.count()
        exhaustive = matchable * (matchable - 1) // 2
        out = {
            "rowsIn": n, "quarantined": held, "clusters": people.clusters, "merged": people.merged,
            "dedupRate": (matchable - people.clusters) / matchable if matchable else 0.0,
            "autoMerged": people.pairs or 0, "pendingReview": self.review.count(), "refused": self.refused.count(),
            "conflicts": people.conflicts or 0, "comparisons": compared,
            "comparisonRatio": compared / exhaustive if exhaustive else 1.0,
            "skippedBlocks": [r.asDict() for r in self.skipped_blocks.collect()],
            "decisions": {kind: 0 for kind in ("link", "must-not-link")} | {r.kind: r["count"] for r in self.constraints.groupBy("kind").count().collect()},
        }
        truth = metrics.true_pairs(self.rows)
        true = truth.count()
        if true:
            auto = metrics.pairs_within(self.membership, "cluster", "id")
            both = auto.unionByName(self.review.select("a", "b"))
            (p, r), (bp, br) = metrics.precision_recall(auto, truth), metrics.precision_recall(both, truth)
            out["groundTruth"] = {"autoPrecision": p, "autoRecall": r, "withReviewPrecision": bp, "withReviewRecall": br, "truePairs": true}
        return out

    @cached_property
    def run_hash(self) -> str:
        """Names the run by its settings, decisions and row ids, whatever their order and number.

        Ids come as two digests that sums make of them, so none is sorted or collected.
        """
        fixed = [r.asDict() for r in self.constraints.collect()]
        fixed = sorted(({k: v for k, v in c.items() if v is not None} for c in fixed), key=lambda c: (c["a"], c["b"]))
        parts = [F.sum(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000_007)).cast("decimal(38,0)")) for seed in (1, 2)]
        ids = [int(x or 0) for x in self.rows.agg(F.count("*"), *parts).first()]
        return content_hash({"config": self.config.described(), "constraints": fixed, "ids": ids})

    def summary(self) -> str:
        m = self.metrics
        return (
            f"{m['rowsIn']} rows, {m['clusters']} people, {m['dedupRate']:.1%} duplicates, {m['pendingReview']} to review, "
            f"{m['quarantined']} held back, {m['comparisons']} comparisons ({m['comparisonRatio']:.2%} of all pairs)"
        )


def stable_json(value: object) -> str:
    """JSON with sorted names and without spaces; whole numbers have no decimal point."""

    def plain(v: object) -> object:
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items() if x is not None}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def content_hash(value: object) -> str:
    """FNV-1a, 32 bits, of the UTF-16 units of the stable JSON, in hexadecimal."""
    units = memoryview(stable_json(value).encode("utf-16-le")).cast("H")
    h = 0x811C9DC5
    for unit in units:
        h = (h ^ unit) * 0x01000193 & 0xFFFFFFFF
    return f"{h:08x}"


def clean(rows: DataFrame, config: Config | None = None, constraints: DataFrame | None = None) -> Result:
    """Link ``rows`` (``id`` and the columns of ``schema.MAPPED``) under ``constraints``."""
    return Result(rows, config or Config(), constraints)


def latest_decisions(decisions: DataFrame, order: str) -> DataFrame:
    """The last decision on each pair, by ``order``; undone ones (kind is null) leave nothing."""
    pair = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy(F.col(order).desc())
    return decisions.withColumn("_n", F.row_number().over(pair)).filter("_n = 1 AND kind IS NOT NULL").drop("_n")


def split_off(constraints: DataFrame, a: str, b: str) -> DataFrame:
    """``constraints`` and the decision that two rows are not one person."""
    more = constraints.sparkSession.createDataFrame([("must-not-link", a, b, "human", None)], constraints.schema)
    return constraints.unionByName(more)
