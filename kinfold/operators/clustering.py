"""Clusters: connected components that honour decisions that two rows differ."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.cut import cut


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); a component is its smallest id.

    Large-star and small-star steps by turns (Kiveris et al., 2014) until the edges stay as
    they are, some dozen rounds for a chain of thousands. Each step sends an id's neighbours
    to its smallest one, so no list of neighbours is ever gathered; minima are taken before
    ids are dealt out, and Spark splits what an id with very many neighbours brings to a join.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while (now := _mark(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("id"), F.col("v").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def replay(edges: list[tuple[str, str, float]], apart: list[tuple[str, str]]) -> tuple[dict[str, str], list[tuple[str, str, str]]]:
    """Join the ends of ``edges`` by score, then by pair, unless that unites a pair of ``apart``.

    Returns each id's cluster (its smallest member) and the edges that were refused with
    the pair that stood against them. ``edges`` are the links of one component.
    """
    members = {i: [i] for e in edges for i in e[:2]}
    root = {i: i for i in members}
    foes: dict[str, set[str]] = {}
    for a, b in apart:
        foes.setdefault(a, set()).add(b)
        foes.setdefault(b, set()).add(a)
    refused = []
    for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        p, q = root[a], root[b]
        if p == q:
            continue
        against = next(((x, y) for x in members[p] if x in foes for y in members[q] if y in foes[x]), None)
        if against:
            refused.append((a, b, " and ".join(sorted(against))))
            continue
        keep, gone = min(p, q), max(p, q)
        for i in members[gone]:
            root[i] = keep
        members[keep] = sorted(members[keep] + members.pop(gone))
    return root, refused


def clustered(ids: DataFrame, accepted: DataFrame, apart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, cluster) of all ``ids``, and (a, b, against) of accepted edges that were refused.

    Components without a forbidden pair inside are clusters as they are. Only the others
    are replayed edge by edge, each in a task of its own, as the order of joins matters.
    """
    links = accepted.select("a", "b", "score").distinct()
    found = cut(components(links))
    of_a, of_b = (found.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
    inside = apart.join(of_a, "a").join(of_b, "b").filter("of_a = of_b").select("a", "b", F.col("of_a").alias("component"))
    disputed = inside.select("component").distinct()

    sides = links.join(of_a, "a").select("a", "b", "score", F.col("of_a").alias("component"), F.lit(False).alias("apart"))
    forbidden = inside.select("a", "b", F.lit(0.0).alias("score"), "component", F.lit(True).alias("apart"))
    work = sides.join(disputed, "component", "left_semi").select(forbidden.columns).unionByName(forbidden)

    def replayed(table: pa.Table) -> pa.Table:
        rows = list(zip(table["a"].to_pylist(), table["b"].to_pylist(), table["score"].to_pylist(), table["apart"].to_pylist(), strict=True))
        root, refused = replay([r[:3] for r in rows if not r[3]], [r[:2] for r in rows if r[3]])
        a = [*root, *(r[0] for r in refused)]
        b = [*root.values(), *(r[1] for r in refused)]
        return pa.table({"a": a, "b": b, "against": pa.array([None] * len(root) + [r[2] for r in refused], pa.string())})

    outcome = cut(work.groupBy("component").applyInArrow(replayed, "a string, b string, against string"))
    settled = found.join(disputed, "component", "left_anti").select("id", F.col("component").alias("cluster"))
    settled = settled.unionByName(outcome.filter("against IS NULL").select(F.col("a").alias("id"), F.col("b").alias("cluster")))
    whole = ids.select("id").join(settled, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))
    return whole, outcome.filter("against IS NOT NULL")
