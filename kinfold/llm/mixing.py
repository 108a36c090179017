"""Mixing sources to target weights by hash-threshold histograms (operator 6).

A source's target is a share, by its weight, of 1.5 times the words of all sources, but no
more than twice its own; what is above is shared among the others. A target of ``base``
times a source's size (0, 1 or 2) and a rest takes each document ``base`` times, and once
more those whose hash is at most the source's threshold. The threshold comes from sums of
words by source and hash bucket: the bucket where the running sum passes the rest is split
by the hash's next bits, and only it, until it holds one hash. No document is sorted.

Null texts and texts without words have size 0 and are never chosen for their words. Null
is a source of its own, the last. The hash is of id and text, so reruns agree, and rows
that are alike in both are chosen together: a source misses its target by at most half the
words of the rows that share one hash, which is half a document where ids differ. Columns of
any name pass untouched, as rows travel as one value. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm._shared import WORD, settle

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: What all targets share, and what a target can be at most, in multiples of the words there are.
SHARED, MOST = 1.5, 2.0
#: Sources up to so many (some 100 bytes each) go to every executor; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Bits of the hash by which a bucket is split.
BITS = 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(id_col: str, text_col: str, seed: int = 6) -> Column:
    return F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) for ``sizes`` (source, source_size), one row a source.

    Sources whose cap is least for their weight reach it first. With the others sharing
    what is left by weight, the first source in that order that stays below its cap ends
    the capped ones. The windows have a row for each source.
    """
    ranked = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("n") % len(WEIGHTS) + 1).cast("int"))
    total = F.sum("source_size").over(Window.partitionBy())
    caps = ranked.select("*", weight.alias("w"), (F.col("source_size") * MOST).alias("cap"), (total * SHARED).alias("all"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "n")
    shared = caps.select(
        "*",
        F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
        F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
    ).withColumn("each", (F.col("all") - F.col("full")) / F.col("open"))
    least = F.min(F.when(F.col("cap") > F.col("each") * F.col("w"), F.struct(F.col("cap") / F.col("w"), "n", "each"))).over(Window.partitionBy())
    level = shared.withColumn("level", least["each"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w")))
    return level.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, base, threshold) for rows of (source, size, hash).

    Rows whose hash is at most the threshold are taken once more; none if it is null.
    ``sized`` is read once for each level; as a level splits one bucket a source into
    ``2 ** BITS``, there are two or three, and six at most.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = settle(targets(totals).withColumn("base", F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")))

    edge = goal.select("source", F.col("rest").alias("left"), F.lit(None).cast("long").alias("prefix"))
    found, shift = None, 64
    while True:
        bits = min(BITS, shift)
        shift -= bits
        prefix = F.shiftright("hash", shift)
        if found is None:
            inside = sized.select("source", "size", "hash", prefix.alias("bucket"))
        else:
            at = edge.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
            above = F.shiftright("hash", shift + bits)
            inside = sized.select("source", "size", "hash", prefix.alias("bucket"), above.alias("above"))
            inside = inside.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col("above") == F.col("p"))).drop("s", "p", "above")
        bars = inside.groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        left = edge.select(F.col("source").alias("s"), "left")
        bars = bars.withColumn("upto", F.sum("size").over(run)).join(left, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        # The first bucket whose running sum passes what is left; below it, the last whole bucket.
        step = bars.groupBy("source").agg(
            F.max(F.when(F.col("upto") <= F.col("left"), F.struct("bucket", "high"))).alias("whole"),
            F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", "low", "high", "size", (F.col("left") - F.col("upto") + F.col("size")).alias("left")))).alias("split"),
        )
        # One hash cannot be split: it is taken if that comes nearer to what is left.
        one = F.col("split.low") == F.col("split.high")
        near = one & (F.col("split.size") <= 2 * F.col("split.left"))
        step = settle(step.select(
            "source",
            F.when(near, F.col("split.high")).otherwise(F.col("whole.high")).alias("reached"),
            F.when(~one, F.struct("split.bucket", "split.left")).alias("more"),
        ))
        reached = step.select("source", "reached")
        found = reached if found is None else found.unionByName(reached)
        edge = settle(step.filter("more is not null").select("source", F.col("more.left").alias("left"), F.col("more.bucket").alias("prefix")))
        if shift == 0 or edge.isEmpty():
            break
    best = found.groupBy("source").agg(F.max("reached").alias("threshold")).withColumnRenamed("source", "s")
    return goal.join(best, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "base", "threshold")


def _copies(once_more_at: Column, hashed: Column, base: Column) -> Column:
    """How often a row of this hash is taken."""
    once_more = F.coalesce(hashed <= once_more_at, F.lit(False))
    return F.least(base + once_more.cast("long"), F.lit(int(MOST)))


def _marks(sized: DataFrame) -> DataFrame:
    """``thresholds`` as (of, mark), for a join by broadcast if the sources are few enough."""
    marks = settle(thresholds(sized).select(F.col("source").alias("of"), F.struct("source_size", "target", "base", "threshold").alias("mark")))
    return F.broadcast(marks) if marks.count() <= BROADCAST_SOURCES else marks


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", out_col: str = "mix") -> DataFrame:
    """``docs`` without the text and with ``out_col`` (size, source_size, target, copies, taken).

    Texts are read once; ids, sources, sizes and hashes are written and used from there on.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in (text_col, out_col)))
    narrow = docs.select(row.alias("row"), F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"), row_hash(id_col, text_col).alias("hash"))
    narrow = settle(narrow)
    joined = narrow.join(_marks(narrow.select("source", "size", "hash")), F.col("source").eqNullSafe(F.col("of")), "left")
    counted = joined.withColumn("copies", _copies(F.col("mark.threshold"), F.col("hash"), F.col("mark.base")))
    found = F.struct("size", "mark.source_size", "mark.target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    return counted.select("row", found.alias("found")).select("row.*", F.col("found").alias(out_col))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns.

    Texts are read twice, to count and hash, then to hash and copy; they are written nowhere.
    """
    source, hashed = F.col(f"`{source_col}`"), row_hash(id_col, text_col)
    marks = _marks(settle(docs.select(source.alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"), hashed.alias("hash"))))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), source.alias("source"), hashed.alias("hash"))
    joined = rows.join(marks, F.col("source").eqNullSafe(F.col("of")), "left")
    taken = joined.withColumn("copies", _copies(F.col("mark.threshold"), F.col("hash"), F.col("mark.base"))).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
