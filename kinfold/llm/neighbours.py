"""Near duplicates of embeddings by NN-descent (operator 3).

A graph of each vector's nearest neighbours is seeded and then refined: a vector's
neighbours, and some of those that have it as a neighbour, are compared with one another,
and what comes nearer than a list's last replaces it. Seeds come from buckets of random
hyperplanes, in which a vector takes its nearest; there are as many bucketings as a pair at
the threshold needs to meet, more in larger tables, and a bucket that grows too large is
parted by further planes, at last by hash. Rounds end when seeds of other planes, which hold
rare links too, have no link between components, and an audit, a sample of vectors against
all rows that grows until it holds enough links, finds them within components; else lists
grow. If rounds run out, all pairs are compared.

Edges of at least the threshold join vectors to components. A list that only holds such
edges is saturated, as its vector may have more links: it has room for twice as many in the
round that follows. However long, no list is sure to hold all links of a vector among many
copies; so within components lists give way to the whole component, compared block by block,
and only counted. All links of a vector lie in its component, so the counts miss nothing that
the components have.

Equal vectors become one node first. Vectors that are null, empty or zero, or hold null or
non-finite components, link with nothing; nor do vectors of different lengths. Cosines are
in double precision. Rows that share an id are not told apart: an id has one component and
one count, of its rows together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm._shared import runs, settle
from kinfold.llm.graph import components

TABLES, BUCKET, LIST = 8, 256, 8
#: Planes that part a large bucket, and how probably a pair at the threshold shares a bucket.
MORE, SEEDED = 16, 0.98
#: Vectors of the audit at first, and what share of their links must lie within components.
AUDITED, RECALL, ROUNDS = 200, 0.995, 6
#: Links that an audit must hold, and vectors up to which it grows for them.
LEAST, MOST_AUDITED = 200, 4096
#: Vectors of a block when a component is compared with itself.
BLOCK = 1024

EDGES = "u long, v long, cosine double"
_EDGES_ARROW = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("cosine", pa.float64())])


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length one, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square over- or underflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sound(vector: Column) -> Column:
    """Whether a vector can be compared."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _nearest(ids: np.ndarray, x: np.ndarray, k: int) -> pa.RecordBatch:
    """Each row's ``k`` nearest others as edges."""
    near = x @ x.T
    np.fill_diagonal(near, -2)
    k = min(k, len(ids) - 1)
    at = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(ids[at].ravel()), pa.array(np.take_along_axis(near, at, 1).ravel())], schema=_EDGES_ARROW)


def tables(bits: int, threshold: float) -> int:
    """How many bucketings of ``bits`` planes bring a pair at ``threshold`` together with probability ``SEEDED``."""
    apart = float(np.arccos(np.clip(threshold, -1.0, 1.0))) / np.pi
    return max(TABLES, int(np.ceil(np.log(1 - SEEDED) / np.log1p(-min((1 - apart) ** bits, 1 - 1e-9)))))


def seeds(nodes: DataFrame, n: int, k: int, threshold: float = 0.95, turn: int = 0) -> tuple[DataFrame, bool]:
    """Edges from each node to its nearest in bucketings of (id, dim, vector), with planes of
    their own each ``turn``, and whether a hash had to part buckets."""
    bits = max(1, int(np.ceil(np.log2(max(2.0, n / (BUCKET / 4))))))
    many = tables(bits, threshold)

    def coder(with_vectors: bool):
        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    dims = batch.column(1).to_numpy()
                    codes = np.zeros((batch.num_rows, many, 2), np.int64)
                    for dim in np.unique(dims):
                        mine = np.flatnonzero(dims == dim)
                        planes = np.random.default_rng([int(dim), turn]).normal(size=(int(dim), many * (bits + MORE)))
                        sides = (_matrix(batch.column(2).take(pa.array(mine))) @ planes > 0).reshape(len(mine), many, bits + MORE)
                        codes[mine, :, 0] = sides[:, :, :bits] @ (1 << np.arange(bits, dtype=np.int64))
                        codes[mine, :, 1] = sides[:, :, bits:] @ (1 << np.arange(MORE, dtype=np.int64))
                    own = [batch.column(0), batch.column(1), *([batch.column(2)] if with_vectors else [])]
                    lists = [pa.array(codes[:, :, i].tolist(), pa.list_(pa.int64())) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*own, *lists], ["id", "dim", *(["vector"] if with_vectors else []), "codes", "finer"])

        own = ["id", "dim", *(["vector"] if with_vectors else [])]
        schema = "id long, dim int" + (f", vector {nodes.schema['vector'].dataType.simpleString()}" if with_vectors else "") + ", codes array<long>, finer array<long>"
        spread = nodes.mapInArrow(coded, schema).select(*own, F.posexplode(F.arrays_zip("codes", "finer")).alias("number", "c"))
        return spread.select(*own, "number", F.col("c.codes").alias("code"), F.col("c.finer").alias("finer"))

    # A bucket that is too large is parted by further planes, and what those leave too large by a hash.
    codes = coder(False)
    sizes = settle(codes.groupBy("dim", "number", "code").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET))
    part = F.when(F.col("n").isNotNull(), F.pmod(F.col("finer"), F.least(F.lit(1 << MORE), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") * 4 / BUCKET)))).cast("long"))).otherwise(F.lit(0).cast("long"))

    def parted(rows: DataFrame) -> DataFrame:
        return rows.join(sizes, ["dim", "number", "code"], "left").withColumn("part", part).drop("n", "finer")

    still = settle(parted(codes.join(sizes, ["dim", "number", "code"], "left_semi")).groupBy("dim", "number", "code", "part").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET))
    salt = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("id", "number", F.lit(turn)), F.ceil(F.col("n") / BUCKET))).otherwise(F.lit(0))
    keys = ["dim", "number", "code", "part", "salt"]
    dealt = parted(coder(True)).join(still, ["dim", "number", "code", "part"], "left").withColumn("salt", salt).drop("n")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "id", "vector")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, keys):
            if group.num_rows > 1:
                yield _nearest(group["id"].to_numpy(), _matrix(group["vector"]), k)

    return dealt.mapInArrow(near, EDGES), not still.isEmpty()


def _lists(edges: DataFrame, k: int, threshold: float) -> DataFrame:
    """Each node's ``k`` nearest among ``edges``, and twice as many if those are links all of them."""
    first = Window.partitionBy("u").orderBy(F.col("cosine").desc(), "v")
    ranked = edges.dropDuplicates(["u", "v"]).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= 2 * k)
    links = F.count_if(F.col("cosine") >= threshold).over(Window.partitionBy("u"))
    return ranked.withColumn("room", F.when(links >= k, F.lit(2 * k)).otherwise(F.lit(k))).filter("place <= room")


def refine(lists: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Edges that neighbours of neighbours add to ``lists`` (u, v, cosine, place, room)."""
    back = Window.partitionBy("v").orderBy("place", F.xxhash64("u", "v"))
    reverse = lists.withColumn("n", F.row_number().over(back)).filter(F.col("n") <= k).select(F.col("v").alias("w"), F.col("u").alias("id"))
    met = lists.select(F.col("u").alias("w"), F.col("v").alias("id")).unionByName(reverse).distinct()
    last = lists.groupBy("u").agg(F.min("cosine").alias("last"), F.count("*").alias("held"), F.max("room").alias("room"))
    full = nodes.join(last, F.col("id") == F.col("u"), "left").select("id", "vector", F.when(F.col("held") >= F.col("room"), F.col("last")).otherwise(F.lit(-2.0)).alias("last"))
    around = met.join(full, "id").select("w", "id", "last", "vector").repartition("w").sortWithinPartitions("w")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, others, cosines = [], [], []
        for group in runs(batches, ["w"]):
            if group.num_rows < 2:
                continue
            x, i, last = _matrix(group["vector"]), group["id"].to_numpy(), group["last"].to_numpy()
            near = x @ x.T
            np.fill_diagonal(near, -2)
            a, b = np.nonzero(near > last[:, None])
            ids.append(i[a])
            others.append(i[b])
            cosines.append(near[a, b])
            if len(ids) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ids, others, cosines)], schema=_EDGES_ARROW)
                ids, others, cosines = [], [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ids, others, cosines)], schema=_EDGES_ARROW)

    return around.mapInArrow(compared, EDGES).dropDuplicates(["u", "v"])


def _against(nodes: DataFrame, asked: list, threshold: float) -> DataFrame:
    """(u, v, cosine, apart): links of the rows ``asked`` with all ``nodes`` (id, dim, vector, part), by brute force."""
    by_dim = {}
    for dim in {r.dim for r in asked}:
        some = [r for r in asked if r.dim == dim]
        by_dim[dim] = np.array([r.id for r in some]), np.array([r.part for r in some]), _matrix(pa.array([r.vector for r in some], pa.list_(pa.float64())))
    sample = nodes.sparkSession.sparkContext.broadcast(by_dim)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, BLOCK) for i in range(0, whole.num_rows, BLOCK)):
                dims = batch.column(1).to_numpy()
                for dim, (ids, parts, x) in sample.value.items():
                    mine = np.flatnonzero(dims == dim)
                    if len(mine):
                        held = batch.take(pa.array(mine))
                        near = _matrix(held.column(2)) @ x.T
                        a, b = np.nonzero(near >= threshold)
                        apart = held.column(3).to_numpy()[a] != parts[b]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[b]), pa.array(held.column(0).to_numpy()[a]), pa.array(near[a, b]), pa.array(apart)], ["u", "v", "cosine", "apart"])

    return nodes.select("id", "dim", "vector", "part").mapInArrow(links, EDGES + ", apart boolean").filter("u <> v")


def _parted(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """``nodes`` with the component of each, its own id where it has none."""
    return nodes.join(parts.select(F.col("node").alias("id"), F.col("component").alias("part")), "id", "left").select("id", "dim", "vector", F.coalesce("part", "id").alias("part"))


def _linked(edges: DataFrame, threshold: float) -> DataFrame:
    return edges.filter(F.col("cosine") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))


def _crossing(links: DataFrame, parts: DataFrame) -> bool:
    """Whether any of ``links`` (a, b) lies between different components."""
    of_a, of_b = (parts.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
    placed = links.join(of_a, "a", "left").join(of_b, "b", "left")
    return not placed.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).isEmpty()


def audit(nodes: DataFrame, parts: DataFrame, threshold: float) -> float | None:
    """Share of the links of a sample of nodes, found by brute force, that lie within components.

    The sample grows until it holds ``LEAST`` links. None, unknown, if even ``MOST_AUDITED``
    nodes hold fewer and they are not all nodes; a table of fewer nodes is compared in full.
    """
    n, asked_for, placed = nodes.count(), AUDITED, _parted(nodes, parts)
    while True:
        whole = asked_for >= n
        chosen = F.lit(True) if whole else F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 40)) < int(asked_for / n * (1 << 40))
        asked = placed.filter(chosen).collect()  # about MOST_AUDITED rows at most
        found = _against(placed, asked, threshold).agg(F.count("*"), F.count_if("apart")).first() if asked else (0, 0)
        if whole or found[0] >= LEAST:
            return 1 - found[1] / found[0] if found[0] else 1.0
        if asked_for >= MOST_AUDITED:
            return None if not found[1] else 1 - found[1] / found[0]
        asked_for = min(8 * asked_for, MOST_AUDITED)


def lost(nodes: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """(u, v, cosine): all links between different components, by comparing every pair of nodes."""
    placed = settle(_parted(nodes, parts))
    slices, found = max(1, -(-placed.count() // MOST_AUDITED)), None
    for i in range(slices):
        asked = placed.filter(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(slices)) == i).collect()
        more = settle(_against(placed, asked, threshold).filter("apart").drop("apart"))
        found = more if found is None else found.unionByName(more)
    return found


def counted(nodes: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """(id, others): how many rows of other nodes each node in ``parts`` links with."""
    sizes = parts.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    held = parts.join(sizes, "component").join(nodes, F.col("node") == F.col("id")).select("component", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id", "copies", "vector")
    pairs = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = ["component", "low", "high"]
    dealt = pairs.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "copies", "vector")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, others = [], []
        for group in runs(batches, keys):
            i, n, x = group["id"].to_numpy(), group["copies"].to_numpy(), _matrix(group["vector"])
            side = group["block"].to_numpy() == group["low"].to_numpy()
            if group["low"][0].as_py() == group["high"][0].as_py():
                linked = x @ x.T >= threshold
                np.fill_diagonal(linked, False)
                ids.append(i)
                others.append(linked @ n)
            else:
                linked = x[side] @ x[~side].T >= threshold
                ids += [i[side], i[~side]]
                others += [linked @ n[~side], n[side] @ linked]
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(others).astype(np.int64))], ["id", "others"])

    return dealt.mapInArrow(compared, "id long, others long").groupBy("id").agg(F.sum("others").alias("others"))


def classes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(id, n_links, component) of every row."""
    vector = F.col("vector")
    element = rows.schema[vector_col].dataType.elementType.typeName()
    kind = "array<float>" if element == "float" else "array<double>"  # as wide as it was given
    named = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast(kind).alias("vector"))
    named = settle(named.withColumn("whole", sound(vector) & F.col("id").isNotNull()).withColumn("key", F.when(F.col("whole"), F.struct(F.xxhash64("vector"), F.hash("vector"), F.size("vector")))))
    equal = named.filter("whole").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min("vector").alias("vector"))
    nodes = settle(equal.select("key", "id", F.size("vector").alias("dim"), "copies", "vector"))
    bare = nodes.select("id", "dim", "vector")
    n = nodes.count()
    k, known, parts = LIST, None, None
    edges, _ = seeds(bare, n, k, threshold)
    edges = settle(edges)
    for turn in range(ROUNDS):
        lists = settle(_lists(edges, k, threshold))
        more = settle(refine(lists, nodes, k))
        new = more.join(lists, ["u", "v"], "left_anti").count()
        known = _linked(edges, threshold).unionByName(_linked(more, threshold)) if known is None else known.unionByName(_linked(more, threshold))
        edges = lists.select("u", "v", "cosine").unionByName(more)
        few = new * 1000 <= max(100_000, n * k)
        if turn == 0 and not few:  # the first round always changes much
            continue
        parts = components(known)
        fresh, hashed = seeds(bare, n, k, threshold, turn + 1)
        fresh = settle(fresh)
        if not _crossing(_linked(fresh, threshold), parts):
            share = audit(bare, parts, threshold)
            # An audit of too few links proves nothing: planes must have done without a hash then, or lists be at rest.
            if (few or not hashed) if share is None else share >= RECALL:
                break
        known, edges = known.unionByName(_linked(fresh, threshold)), edges.unionByName(fresh)
        k *= 2
    else:
        parts = components(known)
        parts = components(known.unionByName(_linked(lost(bare, parts, threshold), threshold)))
    counts = counted(nodes.select("id", "copies", "vector"), parts, threshold)
    member = nodes.select("key", F.col("id").alias("node"), "copies").join(parts, "node", "left").join(counts.withColumnRenamed("id", "node"), "node", "left")
    member = settle(member.select(F.col("key").alias("of_key"), F.coalesce("component", "node").alias("component"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    found = named.join(member, F.col("key") == F.col("of_key"), "left")
    return found.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
