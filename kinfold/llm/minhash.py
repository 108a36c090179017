"""Near duplicates by circulant MinHash (operator 10).

Two permutations of the 32-bit integers make all coordinates of a signature: the first
scatters a document's shingles, the second is shifted circularly by 0, 1, 2, ... and its
least value over the shingles is the next coordinate. Bands of coordinates are the buckets
in which documents meet; every link is confirmed on the full sets of shingles.

Documents with equal sets become one node first, so groups of copies cost one row in what
follows. In a bucket, every node is compared with the smallest. Pairs that meet in a bucket
and are not yet connected after that are compared as well, so no link that shares a bucket
is lost to the short cut; pairs within a component need no comparison. With 40 bands of 6 a
pair of similarity 0.8 meets in none with a probability of 5 in a million.

Lower-casing touches A-Z only. With fewer words than a shingle has, the whole sequence is
the one shingle; null texts and texts without words have an empty set and link with
nothing. Rows without an id have a null component. Rows that share an id but not a text
are judged by their text. Repeated rows are copies of one another, of which the smallest id
stays; an empty table gives no rows; other columns, whatever their names, pass untouched. A
long text costs memory for the hashes of its own words only.

What is dealt out by a key that many rows share, a common bucket or the hub of a large
group, is an inner join whose large side Spark splits when it is skewed; counts are summed
before they are dealt, and comparisons go by blocks of ``BLOCK`` nodes. Tables that come
out of a join much smaller than what it reads are rebalanced before they are written: a file
for each of the join's tasks costs more than its rows, on a local disk without Hadoop's
native library three processes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._shared import Remembered, for_task, parcels, ragged, runs, settle, small_batches
from kinfold.llm.graph import components

BANDS, ROWS = 40, 6
#: Bits of the filter by which documents in no pair are skipped; its size is fixed.
FILTER_BITS = 1 << 25

#: Pairs of a hub that meet its set in one task, and hubs with more up to which (16 bytes each) all
#: executors are told of them; beyond, Spark splits what is skewed.
HUB, MOST_HUBS = 256, 1_000_000
#: Nodes of a block in which a bucket of several components is compared.
BLOCK = 1024
#: How far below the threshold signatures of compared pairs may agree.
MARGIN = 0.15

_STEP = 256
_U64 = np.uint64


class WordHashes(Remembered):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        self.grew(len(word))
        return h


@lru_cache(maxsize=1)
def _words() -> WordHashes:
    return WordHashes()


def shingles(text: bytes, width: int, memory: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words."""
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, _U64)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], _U64)
    h = np.fromiter(map(memory.__getitem__, words), _U64, n)
    out = h[: n - width + 1].copy()
    for i in range(1, width):
        out *= _U64(0x9E3779B97F4A7C15)
        out += h[i : n - width + 1 + i]
    return np.unique(out)


@lru_cache(maxsize=4)
def _shifts(n: int) -> np.ndarray:
    return np.arange(n, dtype=np.uint32)[:, None]


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    """``n`` coordinates for a set that is not empty."""
    first = (hashes ^ (hashes >> _U64(32))).astype(np.uint32)
    first ^= first >> np.uint32(16)
    first *= np.uint32(0x7FEB352D)
    first ^= first >> np.uint32(15)
    first *= np.uint32(0x846CA68B)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    spare = np.empty((n, min(_STEP, len(first))), np.uint32)
    x = np.empty_like(spare)
    for a in range(0, len(first), _STEP):
        part = first[a : a + _STEP]
        y, s = x[:, : len(part)], spare[:, : len(part)]
        np.add(part, _shifts(n), out=y)  # the circular shift of the second permutation
        np.multiply(y, np.uint32(0x85EBCA6B), out=y)
        np.right_shift(y, np.uint32(15), out=s)
        np.bitwise_xor(y, s, out=y)
        np.multiply(y, np.uint32(0xC2B2AE35), out=y)
        np.minimum(out, y.min(axis=1), out=out)
    return out


def buckets(coordinates: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of coordinates, distinct from band to band."""
    key = np.arange(1, bands + 1, dtype=_U64) * _U64(0xD6E8FEB86659FD93)
    for column in coordinates.reshape(bands, -1).T:
        key = (key ^ column.astype(_U64)) * _U64(0x9E3779B97F4A7C15)
        key ^= key >> _U64(29)
    return key.view(np.int64)


SKETCH = "struct<n_shingles:long,set_key:binary,buckets:array<long>>"


def sketches(docs: DataFrame, text_col: str = "text", width: int = 4, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with ``sketch``: the size and a 128-bit key of the set, and its buckets."""
    small_batches(docs)

    @F.arrow_udf(SKETCH)
    def sketched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with for_task(_words()) as memory:
            for batch in batches:
                sizes, keys, found, number = [], [], [], []
                for _, texts in parcels(batch):
                    for text in texts:
                        held = shingles(text, width, memory)
                        sizes.append(len(held))
                        keys.append(xxhash.xxh3_128_digest(held.tobytes()) if len(held) else None)
                        number.append(bands if len(held) else 0)
                        if len(held):
                            found.append(buckets(signature(held, bands * rows), bands))
                    memory.trim()
                flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
                yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), ragged(flat, number)], ["n_shingles", "set_key", "buckets"])

    return docs.withColumn("sketch", sketched(F.col(text_col)))


def _filter(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of ``ids``: ``FILTER_BITS`` of them, however many ids there are."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select(bit.alias("bit")).selectExpr("int(bit div 64) AS word", "shiftleft(1L, int(bit % 64)) AS bits")
    held = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[held["word"].to_numpy()] = held["bits"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the documents whose id may be in ``nodes``, by one more read of the texts."""
    chosen = docs.sparkSession.sparkContext.broadcast(np.packbits(_filter(nodes)).tobytes())  # 4 MB, however many nodes
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("bit")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(chosen.value, np.uint8)
        with for_task(_words()) as memory:
            for batch in batches:
                bit = batch.column(2).to_numpy()
                batch = batch.filter(pa.array((packed[bit >> 3] << (bit & 7) & 128).astype(bool)))
                ids = batch.column(0)
                for first, texts in parcels(batch.column(1)):
                    held = [shingles(t, width, memory).view(np.int64) for t in texts]
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(held)), ragged(pa.array(np.concatenate(held)), [len(h) for h in held])], ["id", "shingles"])
                    memory.trim()

    return docs.filter("id is not null").select("id", "text", bit).mapInArrow(read, "id long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    whole = F.size("of_a") + F.size("of_b") - both
    # A hub's pairs are dealt to parts of some HUB, each with the hub's set.
    hubs = settle(pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB).alias("parts")).filter("parts > 1"))
    if 0 < hubs.count() <= MOST_HUBS:
        parts = F.coalesce("parts", F.lit(1).cast("long"))
        pairs = pairs.join(F.broadcast(hubs), "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), parts)).drop("parts")
        right = right.join(F.broadcast(hubs), "b", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
        met = pairs.join(right, ["b", "part"])
    else:
        met = pairs.join(right, "b")
    return met.join(left, "a").filter(both * 100 >= whole * percent).select("a", "b").distinct()


def _joining(group: pa.Table, percent: int, bands: int, rows: int) -> list[tuple[int, int]]:
    """Links of one block of a bucket that join components."""
    nodes, bucket = group["node"].to_pylist(), group["bucket"][0].as_py()
    sets = [x.values.to_numpy().view(_U64) for x in group["shingles"]]
    signed = np.stack([signature(h, bands * rows) for h in sets])
    keys = np.stack([buckets(x, bands) for x in signed])
    n = np.array([len(h) for h in sets])
    names, label = np.unique(group["component"].to_numpy(), return_inverse=True)
    parent = list(range(len(names)))

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    low, high = group["low"][0].as_py(), group["high"][0].as_py()
    blocks = group["block"].to_numpy()
    left = np.flatnonzero(blocks == low)
    right = left if low == high else np.flatnonzero(blocks == high)
    out = []
    for i in left.tolist():
        roots = np.array([root(c) for c in range(len(parent))])[label]
        others = right[(right > i) & (roots[right] != roots[i])] if low == high else right[roots[right] != roots[i]]
        others = others[(n[others] * 100 >= n[i] * percent) & (n[i] * 100 >= n[others] * percent)]
        if not len(others):
            continue
        near = (signed[others] == signed[i]).mean(axis=1)
        others = others[near >= percent / 100 - MARGIN]
        same = keys[others] == keys[i]
        others = others[keys[i][same.argmax(axis=1)] == bucket]  # else another bucket compares the two
        for j in others.tolist():
            a, b = root(int(label[i])), root(int(label[j]))
            if a == b:
                continue
            at = np.minimum(np.searchsorted(sets[j], sets[i]), len(sets[j]) - 1)
            both = int((sets[j][at] == sets[i]).sum())
            if both * 100 >= (n[i] + n[j] - both) * percent:
                parent[max(a, b)] = min(a, b)
                out.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))
    return out


def _between(labelled: DataFrame, sets: DataFrame, percent: int, bands: int, rows: int) -> DataFrame:
    """Links (a, b) that join components within buckets of ``labelled`` (bucket, m, node, component).

    A bucket's ``m`` nodes are dealt to blocks, and a pair of blocks is a task's group of at
    most some ``2 * BLOCK`` nodes. Shipping a pair of blocks costs far less than comparing it.
    """
    spread = labelled.withColumn("blocks", F.ceil(F.col("m") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = ["bucket", "low", "high"]
    dealt = spread.join(sets, F.col("node") == F.col("id")).select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "component", "shingles")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, keys):
            found = _joining(group, percent, bands, rows) if group.num_rows > 1 else []
            if found:
                yield pa.RecordBatch.from_pydict({"a": [a for a, _ in found], "b": [b for _, b in found]})

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(joined, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component) of every document: a component is its smallest id."""
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    base = settle(sketches(named, "text", width, bands, rows).select("id", "sketch.*"))
    # One node for each set of shingles. Copies meet in partial sums before the shuffle.
    of_set = base.filter("n_shingles > 0 and id is not null").groupBy("set_key").agg(F.min("id").alias("node"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"))
    spread = settle(of_set.select("node", "n", F.explode("buckets").alias("bucket")))
    met = spread.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("m")).filter("m > 1").select("bucket", "hub", "m")
    shared = settle(spread.join(met, "bucket").hint("rebalance"))

    def sized(n: str, m: str):
        return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)

    stars = settle(shared.filter((F.col("node") != F.col("hub.node")) & sized("n", "hub.n")).select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct())
    ends = stars.select(F.col("a").alias("id")).unionByName(stars.select(F.col("b").alias("id")))
    links = settle(_confirmed(stars, _sets(named, ends, width), percent).hint("rebalance"))
    parts = components(links)

    # Buckets in which more than one component is left.
    labelled = shared.select("bucket", "m", "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    labelled = settle(labelled.join(mixed, "bucket", "left_semi"))
    if not labelled.isEmpty():
        more = _between(labelled, _sets(named, labelled.select(F.col("node").alias("id")), width), percent, bands, rows)
        parts = components(links.unionByName(more))

    member = settle(of_set.select(F.col("set_key").alias("key"), "node").join(parts, "node", "left").select("key", F.coalesce("component", "node").alias("component")))
    found = base.select("id", "n_shingles", "set_key").join(member, F.col("set_key") == F.col("key"), "left")
    return found.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those that are not the first of their component; rows without an id stay."""
    gone = classes(docs, id_col, text_col, **options).filter("id <> component").select(F.col("id").alias("gone")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")
