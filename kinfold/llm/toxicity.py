"""Toxicity by class-conditional Kneser-Ney models (operator 9).

Two models, of toxic and of ordinary texts, give each word a probability after the word
before it, and a text's evidence is the difference of its two log-likelihoods divided by its
length. Both are counted over all rows that may teach, in three orders:

* pairs (u, w): in how many texts of the class w follows u, but in no more than the different
  surroundings (three words to each side) in which it does, by linear counting on 32 bits.
  So copies, near copies and loops of a text count once, and an expression that occurs in
  many texts counts each time;
* words: Kneser and Ney's lower order, after how many different words a word occurs;
* the shared order, the same count over both classes together.

Each count loses ``DISCOUNT`` and is smoothed with the shared counts, which weigh ``SHARED``
of the smaller class. A pair or word whose two estimates differ by no more than chance
(``SURE`` standard deviations) or weakly (``STRONG``) backs off: in both classes a pair to
its word, a word to the shared counts, with the weight that is left of the class, so that
each model's probabilities after a word sum to one. Rare expressions thus take the shared
counts in both classes, and only the classes' weights are left to tell them apart.

A logistic curve fitted on the rows that may teach turns evidence into a score. The model
grows with the corpus. It goes to the workers whole while it has at most ``BROADCAST_ENTRIES``
entries; a larger one meets the texts' distinct words and pairs by a shuffle, and none of it
is left out.

Null texts, empty ones and those without letters or digits have no evidence and score as
texts that say nothing. Without labels of both classes there is no evidence at all. Repeated
rows and ties score alike. Texts of fewer than ``SHORTEST`` words are divided by that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm._shared import for_task, parcels, settle, small_batches
from kinfold.llm.labelled import WordIds, platt

DISCOUNT = 0.75
#: Weight of the shared counts, as a share of the smaller class's.
SHARED = 0.25
#: How sure (in standard deviations) and how strong (a ratio's logarithm) a difference must be.
SURE, STRONG = 4.0, 1.0
SHORTEST = 20
#: Entries up to which the model goes to every worker, and in how many parts keys are joined beyond.
BROADCAST_ENTRIES, SALTS = 200_000, 16
#: Bits by which the surroundings of a pair are told apart in each class, and how many may be set
#: before they count as past telling.
MARKS, FULL = 32, 24
#: Bits of the filter by which words that no entry is about stay out of the join; its size is fixed.
FILTER_BITS = 1 << 25
#: Stand-ins: what comes before the first word, and "any" in an entry about a word or a context alone.
START, ANY = (1 << 48) - 1, (1 << 48) - 2


@lru_cache(maxsize=1)
def _word_ids() -> WordIds:
    return WordIds()


def _ids(text: bytes, memory: WordIds) -> np.ndarray:
    words = text.decode().lower().split()
    found = np.fromiter(map(memory.__getitem__, words), np.int64, len(words))
    return found[found >= 0]


def _mixed(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit number for each pair."""
    x = u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ w.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _before(ids: np.ndarray) -> np.ndarray:
    return np.concatenate([[START], ids[:-1]]) if len(ids) else ids


def _marks(ids: np.ndarray) -> np.ndarray:
    """For each word, which of ``MARKS`` bits its pair's surroundings set."""
    n = len(ids)
    wide = np.concatenate([np.zeros(4, np.int64), ids, np.zeros(4, np.int64)])
    x = np.zeros(n, np.uint64)
    for at in (0, 1, 2, 5, 6, 7):  # the pair itself stands at 3 and 4
        x = _mixed(x, wide[at : at + n])
    return (x % np.uint64(MARKS)).astype(np.int64)


def contexts(rows: DataFrame) -> DataFrame:
    """(u, w, toxic, ordinary): how often word w follows u in each class of ``rows`` (text, label)."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with for_task(_word_ids()) as memory:
            for batch in batches:
                labels = batch.column(1).to_numpy(zero_copy_only=False)
                for first, texts in parcels(batch.column(0), 1 << 23):
                    ids = [_ids(t, memory) for t in texts]
                    memory.trim()
                    sizes = [len(i) for i in ids]
                    if not sum(sizes):
                        continue
                    toxic = np.repeat(labels[first : first + len(texts)] > 0, sizes)
                    u, w, bit = (np.concatenate([f(i) for i in ids]) for f in (_before, np.asarray, _marks))
                    text = np.repeat(np.arange(len(ids)), sizes)
                    key = _mixed(u, w)
                    order = np.argsort(key, kind="stable")  # so a pair's places are in order of their texts
                    key, text = key[order], text[order]
                    new = np.append(True, key[1:] != key[:-1])
                    once = new | np.append(True, text[1:] != text[:-1])
                    starts = np.flatnonzero(new)
                    upper = np.where(toxic, np.int64(MARKS), np.int64(0))[order]
                    counts = np.add.reduceat(np.where(once, np.int64(1) << upper, 0), starts)
                    seen = np.bitwise_or.reduceat(np.int64(1) << (bit[order] + upper), starts)
                    u, w = u[order][starts], w[order][starts]
                    columns = [u << 16 | w >> 32, (w & 0xFFFFFFFF).astype(np.uint32).view(np.int32), counts, seen]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["high", "low", "counts", "seen"])

    # The two ids take 12 bytes of a row that is dealt out.
    found = rows.select("text", "label").mapInArrow(met, "high long, low int, counts long, seen long")
    summed = found.groupBy("high", "low").agg(F.sum("counts").alias("counts"), F.bit_or("seen").alias("seen"))
    low = F.lit((1 << MARKS) - 1)
    u = F.shiftrightunsigned("high", 16)
    w = F.shiftleft(F.col("high").bitwiseAND(F.lit(0xFFFF).cast("long")), 32).bitwiseOR(F.col("low").cast("long").bitwiseAND(low))

    def effective(counts: Column, seen: Column) -> Column:
        bits = F.bit_count(seen)
        apart = F.round(F.lit(float(MARKS)) * F.log(F.lit(float(MARKS)) / F.greatest(F.lit(MARKS) - bits, F.lit(1)))).cast("long")
        return F.when(bits >= FULL, counts).otherwise(F.least(counts, apart)).cast("double")

    toxic = effective(F.shiftrightunsigned("counts", MARKS), F.shiftrightunsigned("seen", MARKS))
    return summed.select(u.alias("u"), w.alias("w"), toxic.alias("toxic"), effective(F.col("counts").bitwiseAND(low), F.col("seen").bitwiseAND(low)).alias("ordinary"))


def _telling(toxic: Column, both: Column, share: Column, evidence: Column) -> Column:
    """Whether ``toxic`` of ``both`` differs from ``share`` of them by more than chance, and strongly."""
    return (F.abs(toxic - both * share) >= F.lit(SURE) * F.sqrt(both * share + 0.25)) & (F.abs(evidence) >= STRONG)


class Model(NamedTuple):
    """``entries`` (u, w, evidence) of pairs, of words (u is ``ANY``) and of contexts (w is ``ANY``),
    and the evidence of a word without an entry. No entries without both classes."""

    entries: DataFrame | None
    rest: float


def learned(rows: DataFrame) -> Model:
    """The two models of ``rows`` (text, label), as far as they differ."""
    return model_of(contexts(rows))


def model_of(pairs: DataFrame) -> Model:
    """The two models from all pairs' counts (u, w, toxic, ordinary), as far as they differ.

    Pairs are read once, for the sums by word and by context and for the pairs that can tell:
    those twice in toxic texts, or more often at all than chance leaves without toxic ones.
    Most pairs occur once, so what is written is far less than they are.
    """
    t, o, none = F.col("toxic"), F.col("ordinary"), F.lit(ANY).cast("long")

    def part(u: Column, w: Column, x: Column, y: Column) -> Column:
        return F.struct(u.alias("u"), w.alias("w"), x.cast("double").alias("toxic"), y.cast("double").alias("ordinary"))

    u, w = F.col("u"), F.col("w")
    parts = F.array_compact(F.array(part(none, w, t > 0, o > 0), part(u, none, t, o), F.when((t >= 2) | (t + o > SURE * SURE), part(u, w, t, o))))
    sums = settle(pairs.select(F.explode(parts).alias("p")).select("p.*").groupBy("u", "w").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    words = sums.filter(u == ANY).drop("u")
    of_t, of_o = words.agg(F.sum("toxic"), F.sum("ordinary")).first()
    if not of_t or not of_o:
        return Model(None, 0.0)
    weight, both = SHARED * min(of_t, of_o), t + o

    def of_word(n: Column, whole: float) -> Column:
        return (F.greatest(n - DISCOUNT, F.lit(0.0)) + both / (of_t + of_o) * weight) / (whole + weight)

    words = words.withColumns({"p": of_word(t, of_t), "q": of_word(o, of_o), "shared": both / (of_t + of_o)})
    words = words.withColumn("evidence", F.log(F.col("p") / F.col("q")))
    telling = settle(words.filter(_telling(t, both, F.lit(of_t / (of_t + of_o)), F.col("evidence"))).select("w", "evidence", "p", "q", "shared"))
    in_t, in_o, in_shared = (x or 0.0 for x in telling.agg(F.sum("p"), F.sum("q"), F.sum("shared")).first())
    rest_t, rest_o = ((1 - x) / max(1 - in_shared, 1e-9) for x in (in_t, in_o))  # what is left, for shared counts
    rest = math.log(max(rest_t, 1e-9) / max(rest_o, 1e-9))

    after = sums.filter(w == ANY).select("u", t.alias("all_t"), o.alias("all_o"))
    pairs_t, pairs_o = after.agg(F.sum("all_t"), F.sum("all_o")).first()
    share = pairs_t / (pairs_t + pairs_o)
    some = _met(sums.filter((u != ANY) & (w != ANY)), after, "u")
    k = 1 + SHARED * min(share, 1 - share) * (F.col("all_t") + F.col("all_o"))
    together = (both - DISCOUNT) / (F.col("all_t") + F.col("all_o"))

    def of_pair(n: Column, whole: Column) -> Column:
        return (F.greatest(n - DISCOUNT, F.lit(0.0)) + k * together) / (whole + k)

    some = some.withColumns({"p": of_pair(t, F.col("all_t")), "q": of_pair(o, F.col("all_o"))}).withColumn("evidence", F.log(F.col("p") / F.col("q")))
    expected = (F.col("all_t") + 10 * share) / (F.col("all_t") + F.col("all_o") + 10)
    some = settle(some.filter(_telling(t, both, expected, F.col("evidence"))).select("u", "w", "evidence", "p", "q"))
    # What a context's telling pairs leave to all other words, in each class.
    lower = _met(some, telling.select("w", F.col("p").alias("p1"), F.col("q").alias("q1")), "w", "left")
    lower = _met(lower, words.select("w", "shared"), "w").select(
        "u", "p", "q", F.coalesce("p1", F.lit(rest_t) * F.col("shared")).alias("p1"), F.coalesce("q1", F.lit(rest_o) * F.col("shared")).alias("q1")
    )

    def left(*names: str) -> list[Column]:
        return [F.greatest(1 - F.sum(n), F.lit(1e-9)) for n in names]

    p, q, p1, q1 = left("p", "q", "p1", "q1")
    around = lower.groupBy("u").agg(F.log(p / p1 / (q / q1)).alias("evidence"))
    entries = some.select("u", "w", "evidence")
    entries = entries.unionByName(telling.select(F.lit(ANY).cast("long").alias("u"), "w", "evidence"))
    entries = entries.unionByName(around.select("u", F.lit(ANY).cast("long").alias("w"), "evidence"))
    return Model(settle(entries), rest)


def _met(rows: DataFrame, by_key: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` (few of all) joined with one row for each ``key``; common keys are dealt out in ``SALTS`` parts."""
    asked = by_key.join(rows.select(key).distinct(), key, "left_semi")
    salted = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("u", "w"), F.lit(SALTS))).join(salted, [key, "_salt"], how).drop("_salt")


class Table:
    """Evidence by pair, looked up for arrays."""

    def __init__(self, u: np.ndarray, w: np.ndarray, evidence: np.ndarray):
        keys = _mixed(u, w)
        order = np.argsort(keys)
        self.keys, self.evidence = keys[order], evidence[order]

    def get(self, u: np.ndarray, w: np.ndarray, default: float) -> tuple[np.ndarray, np.ndarray]:
        """The evidence of each pair, and whether it has an entry."""
        if not len(self.keys):
            return np.full(len(w), default), np.zeros(len(w), bool)
        wanted = _mixed(u, w)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        known = self.keys[at] == wanted
        return np.where(known, self.evidence[at], default), known

    def of_text(self, ids: np.ndarray, rest: float) -> float:
        """The difference of the two log-likelihoods of a text, a word."""
        if not len(ids):
            return 0.0
        before, any_ = _before(ids), np.full(len(ids), ANY)
        of_pair, known = self.get(before, ids, 0.0)
        each = np.where(known, of_pair, self.get(before, any_, 0.0)[0] + self.get(any_, ids, rest)[0])
        return float(each.sum() / max(len(ids), SHORTEST))


def evidence(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "evidence") -> DataFrame:
    """``docs``, without their text, with the difference of log-likelihoods of each whole text, a word."""
    if model.entries is None:
        return docs.drop(text_col).withColumn(out_col, F.lit(0.0))
    if model.entries.count() > BROADCAST_ENTRIES:
        return _evidence_by_join(docs, model, text_col, out_col)
    held = model.entries.toArrow()
    table = Table(*(held[c].to_numpy() for c in ("u", "w", "evidence")))
    shipped, rest = docs.sparkSession.sparkContext.broadcast((table.keys, table.evidence)), model.rest

    @F.arrow_udf("double")
    def weighed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Table.__new__(Table)
        known.keys, known.evidence = shipped.value
        with for_task(_word_ids()) as memory:
            for batch in batches:
                out = []
                for _, texts in parcels(batch):
                    out += [known.of_text(_ids(text, memory), rest) for text in texts]
                    memory.trim()
                yield pa.array(out, pa.float64())

    return docs.withColumn(out_col, weighed(F.col(f"`{text_col}`"))).drop(text_col)


def _filter(entries: DataFrame) -> np.ndarray:
    """The bit of each entry among ``FILTER_BITS``, as bytes."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _mixed(*(batch.column(i).to_numpy() for i in (0, 1))) % np.uint64(FILTER_BITS)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(5)).astype(np.int64)), pa.array(np.int64(1) << (at & np.uint64(31)).astype(np.int64))], ["word", "bits"])

    held = entries.select("u", "w").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[held["word"].to_numpy()] = held["bits"].to_numpy().astype(np.uint32)
    return out


def _evidence_by_join(docs: DataFrame, model: Model, text_col: str, out_col: str) -> DataFrame:
    """``evidence`` with a model of any size: each text's distinct keys meet it by a shuffle."""
    shipped, rest = docs.sparkSession.sparkContext.broadcast(_filter(model.entries)), model.rest  # 4 MB, whatever the model
    keys = "array<struct<u:bigint,w:bigint>>"
    keys_arrow = pa.list_(pa.struct([("u", pa.int64()), ("w", pa.int64())]))

    @F.arrow_udf(keys)
    def asked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = shipped.value
        with for_task(_word_ids()) as memory:
            for batch in batches:
                out = []
                for _, texts in parcels(batch):
                    for text in texts:
                        ids = _ids(text, memory)
                        before, any_ = _before(ids), np.full(len(ids), ANY)
                        u, w = np.concatenate([before, before, any_]), np.concatenate([ids, any_, ids])
                        at = _mixed(u, w) % np.uint64(FILTER_BITS)
                        may = words[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1) > 0
                        out.append([{"u": a, "w": b} for a, b in set(zip(u[may].tolist(), w[may].tolist(), strict=True))])
                    memory.trim()
                yield pa.array(out, keys_arrow)

    @F.arrow_udf("double")
    def weighed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        with for_task(_word_ids()) as memory:
            for texts, entries in batches:
                out = []
                for text, found in zip(texts, entries, strict=True):
                    got = found.values if found.is_valid else pa.array([], pa.struct([("u", pa.int64()), ("w", pa.int64()), ("evidence", pa.float64())]))
                    known = Table(*(got.field(c).to_numpy(zero_copy_only=False) for c in ("u", "w", "evidence")))
                    out.append(known.of_text(_ids((text.as_py() or "").encode(), memory), rest))
                    memory.trim()
                yield pa.array(out, pa.float64())

    # A row's number holds once it is written. Common words are dealt out by salt.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != out_col))
    rows = settle(docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text"), asked(F.col(f"`{text_col}`")).alias("keys"), F.monotonically_increasing_id().alias("number")))
    met = rows.select("number", F.pmod(F.xxhash64("number"), F.lit(SALTS)).alias("salt"), F.explode("keys").alias("key")).select("number", "salt", "key.*")
    salted = model.entries.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    found = met.join(salted, ["u", "w", "salt"]).groupBy("number").agg(F.collect_list(F.struct("u", "w", "evidence")).alias("entries"))
    joined = rows.drop("keys").join(found, "number", "left").select("row", weighed("text", "entries").alias("found"))
    return joined.select("row.*", F.col("found").alias(out_col)).drop(text_col)


def score(docs: DataFrame, rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of every document of ``docs`` (doc_id, text).

    ``rows`` (text, label) teach the models and ``labels`` (doc_id, label) the curve; both
    must leave out what is held out.
    """
    small_batches(docs)
    weighed = settle(evidence(docs.select("doc_id", "text"), learned(rows)))
    rounded = F.round(F.greatest(F.least(F.col("evidence"), F.lit(4.0)), F.lit(-4.0)) * 1000).cast("int")
    bars = weighed.join(labels, "doc_id").groupBy(rounded.alias("bar")).agg(F.sum(F.col("label").cast("long")).alias("pos"), F.count("*").alias("n"))
    points = [(r.bar / 1000, float(r.pos), float(r.n - r.pos)) for r in bars.filter("bar is not null").collect()]  # 8,001 at most
    a, b = platt(points)
    if not math.isfinite(a + b):
        a, b = 0.0, 0.0
    return weighed.select("doc_id", (1 / (1 + F.exp(-(F.col("evidence") * a + b)))).alias("score"))
