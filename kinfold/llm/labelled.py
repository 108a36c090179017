"""Rows that may teach: labels with their texts, held-out folds left out."""

from __future__ import annotations

import math
import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm._shared import Remembered

#: Labels up to so many rows (16 bytes each) go to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000

#: What surrounds a word's letters and digits.
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(folds)), F.lit(0)).cast("int")


def teaching(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int | None = None) -> DataFrame:
    """(text, label) of the rows of ``docs`` that have a label and whose id passes ``keep``.

    ``keep`` is a condition on ``doc_id``. Several labels of a document count as the
    highest, null ones not at all. With ``limit``, at most as many labels are kept, those
    with the smallest hashes of their ids.
    """
    chosen = labels.filter(keep & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    n = chosen.count()
    if limit is not None and n > limit:
        chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        n = limit
    if n <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    return docs.filter(keep).select("doc_id", "text").join(chosen, "doc_id").select("text", "label")


class WordIds(Remembered):
    """48-bit hashes of words without the marks around them, in lower case; -1 for marks alone.

    The two largest numbers stand for no word. Among a billion words, 4 in a million share one.
    """

    def __missing__(self, word: str) -> int:
        core = _EDGES.sub("", word)
        self[word] = h = xxhash.xxh3_64_intdigest(core.encode()) % ((1 << 48) - 2) if core else -1
        self.grew(len(word))
        return h


def platt(points: list[tuple[float, float, float]]) -> tuple[float, float]:
    """(a, b) of the logistic curve through (x, positives, negatives), by Newton's method.

    Targets are drawn in from 0 and 1 by the number of rows behind them, as Platt does, so
    that classes which do not overlap still give a finite slope.
    """
    pos, neg = sum(p for _, p, _ in points), sum(n for _, _, n in points)
    if not pos or not neg:
        return 0.0, math.log((pos + 1) / (neg + 1))
    high, low = (pos + 1) / (pos + 2), 1 / (neg + 2)
    a, b = 0.0, math.log((pos + 1) / (neg + 1))

    def loss(a: float, b: float) -> float:
        total = 1e-6 * a * a
        for x, p, n in points:
            z = a * x + b
            softplus = max(z, 0) + math.log1p(math.exp(-abs(z)))
            total += p * (softplus - high * z) + n * (softplus - low * z)
        return total

    for _ in range(100):
        ga, gb, haa, hab, hbb = 2e-6 * a, 0.0, 2e-6 + 1e-9, 0.0, 1e-9
        for x, p, n in points:
            s = 1 / (1 + math.exp(-max(-500.0, min(500.0, a * x + b))))
            g, h = p * (s - high) + n * (s - low), (p + n) * max(s * (1 - s), 1e-12)
            ga, gb, haa, hab, hbb = ga + g * x, gb + g, haa + h * x * x, hab + h * x, hbb + h
        det = haa * hbb - hab * hab
        if det <= 0 or abs(ga) + abs(gb) < 1e-9:
            break
        da, db, step, now = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det, 1.0, loss(a, b)
        while step > 1e-6 and loss(a - step * da, b - step * db) > now:
            step /= 2
        a, b = a - step * da, b - step * db
        if step * (abs(da) + abs(db)) < 1e-9:
            break
    return a, b
