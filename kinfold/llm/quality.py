"""Quality by a factorisation machine (operator 4).

A text becomes hashed words (logarithms of counts, as a vector of length one), statistics of
its structure and its size. The machine scores

    b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

the last term being all pairwise interactions in time linear in the features. It is fitted
by AdaGrad on the driver, on a sample of labelled rows of at most ``SAMPLE`` rows, chosen by
a hash of the id; their features, 8 bytes for each of at most ``BUCKETS + STATISTICS`` that a
text has, are all that is collected.

Null texts count as empty. An empty text has no words and all statistics zero, and is scored
like any other. With labels of one class only all scores are near that class (0.00005 from it),
without any they are one half.
Repeated rows and ties get equal scores; a repeated id teaches with each of its texts. An
empty table gives none, and other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._shared import Remembered, for_task, parcels, small_batches

#: Most labelled rows that the machine is fitted on.
SAMPLE = 8_000
BUCKETS, FACTORS, EPOCHS = 1 << 14, 6, 12

_MARKS = b".,!?;:()[]{}\"'|*$%&#<>=_-"
_DROP = {
    "symbols": b"#*$%&<>",
    "bars": b"|",
    "shouts": b"!",
    "stops": b".,;:?",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": b"0123456789",
    "lines": b"\n",
    "other": bytes(range(128, 256)),
}
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
#: Number of statistics of a text.
STATISTICS = len(_DROP) + 8


class Buckets(Remembered):
    """Hashes of words; those of words without a letter are ``BUCKETS`` higher."""

    def __missing__(self, word: bytes) -> int:
        core = word.lower().strip(_MARKS) or word
        self[word] = h = xxhash.xxh3_64_intdigest(core) % BUCKETS + (0 if _LETTER.search(word) else BUCKETS)
        self.grew(len(word))
        return h


@lru_cache(maxsize=1)
def _buckets() -> Buckets:
    return Buckets()


def statistics(raw: bytes, words: list[bytes], bare: int) -> list[float]:
    """Shares and logarithms that describe a text's structure and size; ``bare`` words have no letter."""
    n, k = len(raw), len(words)
    if not k:
        return [0.0] * STATISTICS
    shares = [8 * (n - len(raw.translate(None, drop))) / n for drop in _DROP.values()]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        *(min(s, 4.0) for s in shares),
        np.log1p(n) / 8,
        np.log1p(k) / 6,
        min(n / k / 8, 4.0),
        2 * (1 - len(set(lines)) / len(lines)),
        2 * len(set(words)) / k,
        4 * sum(map(eq, words, words[1:])) / k,
        min(2.0, 2 * bare / k),
        np.log1p(k / len(lines)) / 4,
    ]


def features(raw: bytes, memory: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the features that are not zero."""
    words = raw.split()
    hashes = np.fromiter(map(memory.__getitem__, words), np.int64, len(words))
    dense = np.array(statistics(raw, words, np.count_nonzero(hashes >= BUCKETS)))
    if not words:
        return np.arange(BUCKETS, BUCKETS + STATISTICS), dense
    found, counts = np.unique(hashes % BUCKETS, return_counts=True)
    values = np.log1p(counts)
    values /= np.sqrt((values * values).sum())
    return np.concatenate([found, np.arange(BUCKETS, BUCKETS + STATISTICS)]), np.concatenate([values, dense])


class Machine:
    """Weights of a factorisation machine; ``fit`` learns them."""

    def __init__(self, prior: float = 0.5):
        rng = np.random.default_rng(4)
        self.bias = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 20.0 * (prior > 0.5) - 10.0
        self.linear = np.zeros(BUCKETS + STATISTICS)
        self.factors = rng.normal(0, 0.01, (BUCKETS + STATISTICS, FACTORS))

    @classmethod
    def flat(cls, share: float) -> Machine:
        """A machine that scores every text alike, with the share of label 1."""
        made = cls(share)
        made.factors[:] = 0
        return made

    def raw(self, numbers: np.ndarray, values: np.ndarray) -> float:
        v = self.factors[numbers]
        sums = values @ v
        squares = (values * values) @ (v * v)
        return self.bias + float(self.linear[numbers] @ values) + 0.5 * float(sums @ sums - squares.sum())

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, batch: int = 64, rate: float = 0.1, decay: float = 1e-5) -> Machine:
        rng = np.random.default_rng(5)
        seen = [1e-8, np.full(self.linear.shape, 1e-8), np.full(self.factors.shape, 1e-8)]
        for _ in range(max(EPOCHS, 1000 * batch // len(rows))):  # 1,000 steps at least
            for some in np.array_split(rng.permutation(len(rows)), -(-len(rows) // batch)):
                sizes = np.array([len(rows[i][0]) for i in some])
                numbers, values = (np.concatenate([rows[i][j] for i in some]) for j in (0, 1))
                starts, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(some)), sizes)
                v = self.factors[numbers] * values[:, None]
                sums = np.add.reduceat(v, starts)
                z = self.bias + np.add.reduceat(self.linear[numbers] * values, starts) + 0.5 * (sums**2 - np.add.reduceat(v * v, starts)).sum(1)
                slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) / len(some)
                used, at = np.unique(numbers, return_inverse=True)
                by_row = slope[row] * values
                g = np.bincount(at, by_row) + decay * self.linear[used]
                seen[1][used] += g * g
                self.linear[used] -= rate * g / np.sqrt(seen[1][used])
                pull = by_row[:, None] * (sums[row] - v)
                g = np.stack([np.bincount(at, pull[:, f]) for f in range(FACTORS)], 1) + decay * self.factors[used]
                seen[2][used] += g * g
                self.factors[used] -= rate * 0.3 * g / np.sqrt(seen[2][used])
                g = slope.sum()
                seen[0] += g * g
                self.bias -= rate * g / np.sqrt(seen[0])
        return self


FEATURES = "struct<numbers:array<int>,values:array<float>>"


def learn(rows: DataFrame) -> Machine:
    """A machine fitted on ``rows`` (text, label), whose number the caller bounds."""
    small_batches(rows)

    @F.arrow_udf(FEATURES)
    def featured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with for_task(_buckets()) as memory:
            for batch in batches:
                got = []
                for _, texts in parcels(batch):
                    got += [features(t, memory) for t in texts]
                    memory.trim()
                numbers, values = (pa.array([g[i] for g in got], pa.list_(t)) for i, t in ((0, pa.int32()), (1, pa.float32())))
                yield pa.StructArray.from_arrays([numbers, values], ["numbers", "values"])

    held = rows.select(featured("text").alias("x"), "label").select("x.*", "label").toArrow()
    if not held.num_rows:
        return Machine.flat(0.5)
    labels = (held["label"].to_numpy() > 0).astype(float)
    if labels.min() == labels.max():
        return Machine.flat(float(labels[0]))
    pairs = list(zip((x.values.to_numpy() for x in held["numbers"]), (x.values.to_numpy().astype(float) for x in held["values"]), strict=True))
    order = sorted(range(len(pairs)), key=lambda i: (xxhash.xxh3_64_intdigest(pairs[i][0].tobytes() + pairs[i][1].tobytes()), labels[i]))  # rows come in any order
    return Machine(labels.mean()).fit([pairs[i] for i in order], labels[order])


def score(docs: DataFrame, machine: Machine, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is of label 1."""
    small_batches(docs)
    model = docs.sparkSession.sparkContext.broadcast(machine)  # 1 MB, whatever the input

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = model.value
        with for_task(_buckets()) as memory:
            for batch in batches:
                out = []
                for _, texts in parcels(batch):
                    out += [machine.raw(*features(t, memory)) for t in texts]
                    memory.trim()
                yield pa.array(1 / (1 + np.exp(-np.clip(np.array(out, float), -500, 500))), pa.float64())

    return docs.withColumn(out_col, scored(F.col(text_col)))
