"""String similarity: Jaro, Jaro-Winkler and token sets, as plain functions and Arrow UDFs.

Spark has none of them. The UDFs work on whole Arrow batches and compare each distinct pair
of a batch once, as the same surnames and companies meet again and again. Null on either
side is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The boost for a shared start, how much of it counts, and from which score.
PREFIX_SCALE, PREFIX_MOST, BOOST_FROM = 0.1, 4, 0.7
#: Fixed value: from which similarity two tokens may stand for one another.
TOKEN_FLOOR = 0.9


def jaro(a: str, b: str) -> float:
    """Jaro similarity; a transposition counts one half for each of its two places."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    from_a = []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), None)
        if j is not None:
            free[j] = False
            from_a.append(c)
    m = len(from_a)
    if not m:
        return 0.0
    from_b = (c for c, unused in zip(b, free, strict=True) if not unused)
    swapped = sum(x != y for x, y in zip(from_a, from_b, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


@lru_cache(maxsize=200_000)
def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised for a shared start if it is high enough already."""
    base = jaro(a, b)
    if base < BOOST_FROM:
        return base
    shared = 0
    for x, y in zip(a[:PREFIX_MOST], b[:PREFIX_MOST], strict=False):
        if x != y:
            break
        shared += 1
    return base + shared * PREFIX_SCALE * (1 - base)


def token_set(a: str, b: str) -> tuple[float, float, list[tuple[str, str, float]]]:
    """(score, containment, pairs) of the sets of tokens of two strings.

    Tokens of ``a`` in order each take their best partner that is left in ``b``, the first of
    equals. The score is the weight of the pairs over the larger set, containment over the
    smaller.
    """
    left, right = sorted(set(a.split())), sorted(set(b.split()))
    if not left or not right:
        return 0.0, 0.0, []
    open_, pairs = list(right), []
    for token in left:
        best, best_score = None, 0.0
        for other in open_:
            if (s := jaro_winkler(token, other)) > best_score:
                best, best_score = other, s
        if best is not None and best_score >= TOKEN_FLOOR:
            open_.remove(best)
            pairs.append((token, best, best_score))
    weight = sum(s for *_, s in pairs)
    return weight / max(len(left), len(right)), weight / min(len(left), len(right)), pairs


@lru_cache(maxsize=200_000)
def _token_score(a: str, b: str) -> float:
    return token_set(a, b)[0]


def _codes(strings: pa.Array) -> tuple[np.ndarray, list[str]]:
    """A number for each string, -1 for null, and the strings they stand for."""
    coded = strings.dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _paired(function: Callable[[str, str], float]):
    @F.arrow_udf("double")
    def scored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            (i, of_i), (j, of_j) = _codes(left), _codes(right)
            there = (i >= 0) & (j >= 0)
            pairs, at = np.unique(np.where(there, i << 32 | j, -1), return_inverse=True)
            scores = np.array([0.0 if p < 0 else function(of_i[p >> 32], of_j[p & 0xFFFFFFFF]) for p in pairs.tolist()], np.float64)
            yield pa.array(scores[at], pa.float64(), mask=~there)

    return scored


def jaro_column(a: Column, b: Column) -> Column:
    return _paired(jaro)(a, b)


def jaro_winkler_column(a: Column, b: Column) -> Column:
    return _paired(jaro_winkler)(a, b)


def token_set_column(a: Column, b: Column) -> Column:
    return _paired(_token_score)(a, b)


def token_set_details(a: Column, b: Column) -> Column:
    """Score, containment and pairs as a struct."""
    kind = "struct<score:double,containment:double,pairs:array<struct<a:string,b:string,similarity:double>>>"

    @F.arrow_udf(kind)
    def scored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        made = pa.struct([("score", pa.float64()), ("containment", pa.float64()), ("pairs", pa.list_(pa.struct([("a", pa.string()), ("b", pa.string()), ("similarity", pa.float64())])))])
        for left, right in batches:
            rows = []
            for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True):
                if x is None or y is None:
                    rows.append(None)
                    continue
                score, containment, pairs = token_set(x, y)
                rows.append({"score": score, "containment": containment, "pairs": [{"a": p, "b": q, "similarity": s} for p, q, s in pairs]})
            yield pa.array(rows, made)

    return scored(a, b)


def soundex(word: Column) -> Column:
    """American Soundex of the letters A to Z; the empty string if there are none."""
    return F.soundex(F.regexp_replace(F.upper(word), "[^A-Z]", ""))
