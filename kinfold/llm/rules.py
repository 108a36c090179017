"""Quality rules as learned decision lists (operator 1), in DataFrame operations only.

Texts become statistics. From those of labelled documents, sequential covering learns an
ordered list of conjunctions of thresholds that reject: a rule is grown on one part of the
rows by the condition with the most FOIL gain, pruned to the length that does best on the
other part, and kept if it is precise enough; the rows it covers are set aside for the next.
The list becomes one conditional expression, so applying it needs no Python.

Each step of growing is one aggregation over all labelled rows, whose result has a row for
each statistic and bin; that is all the driver sees. Cut points come from counts on a fixed
grid, so they do not depend on how rows are dealt out.

Null texts and texts without words have all statistics zero. Without labels of both kinds
the list is empty and rejects nothing. Rows that repeat count as often as they occur, ties
fall on the same side of a cut, an empty table gives no rows, and of columns with the names
of statistics the text's own stay. A text of any length is counted whole, in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm._shared import settle

#: White space, and what counts as a symbol.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Statistics that conditions may be about, as shares of what they are counted in.
SHARES: dict[str, tuple[str, str]] = {
    "symbol_share": ("n_symbols", "word_chars"),
    "shout_share": ("n_shouts", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "bar_share": ("n_bars", "n_words"),
    "mean_word": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}

#: Cut points of a statistic in each class, conditions of a rule, rules of a list.
CUTS, MOST_CONDITIONS, MOST_RULES = 16, 3, 8
#: A statistic x is counted at the place ln(1 + 1000 x) * 64 of a grid; some 1,500 places hold all.
GRID = (1000.0, 64.0)
#: Rejected share that a rule must reach on both parts, and rows it must reject.
PRECISION, LEAST = 0.95, 3


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.name) > self.cut if self.above else F.col(self.name) <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:.6g}"


def _less(text: Column, characters: str) -> Column:
    """How many of ``characters`` (ASCII) the text has."""
    bare = text
    for c in characters:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(bare)).cast("long")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text and with its counts and ``SHARES``; equal names are replaced."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    kept = [c for c in docs.columns if c != text_col and c not in SHARES]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias("_text")).withColumn("_text", text)
    trimmed = F.btrim(F.col("_text"), F.lit(SPACES))
    rows = rows.withColumns({
        "_words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")),
        "_lines": F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
        "n_symbols": _less(F.col("_text"), SYMBOLS),
        "n_bars": _less(F.col("_text"), "|"),
        "n_shouts": _less(F.col("_text"), "!"),
        "n_upper": F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long"),
    }).drop("_text")
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    }).drop("_words", "_lines")
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_hashes") - WINDOW),
        lambda i: F.xxhash64(*(F.get("_hashes", i + j) for j in range(WINDOW))),
    )
    rows = rows.withColumn("_windows", F.when(F.size("_hashes") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>"))).drop("_hashes")
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = rows.withColumn("_sorted", F.when(repeated, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_windows")
    # Windows that stand beside an equal one after sorting, back in the order of the text.
    beside = F.filter("_sorted", lambda x, i: (x["h"] == F.get("_sorted", i - 1)["h"]) | (x["h"] == F.get("_sorted", i + 1)["h"]))
    starts = F.array_sort(F.transform(beside, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + WINDOW - F.greatest(a["end"] - i, F.lit(0))).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    rows = rows.withColumn("n_repeat_words", F.when(F.col("_sorted").isNotNull(), covered).otherwise(F.lit(0)).cast("long")).drop("_sorted")
    return rows.withColumns({name: F.col(a) / F.greatest(F.col(b), F.lit(1)) for name, (a, b) in SHARES.items()})


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _quantiles(bars: list[tuple[int, int]]) -> list[float]:
    """Values at ``CUTS`` even steps of (place on the grid, rows)."""
    whole, out, upto = sum(n for _, n in bars), [], 0
    for g, n in sorted(bars):
        upto += n
        while len(out) <= CUTS and upto * CUTS >= len(out) * whole:
            out.append(math.expm1(g / GRID[1]) / GRID[0])
    return out


def learn(rows: DataFrame, reject: str = "reject") -> list[list[Condition]]:
    """The rules for ``rows`` with ``SHARES``, the boolean ``reject``, and the boolean ``grow``."""
    names = list(SHARES)
    grid = F.array(*(F.round(F.log1p(F.col(c) * GRID[0]) * GRID[1]).cast("int") for c in names))
    bars = rows.select(reject, F.posexplode(grid).alias("k", "g")).groupBy(reject, "k", "g").agg(F.count("*").alias("n")).collect()
    if len({r[reject] for r in bars}) < 2:
        return []
    seen = {c: sorted({x for y in (False, True) for x in _quantiles([(r.g, r.n) for r in bars if r.k == k and r[reject] == y])}) for k, c in enumerate(names)}
    cuts = {c: [(x + y) / 2 for x, y in pairwise(seen[c])] for c in names}  # half-way, for a margin to both sides
    bins = F.array(*(_bin(c, cuts[c]) for c in names))
    left = settle(rows.select(*names, F.col(reject).cast("int").alias("p"), (~F.col(reject)).cast("int").alias("n"), "grow", bins.alias("bins")))
    rules: list[list[Condition]] = []
    while len(rules) < MOST_RULES:
        rule: list[Condition] = []
        while len(rule) < MOST_CONDITIONS:
            inside = left.filter("grow")
            for c in rule:
                inside = inside.filter(c.column())
            bars = inside.select(F.posexplode("bins").alias("k", "bin"), "p", "n").groupBy("k", "bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()
            p0, n0 = (sum(r[x] for r in bars if r.k == 0) for x in ("p", "n"))
            if not p0 or not n0:
                break
            best = max(_candidates(names, cuts, bars, p0, n0), key=lambda g: g[0], default=(0.0, None))
            if best[0] <= 0:
                break
            rule.append(best[1])
        if not rule:
            break
        # How each start of the rule does on both parts.
        tests, so_far = [], F.lit(True)
        for i, c in enumerate(rule):
            so_far = so_far & c.column()
            tests += [F.coalesce(F.sum(F.when(so_far & part, F.col(x))), F.lit(0)).alias(f"{x}{i}{g}") for x in "pn" for g, part in (("g", F.col("grow")), ("r", ~F.col("grow")))]
        got = left.agg(*tests).first()
        worth = [((got[f"p{i}r"] - got[f"n{i}r"]) / max(1, got[f"p{i}r"] + got[f"n{i}r"]), -i) for i in range(len(rule))]
        size = -max(worth)[1] + 1
        p, n = (got[f"{x}{size - 1}g"] + got[f"{x}{size - 1}r"] for x in "pn")
        if p < LEAST or p < PRECISION * (p + n):
            break
        rules.append(rule[:size])
        covered = F.lit(True)
        for c in rules[-1]:
            covered = covered & c.column()
        left = left.filter(~covered)
    return rules


def _bin(name: str, cuts: list[float]) -> Column:
    """How many cut points are below the value."""
    return sum(((F.col(name) > c).cast("int") for c in cuts), F.lit(0))


def _candidates(names: list[str], cuts: dict[str, list[float]], bars: list, p0: int, n0: int):
    """(gain, condition) of every condition about one statistic."""
    for k, name in enumerate(names):
        by_bin = {r.bin: (r.p, r.n) for r in bars if r.k == k}
        p = n = 0
        for j, cut in enumerate(cuts[name]):
            p, n = p + by_bin.get(j, (0, 0))[0], n + by_bin.get(j, (0, 0))[1]
            yield _gain(p0, n0, p, n), Condition(name, False, cut)
            yield _gain(p0, n0, p0 - p, n0 - n), Condition(name, True, cut)


def verdict(rules: list[list[Condition]]) -> Column:
    """The first rule that rejects, in words; null where none does."""
    out = None
    for rule in rules:
        hit = F.lit(True)
        for c in rule:
            hit = hit & c.column()
        said = F.lit(" and ".join(map(str, rule)))
        out = F.when(hit, said) if out is None else out.when(hit, said)
    return F.lit(None).cast("string") if out is None else out


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> tuple[DataFrame, list[list[Condition]]]:
    """Statistics and ``rejected_by`` of all ``docs``, and the rules learned from ``labels``."""
    measured = settle(statistics(docs.select(id_col, text_col), text_col))
    marks = labels.filter(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg((F.max(label) == 0).alias("reject"))
    grow = F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(3)) > 0
    taught = settle(measured.join(marks, F.col(id_col) == F.col("_id")).select(*SHARES, "reject", grow.alias("grow")))
    rules = learn(taught)
    return measured.withColumn("rejected_by", verdict(rules)), rules
