"""Expressions in steps, so that what several later terms need is worked out once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[SimpleNamespace], dict[str, Column]]


@dataclass(frozen=True)
class Staged:
    """A function of columns as steps that name intermediate values, and a result from them.

    ``on`` adds a projection for each step, which keeps plans small and code generated.
    ``column`` is one expression for use anywhere; it binds each step's values by a lambda.
    """

    steps: tuple[Step, ...]
    result: Callable[[SimpleNamespace], Column]

    def on(self, df: DataFrame, out: str, **inputs: Column) -> DataFrame:
        names = {k: f"__{out}_{k}" for k in inputs}
        held = df.withColumns({names[k]: c for k, c in inputs.items()})
        for step in self.steps:
            made = step(SimpleNamespace(**{k: F.col(n) for k, n in names.items()}))
            names |= {k: f"__{out}_{k}" for k in made}
            held = held.withColumns({names[k]: c for k, c in made.items()})
        done = held.withColumn(out, self.result(SimpleNamespace(**{k: F.col(n) for k, n in names.items()})))
        return done.drop(*names.values())

    def column(self, **inputs: Column) -> Column:
        def bound(values: Column, names: list[str], left: tuple[Step, ...]) -> Column:
            held = SimpleNamespace(**{k: values[k] for k in names})
            if not left:
                return self.result(held)
            made = left[0](held)
            both = F.struct(*(values[k].alias(k) for k in names), *(c.alias(k) for k, c in made.items()))
            return F.transform(F.array(both), lambda v: bound(v, [*names, *made], left[1:]))[0]

        first = F.struct(*(c.alias(k) for k, c in inputs.items()))
        return F.transform(F.array(first), lambda v: bound(v, list(inputs), self.steps))[0]
