"""Annotators: anything that adds columns to a frame, composed by what it needs and gives.

Trained taggers and parsers plug in through ``batch_annotator``: the model is made once per Python worker,
and rows reach it in Arrow batches. Only rows that pass ``where`` cross into Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X


@dataclass(frozen=True)
class Annotator:
    name: str
    run: Callable[[DataFrame], DataFrame]
    needs: frozenset[str] = field(default_factory=frozenset)
    gives: frozenset[str] = field(default_factory=frozenset)


class Registry:
    """Annotators by (name, variant)."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], Annotator] = {}

    def add(self, a: Annotator, variant: str = "default") -> Annotator:
        if (a.name, variant) in self.known:
            raise ValueError(f"{a.name}/{variant} is registered twice")
        self.known[a.name, variant] = a
        return a

    def chain(self, *names: str) -> Callable[[DataFrame], DataFrame]:
        """The named annotators in order; a column that none of them gives and the frame lacks is an error before any job."""
        steps = [self.known[tuple(n.split("/")) if "/" in n else (n, "default")] for n in names]

        def run(df: DataFrame) -> DataFrame:
            have = set(df.columns)
            for s in steps:
                if s.needs - have:
                    raise ValueError(f"{s.name} needs {sorted(s.needs - have)}")
                have |= s.gives
            for s in steps:
                df = df.transform(s.run)
            return df

        return run


def batch_annotator(name: str, make: Callable[[], Callable[[list[str]], list]], needs: str, gives: str, kind: str, where: str | None = None, size: int = 16) -> Annotator:
    """Wraps a model: ``make()`` returns a function from a list of texts to a list of results. A failed batch leaves null and the reason in ``_error``."""

    def run(df: DataFrame) -> DataFrame:
        rows = df if where is None else df.where(where)

        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = make()
            for b in batches:
                out, err = [], []
                for at in range(0, len(b), size):
                    part = b[needs].iloc[at : at + size].tolist()
                    try:
                        out += list(model(part))
                        err += [None] * len(part)
                    except Exception as e:  # one batch, not the job
                        out += [None] * len(part)
                        err += [str(e)[:200]] * len(part)
                yield b.assign(**{gives: out, "_error": err})

        return rows.mapInPandas(apply, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {gives} {kind}, _error string")

    return Annotator(name, run, frozenset({needs}), frozenset({gives, "_error"}))


REGISTRY = Registry()
REGISTRY.add(Annotator("sentences", lambda d: d.withColumn("sentences", X.sentences(F.col("text"))), frozenset({"text"}), frozenset({"sentences"})))
REGISTRY.add(Annotator("tokens", lambda d: d.withColumn("tokens", F.transform("sentences", X.words)), frozenset({"sentences"}), frozenset({"tokens"})))
REGISTRY.add(Annotator("lemmas", lambda d: d.withColumn("lemmas", F.col("tokens")), frozenset({"tokens"}), frozenset({"lemmas"})))
REGISTRY.add(Annotator("lemmas", lambda d: d.withColumn("lemmas", F.transform("tokens", lambda s: F.transform(s, F.lower))), frozenset({"tokens"}), frozenset({"lemmas"})), "lower")


def routed(df: DataFrame, by: str, ways: dict[str, Callable[[DataFrame], DataFrame]], other: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows through the way of their value (a language, say); the rest through ``other``, or as they are."""
    out = [f(df.where(F.col(by) == k)) for k, f in ways.items()]
    rest = df.where(~F.coalesce(F.col(by).isin(*ways), F.lit(False)))
    out.append(other(rest) if other else rest)
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o, allowMissingColumns=True)
    return result
