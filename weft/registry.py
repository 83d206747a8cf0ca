"""Named slots that a user fills (X01, X03-X05, X07, X08): adapters, metrics, tokenisers.

An adapter is a function ``DataFrame -> DataFrame`` (chained by :func:`apply_chain`), a
metric a function of two Columns (pred, target) that gives a number per row, a tokeniser a
function of a Column that gives an array of ids. Names are looked up on the driver while the
plan is built; nothing of this runs per row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Adapter = Callable[[DataFrame], DataFrame]
Metric = Callable[[Column, Column], Column]
Tokeniser = Callable[[Column], Column]


class Registry(dict):
    """Functions by name; a name can be given once."""

    def __init__(self, kind: str):
        super().__init__()
        self.kind = kind

    def register(self, name: str):
        def deco(fn):
            if name in self:
                raise ValueError(f"{self.kind} '{name}' is already registered")
            self[name] = fn
            return fn

        return deco

    def find(self, name: str):
        if name not in self:
            raise ValueError(f"no {self.kind} '{name}'; known: {', '.join(sorted(self))}")
        return self[name]


ADAPTERS: Registry = Registry("adapter")
METRICS: Registry = Registry("metric")
TOKENISERS: Registry = Registry("tokeniser")


def apply_chain(df: DataFrame, steps: Sequence[str | Adapter]) -> DataFrame:
    """Adapters, by name or as functions, one after the other."""
    for step in steps:
        df = df.transform(ADAPTERS.find(step) if isinstance(step, str) else step)
    return df


def metric_table(df: DataFrame, pred: str, target: str, metrics: Mapping[str, Metric] | Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The mean of each metric over all rows or per group, in one aggregate."""
    table = dict(metrics) if isinstance(metrics, Mapping) else {m: METRICS.find(m) for m in metrics}
    return df.groupBy(*by).agg(*[F.avg(fn(F.col(pred), F.col(target)).cast("double")).alias(name) for name, fn in table.items()])


def tokenise(text: Column, tokeniser: str | Tokeniser) -> Column:
    """Ids of a text by a registered tokeniser or a Column function."""
    return (TOKENISERS.find(tokeniser) if isinstance(tokeniser, str) else tokeniser)(text)


def tokeniser_file(path: str, special: bool = False) -> Tokeniser:
    """A tokeniser file of the ``tokenizers`` library, run on Arrow batches."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        found = loaded.encode_batch([t or "" for t in texts], add_special_tokens=special)
        return pd.Series([e.ids for e in found])

    return encode


@METRICS.register("exact")
def _exact(pred: Column, target: Column) -> Column:
    return (pred == target).cast("double")


@METRICS.register("contained")
def _contained(pred: Column, target: Column) -> Column:
    return F.lower(pred).contains(F.lower(target)).cast("double")


@METRICS.register("similarity")
def _similarity(pred: Column, target: Column) -> Column:
    longest = F.greatest(F.length(pred), F.length(target))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(pred, target) / longest)


@TOKENISERS.register("word_lengths")
def _word_lengths(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.length(w))
