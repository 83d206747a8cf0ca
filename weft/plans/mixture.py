"""Mixture expressions resolved into one lazy plan (U06 with J09, J19, U01).

Grammar (kept from the reference): ``a+b`` splits at the top level only; a name that is
itself a mixture expands until none is left; the final list is **sorted** (Q25). Each
item is ``name[*times][@subset]``: ``@subset`` names an *ignore list* of row positions
to drop (J09, a left-anti join), ``*times`` repeats the rows (J19, an explode of a
sequence, no join). ``name@s*3`` would put ``*3`` in the subset name; that form is
rejected (Q11). Expansion cycles are an error (Q12 fix).

Only names are handled on the driver; rows never leave the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MixtureItem:
    name: str
    subset: str | None
    times: int


def expand_names(expr: str, mixtures: Mapping[str, Sequence[str]]) -> list[str]:
    """Expand an expression to the sorted list of dataset items (duplicates kept)."""
    names = expr.split("+") if "+" in expr else [expr]
    seen: set[str] = set()
    while any(n in mixtures for n in names):
        for n in names:
            if n in mixtures:
                if n in seen:
                    raise ValueError(f"mixture '{n}' expands into itself")
                seen.add(n)
        names = [m for n in names for m in (mixtures[n] if n in mixtures else [n])]
    return sorted(names)


def parse_item(item: str) -> MixtureItem:
    subset = None
    name = item
    if "@" in name:
        parts = name.split("@")
        if len(parts) != 2:
            raise ValueError(f"bad mixture item '{item}'")
        name, subset = parts
        if "*" in subset:
            raise ValueError(f"'{item}': write the repeat before the subset, as name*k@subset")
    times = 1
    if "*" in name:
        name, t = name.split("*")
        times = int(t)
    return MixtureItem(name, subset, times)


def drop_positions(df: DataFrame, ignore: DataFrame, key: str = "row_id") -> DataFrame:
    """All positions minus the ignored ones (left-anti join)."""
    return df.join(ignore.select(key).distinct(), key, "left_anti")


def repeat_rows(df: DataFrame, times: int, name: str = "copy") -> DataFrame:
    """Each row ``times`` times with a copy index; a generator, not a join."""
    if times < 1:
        raise ValueError("times must be >= 1")
    if times == 1:
        return df.withColumn(name, F.lit(0))
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def concat_all(parts: Sequence[DataFrame], ordinal: str = "part") -> DataFrame:
    """Union keeping duplicates; ``part`` records the concatenation order.

    (Q15 fix: the reference's two-way sum indexes its right side modulo the left size;
    here every part keeps all of its rows.)
    """
    out = None
    for i, df in enumerate(parts):
        df = df.withColumn(ordinal, F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to concatenate")
    return out


def build_mixture(
    expr: str,
    datasets: Mapping[str, Callable[[bool], DataFrame]],
    mixtures: Mapping[str, Sequence[str]] | None = None,
    ignore_lists: Callable[[str, str], DataFrame] | None = None,
) -> DataFrame:
    """One lazy DataFrame for a mixture expression.

    ``datasets[name](numbered)`` returns canonical samples; ``row_id`` is needed, and
    worked out, only where an ignore list asks for it (``numbered``). ``ignore_lists(name,
    subset)`` returns the row positions to drop. The result has ``part`` (sorted item
    ordinal) and ``copy`` columns next to the sample columns.
    """
    parts = []
    for raw in expand_names(expr, mixtures or {}):
        item = parse_item(raw)
        if item.name not in datasets:
            raise ValueError(f"dataset '{item.name}' is not registered")
        df = datasets[item.name](item.subset is not None)
        if item.subset is not None:
            if ignore_lists is None:
                raise ValueError(f"no ignore lists for '{raw}'")
            df = drop_positions(df, ignore_lists(item.name, item.subset))
        parts.append(repeat_rows(df, item.times))
    return concat_all(parts)


def merge_datasets(spark, root: str, allow: Sequence[str], partition: str = "dataset") -> DataFrame:
    """Concatenate the record files of the allowed datasets under a
    ``partition=name`` folder layout; only the allowed folders are read (partition
    pruning)."""
    df = spark.read.parquet(root)
    return df.filter(F.col(partition).isin(list(allow)))
