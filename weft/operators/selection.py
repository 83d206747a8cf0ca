"""Exact selection of the top rows of each part without sorting them all.

The score at which a part is cut is found by refining histograms: scores between the least
and the greatest undecided one fall into ``BINS`` equal bins, bins above the cut are in,
those below are out, and the bin with the cut is what is undecided next. A round is one
pass over (part, score) with sums combined before the shuffle, and leaves a bin's share of
the rows undecided; when they are few, or have all one score, only they are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.ids import positions
from weft.session import ensure_checkpoint_dir

BINS = 1024
#: Undecided rows of a part that are put in order rather than refined.
FEW = 10_000
#: Parts whose cuts are sent to all tasks.
FEW_PARTS = 50_000

# Scores that have no place in a bin come in Spark's order: NaN over all numbers, null under all.
_NAN, _TOP, _FINITE, _BOTTOM, _NULL = 4, 3, 2, 1, 0


def _kind(score: Column) -> Column:
    inf = F.lit(float("inf"))
    kind = F.when(score.isNull(), _NULL).when(F.isnan(score), _NAN).when(score == inf, _TOP).when(score == -inf, _BOTTOM)
    return kind.otherwise(_FINITE)


def _bin(score: Column, low: Column, high: Column) -> Column:
    """Bin of a score from its interval; growing with the score, as each step of the division is."""
    width = high - low
    # halves where the width of an interval of great numbers is no number
    halves = (score / 2 - low / 2) / (high / 2 - low / 2)
    place = F.when(width == float("inf"), halves).otherwise((score - low) / width) * BINS
    return F.when(high > low, F.least(F.floor(place), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")


def select_top(df: DataFrame, part: str, score: str, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` that are among the first ``wanted`` (part, ``n``) of their part, by falling score and then by key.

    ``key`` is unique in a part. Parts without a row in ``wanted`` have none. Equal to a rank
    filter, for scores of any kind: nulls come last and NaN first.
    """
    ensure_checkpoint_dir(df.sparkSession)
    value = F.col(score).cast("double")
    rows = df.withColumns({"_wf_score": value, "_wf_kind": _kind(value)})
    narrow = rows.select(part, "_wf_score", "_wf_kind")
    # the cut's kind, its interval of scores, the rows still to be taken there and those there are
    state = wanted.where("n > 0").select(part, F.col("n").cast("bigint").alias("_wf_need")).checkpoint()
    state = _refine(narrow.join(_sent(state), part), part, F.col("_wf_kind"), [])
    while not state.where((F.col("_wf_rows") > FEW) & (F.col("_wf_high") > F.col("_wf_low")) & (F.col("_wf_need") < F.col("_wf_rows"))).isEmpty():
        inside = narrow.join(_sent(state.drop("_wf_rows")), part).where(_undecided())
        slot = _bin(F.col("_wf_score"), F.col("_wf_low"), F.col("_wf_high"))
        state = _refine(inside, part, slot, ["_wf_cut"])
    sure = (F.col("_wf_kind") > F.col("_wf_cut")) | ((F.col("_wf_kind") == F.col("_wf_cut")) & F.coalesce(F.col("_wf_score") > F.col("_wf_high"), F.lit(False)))
    # a cut that takes all undecided rows needs no order
    whole = F.col("_wf_need") >= F.col("_wf_rows")
    placed = rows.join(_sent(state), part)
    certain = placed.where((sure & ~_undecided()) | (_undecided() & whole)).select(*df.columns)
    open_ = placed.where(_undecided() & ~whole).select(*df.columns, "_wf_need", "_wf_score")
    ranked = positions(open_, [F.col("_wf_score").desc(), F.col(key)], partition=[part], name="_wf_rank")
    return certain.union(ranked.where(F.col("_wf_rank") < F.col("_wf_need")).select(*df.columns))


def _sent(state: DataFrame) -> DataFrame:
    """The side of one row a part, sent to the tasks where parts are few: rows stay where they are
    then, and a part need not come together in one task. Many parts spread by themselves."""
    return F.broadcast(state) if state.limit(FEW_PARTS + 1).count() <= FEW_PARTS else state


def _undecided() -> Column:
    within = F.col("_wf_score").between(F.col("_wf_low"), F.col("_wf_high"))
    return (F.col("_wf_kind") == F.col("_wf_cut")) & ((F.col("_wf_cut") != _FINITE) | within)


def _refine(inside: DataFrame, part: str, slot: Column, carried: list[str]) -> DataFrame:
    """(part, need, cut, low, high, rows) of the slot in which the last row to be taken stands.

    A part has at most ``BINS`` slots. Where fewer rows are there than needed, the lowest
    slot is the cut and all of it is needed.
    """
    finite = F.when(F.col("_wf_kind") == _FINITE, F.col("_wf_score"))
    slots = inside.groupBy(part, "_wf_need", *carried, slot.alias("_wf_slot")).agg(
        F.count(F.lit(1)).alias("_wf_rows"), F.min(finite).alias("_wf_low"), F.max(finite).alias("_wf_high")
    )
    down = Window.partitionBy(part).orderBy(F.col("_wf_slot").desc())
    slots = slots.withColumns({"_wf_upto": F.sum("_wf_rows").over(down), "_wf_below": F.lead("_wf_slot").over(down)})
    above = F.col("_wf_upto") - F.col("_wf_rows")
    cut = slots.where((above < F.col("_wf_need")) & ((F.col("_wf_upto") >= F.col("_wf_need")) | F.col("_wf_below").isNull()))
    kind = F.col("_wf_cut") if carried else F.col("_wf_slot")
    return cut.select(part, (F.col("_wf_need") - above).alias("_wf_need"), kind.alias("_wf_cut"), "_wf_low", "_wf_high", "_wf_rows").checkpoint()
