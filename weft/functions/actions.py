"""Agent actions (F24–F26): parse a predicted action, compare it with the ground truth."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.boxes import BOX_PATTERN, iou_floor1
from weft.functions.lcs import lcs_length

ARGS = "struct<bbox:array<double>,direction:string,text:string,status:string>"
# Action types in the order the keyword ladder tries them; scroll directions.
ACTION_TYPES = ["click_element", "scroll", "input", "press_home", "press_back", "press_enter", "stop"]
DIRECTIONS = ["up", "down", "left", "right"]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _between(text: Column, sep: str) -> Column:
    """``text.split(sep)[1]`` (null when sep is absent)."""
    return F.get(F.split(text, sep.replace("{", "\\{"), -1), 1)


def parse_action(pred: Column | str) -> Column:
    """struct(action, args) from JSON; else JSON after the first ``{``; else the
    first action keyword (lower or upper case) with typed args: first box for clicks,
    first direction after ``scroll``, the text after ``text`` for input."""
    p = _c(pred)
    # keys differ only by case, so read a string map (nested values stay JSON text)
    js = F.from_json(p, "map<string,string>")
    js2 = F.from_json(F.concat(F.lit("{"), _between(p, "{")), "map<string,string>")
    act = lambda j: F.coalesce(F.try_element_at(j, F.lit("ACTION")), F.try_element_at(j, F.lit("action")))
    valid = lambda j: act(j).isNotNull()
    # Q2 fix: predicted args are ARGS, else args
    raw_args = lambda j: F.coalesce(F.try_element_at(j, F.lit("ARGS")), F.try_element_at(j, F.lit("args")))
    from_js = lambda j: F.struct(act(j).alias("action"), F.from_json(raw_args(j), ARGS).alias("args"))
    kw = F.lit(None).cast("string")
    for t in reversed(ACTION_TYPES):
        kw = F.when(p.contains(t) | p.contains(t.upper()), F.lit(t)).otherwise(kw)
    box = F.transform(F.regexp_extract_all(p, F.lit(BOX_PATTERN), 0), lambda b: b)
    first_box = F.get(
        F.transform(
            F.regexp_extract_all(p, F.lit(BOX_PATTERN), 1),
            lambda _x, i: F.array(*[F.get(F.regexp_extract_all(p, F.lit(BOX_PATTERN), k), i).cast("double") for k in (1, 2, 3, 4)]),
        ),
        0,
    )
    after_scroll = _between(p, "scroll")
    direction = F.lit(None).cast("string")
    for d in reversed(DIRECTIONS):
        direction = F.when(after_scroll.contains(d), F.lit(d)).otherwise(direction)
    none_args = F.lit(None).cast(ARGS)

    def args(**kv):
        fields = {"bbox": F.lit(None).cast("array<double>"), "direction": F.lit(None).cast("string"), "text": F.lit(None).cast("string"),
                  "status": F.lit(None).cast("string")}
        fields.update(kv)
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    kw_args = (
        F.when(kw == "click_element", F.when(F.size(box) > 0, args(bbox=first_box)).otherwise(none_args))
        .when(kw == "scroll", F.when(direction.isNotNull(), args(direction=direction)).otherwise(none_args))
        .when(kw == "input", F.when(_between(p, "text").isNotNull(), args(text=_between(p, "text"))).otherwise(none_args))
        .when(kw.isin("press_home", "press_back", "press_enter"), args())
        .when(kw == "stop", args(status=F.lit("success")))
    )
    from_kw = F.struct(kw.alias("action"), kw_args.alias("args"))
    return F.when(valid(js), from_js(js)).when(valid(js2), from_js(js2)).otherwise(from_kw)


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """indel similarity 2 * LCS / (len(a) + len(b)) over characters (1.0 for two
    empty strings, null when either is null)."""

    def ratio(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        total = len(x) + len(y)
        return 2.0 * lcs_length(x, y) / total if total else 1.0

    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def compare_action(gt: Column, pred: Column, text_threshold: float = 0.8) -> Column:
    """type match; exact match by type: click IoU > 0.5, same scroll direction,
    input text contained either way or indel ratio above the threshold, press_* and
    stop on type alone (Q3 fix: the press_* rule applies only when the types match)."""
    tm = pred["action"].isNotNull() & (gt["action"] == pred["action"])
    pa, ga = pred["args"], gt["args"]
    # other actions have no text to compare
    ratio = indel_ratio(F.when(pred["action"] == "input", pa["text"]), ga["text"])
    click = iou_floor1(pa["bbox"], ga["bbox"]) > 0.5
    exact = (
        F.when(~tm, F.lit(False))
        .when(pred["action"] == "click_element", F.coalesce(click, F.lit(False)))
        .when(pred["action"] == "scroll", F.coalesce(pa["direction"] == ga["direction"], F.lit(False)))
        .when(pred["action"] == "input", F.coalesce(ga["text"].contains(pa["text"]) | pa["text"].contains(ga["text"]) | (ratio > text_threshold), F.lit(False)))
        .otherwise(F.lit(True))
    )
    dist = F.when(tm & (pred["action"] == "input") & pa["text"].isNotNull(), ratio)
    return F.struct(pred["action"].isNotNull().alias("hit"), tm.alias("type_match"), exact.alias("exact_match"), dist.alias("text_dist"))
