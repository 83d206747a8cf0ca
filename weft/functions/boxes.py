"""Box and polygon expressions (F05–F11). All arithmetic stays in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _grid(v: Column, size: Column) -> Column:
    """int(v / size * 1000) clipped to 0..999 (int truncates toward zero)."""
    return F.least(F.greatest((v / size * 1000).cast("int"), F.lit(0)), F.lit(999))


def _fmt(l: Column, u: Column, r: Column, b: Column) -> Column:  # noqa: E741
    return F.format_string("[%03d,%03d,%03d,%03d]", l, u, r, b)


def polygon_box_text(points: Column | str, width: Column | str, height: Column | str) -> Column:
    """polygon [[x,y],...] -> ``[lll,uuu,rrr,bbb]`` on a 0..999 grid (min/max)."""
    p, w, h = _c(points), _c(width), _c(height)
    xs = F.transform(p, lambda q: q[0])
    ys = F.transform(p, lambda q: q[1])
    return _fmt(_grid(F.array_min(xs), w), _grid(F.array_min(ys), h), _grid(F.array_max(xs), w), _grid(F.array_max(ys), h))


def flat_polygon_box_text(coords: Column | str, width: Column | str, height: Column | str) -> Column:
    """F05, flat variant: [x0,y0,x1,y1,...]."""
    c, w, h = _c(coords), _c(width), _c(height)
    xs = F.filter(c, lambda _v, i: i % 2 == 0)
    ys = F.filter(c, lambda _v, i: i % 2 == 1)
    return _fmt(_grid(F.array_min(xs), w), _grid(F.array_min(ys), h), _grid(F.array_max(xs), w), _grid(F.array_max(ys), h))


def corner_box_text(points: Column | str, width: Column | str, height: Column | str) -> Column:
    """F06 (Q7 kept): fixed corners: left from points 0,2; top 0,1; right 1,3; bottom 2,3."""
    p, w, h = _c(points), _c(width), _c(height)
    left = F.least(p[0][0], p[2][0])
    upper = F.least(p[0][1], p[1][1])
    right = F.greatest(p[1][0], p[3][0])
    bottom = F.greatest(p[2][1], p[3][1])
    return _fmt(_grid(left, w), _grid(upper, h), _grid(right, w), _grid(bottom, h))


def box_from_points(points: Column | str) -> Column:
    """polygon -> [xmin, ymin, xmax, ymax]."""
    p = _c(points)
    xs = F.transform(p, lambda q: q[0])
    ys = F.transform(p, lambda q: q[1])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


BOX_PATTERN = r"\[([\d.]+),\s*([\d.]+),\s*([\d.]+),\s*([\d.]+)\]"


def boxes_in_text(text: Column | str, w: Column | None = None, h: Column | None = None, fractional: bool = True) -> Column:
    """every ``[a, b, c, d]`` in the text as 4 numbers; ``fractional`` reads the
    digits as ``0.<digits>`` (then scales by w, h)."""
    t = _c(text)

    def num(i: int) -> Column:
        return F.regexp_extract_all(t, F.lit(BOX_PATTERN), i)

    boxes = F.arrays_zip(num(1).alias("a"), num(2).alias("b"), num(3).alias("c"), num(4).alias("d"))

    def val(s: Column) -> Column:
        return (F.concat(F.lit("0."), s) if fractional else s).try_cast("double")

    def scale(b: Column) -> Column:
        a, bb, c, d = val(b["a"]), val(b["b"]), val(b["c"]), val(b["d"])
        if w is not None:
            a, bb, c, d = a * w, bb * h, c * w, d * h
        return F.array(a, bb, c, d)

    return F.transform(boxes, scale)


def grounding_box(text: Column | str, w: Column | str, h: Column | str, box_format: str = "square_padded") -> Column:
    """strip a trailing dot and the brackets, exactly 4 numbers (else null),
    standard or ``0.``-fractional (unknown format: fractional first), then un-pad from
    the square (square_padded) or scale by w, h."""
    t = F.regexp_replace(_c(text), r"^\s+|\s+$", "")
    t = F.when(t.endswith("."), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t)
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    inner = t.substr(F.lit(2), F.length(t) - 2)
    parts = F.split(inner, ",")
    std = F.transform(parts, lambda x: F.trim(x).try_cast("double"))
    frac = F.transform(parts, lambda x: F.concat(F.lit("0."), F.trim(x)).try_cast("double"))
    if "standard" in box_format:
        nums = std
    elif "000" in box_format:
        nums = frac
    else:
        nums = F.when(F.forall(frac, lambda v: v.isNotNull()), frac).otherwise(std)
    nums = F.when((F.size(parts) == 4) & F.forall(nums, lambda v: v.isNotNull()), nums)
    wf, hf = _c(w).cast("double"), _c(h).cast("double")
    if "square_padded" in box_format:
        n = F.greatest(wf, hf)
        dx, dy = (n - wf) / 2, (n - hf) / 2
        return F.array(nums[0] * n - dx, nums[1] * n - dy, nums[2] * n - dx, nums[3] * n - dy)
    return F.array(nums[0] * wf, nums[1] * hf, nums[2] * wf, nums[3] * hf)


def iou_plus1(a: Column, b: Column) -> Column:
    """IoU with +1-pixel widths (detection accuracy)."""
    iw = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + 1)
    ih = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + 1)
    inter = iw * ih
    area_a = (a[2] - a[0] + 1) * (a[3] - a[1] + 1)
    area_b = (b[2] - b[0] + 1) * (b[3] - b[1] + 1)
    return inter / (area_a + area_b - inter)


def iou_floor1(a: Column, b: Column) -> Column:
    """IoU with each area floored at 1 (agent click targets); null without either box."""
    inter = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(
        F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    )
    area_a = F.greatest((a[2] - a[0]) * (a[3] - a[1]), F.lit(1.0))
    area_b = F.greatest((b[2] - b[0]) * (b[3] - b[1]), F.lit(1.0))
    # least and greatest pass over nulls, so a missing box must be told apart
    return F.when(a.isNotNull() & b.isNotNull(), inter / (area_a + area_b - inter))


def temporal_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """1-D IoU; 0 when the union is empty."""
    i = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))
    u = F.greatest(e1 - s1, F.lit(0)) + F.greatest(e2 - s2, F.lit(0)) - i
    return F.when(u > 0, i / u).otherwise(F.lit(0.0))


def cell_box(box: Column) -> Column:
    """inclusive cell box [floor(x1), floor(y1), ceil(x2), ceil(y2)] of a selection."""
    return F.array(F.floor(box[0]), F.floor(box[1]), F.ceil(box[2]), F.ceil(box[3]))
