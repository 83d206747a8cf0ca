"""Time expressions (F12–F15): clip timestamps and time tokens, rebuilt with split +
regexp_extract_all + an ordered ``aggregate`` (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# <seconds> markers: "<12>", "<12.>", "<.5>", "<3.25>"
ENC_PATTERN = r"<(?:(?:\d*\.\d+)|(?:\d+\.?))>"
PARSE_PATTERN = r"<(?:(?:\d*\.?\d+)|(?:\d+\.?))>"
TOKEN_PATTERN = r"<t(\d+)>"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hms_to_seconds(c: Column | str) -> Column:
    """``H:M:S.f`` -> seconds."""
    p = F.split(_c(c), ":")
    return p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")


def _rebuild(text: Column, pattern: str, repl) -> Column:
    """Replace every match of ``pattern`` by ``repl(match_text)`` in order."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    body = F.aggregate(
        F.filter(F.sequence(F.lit(0), F.size(matches)), lambda i: i < F.size(matches)),
        F.lit(""),
        lambda acc, i: F.concat(acc, F.get(pieces, i), repl(F.get(matches, i))),
    )
    return F.concat(body, F.get(pieces, F.size(matches)))


def encode_time_tokens(text: Column | str, duration: Column | str, n_tokens: int, fmt: str = "<t{t}>") -> Column:
    """``<seconds>`` -> ``<tK>`` with K = round_half_even(t / duration * (n-1)),
    then the text is stripped."""
    d = _c(duration).cast("double")
    pre, post = fmt.split("{t}")

    def tok(m: Column) -> Column:
        t = F.regexp_replace(m, r"[<>]", "")
        k = F.bround(t.cast("double") / d * (n_tokens - 1), 0).cast("bigint")
        return F.concat(F.lit(pre), k.cast("string"), F.lit(post))

    out = _rebuild(_c(text), ENC_PATTERN, tok)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def decode_time_tokens(text: Column | str, duration: Column | str, n_tokens: int) -> Column:
    """``<tK>`` -> ``<seconds>`` with seconds = round(K * duration / (n-1), 2)
    (decimal half-even rounding); K >= n maps to the rounded duration."""
    d = _c(duration).cast("double")

    def tok(m: Column) -> Column:
        k = F.regexp_extract(m, TOKEN_PATTERN, 1).cast("bigint")
        ts = F.when(k < n_tokens, F.bround(k * d / (n_tokens - 1), 2)).otherwise(F.bround(d, 2))
        return F.concat(F.lit("<"), ts.cast("string"), F.lit(">"))

    return _rebuild(_c(text), r"<t\d+>", tok)


def parse_timestamps(text: Column | str, duration: Column | str, strict: bool = False) -> Column:
    """the first two ``<seconds>`` markers clamped to [0, duration] as
    [min, max]; fewer than two -> [0, duration] (``strict`` fails instead)."""
    d = _c(duration).cast("double")
    ms = F.transform(F.regexp_extract_all(_c(text), F.lit(PARSE_PATTERN), 0), lambda m: F.regexp_replace(m, r"[<>]", "").cast("double"))
    two = F.transform(F.slice(ms, 1, 2), lambda t: F.least(F.greatest(t, F.lit(0.0)), d))
    ok = F.size(ms) >= 2
    fallback = F.array(F.lit(0.0), d)
    if strict:
        fallback = F.raise_error(F.lit("Expected at least two timestamps in the text.")).cast("array<double>")
    return F.when(ok, F.array(F.array_min(two), F.array_max(two))).otherwise(fallback)
