"""Multiple-choice and free-form answer parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.ids import keyed_hash

STRIP_CHARS = [",", ".", "!", "?", ";", ":", "'"]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _rfind(s: Column, sub: Column) -> Column:
    """Python ``str.rfind``: index of the last occurrence, -1 when absent."""
    pos = F.instr(F.reverse(s), F.reverse(sub))
    return F.when(pos > 0, F.length(s) - F.length(sub) - pos + 1).otherwise(F.lit(-1))


def parse_choice(response: Column | str, letters: Column, answers: Column | None = None, seed: int = 42, key: Column | None = None) -> Column:
    """the chosen letter: ``(X)`` matches first, then `` X `` with spaces, then (for
    responses longer than 5 words) answer texts contained in the response; with several
    candidates the last occurrence wins (first candidate on ties); with none, a
    keyed-hash pick replaces the random choice."""
    r = _c(response)
    for ch in STRIP_CHARS:
        r = F.btrim(r, F.lit(ch))
    resp = F.concat(F.lit(" "), r, F.lit(" "))
    idx = F.sequence(F.lit(0), F.size(letters) - 1)
    brack = F.filter(idx, lambda i: F.instr(resp, F.concat(F.lit("("), letters[i], F.lit(")"))) > 0)
    spaced = F.filter(idx, lambda i: F.instr(resp, F.concat(F.lit(" "), letters[i], F.lit(" "))) > 0)
    n_words = F.size(F.filter(F.split(F.trim(resp), r"\s+"), lambda w: w != ""))
    if answers is not None:
        content = F.filter(idx, lambda i: F.instr(F.lower(resp), F.lower(answers[i])) > 0)
        content = F.when(n_words > 5, content).otherwise(F.array().cast("array<int>"))
    else:
        content = F.array().cast("array<int>")

    def last_of(cands: Column, needle) -> Column:
        scored = F.transform(cands, lambda i: F.struct(_rfind(resp, needle(i)).alias("p"), (-i).alias("ni")))
        return -F.array_max(scored)["ni"]

    pick_b = last_of(brack, lambda i: F.concat(F.lit("("), letters[i], F.lit(")")))
    pick_s = last_of(spaced, lambda i: F.concat(F.lit(" "), letters[i], F.lit(" ")))
    if answers is not None:
        scored_c = F.transform(content, lambda i: F.struct(_rfind(F.lower(resp), F.lower(answers[i])).alias("p"), (-i).alias("ni")))
        pick_c = -F.array_max(scored_c)["ni"]
    else:
        pick_c = F.lit(None).cast("int")
    rnd_key = key if key is not None else r
    pick_r = (keyed_hash(seed, rnd_key) % F.size(letters)).cast("int")
    chosen = (
        F.when(F.size(brack) > 0, pick_b)
        .when(F.size(spaced) > 0, pick_s)
        .when(F.size(content) > 0, pick_c)
        .otherwise(pick_r)
    )
    return letters[chosen]


def extract_answer(response: Column | str, question_type: Column | str, answer_type: Column | str, choices: Column | str) -> Column:
    """rule-based extraction: empty stays empty; a multi-choice response equal to a
    choice; an integer or float that parses; ``The answer is "..."``; otherwise null
    (the external extractor slot, X08, takes those rows)."""
    r, qt, at, ch = _c(response), _c(question_type), _c(answer_type), _c(choices)
    whole = r"^\s*([-+]?)0*(\d+)\s*$"  # of any length, so it stays text
    digits = F.regexp_extract(r, whole, 2)
    minus = (F.regexp_extract(r, whole, 1) == "-") & (digits != "0")
    as_int = F.when(r.rlike(whole), F.concat(F.when(minus, F.lit("-")).otherwise(F.lit("")), digits))
    as_float = F.trim(r).try_cast("double").cast("string")
    quoted = F.regexp_extract(r, r'The answer is "(.*)"\.', 1)
    return (
        F.when(r == "", F.lit(""))
        .when((qt == "multi_choice") & F.array_contains(ch, r), r)
        .when((at == "integer") & as_int.isNotNull(), as_int)
        .when((at == "float") & as_float.isNotNull(), as_float)
        .when(quoted != "", quoted)
    )


def _whole_number(f: Column) -> Column:
    """The digits of a double without its fraction, exact up to 124 bits; null beyond and for NaN."""
    small, half = F.abs(f) < 2.0**62, 2.0**62
    high = F.when(small, F.lit(0.0)).otherwise(F.floor(F.abs(f) / half).cast("double"))
    low = F.when(small, F.floor(F.abs(f))).otherwise(F.abs(f) - high * half)  # exact, as powers of two are
    digits = high.cast("bigint").cast("decimal(19,0)") * F.lit(2**62).cast("decimal(19,0)") + low.cast("bigint").cast("decimal(19,0)")
    signed = F.when(f < 0, -digits).otherwise(digits).cast("string")
    return F.when(~F.isnan(f) & (F.abs(f) < 2.0**124), signed)


def normalise_extraction(extraction: Column | str, choices: Column | str, question_type: Column | str, answer_type: Column | str,
                         precision: Column | str) -> Column:
    """multi-choice: ``(X)`` -> X, a letter -> its choice text, else the most
    similar choice (K05); integer: str(int(float(x))), null from 2**124 on and for what is
    no number; float: rounded to ``precision`` (decimal half-even); list/text: unchanged;
    unparsable -> null."""
    from weft.operators.windows import most_similar

    e, ch = F.trim(_c(extraction)), _c(choices)
    letter = F.upper(F.regexp_extract(e, r"\(([a-zA-Z])\)", 1))
    e2 = F.when(letter != "", letter).otherwise(e)
    letters = F.transform(F.sequence(F.lit(0), F.size(ch) - 1), lambda i: F.char(65 + i))
    pos = F.array_position(letters, e2)
    mc = F.when(pos > 0, F.element_at(ch, pos.cast("int"))).otherwise(most_similar(e2, ch))
    f = _c(extraction).try_cast("double")
    as_int = _whole_number(f)
    as_float = F.when(f.isNotNull(), F.bround(f, _c(precision).cast("int")).cast("string"))
    return (
        F.when(_c(question_type) == "multi_choice", mc)
        .when(_c(answer_type) == "integer", as_int)
        .when(_c(answer_type) == "float", as_float)
        .otherwise(_c(extraction).cast("string"))
    )


# Words that name a quantity. "fewestmore" is one entry, as two strings run
# together there.
QUANTITY_WORDS = [
    "most", "least", "fewestmore", "less", "fewer", "largest", "smallest", "greatest", "larger", "smaller", "greater",
    "highest", "lowest", "higher", "lower", "increase", "decrease", "minimum", "maximum", "max", "min", "mean",
    "average", "median", "total", "sum", "add", "subtract", "difference", "quotient", "gap", "half", "double", "twice",
    "triple", "square", "cube", "root", "approximate", "approximation", "triangle", "rectangle", "circle", "square",
    "cube", "sphere", "cylinder", "cone", "pyramid", "multiply", "divide", "percentage", "percent", "ratio",
    "proportion", "fraction", "rate",
]
# Single words that read as a number.
NUMBER_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
    "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty",
    "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "lakh", "crore", "million", "billion",
]
BOOL_WORDS = ["Yes", "No", "True", "False", "yes", "no", "true", "false", "YES", "NO", "TRUE", "FALSE"]


def _any_word(text: Column, words: list[str]) -> Column:
    return F.arrays_overlap(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), 0), F.array(*[F.lit(w) for w in words]))


def has_digit(c: Column | str) -> Column:
    """F21 predicates: digits present."""
    return _c(c).rlike(r"[0-9]")


def has_number_word(c: Column | str) -> Column:
    """a word that reads as a number (in any case), or a digit."""
    return _any_word(F.lower(_c(c)), NUMBER_WORDS) | has_digit(c)


def has_quantity_word(c: Column | str, keep: list[str] | None = None) -> Column:
    """a quantity word, as it stands, or one of the caller's own."""
    return _any_word(_c(c), [*QUANTITY_WORDS, *(keep or [])])


def is_bool_word(c: Column | str) -> Column:
    """exactly one of the yes/no words."""
    return _c(c).isin(BOOL_WORDS)


def is_int_string(c: Column | str) -> Column:
    """an integer, with spaces around and ``.000`` after it at most."""
    return F.regexp_replace(F.trim(_c(c)), r"\.0+$", "").rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$")


def is_float_string(c: Column | str) -> Column:
    """a number with a point."""
    return _c(c).contains(".") & _c(c).rlike(r"^\s*[+-]?([0-9]+(_[0-9]+)*\.([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?\s*$")
