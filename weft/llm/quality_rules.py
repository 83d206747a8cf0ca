"""Quality rules with adaptive thresholds from mergeable quantile sketches (operator 7).

Each text gets a few counts. Two fixed base rules fail short texts and texts that repeat
themselves. For the others, ratios of the counts must lie inside fences that follow the
data: a quantile sketch for each language and source gives the quartiles of each ratio,
and a fence lies ``FENCE`` quartile distances outside them (with a least distance for each
ratio, so that a constant ratio does not fail its smallest change). Sketches of sources
are merged to sketches of languages, and these to one of all rows; a source with fewer
than ``LEAST_ROWS`` rows takes its language's fences, a language those of all rows. The
fences are joined to the rows by language and source.

Everything is DataFrame expressions. Texts are read once: the counts go to a checkpoint,
which the sketches and the join read. Repeated windows are found by 64-bit hashes of eight
words, sorted within the text.

Defined results: null and empty texts have no words and fail the base rule; a null
language or source is a group of its own; repeated rows are judged alike; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.batches import durable

SHORTEST_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
LEAST_ROWS = 200
FENCE = 4.0
SKETCH_SIZE = 1024
#: Ratios that are fenced, with the least quartile distance of each.
RATIOS = {"word_length": 0.25, "symbols": 0.05, "repeats": 0.05, "dup_lines": 0.05}

_BLANK = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text: Column) -> Column:
    """Words in linear time: a trim by pattern would try each place of a long run of blanks."""
    return F.filter(F.split(text, f"{_BLANK}+"), lambda w: w != "")


def _covered(places: Column) -> Column:
    """Words inside the windows that begin at the sorted places."""

    def step(p: Column, i: Column) -> Column:
        after = F.try_element_at(places, i + 2)
        return F.when(after.isNull(), F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), after - p))

    return F.aggregate(F.transform(places, step), F.lit(0), lambda a, x: a + x)


def _repeated_places(hashes: Column) -> Column:
    """Sorted places of hashes that occur twice or more."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(sorted_pairs: Column) -> Column:
        def same(e: Column, i: Column) -> Column:
            before = F.when(i > 0, F.try_element_at(sorted_pairs, i)["h"])  # the one before: places count from 1
            after = F.try_element_at(sorted_pairs, i + 2)["h"]
            return F.coalesce(before == e["h"], F.lit(False)) | F.coalesce(after == e["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(sorted_pairs, same), lambda e: e["i"]))

    return let(pairs, twice)


def repeat_words(words: Column) -> Column:
    """Words in windows of eight that stand twice or more in the text, the first time included."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    covered = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(_repeated_places(h), _covered)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(covered)


def _by_word(words: Column) -> Column:
    return F.struct(
        F.size(words).alias("n_words"),
        F.char_length(F.array_join(words, "")).alias("word_chars"),
        repeat_words(words).alias("n_repeat_words"),
    )


def _by_line(lines: Column) -> Column:
    return F.struct(F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))


def counts(text: Column) -> Column:
    """The counts of one text as a struct."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        let(split_words(text), _by_word).alias("word"),
        let(lines, _by_line).alias("line"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).alias("n_symbols"),
    )


def measured(df: DataFrame, keep=("doc_id", "lang", "source"), text: str = "text") -> DataFrame:
    """``keep`` columns and the counts of every whole text."""
    found = df.select(*[F.col(f"`{c}`") for c in keep], counts(F.coalesce(F.col(text), F.lit(""))).alias("_c"))
    names = {"n_words": "word", "word_chars": "word", "n_symbols": None, "n_dup_lines": "line", "n_repeat_words": "word", "n_lines": "line"}
    cols = [(F.col("_c")[part][n] if part else F.col("_c")[n]).cast("long").alias(n) for n, part in names.items()]
    return found.select(*[F.col(f"`{c}`") for c in keep if c not in names], *cols)


def base_failed() -> Column:
    return (F.col("n_words") < SHORTEST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _ratios() -> dict[str, Column]:
    return {
        "word_length": F.try_divide("word_chars", "n_words"),
        "symbols": F.try_divide("n_symbols", "n_words"),
        "repeats": F.try_divide("n_repeat_words", "n_words"),
        "dup_lines": F.try_divide("n_dup_lines", "n_lines"),
    }


def fences(rows: DataFrame) -> DataFrame:
    """lang, source, and for each ratio its low and high fence."""
    good = rows.where(~base_failed()).select("lang", "source", *[c.alias(n) for n, c in _ratios().items()])
    own = durable(good.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(r, SKETCH_SIZE).alias(r) for r in RATIOS]))
    merge = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(r, SKETCH_SIZE).alias(r) for r in RATIOS]]
    by_lang = own.groupBy("lang").agg(*merge)
    overall = by_lang.agg(*merge)

    def named(level: DataFrame, prefix: str) -> DataFrame:
        return level.select(*[F.col(c).alias(c if c in ("lang", "source") else prefix + c) for c in level.columns])

    lang = named(by_lang, "l_").withColumnRenamed("lang", "l_lang")
    joined = named(own, "s_").join(lang, F.col("lang").eqNullSafe(F.col("l_lang")))
    joined = joined.withColumn("_one", F.lit(1)).join(F.broadcast(named(overall, "a_").withColumn("_one", F.lit(1))), "_one")  # one row
    out = []
    for r, least in RATIOS.items():
        sketch = F.when(F.col("s_n") >= LEAST_ROWS, F.col(f"s_{r}")).when(F.col("l_n") >= LEAST_ROWS, F.col(f"l_{r}")).otherwise(F.col(f"a_{r}"))
        low, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        room = FENCE * F.greatest(high - low, F.lit(least))
        out += [(low - room).alias(f"{r}_low"), (high + room).alias(f"{r}_high")]
    return joined.select("lang", "source", *out)


def judged(df: DataFrame, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep`` columns, the counts, base_failed and kept. ``df`` has columns lang and source."""
    rows = durable(measured(df, keep=(*keep, "lang", "source"), text=text))
    limits = durable(fences(rows)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    match = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    inside = F.lit(True)
    for r, value in _ratios().items():
        inside = inside & value.between(F.col(f"{r}_low"), F.col(f"{r}_high"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return (
        rows.join(limits, match, "left")
        .withColumn("base_failed", base_failed())
        .select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
    )
