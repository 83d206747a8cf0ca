"""Projections, filters and predicates.

Filters are written as Column predicates so Catalyst can push the simple ones into the
parquet scan. Checks that the reference does with ``assert`` stay lazy: a global ratio
or count is one partial aggregate joined back as a single row, and ``raise_error``
fails the job when the check does not hold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.ids import keyed_hash, positions
from weft.schema import IMAGE_TOKEN


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _attach_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach a single-row aggregate to every row (constant-key broadcast join)."""
    return df.withColumn("_wf_k", F.lit(1)).join(F.broadcast(one.withColumn("_wf_k", F.lit(1))), "_wf_k").drop("_wf_k")


def select_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep only the training columns (pruned at the scan)."""
    return df.select(*cols)


def score_filter(df: DataFrame, cols: Sequence[str], threshold: float, min_keep: float, name: str = "score") -> DataFrame:
    """``score = sum(cols)``, keep ``score > threshold``; fail unless more than
    ``min_keep`` of the rows survive (computed lazily, in the same job)."""
    scored = df.withColumn(name, sum((F.col(c) for c in cols), F.lit(0.0)))
    keep = F.col(name) > threshold
    stats = scored.agg(
        F.count(F.lit(1)).alias("_wf_total"), F.count(F.when(keep, F.lit(1))).alias("_wf_kept")
    )
    out = _attach_one_row(scored.filter(keep), stats)
    ok = (F.col("_wf_kept") / F.col("_wf_total")) > min_keep
    out = out.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("too few rows survive the score filter")).cast("boolean")))
    return out.drop("_wf_total", "_wf_kept")


def route_by_source(df: DataFrame, routes: Mapping[str, Sequence[str]], source: str = "source") -> DataFrame:
    """Split by a source allow list into named subsets (a row may land in several).
    The route table is a literal registry, so its broadcast is bounded by its size."""
    spark = df.sparkSession
    table = spark.createDataFrame([(sub, s) for sub, srcs in routes.items() for s in srcs], f"subset string, {source} string")
    return df.join(F.broadcast(table), source)


def keep_source_or_prefix(df: DataFrame, sources: Sequence[str], prefixes: Sequence[str], source: str = "source",
                          path: str = "image") -> DataFrame:
    """Source in the allow list OR media path starting with an allowed prefix."""
    cond = F.col(source).isin(list(sources))
    for p in prefixes:
        cond = cond | F.col(path).startswith(p)
    return df.filter(cond)


def max_tags_per_turn(df: DataFrame, n: int = 1, tag: str = IMAGE_TOKEN) -> DataFrame:
    """Reject samples having a turn with more than ``n`` tags."""
    return df.filter(F.forall("turns", lambda t: (F.size(F.split(t["value"], tag, -1)) - 1) <= n))


def valid_roles(df: DataFrame, roles: Sequence[str] = ("human", "gpt")) -> DataFrame:
    """Keep samples whose turn roles all belong to ``roles``."""
    return df.filter(F.forall("turns", lambda t: t["from"].isin(list(roles))))


# Stop words per language (fixed values chosen for the default language score).
STOP_WORDS = {
    "en": ["the", "and", "of", "to", "is", "in", "it", "that", "with", "for", "was", "as", "on", "are", "this"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "sich", "mit", "von", "den", "zu", "ein", "eine", "auf", "im"],
    "fr": ["le", "la", "les", "et", "des", "un", "une", "du", "qui", "que", "dans", "pour", "est", "en", "par"],
    "es": ["el", "los", "las", "y", "del", "que", "por", "con", "una", "para", "es", "se", "al", "lo", "como"],
}
LANG_ORDER = ["en", "de", "fr", "es"]


def detect_lang(text: Column | str) -> Column:
    """Default detector for P07: the language whose stop words occur most often among
    the lower-cased words (first in ``LANG_ORDER`` on ties; ``unknown`` with none).
    One split and one pass per text: an ``aggregate`` keeps the four counts in a struct
    and its finishing lambda picks the language."""
    ws = F.array_remove(F.split(F.lower(_c(text)), r"[^\p{L}]+", -1), "")
    init = F.struct(*[F.lit(0).alias(lang) for lang in LANG_ORDER])

    def step(acc: Column, w: Column) -> Column:
        return F.struct(*[(acc[lang] + F.when(w.isin(STOP_WORDS[lang]), 1).otherwise(0)).alias(lang) for lang in LANG_ORDER])

    return F.aggregate(ws, init, step, lambda acc: _pick_lang([acc[lang] for lang in LANG_ORDER]))


def _pick_lang(scores: list[Column]) -> Column:
    best = F.greatest(*scores)
    out = F.lit("unknown")
    for lang, s in reversed(list(zip(LANG_ORDER, scores))):
        out = F.when((best > 0) & (s == best), F.lit(lang)).otherwise(out)
    return out


def with_detected_lang(df: DataFrame, text: str, name: str = "detected") -> DataFrame:
    """Adds the detected language of ``text``."""
    return df.withColumn(name, detect_lang(text))


def lang_filter(df: DataFrame, cols: Sequence[str], lang: str = "en", detector=detect_lang) -> DataFrame:
    """Keep rows whose ``cols`` (the first QA pair) all detect as ``lang``. The
    detector is pluggable (any Column function, e.g. a pandas UDF); a null result
    (detector error) rejects the row."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.coalesce(detector(F.col(c)) == lang, F.lit(False))
    return df.filter(cond)


def media_path(video: str = "video", sample_id: str = "sample_id", ext: str = ".mp4") -> Column:
    """P08 path rule: ``video`` when present, else id + extension."""
    return F.coalesce(F.col(video), F.concat(F.col(sample_id).cast("string"), F.lit(ext)))


def read_manifest(spark, root: str) -> DataFrame:
    """File manifest (path, length, modificationTime) via ``binaryFile``; the content
    column is pruned, so no media bytes are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(
        "path", "length", "modificationTime"
    )


def min_media_size(df: DataFrame, manifest: DataFrame, min_bytes: int = 100 * 1024, path: Column | None = None) -> DataFrame:
    """Keep samples whose media exists in ``manifest`` (path, length) and is larger
    than ``min_bytes``; a semi join on the path."""
    p = path if path is not None else media_path()
    big = manifest.filter(F.col("length") > min_bytes).select(F.col("path").alias("_wf_path"))
    return df.withColumn("_wf_path", p).join(big, "_wf_path", "left_semi").drop("_wf_path")


def probe_media(manifest: DataFrame, magic: Mapping[str, str], min_bytes: int = 1) -> DataFrame:
    """A reasons table for media that fails an integrity probe: too small, or the
    first bytes (hex) match none of the expected headers. Nothing is deleted."""
    head = F.hex(F.substring(F.col("content"), 1, 4))
    ok_header = F.lit(False)
    for hx in magic.values():
        ok_header = ok_header | head.startswith(hx.upper())
    reason = F.when(F.col("length") < min_bytes, F.lit("too small")).when(~ok_header, F.lit("bad header"))
    return manifest.select("path", reason.alias("reason")).filter(F.col("reason").isNotNull())


def drop_broken_media(df: DataFrame, reasons: DataFrame, path: Column) -> DataFrame:
    """Samples (and their sidecars, which share the key) minus broken media."""
    return df.withColumn("_wf_path", path).join(reasons.select(F.col("path").alias("_wf_path")), "_wf_path", "left_anti").drop(
        "_wf_path"
    )


def legible(anns: Column | str, text: str = "transcription", flag: str = "illegible") -> Column:
    """P10: drop annotations flagged illegible/ignore, or whose text contains ``###``
    or equals ``.``."""
    return F.filter(
        _c(anns),
        lambda a: ~F.coalesce(a[flag], F.lit(False)) & ~F.coalesce(a[text].contains("###"), F.lit(False)) & (a[text] != "."),
    )


def min_area(anns: Column | str, img_w: Column, img_h: Column, share: float) -> Column:
    """Drop boxes (x, y, w, h) whose area is below ``share`` of the image area."""
    return F.filter(_c(anns), lambda a: (a["w"] * a["h"]) / (img_w * img_h) >= share)


def hier_text(df: DataFrame, mode: str = "lines", legibility: Sequence[bool] = (True,),
              handwritten: Sequence[bool] = (False, True)) -> DataFrame:
    """Hierarchical OCR (image -> paragraphs -> lines -> words) to line or word rows.

    A line is skipped when ``x2*y2 < 225`` (Q23: the reference multiplies the corner,
    not width by height), when it is taller than wide, when its legibility or
    handwriting flag is outside the sets, or when it is vertical. In word mode the
    vertical words are skipped too. Boxes are min/max over the vertices (F07).
    """
    from weft.functions.boxes import box_from_points

    lines = df.select("image_id", F.explode("paragraphs").alias("p")).select("image_id", F.explode("p.lines").alias("l"))
    lines = lines.withColumn("bbx", box_from_points(F.col("l.vertices")))
    b = F.col("bbx")
    keep = (
        ~(b[2] * b[3] < 225)
        & ~((b[2] - b[0]) < (b[3] - b[1]))
        & F.col("l.legible").isin(list(legibility))
        & F.col("l.handwritten").isin(list(handwritten))
        & ~F.col("l.vertical")
    )
    lines = lines.filter(keep)
    if mode == "lines":
        return lines.select("image_id", "bbx", F.col("l.text").alias("transcription"))
    words = lines.select("image_id", F.explode("l.words").alias("w")).filter(~F.col("w.vertical"))
    return words.select("image_id", box_from_points(F.col("w.vertices")).alias("bbx"), F.col("w.text").alias("transcription"))


def all_ok(fetches: DataFrame, key: str = "sample_id", ok: str = "ok") -> DataFrame:
    """Samples whose every fetched item succeeded (partial aggregate per key)."""
    return fetches.groupBy(key).agg(F.bool_and(ok).alias("_wf_all")).filter("_wf_all").select(key)


def ok_only(fetches: DataFrame, ok: str = "ok") -> DataFrame:
    """Items whose single fetch succeeded."""
    return fetches.filter(F.col(ok))


def clean_title(c: Column | str) -> Column:
    """text before the first ``##``; ``NoName`` becomes empty."""
    head = F.substring_index(_c(c), "##", 1)
    return F.when(head == "NoName", F.lit("")).otherwise(head)


def non_empty_title(df: DataFrame, title: str = "title") -> DataFrame:
    """Skip empty or ``NoName`` titles after F04 cleaning."""
    return df.withColumn(title, clean_title(title)).filter(F.length(title) > 0)


def non_empty_turns(df: DataFrame) -> DataFrame:
    """Skip samples with no turns left."""
    return df.filter(F.coalesce(F.size("turns"), F.lit(0)) > 0)


def slice_fraction(df: DataFrame, start: float, end: float, row_id: str = "row_id") -> DataFrame:
    """Rows ``[int(n*start), int(n*end))`` by position; ``n`` is one global count."""
    n = df.agg(F.count(F.lit(1)).alias("_wf_n"))
    out = _attach_one_row(df, n)
    lo = F.floor(F.col("_wf_n") * F.lit(start))
    hi = F.floor(F.col("_wf_n") * F.lit(end))
    return out.filter((F.col(row_id) >= lo) & (F.col(row_id) < hi)).drop("_wf_n")


def on_failure(df: DataFrame, error: str = "error", mode: str = "raise", seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Failed rows either fail the job (``raise``) or are replaced by another row
    chosen by keyed hash among the good rows (``resample``); ``replaced_from`` keeps the
    failed row id. The pick is a join on a position, never a driver-side loop."""
    bad = F.col(error).isNotNull()
    if mode == "raise":
        return df.filter(F.when(bad, F.raise_error(F.concat(F.lit("row failed: "), F.col(error)))).otherwise(F.lit(True)))
    if mode != "resample":
        raise ValueError(mode)
    good = df.filter(~bad)
    ranked = positions(good, [row_id], name="_wf_gpos")
    n_good = good.agg(F.count(F.lit(1)).alias("_wf_ng"))
    failed = _attach_one_row(df.filter(bad).select(F.col(row_id).alias("replaced_from")), n_good)
    failed = failed.withColumn("_wf_gpos", keyed_hash(seed, "replaced_from") % F.col("_wf_ng")).drop("_wf_ng")
    repl = failed.join(ranked, "_wf_gpos").drop("_wf_gpos")
    kept = good.withColumn("replaced_from", F.lit(None).cast("bigint"))
    return kept.unionByName(repl)


def letters_only(df: DataFrame, response: str = "response", letters: str = "ABCD") -> DataFrame:
    """P20: keep answers whose first character is one of the letters (Q24 fix: an empty
    answer is rejected instead of failing)."""
    first = F.substring(F.col(response), 1, 1)
    return df.filter((F.length(response) > 0) & F.lit(letters).contains(first)).withColumn("letter", first)


def first_human(df: DataFrame, mode: str = "flag") -> DataFrame:
    """The first turn must be human: ``raise`` fails the job, ``flag`` sets
    ``error`` so the rows can be split into a quarantine table."""
    bad = F.coalesce(F.get(F.col("turns"), 0)["from"] != "human", F.lit(True))
    if mode == "raise":
        return df.filter(F.when(bad, F.raise_error(F.lit("first message is not from human"))).otherwise(F.lit(True)))
    return df.withColumn("error", F.when(bad, F.lit("first message is not from human")))


def check_media_counts(df: DataFrame, mode: str = "truncate", tag: str = IMAGE_TOKEN) -> DataFrame:
    """Image tags in the text vs images in the row. ``raise``: any mismatch fails;
    ``truncate``: surplus images are cut to the tag count and a shortage is flagged."""
    text = F.array_join(F.transform("turns", lambda t: t["value"]), "\n")
    tokens = F.size(F.split(text, tag, -1)) - 1
    n = F.size("images")
    if mode == "raise":
        return df.filter(
            F.when(n != tokens, F.raise_error(F.lit("number mismatch between images and image tokens"))).otherwise(F.lit(True))
        )
    return df.withColumn("images", F.when(n > tokens, F.slice("images", 1, tokens)).otherwise(F.col("images"))).withColumn(
        "error", F.when(n < tokens, F.lit("fewer images than image tokens"))
    )
