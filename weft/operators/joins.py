"""Joins (J01–J22).

Physical strategy is left to Catalyst/AQE: equi-joins on ids shuffle (sort-merge) or
broadcast when AQE sees a small side. Explicit ``broadcast`` is only used for literal
registries and one-row aggregates.

Non-equi joins never compare all pairs:

* prefix matching (J15) explodes the bounded set of prefixes of each id and equi-joins;
* interval overlap (J21) equi-joins on places in the order of borders;
* point-in-interval (J16, J20) equi-joins on a bucket of the range key
  (:func:`range_join`), so each point meets only intervals that share its bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.ids import keyed_hash, prefix_sum
from weft.schema import IMAGE_TOKEN, TURNS
from weft.session import ensure_checkpoint_dir


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def semi_with_count_check(annotations: DataFrame, images: DataFrame, keys: Sequence[str], n_ann: str, n_img: str) -> DataFrame:
    """Keep annotations whose key has images; the image count must agree with the
    annotation's image list (the job fails otherwise). A key may be the shard and the line
    that :func:`weft.sources.files.read_numbered_lines` gives, which is ``org_idx`` then. Image rows are brought to one per
    key first, so a repeated key neither repeats annotations nor hides another count."""
    per_key = images.groupBy(*keys).agg(F.min(n_img).alias("_wf_lo"), F.max(n_img).alias("_wf_hi"))
    joined = annotations.join(per_key, list(keys))
    bad = (F.col(n_ann) != F.col("_wf_lo")) | (F.col(n_ann) != F.col("_wf_hi"))
    return joined.filter(
        F.when(bad, F.raise_error(F.lit("image count does not match the annotation"))).otherwise(F.lit(True))
    ).drop("_wf_lo", "_wf_hi")


def _last_per_key(updates: DataFrame, keys: Sequence[str], value: str, name: str, order: str | None = None) -> DataFrame:
    """One row per key: the value with the largest ``order`` (the greatest value without
    one), so that repeated update keys never multiply the rows they are joined to."""
    pick = F.max(value) if order is None else F.max_by(value, order)
    return updates.groupBy(*keys).agg(pick.alias(name))


def attach_payloads(docs: DataFrame, payloads: DataFrame, key: str, info: str, name: str, payload: str) -> DataFrame:
    """Payloads of one key, sorted by file name, zipped onto the nested
    ``info`` array element by element; lengths must be equal. The per-key group is one
    document's images (bounded)."""
    grouped = payloads.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(name, payload))), lambda x: x[payload]).alias("_wf_pl")
    )
    joined = docs.join(grouped, key, "inner")
    check = F.when(F.size(info) != F.size("_wf_pl"), F.raise_error(F.lit("payload count differs"))).otherwise(F.lit(True))
    return joined.filter(check).withColumn(
        info, F.zip_with(info, "_wf_pl", lambda i, p: i.withField("payload", p))
    ).drop("_wf_pl")


def override(df: DataFrame, updates: DataFrame, keys: Sequence[str], col: str, new: str, only_non_empty: bool = False) -> DataFrame:
    """Left join on ``keys``; a matching ``new`` value replaces ``col``
    (optionally only when non-empty). ``overridden`` tells which rows changed."""
    u = _last_per_key(updates, keys, new, "_wf_new")
    j = df.join(u, list(keys), "left")
    hit = F.col("_wf_new").isNotNull()
    if only_non_empty:
        hit = hit & (F.length("_wf_new") > 0)
    return j.withColumn(col, F.when(hit, F.col("_wf_new")).otherwise(F.col(col))).withColumn("overridden", hit).drop("_wf_new")


def missing_keys(df: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys without an override (reported once each): an anti join."""
    return df.select(*keys).distinct().join(updates.select(*keys), list(keys), "left_anti")


def first_caption(df: DataFrame, sources: Sequence[DataFrame], keys: Sequence[str], fallback: str = "") -> DataFrame:
    """Caption from the first source that has the key, else ``fallback``. Each
    source is (keys..., caption); one left join per source."""
    out = df
    names = []
    for i, s in enumerate(sources):
        n = f"_wf_c{i}"
        out = out.join(_last_per_key(s, keys, "caption", n), list(keys), "left")
        names.append(F.col(n))
    return out.withColumn("caption", F.coalesce(*names, F.lit(fallback))).drop(*[f"_wf_c{i}" for i in range(len(sources))])


def short_long_caption(df: DataFrame, short: DataFrame, long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Short caption, or the two-part text when a long caption exists; a missing
    short caption is empty (Q13 fix, the reference prints ``None``); tags are escaped
    and the text is ``<image>`` + caption."""
    j = df.join(_last_per_key(short, keys, "caption", "_wf_s"), list(keys), "left").join(
        _last_per_key(long, keys, "caption", "_wf_l"), list(keys), "left"
    )
    s = F.coalesce(F.col("_wf_s"), F.lit(""))
    both = F.concat(F.lit("### Short description: \n"), s, F.lit(" \n\n"), F.lit("### Long description: \n"), F.col("_wf_l"))
    cap = F.when(F.col("_wf_l").isNotNull(), both).otherwise(s)
    cap = F.replace(cap, F.lit(IMAGE_TOKEN), F.lit("<IMAGE>"))
    return j.withColumn("caption", cap).withColumn("text", F.concat(F.lit(IMAGE_TOKEN), F.col("caption"))).drop("_wf_s", "_wf_l")


def caption_family_turns(df: DataFrame, families: DataFrame, questions: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Every caption family that has the key becomes a (question, answer) pair;
    families appear in keyed-hash order, the question is a keyed-hash pick from the
    family's list. Misses are skipped. ``questions`` is a small registry (family,
    questions array) joined by broadcast."""
    f = families.join(F.broadcast(questions), "family")
    f = f.withColumn("_wf_o", keyed_hash(seed, F.col(key).cast("string"), F.col("family")))
    pick = F.get(F.col("questions"), (keyed_hash(seed + 1, F.col(key).cast("string"), F.col("family")) % F.size("questions")).cast("int"))
    f = f.withColumn("_wf_q", pick)
    g = f.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_wf_o", "family", "_wf_q", "caption"))).alias("_wf_f"))
    turns = F.flatten(
        F.transform("_wf_f", lambda x: F.array(F.struct(F.lit("human").alias("from"), x["_wf_q"].alias("value")),
                                                F.struct(F.lit("gpt").alias("from"), x["caption"].alias("value"))))
    )
    out = df.join(g, key, "left")
    return out.withColumn("qa_turns", F.coalesce(turns, F.array().cast(TURNS)).cast(TURNS)).drop("_wf_f")


def prefix_category(ids: DataFrame, mapping: DataFrame, id_col: str) -> DataFrame:
    """Category of the first mapping entry (by ``rank``) whose key without
    extension is a prefix of the id; ``Other`` when none matches.

    Equi-join on the prefixes of the id instead of a nested loop. Only the lengths that
    some key has are tried (a set of small numbers, aggregated from the mapping), so keys
    of any length match and an id makes as many rows as there are such lengths.
    """
    m = mapping.select(
        F.regexp_replace("key", r"\.[^./]*$", "").alias("_wf_base"), "category", "rank"
    )
    lengths = m.agg(F.collect_set(F.length("_wf_base")).alias("_wf_lens")).withColumn("_wf_one", F.lit(1))
    pre = ids.select(id_col).distinct().withColumn("_wf_one", F.lit(1)).join(F.broadcast(lengths), "_wf_one")
    fitting = F.filter("_wf_lens", lambda n: n <= F.length(id_col))
    pre = pre.select(id_col, F.explode(F.transform(fitting, lambda n: F.substring(F.col(id_col), F.lit(1), n))).alias("_wf_base"))
    best = pre.join(m, "_wf_base").groupBy(id_col).agg(F.min_by("category", "rank").alias("category"))
    return ids.join(best, id_col, "left").withColumn("category", F.coalesce("category", F.lit("Other")))


def range_join(
    points: DataFrame,
    intervals: DataFrame,
    t: str,
    start: str,
    end: str,
    keys: Sequence[str] = (),
    bucket: float = 1.0,
    closed_end: bool = False,
) -> DataFrame:
    """Rows of ``points`` with every interval holding ``t`` (``start <= t < end``), joined
    on ``keys`` and on ``floor(t / bucket)``. Intervals are exploded over the buckets
    they cover, so no pair outside a shared bucket is formed. Choose ``bucket`` near the
    typical interval length (an interval spans ``len/bucket + 1`` buckets)."""
    k = list(keys)
    iv = intervals.withColumn(
        "_wf_b",
        F.explode(F.sequence(F.floor(F.col(start) / bucket).cast("bigint"), F.floor(F.col(end) / bucket).cast("bigint"))),
    )
    pt = points.withColumn("_wf_b", F.floor(F.col(t) / bucket).cast("bigint"))
    cond_end = F.col(t) <= F.col(end) if closed_end else F.col(t) < F.col(end)
    return pt.join(iv, k + ["_wf_b"]).filter((F.col(t) >= F.col(start)) & cond_end).drop("_wf_b")


#: Places of a run that one row stands for before they are laid out one by one.
RUN = 4096


def _places(spans: DataFrame, points: DataFrame, keys: list[str], strictly_after: bool) -> DataFrame:
    """(id, point): the points within each span of (keys, id, lo, hi), by one range sort of borders.

    Points (keys, point, at) are numbered in order; a span's points are a run of numbers,
    from those before its start (and at it, if ``strictly_after``) to those before its end.
    Runs are laid out and meet the points by number, so there is a row for each pair of the
    result and no other, and pairs of one key are spread like any.
    """
    start = F.lit(2 if strictly_after else 0)
    blank = F.lit(None).cast("bigint")
    events = [
        points.select(*keys, F.col("at"), F.lit(1).alias("_wf_kind"), F.lit(1).alias("_wf_one"), blank.alias("id"), "point"),
        spans.select(*keys, F.col("lo").alias("at"), start.alias("_wf_kind"), F.lit(0).alias("_wf_one"), "id", blank.alias("point")),
        spans.select(*keys, F.col("hi").alias("at"), F.lit(0).alias("_wf_kind"), F.lit(0).alias("_wf_one"), "id", blank.alias("point")),
    ]
    order = [*keys, "at", "_wf_kind", F.coalesce("id", "point")]
    below = prefix_sum(events[0].union(events[1]).union(events[2]), order, F.col("_wf_one").cast("bigint"), name="_wf_below")
    # the lower of a span's two numbers is that of its start; both are the same where it holds no point
    runs = below.where("id is not null").groupBy("id").agg(F.min("_wf_below").alias("first"), F.max("_wf_below").alias("last")).where("first < last")
    blocks = runs.select("id", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / RUN), F.floor((F.col("last") - 1) / RUN))).alias("_wf_b"))
    lo, hi = F.greatest(F.col("first"), F.col("_wf_b") * RUN), F.least(F.col("last"), (F.col("_wf_b") + 1) * RUN)
    numbers = blocks.select("id", F.explode(F.sequence(lo, hi - 1)).alias("_wf_below"))
    return numbers.join(below.where("point is not null").select("point", (F.col("_wf_below") - 1).alias("_wf_below")), "_wf_below").select("id", "point")


def overlap_join(a: DataFrame, b: DataFrame, a_lo: str, a_hi: str, b_lo: str, b_hi: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of half-open ranges that intersect, with the intersection
    ``[greatest(lo), least(hi))``.

    Of two ranges that intersect, either ``b`` starts within ``a`` or ``a`` starts later
    within ``b``, so all pairs are found as starts in spans, each once. Work follows the
    number of ranges and of pairs, whatever their lengths and however many share a key.
    Empty ranges, and those with a null border or key, intersect nothing.
    """
    k = list(keys)
    ensure_checkpoint_dir(a.sparkSession)

    def numbered(df: DataFrame, name: str, lo: str, hi: str) -> tuple[DataFrame, DataFrame]:
        solid = df.where(F.col(lo) < F.col(hi)).dropna(subset=k) if k else df.where(F.col(lo) < F.col(hi))
        rows = solid.withColumn(name, F.monotonically_increasing_id()).checkpoint()  # the numbers must stay
        return rows, rows.select(*k, F.col(name).alias("id"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))

    rows_a, spans_a = numbered(a, "_wf_a", a_lo, a_hi)
    rows_b, spans_b = numbered(b, "_wf_b", b_lo, b_hi)
    points = lambda spans: spans.select(*k, F.col("id").alias("point"), F.col("lo").alias("at"))
    first = _places(spans_a, points(spans_b), k, False).select(F.col("id").alias("_wf_a"), F.col("point").alias("_wf_b"))
    second = _places(spans_b, points(spans_a), k, True).select(F.col("point").alias("_wf_a"), F.col("id").alias("_wf_b"))
    j = first.union(second).join(rows_a, "_wf_a").join(rows_b.drop(*k), "_wf_b").drop("_wf_a", "_wf_b")
    return j.withColumns({"lo": F.greatest(F.col(a_lo), F.col(b_lo)), "hi": F.least(F.col(a_hi), F.col(b_hi))})


def index_to_shard(indices: DataFrame, shards: DataFrame, index: str = "index", order: str = "url", n: str = "nsamples") -> DataFrame:
    """Global index -> (shard, inner index) via prefix sums of shard sizes.

    The shard table is one row per shard (like a file listing); its prefix sum runs
    over that small table, then a bucketed range join places each index. The bucket
    is the mean shard size, so a bucket meets few shards even when one shard is huge.
    """
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sh = shards.select(order, n, F.coalesce(F.sum(n).over(w), F.lit(0)).alias("_wf_lo"))
    sh = sh.withColumn("_wf_hi", F.col("_wf_lo") + F.col(n))
    stats = shards.agg(F.sum(n).alias("t"), F.count(F.lit(1)).alias("c")).first()
    bucket = max(1.0, float((stats["t"] or 0) // max(stats["c"], 1)))
    out = range_join(indices, sh, index, "_wf_lo", "_wf_hi", bucket=bucket)
    return out.withColumn("inner_index", F.col(index) - F.col("_wf_lo")).drop("_wf_lo", "_wf_hi")


def stem_manifest(manifest: DataFrame, path: str = "path") -> DataFrame:
    """J10 helper: (stem, path, length) where stem is the path without its extension."""
    return manifest.select(F.regexp_replace(path, r"\.[^./]*$", "").alias("stem"), F.col(path).alias("media_path"))


def resolve_media(df: DataFrame, manifest: DataFrame, stem: Column) -> DataFrame:
    """Keep samples whose media exists: an exact path match wins, else the
    shortest ``stem.*`` match."""
    m = stem_manifest(manifest)
    best = m.groupBy("stem").agg(F.min_by("media_path", F.struct(F.length("media_path"), F.col("media_path"))).alias("_wf_best"))
    exact = manifest.select(F.col("path").alias("_wf_exact"))
    j = df.withColumn("stem", stem).join(exact, F.col("stem") == F.col("_wf_exact"), "left").join(best, "stem", "left")
    return j.withColumn("media_path", F.coalesce("_wf_exact", "_wf_best")).filter(F.col("media_path").isNotNull()).drop(
        "_wf_exact", "_wf_best"
    )


def resolve_by_extension(df: DataFrame, manifest: DataFrame, stem: Column, extensions: Sequence[str]) -> DataFrame:
    """J10, fixed extension order: the first of ``stem + extension`` that exists; samples
    without any go. The order stands in the table of extensions, a literal registry."""
    ranked = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(e).alias("ext")) for i, e in enumerate(extensions)]))
    tried = df.withColumn("stem", stem).select("*", ranked.alias("_wf_e")).withColumn("media_path", F.concat("stem", "_wf_e.ext"))
    known = manifest.select(F.col("path").alias("media_path")).distinct()
    found = tried.join(known, "media_path").groupBy("stem").agg(F.min_by("media_path", "_wf_e.rank").alias("media_path"))
    return df.withColumn("stem", stem).join(found, "stem")


def folder_extension(manifest: DataFrame, path: str = "path") -> DataFrame:
    """J10, folder rule: (folder, ext, error): the one extension of a folder's files; a
    folder with several is an error."""
    parts = manifest.select(
        F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract(path, r"(\.[^./]*)$", 1).alias("ext")
    )
    found = parts.groupBy("folder").agg(F.min("ext").alias("ext"), F.count_distinct("ext").alias("_wf_n"))
    error = F.when(F.col("_wf_n") > 1, F.lit("several extensions in the folder"))
    return found.select("folder", F.when(F.col("_wf_n") == 1, F.col("ext")).alias("ext"), error.alias("error"))


def resume(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work that is not done yet: by id, by file name, by several columns (frames and
    depth), by task. Null keys are never done."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def dedupe_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """J12 helper: one row per key, the one with the largest ``order`` (last wins);
    a ``max_by`` aggregate, so a hot key is combined map-side."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_wf_r")).select(key, "_wf_r.*")


def regroup_annotations(images: DataFrame, img_to_anns: DataFrame, anns: DataFrame) -> DataFrame:
    """``imgs`` (id -> struct), ``imgToAnns`` (id -> [ann ids]) and ``anns``
    (ann id -> struct) maps, each one row per map, exploded and joined, then regrouped per
    image (an image's annotations are a bounded group)."""
    im = images.select(F.explode("imgs").alias("image_id", "img"))
    ia = img_to_anns.select(F.explode("imgToAnns").alias("image_id", "ids")).select("image_id", F.explode("ids").alias("ann_id"))
    an = anns.select(F.explode("anns").alias("ann_id", "ann"))
    j = ia.join(an, "ann_id").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ann_id", "ann"))).alias("annotations"))
    return im.join(j, "image_id", "left")
