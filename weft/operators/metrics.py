"""Evaluation metrics and training statistics.

A metric is an expression per row followed by one aggregation. Aggregates are
combined map-side (partial + final), so a category or task holding a third of the rows
costs one partial row per task. "Overall + per group" tables use ``rollup``; running
prefixes are replaced by a per-group aggregate joined back (no window holds a group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.boxes import iou_plus1, temporal_iou

ROUND = 4


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _level(category: str, overall: str) -> Column:
    """Category of a rollup row; the total is told by its grouping id, not by a null."""
    return F.when(F.col("_wf_all") == 1, F.lit(overall)).otherwise(F.col(category))


def accuracy(df: DataFrame, pred: str, target: str, name: str = "accuracy") -> DataFrame:
    """Mean of exact matches."""
    return df.agg(F.avg((F.col(pred) == F.col(target)).cast("double")).alias(name))


def single_letter_accuracy(df: DataFrame, pred: str, target: str) -> DataFrame:
    """G05 (pmcvqa variant): a prediction longer than one character becomes ``FAILED``."""
    p = F.when(F.length(pred) == 1, F.col(pred)).otherwise(F.lit("FAILED"))
    return df.agg(F.avg((p == F.col(target)).cast("double")).alias("accuracy"))


def accuracy_rollup(df: DataFrame, category: str, correct: Column, categories: Sequence[str]) -> DataFrame:
    """``overall`` plus every listed category (present even with no rows), with
    accuracy = matches / max(total, 1)."""
    spark = df.sparkSession
    d = df.select(F.coalesce(F.col(category), F.lit("Other")).alias("_wf_cat"), correct.cast("int").alias("_wf_ok"))
    per = d.rollup("_wf_cat").agg(F.sum("_wf_ok").alias("match"), F.count(F.lit(1)).alias("total"), F.grouping_id().alias("_wf_all"))
    per = per.select(_level("_wf_cat", "overall").alias("category"), "match", "total")
    cats = spark.createDataFrame([(c,) for c in ["overall", *categories]], "category string")
    out = cats.join(per, "category", "left")
    return out.select(
        "category",
        (F.coalesce(F.col("match"), F.lit(0)) / F.greatest(F.coalesce(F.col("total"), F.lit(0)), F.lit(1))).alias("accuracy"),
    )


def accuracy_by(df: DataFrame, category: str, correct: Column) -> DataFrame:
    """Overall and per-category accuracy and count (missing category = ``Other``),
    sorted by count descending (K07)."""
    d = df.withColumn("_wf_cat", F.coalesce(F.col(category), F.lit("Other")))
    r = d.rollup("_wf_cat").agg(F.avg(correct.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_wf_all"))
    r = r.select(_level("_wf_cat", "Overall").alias("category"), "accuracy", "count")
    return r.orderBy(F.col("count").desc(), "category")


def group_references(df: DataFrame, key: str, text: str, ref: str, order: str) -> DataFrame:
    """References appended per id in row order; the prediction of an id is the
    last one (Q19 fix: a string reference is appended, not spread by character). The
    group is one question's references (bounded)."""
    return df.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order, ref))), lambda x: x[ref]).alias("refs"),
        F.max_by(text, order).alias("pred"),
    )


def bleu_from_parts(precisions: Column, weights: Sequence[float], bp: Column) -> Column:
    """``bp * exp(sum w_i log p_i)`` over the non-zero precisions only."""
    ws = F.array(*[F.lit(float(w)) for w in weights])
    terms = F.zip_with(precisions, ws, lambda p, w: F.when(p != 0, w * F.log(p)).otherwise(F.lit(0.0)))
    return bp * F.exp(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))


def soft_vqa_score(pred: Column, answers: Column) -> Column:
    """Leave-one-out soft accuracy of ``pred`` against n human answers in closed
    form: with c matching answers, (c*min(1,(c-1)/3) + (n-c)*min(1,c/3)) / n."""
    n = F.size(answers)
    c = F.size(F.filter(answers, lambda a: a == pred))
    cd = c.cast("double")
    return (cd * F.least(F.lit(1.0), (cd - 1) / 3) + (n - c) * F.least(F.lit(1.0), cd / 3)) / n


def any_match(pred: Column, answers: Column) -> Column:
    """1.0 when the normalised prediction equals any normalised answer."""
    return F.array_contains(answers, pred).cast("double")


def anls(pred: Column, answers: Column, threshold: float = 0.5) -> Column:
    """Max over answers of 1 - edit distance / max length (lower-cased, stripped),
    zeroed below the threshold. Edit distance counts code points."""
    p = F.lower(F.trim(pred))

    def one(a: Column) -> Column:
        a2 = F.lower(F.trim(a))
        s = 1 - F.levenshtein(p, a2) / F.greatest(F.length(p), F.length(a2))
        return F.when(s >= threshold, s).otherwise(F.lit(0.0))

    return F.array_max(F.transform(answers, one))


def tally_accuracy(df: DataFrame, pred: str, gt: str, simple: str | None = None, largest: int = 15) -> DataFrame:
    """Counting accuracy over ``all``, ``simple``/``complex`` and ``count_<gt>``
    buckets (0..largest); ``pred``/``gt`` already mapped by F18. One row per bucket:
    (bucket, acc, num). Each row is exploded into its buckets, then one aggregate."""
    hit = (F.col(pred) == F.col(gt)).cast("double")
    buckets = [F.lit("all")]
    if simple is not None:
        buckets.append(F.when(F.col(simple) == 1, F.lit("simple")).when(F.col(simple) == 0, F.lit("complex")))
    in_range = F.col(gt).rlike(r"^\d+$") & (F.col(gt).try_cast("int") <= largest)
    buckets.append(F.when(in_range, F.concat(F.lit("count_"), F.col(gt).try_cast("int").cast("string"))))
    ex = df.select(hit.alias("_wf_hit"), F.explode(F.filter(F.array(*buckets), lambda b: b.isNotNull())).alias("bucket"))
    return ex.groupBy("bucket").agg(F.avg("_wf_hit").alias("acc"), F.count(F.lit(1)).alias("num"))


def detection_accuracy(df: DataFrame, pred_box: Column, gt_box: Column, group: Sequence[str]) -> DataFrame:
    """Percentage of rows with +1-pixel IoU >= 0.5, per group (dataset/split)."""
    hit = (iou_plus1(pred_box, gt_box) >= 0.5).cast("double")
    return df.groupBy(*group).agg((F.avg(hit) * 100).alias("accuracy"), F.count(F.lit(1)).alias("total"))


def rtl_macro(df: DataFrame, vid: str, s: str, e: str, ps: str, pe: str) -> DataFrame:
    """Temporal IoU and precision@0.5, averaged per video, then over videos."""
    iou = temporal_iou(F.col(ps), F.col(pe), F.col(s), F.col(e))
    per = df.groupBy(vid).agg(F.avg(iou).alias("_wf_iou"), F.avg((iou >= 0.5).cast("double")).alias("_wf_p"))
    return per.agg(F.avg("_wf_iou").alias("mean_iou"), F.avg("_wf_p").alias("precision_at_05"))


def rtl_micro(df: DataFrame, category: str, s: str, e: str, ps: str, pe: str) -> DataFrame:
    """Temporal IoU and precision@0.5, micro means overall and per category (a missing
    category is ``Other``), with counts."""
    iou = temporal_iou(F.col(ps), F.col(pe), F.col(s), F.col(e))
    d = df.select(F.coalesce(F.col(category), F.lit("Other")).alias("_wf_cat"), iou.alias("_wf_iou"))
    r = d.rollup("_wf_cat").agg(
        F.avg("_wf_iou").alias("mean_iou"),
        F.avg((F.col("_wf_iou") >= 0.5).cast("double")).alias("precision_at_05"),
        F.count(F.lit(1)).alias("count"),
        F.grouping_id().alias("_wf_all"),
    )
    return r.select(_level("_wf_cat", "overall").alias("category"), "mean_iou", "precision_at_05", "count")


def action_step_metrics(df: DataFrame, action: str, type_match: str, exact_match: str, hit: str, text_dist: str | None = None) -> DataFrame:
    """Per action type and ``total``: count, type accuracy, exact accuracy (and
    the total's hit rate, the text-ratio mean of INPUT alone), rounded to 4 places."""
    aggs = [
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg(F.col(type_match).cast("double")), ROUND).alias("type_acc"),
        F.round(F.avg(F.col(exact_match).cast("double")), ROUND).alias("exact_acc"),
        F.round(F.avg(F.col(hit).cast("double")), ROUND).alias("hit_rate"),
    ]
    if text_dist is not None:
        aggs.append(F.round(F.avg(text_dist), ROUND).alias("text_dist"))
    r = df.withColumn("_wf_a", F.coalesce(F.upper(action), F.lit("OTHER"))).rollup("_wf_a").agg(*aggs, F.grouping_id().alias("_wf_all"))
    r = r.withColumn("action", _level("_wf_a", "total")).withColumn("hit_rate", F.when(F.col("_wf_all") == 1, F.col("hit_rate")))
    if text_dist is not None:
        r = r.withColumn("text_dist", F.when(F.col("action") == "INPUT", F.col("text_dist")))
    return r.drop("_wf_a", "_wf_all")


def episode_metrics(df: DataFrame, episode: str, step: str, exact: str) -> DataFrame:
    """G20 with W16: progress = steps before the first miss / episode length; success =
    no miss. The first miss per episode is an aggregate joined back, so no window has
    to hold a whole episode."""
    first_miss = df.groupBy(episode).agg(
        F.min(F.when(~F.col(exact), F.col(step))).alias("_wf_miss"), F.count(F.lit(1)).alias("_wf_n")
    )
    j = df.join(first_miss, episode)
    ok = F.col("_wf_miss").isNull() | (F.col(step) < F.col("_wf_miss"))
    per = j.groupBy(episode).agg(
        (F.sum(ok.cast("int")) / F.first("_wf_n")).alias("_wf_prog"), F.max(F.col("_wf_miss").isNull().cast("double")).alias("_wf_succ")
    )
    return per.agg(F.round(F.avg("_wf_succ"), ROUND).alias("success_rate"), F.round(F.avg("_wf_prog"), ROUND).alias("goal_progress"))


def prefix_success(df: DataFrame, episode: str, step: str, exact: str, name: str = "prefix_ok") -> DataFrame:
    """A step counts while no earlier (or this) step missed in its episode."""
    first_miss = df.groupBy(episode).agg(F.min(F.when(~F.col(exact), F.col(step))).alias("_wf_miss"))
    j = df.join(first_miss, episode)
    return j.withColumn(name, F.col("_wf_miss").isNull() | (F.col(step) < F.col("_wf_miss"))).drop("_wf_miss")


def tolerance_accuracy(df: DataFrame, task: str, pred: Column, gt: Column) -> DataFrame:
    """Per task exact / within 1 / within 2 accuracy in percent; rows with an
    unparsable side are skipped."""
    d = df.select(F.col(task).alias("task"), pred.alias("_p"), gt.alias("_g")).filter(F.col("_p").isNotNull() & F.col("_g").isNotNull())
    diff = F.abs(F.col("_p") - F.col("_g"))
    return d.groupBy("task").agg(
        (F.avg((diff == 0).cast("double")) * 100).alias("exact_accuracy"),
        (F.avg((diff <= 1).cast("double")) * 100).alias("tolerance_1_accuracy"),
        (F.avg((diff <= 2).cast("double")) * 100).alias("tolerance_2_accuracy"),
        F.count(F.lit(1)).alias("total"),
    )


def set_prf(df: DataFrame, pred: Column, gt: Column) -> DataFrame:
    """Precision, recall, F1 and Jaccard of id sets (x100, averaged); rows where
    either side is empty are skipped."""
    p, g = F.array_distinct(pred), F.array_distinct(gt)
    d = df.select(p.alias("p"), g.alias("g")).filter((F.size("p") > 0) & (F.size("g") > 0))
    tp = F.size(F.array_intersect("p", "g")).cast("double")
    prec = tp / F.size("p")
    rec = tp / F.size("g")
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    jac = tp / F.size(F.array_union("p", "g"))
    return d.agg(
        (F.avg(prec) * 100).alias("precision"), (F.avg(rec) * 100).alias("recall"), (F.avg(f1) * 100).alias("f1_score"),
        (F.avg(jac) * 100).alias("accuracy"), F.count(F.lit(1)).alias("total"),
    )


def judge_summary(df: DataFrame, pred: str, score: str) -> DataFrame:
    """yes/no accuracy (``yes`` contained in the judge's pred) and the mean of the
    integer-truncated score. A row whose score does not parse still counts in the
    denominator (Q21 kept) and adds 0."""
    yes = F.lower(F.col(pred)).contains("yes").cast("double")
    sc = F.coalesce(F.col(score).try_cast("double").cast("int"), F.lit(0))
    return df.agg(F.avg(yes).alias("accuracy"), F.avg(sc.cast("double")).alias("average_score"), F.count(F.lit(1)).alias("count"))


def aspect_score(df: DataFrame, task: str, score: str) -> DataFrame:
    """Mean integer-truncated judge score per aspect/task."""
    return df.groupBy(task).agg(F.avg(F.col(score).try_cast("double").cast("int").cast("double")).alias("score"))


def needle_matrix(df: DataFrame, depth: str, frames: str, score: str, frame_values: Sequence[int]) -> DataFrame:
    """Depth x frames mean score (pivot on the given frame values, so no extra
    distinct job runs), with ``overall``, the mean of all cells, in every row."""
    matrix = df.groupBy(depth).pivot(frames, list(frame_values)).agg(F.avg(score))
    cells = df.groupBy(depth, frames).agg(F.avg(score).alias("_wf_s")).agg(F.avg("_wf_s").alias("overall"))
    one = F.lit(1).alias("_wf_one")
    return matrix.select("*", one).join(F.broadcast(cells.select("*", one)), "_wf_one").drop("_wf_one")


def summarise(results: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per (task, metric name): the value at the registry's path
    (``a/b/c``) inside each task's JSON results."""
    j = results.join(registry, "task")
    path = F.concat(F.lit("$."), F.regexp_replace(F.col("path"), "/", "."))
    return j.select("task", "name", F.call_function("get_json_object", F.col("json"), path).try_cast("double").alias("value"))


def loss_weights(df: DataFrame, rank: str, labels: str, world: int, ignore: int = -100) -> DataFrame:
    """Active (non-ignored, shifted) labels per rank over the global active count,
    times the world size."""
    active = F.size(F.filter(F.slice(F.col(labels), 2, 1 << 30), lambda x: x != ignore))
    per = df.groupBy(rank).agg(F.sum(active).alias("active"))
    tot = per.agg(F.sum("active").alias("_wf_t"))
    per = per.withColumn("_k", F.lit(1)).join(F.broadcast(tot.withColumn("_k", F.lit(1))), "_k")
    return per.select(rank, "active", (F.col("active") / F.col("_wf_t") * world).alias("loss_weight"))


def masked_stats(df: DataFrame, value: str, mask: str) -> DataFrame:
    """Masked mean and Bessel-corrected masked variance; a zero mask sum fails."""
    m = F.col(mask).cast("double")
    s = df.agg(F.sum(F.col(value) * m).alias("sx"), F.sum(F.col(value) * F.col(value) * m).alias("sxx"), F.sum(m).alias("sm"))
    mean = F.col("sx") / F.col("sm")
    var = (F.col("sxx") / F.col("sm") - mean * mean) * F.col("sm") / (F.col("sm") - 1)
    checked = F.when(F.col("sm") == 0, F.raise_error(F.lit("mask sum is zero"))).otherwise(var)
    return s.select(mean.alias("mean"), checked.alias("var"))


def moments(df: DataFrame, value: str) -> DataFrame:
    """Global mean / population and sample variance / count (Spark merges the
    per-partition moments exactly like a running merge)."""
    return df.agg(
        F.avg(value).alias("mean"), F.var_pop(value).alias("var_pop"), F.var_samp(value).alias("var_samp"),
        F.count(value).alias("count"),
    )


def pair_accuracy(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """Share of pairs where the chosen score wins (argmax, ties go to chosen),
    the tie count, and the mean softmax probability of the chosen answer."""
    c, r = F.col(chosen), F.col(rejected)
    prob = F.lit(1.0) / (F.lit(1.0) + F.exp(r - c))
    return df.agg(
        F.avg((c >= r).cast("double")).alias("accuracy"), F.count(F.when(c == r, F.lit(1))).alias("ties"), F.avg(prob).alias("p_chosen")
    )


def preference_stats(df: DataFrame, pc: str, pr: str, rc: str, rr: str, beta: float = 0.1) -> DataFrame:
    """rewards = beta * (policy - reference) log-probs; means of chosen/rejected
    rewards, accuracy, margin and of the four log-prob columns."""
    cr = beta * (F.col(pc) - F.col(rc))
    rj = beta * (F.col(pr) - F.col(rr))
    return df.agg(
        F.avg(cr).alias("rewards_chosen"), F.avg(rj).alias("rewards_rejected"), F.avg((cr > rj).cast("double")).alias("rewards_accuracies"),
        F.avg(cr - rj).alias("rewards_margins"), F.avg(pc).alias("logps_chosen"), F.avg(pr).alias("logps_rejected"),
        F.avg(rc).alias("ref_logps_chosen"), F.avg(rr).alias("ref_logps_rejected"),
    )


def rollout_stats(df: DataFrame, query_len: Column, response_len: Column, kl: Column, entropy: Column, score: Column) -> DataFrame:
    """query/response length mean and std, mean KL and entropy, score mean/std."""
    return df.agg(
        F.avg(query_len).alias("tokens_queries_len_mean"), F.stddev_samp(query_len).alias("tokens_queries_len_std"),
        F.avg(response_len).alias("tokens_responses_len_mean"), F.stddev_samp(response_len).alias("tokens_responses_len_std"),
        F.avg(kl).alias("objective_kl"), F.avg(entropy).alias("objective_entropy"),
        F.avg(score).alias("env_reward_mean"), F.stddev_samp(score).alias("env_reward_std"),
    )


def mean_stats(df: DataFrame, stats: str) -> DataFrame:
    """Average nested stat dicts (``map<string, map<string,double>>`` or flat)
    key by key, keys flattened with ``/``."""
    flat = df.select(F.explode(stats).alias("k1", "v1"))
    if isinstance(df.schema[stats].dataType.valueType, type(df.schema[stats].dataType)):
        flat = flat.select("k1", F.explode("v1").alias("k2", "v")).select(F.concat_ws("/", "k1", "k2").alias("key"), "v")
    else:
        flat = flat.select(F.col("k1").alias("key"), F.col("v1").alias("v"))
    return flat.groupBy("key").agg(F.avg("v").alias("mean"))


def facet_breakdown(df: DataFrame, correct: Column, facets: Sequence[str], list_facets: Sequence[str] = ()) -> DataFrame:
    """Accuracy per (facet, value) over scalar facets and list-valued facets (each
    list element counts once); the accuracy is also given as a 2-decimal percentage
    string; rows sorted by facet then accuracy descending. Equivalent to GROUPING SETS
    over the unpivoted facets, computed as one explode + one aggregate."""
    pairs = [F.array(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"))) for f in facets]
    pairs += [_list_pairs(f) for f in list_facets]
    ex = df.select(correct.cast("double").alias("_wf_ok"), F.explode(F.flatten(F.array(*pairs))).alias("fv"))
    g = ex.groupBy("fv.facet", "fv.value").agg(F.avg("_wf_ok").alias("acc"), F.count(F.lit(1)).alias("total"))
    return g.withColumn("accuracy", F.format_string("%.2f", F.col("acc") * 100)).orderBy("facet", F.col("acc").desc(), "value")


def _list_pairs(f: str) -> Column:
    return F.transform(F.array_distinct(F.col(f)), lambda v: F.struct(F.lit(f).alias("facet"), v.cast("string").alias("value")))
