"""Message shaping (M01–M19): turn arrays rewritten with higher-order functions.

A sample's turns live in one row, so every operator here is a projection: no shuffle,
no Python. Ordered folds (running tag counts) use ``aggregate``/``slice`` over the turn
array, which is bounded by the length of one conversation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.ids import keyed_hash
from weft.schema import IMAGE_TOKEN, VIDEO_TOKEN, TURNS

PART = "struct<kind:string,text:string,path:string>"

# Chat templates (fixed values: system text, role markers and separators of each style).
TEMPLATES = {
    "vicuna_v1": dict(
        style="TWO",
        system="A chat between a curious user and an artificial intelligence assistant. "
        "The assistant gives helpful, detailed, and polite answers to the user's questions.",
        roles=("USER", "ASSISTANT"),
        sep=" ",
        sep2="</s>",
    ),
    "plain": dict(style="PLAIN", system="", roles=("", ""), sep="\n", sep2=None),
    "hermes-2": dict(
        style="MPT",
        system="<|im_start|>system\nAnswer the questions.",
        roles=("<|im_start|>user\n", "<|im_start|>assistant\n"),
        sep="<|im_end|>",
        sep2=None,
    ),
    "llama_3": dict(
        style="LLAMA_3",
        system="<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nYou are a helpful language and vision "
        "assistant. You are able to understand the visual content that the user provides, and assist the user with a "
        "variety of tasks using natural language.",
        roles=("<|start_header_id|>user<|end_header_id|>\n\n", "<|start_header_id|>assistant<|end_header_id|>\n\n"),
        sep="<|eot_id|>",
        sep2="<|end_of_text|>",
    ),
}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The characters of Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: leading/trailing white space (Unicode-aware), in linear time."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def count_tag(c: Column, tag: str = IMAGE_TOKEN) -> Column:
    return F.size(F.split(c, _regex_literal(tag), -1)) - 1


def _regex_literal(tag: str) -> str:
    return "".join("\\" + ch if ch in r"\^$.|?*+()[]{}" else ch for ch in tag)


def split_tag(c: Column, tag: str = IMAGE_TOKEN) -> Column:
    return F.split(c, _regex_literal(tag), -1)


def strip_media_tags(c: Column | str) -> Column:
    """Remove ``<image>``/``<video>`` with one adjoining newline, then strip."""
    x = _c(c)
    for tag in (IMAGE_TOKEN, VIDEO_TOKEN):
        x = F.replace(x, F.lit(tag + "\n"), F.lit(""))
        x = F.replace(x, F.lit("\n" + tag), F.lit(""))
        x = F.replace(x, F.lit(tag), F.lit(""))
    return strip_ws(x)


def map_values(turns: Column, fn) -> Column:
    return F.transform(turns, lambda t: F.struct(t["from"].alias("from"), fn(t["value"]).alias("value")))


def normalise_image_tags(turns: Column | str) -> Column:
    """Add a tag to the first turn when the sample has none; every tag is followed
    by exactly one newline and the chunks around tags are stripped."""
    t = _c(turns)
    has_tag = F.exists(t, lambda x: F.instr(x["value"], IMAGE_TOKEN) > 0)

    def fix(v: Column) -> Column:
        chunks = split_tag(v)
        n = F.size(chunks)
        stripped = F.transform(
            chunks, lambda ch, i: F.when(i < n - 1, F.concat(strip_ws(ch), F.lit(" "))).otherwise(strip_ws(ch))
        )
        joined = strip_ws(F.array_join(stripped, IMAGE_TOKEN + "\n"))
        joined = F.replace(joined, F.lit(IMAGE_TOKEN), F.lit(IMAGE_TOKEN + "\n"))
        joined = F.replace(joined, F.lit(IMAGE_TOKEN + "\n\n"), F.lit(IMAGE_TOKEN + "\n"))
        return F.when(F.instr(v, IMAGE_TOKEN) > 0, joined).otherwise(v)

    first_fixed = F.transform(
        t,
        lambda x, i: F.struct(
            x["from"].alias("from"),
            F.when((i == 0) & ~has_tag, F.concat(F.lit(IMAGE_TOKEN + "\n"), x["value"])).otherwise(x["value"]).alias(
                "value"
            ),
        ),
    )
    return map_values(first_fixed, fix)


def _prior_counts(counts: Column, i: Column) -> Column:
    return F.aggregate(F.slice(counts, 1, i), F.lit(0), lambda a, b: a + b)


def cap_image_tags(turns: Column | str, k: int) -> Column:
    """Keep only the first ``k`` image tags across all turns, in order."""
    t = _c(turns)
    counts = F.transform(t, lambda x: count_tag(x["value"]))

    def keep_first(v: Column, keep: Column) -> Column:
        pieces = split_tag(v)
        rest = F.transform(
            _tail(pieces),
            lambda p, j: F.concat(F.when(j < keep, F.lit(IMAGE_TOKEN)).otherwise(F.lit("")), p),
        )
        return F.concat(pieces[0], F.array_join(rest, ""))

    return F.transform(
        t,
        lambda x, i: F.struct(
            x["from"].alias("from"),
            keep_first(x["value"], F.greatest(F.lit(0), F.least(counts[i], F.lit(k) - _prior_counts(counts, i)))).alias(
                "value"
            ),
        ),
    )


def _tail(arr: Column) -> Column:
    """All but the first element (empty for a 1-element array)."""
    return F.filter(arr, lambda _x, j: j > 0)


def media_first(df: DataFrame, images: str = "images", video: str = "video", max_images: int | None = None) -> DataFrame:
    """Media as parts before the text of the first (human) turn; tags removed from
    all text. Samples whose first turn is not human get ``error`` set (quarantine)."""
    imgs = F.coalesce(F.col(images), F.array().cast("array<string>"))
    if max_images is not None:
        imgs = F.slice(imgs, 1, max_images)
    media = F.concat(
        F.transform(imgs, lambda p: F.struct(F.lit("image").alias("kind"), F.lit(None).cast("string").alias("text"), p.alias("path"))),
        F.when(
            F.col(video).isNotNull(),
            F.array(F.struct(F.lit("video").alias("kind"), F.lit(None).cast("string").alias("text"), F.col(video).alias("path"))),
        ).otherwise(F.array().cast(f"array<{PART}>")),
    )

    def text_part(v: Column) -> Column:
        return F.struct(F.lit("text").alias("kind"), strip_media_tags(v).alias("text"), F.lit(None).cast("string").alias("path"))

    parts = F.transform(
        F.col("turns"),
        lambda x, i: F.struct(
            x["from"].alias("from"),
            F.when(i == 0, F.concat(media, F.array(text_part(x["value"])))).otherwise(F.array(text_part(x["value"]))).alias(
                "parts"
            ),
        ),
    )
    err = F.when(F.coalesce(F.get(F.col("turns"), 0)["from"] != "human", F.lit(True)), F.lit("first message is not from human"))
    return df.withColumn("messages", parts).withColumn("error", err)


def inline_media(df: DataFrame, images: str = "images", alternate_roles: bool = False) -> DataFrame:
    """Every in-text tag becomes the next image, in order; the tag count must equal
    the number of images (``error`` otherwise). Optionally force alternating roles."""
    counts = F.transform(F.col("turns"), lambda x: count_tag(x["value"]))
    total = F.aggregate(counts, F.lit(0), lambda a, b: a + b)
    imgs = F.col(images)

    def parts(v: Column, prior: Column) -> Column:
        pieces = split_tag(v)
        last = F.size(pieces) - 1
        return F.flatten(
            F.transform(
                pieces,
                lambda p, j: F.concat(
                    F.when(
                        j > 0,
                        F.array(
                            F.struct(
                                F.lit("image").alias("kind"),
                                F.lit(None).cast("string").alias("text"),
                                F.get(imgs, prior + j - 1).alias("path"),
                            )
                        ),
                    ).otherwise(F.array().cast(f"array<{PART}>")),
                    F.when(
                        (p != "") | (j == last),
                        F.array(F.struct(F.lit("text").alias("kind"), p.alias("text"), F.lit(None).cast("string").alias("path"))),
                    ).otherwise(F.array().cast(f"array<{PART}>")),
                ),
            )
        )

    msgs = F.transform(
        F.col("turns"),
        lambda x, i: F.struct(
            (F.when(i % 2 == 0, F.lit("human")).otherwise(F.lit("gpt")) if alternate_roles else x["from"]).alias("from"),
            parts(x["value"], _prior_counts(counts, i)).alias("parts"),
        ),
    )
    err = F.when(total != F.size(imgs), F.lit("number of tags does not match the number of images"))
    return df.withColumn("messages", msgs).withColumn("error", err)


def inline_numbered_media(df: DataFrame, n_images: str = "n_images") -> DataFrame:
    """Numbered tags ``<image-i>`` (1-based) become ``<image>``; ``unreferenced``
    lists image numbers never referenced, and a sample with any gets ``error``."""
    n = F.col(n_images)
    text = F.array_join(F.transform(F.col("turns"), lambda x: x["value"]), "\n")
    refs = F.transform(F.regexp_extract_all(text, F.lit(r"<image-(\d+)>"), 1), lambda s: s.cast("int"))
    unref = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ~F.array_contains(refs, i))
    turns = map_values(F.col("turns"), lambda v: F.regexp_replace(v, r"<image-\d+>", IMAGE_TOKEN))
    return (
        df.withColumn("turns", turns)
        .withColumn("unreferenced", unref)
        .withColumn("error", F.when(F.size(unref) > 0, F.lit("image not referenced")))
    )


def flatten_parts(messages: Column | str, num_frames: int) -> Column:
    """Parts -> text: stray tokens removed from text parts, one token per image,
    ``num_frames`` tokens per video."""

    def part_text(p: Column) -> Column:
        clean = p["text"]
        for tag in (IMAGE_TOKEN, VIDEO_TOKEN):
            clean = F.when(F.instr(clean, tag) > 0, strip_ws(F.replace(clean, F.lit(tag), F.lit("")))).otherwise(clean)
        return (
            F.when(p["kind"] == "text", clean)
            .when(p["kind"] == "image", F.lit(IMAGE_TOKEN))
            .otherwise(F.repeat(F.lit(IMAGE_TOKEN), num_frames))
        )

    return F.transform(
        _c(messages),
        lambda m: F.named_struct(F.lit("from"), m["from"], F.lit("value"), F.array_join(F.transform(m["parts"], part_text), "")),
    )


def expand_tile_tags(prompt: Column | str, tiles: Column | str) -> Column:
    """The i-th tag becomes ``tiles[i]`` tags (each followed by a newline); with no
    images every tag is removed."""
    pieces = split_tag(_c(prompt))
    t = _c(tiles)
    n = F.size(t)
    m = F.greatest(F.size(pieces), n)
    joined = F.array_join(
        F.transform(
            F.sequence(F.lit(0), m - 1),
            lambda j: F.concat(
                F.coalesce(F.get(pieces, j), F.lit("")),
                F.when(j < n, F.repeat(F.lit(IMAGE_TOKEN + "\n"), F.get(t, j))).otherwise(F.lit("")),
            ),
        ),
        "",
    )
    return F.when(n > 0, joined).otherwise(F.replace(_c(prompt), F.lit(IMAGE_TOKEN), F.lit("")))


def with_system(df: DataFrame, prompts: Sequence[str] | str, seed: int = 42, key: str = "sample_id") -> DataFrame:
    """Prepend a system turn; one of several prompts is picked by keyed hash."""
    if isinstance(prompts, str):
        prompts = [prompts]
    choices = F.array(*[F.lit(p) for p in prompts])
    pick = F.get(choices, (keyed_hash(seed, key) % len(prompts)).cast("int"))
    sys_turn = F.array(F.struct(F.lit("system").alias("from"), pick.alias("value")))
    return df.withColumn("turns", F.concat(sys_turn, F.col("turns")).cast(TURNS))


def render_chat(turns: Column | str, style: str = "vicuna_v1", media_first: bool = False) -> Column:
    """Chat text in the TWO / LLAMA_3 / MPT / PLAIN styles of ``TEMPLATES``.

    With ``media_first`` the image tags of the first turn become one tag in a line before
    its stripped text, as for a sample with media; otherwise tags stay where they are.
    """
    tpl = TEMPLATES[style]
    t = _c(turns)
    if media_first:
        bare = lambda x: strip_ws(F.replace(x["value"], F.lit(IMAGE_TOKEN), F.lit("")))
        front = lambda x, i: F.when(i == 0, F.concat(F.lit(IMAGE_TOKEN + "\n"), bare(x))).otherwise(x["value"])
        t = F.transform(t, lambda x, i: x.withField("value", front(x, i)))
    n = F.size(t)
    r0, r1 = tpl["roles"]
    sep, sep2 = tpl["sep"], tpl["sep2"]

    def role(x: Column) -> Column:
        return F.when(x["from"] == "human", F.lit(r0)).otherwise(F.lit(r1))

    def piece(x: Column, i: Column) -> Column:
        msg = x["value"]
        empty = msg.isNull() | (msg == "")
        if tpl["style"] == "TWO":
            s = F.when(i % 2 == 0, F.lit(sep)).otherwise(F.lit(sep2))
            return F.when(empty, F.concat(role(x), F.lit(":"))).otherwise(F.concat(role(x), F.lit(": "), msg, s))
        if tpl["style"] == "LLAMA_3":
            s = F.when(i < n - 1, F.lit(sep)).otherwise(F.lit(sep2))
            return F.when(empty, role(x)).otherwise(F.concat(role(x), msg, s))
        if tpl["style"] == "MPT":
            return F.when(empty, role(x)).otherwise(F.concat(role(x), msg, F.lit(sep)))
        s = F.when(i % 2 == 0, F.lit(sep)).otherwise(F.lit(sep2 or ""))
        return F.when(empty, F.lit("")).otherwise(F.concat(msg, s))

    head = tpl["system"] if tpl["style"] == "PLAIN" else tpl["system"] + sep
    return F.concat(F.lit(head), F.array_join(F.transform(t, piece), ""))


def to_chatml(turns: Column | str, overrides: dict[str, str] | None = None) -> Column:
    """Human->user, gpt->assistant; any other role fails the job (as the reference
    raises). Per-role content overrides."""
    ov = overrides or {}

    def conv(x: Column) -> Column:
        role = (
            F.when(x["from"] == "human", F.lit("user"))
            .when(x["from"] == "gpt", F.lit("assistant"))
            .otherwise(F.raise_error(F.concat(F.lit("Unexpected sender "), x["from"])).cast("string"))
        )
        content = x["value"]
        for r, text in ov.items():
            content = F.when(x["from"] == r, F.lit(text)).otherwise(content)
        return F.struct(role.alias("role"), content.alias("content"))

    return F.transform(_c(turns), conv)


def format_by_schema(df: DataFrame, style: str = "hermes-2") -> DataFrame:
    """Chat-ML rows (``messages`` of role/content) are rendered with a template,
    prompt/completion rows are concatenated; the choice is made from the schema."""
    cols = set(df.columns)
    if "messages" in cols:
        turns = F.transform(
            F.col("messages"),
            lambda m: F.struct(
                F.when(m["role"] == "user", F.lit("human")).otherwise(F.lit("gpt")).alias("from"), m["content"].alias("value")
            ),
        )
        return df.withColumn("text", render_chat(turns, style))
    if {"prompt", "completion"} <= cols:
        return df.withColumn("text", F.concat(F.col("prompt"), F.col("completion")))
    raise ValueError("dataset has neither messages nor prompt/completion columns")


def plain_pair(df: DataFrame, sep: str = "\n") -> DataFrame:
    """Captioning pair: exactly 2 turns with a tag in the first; the first turn is
    reduced to the tag and ``text`` = tag + answer + sep. Other rows get ``error``."""
    ok = (F.size("turns") == 2) & (F.instr(F.col("turns")[0]["value"], IMAGE_TOKEN) > 0)
    return df.withColumn(
        "text", F.when(ok, F.concat(F.lit(IMAGE_TOKEN), F.col("turns")[1]["value"], F.lit(sep)))
    ).withColumn("error", F.when(~ok, F.lit("not a plain caption pair")))


def mc_prompt(question: Column | str, options: Column | str, style: str = "lettered") -> Column:
    """Multiple-choice prompt builders.

    ``dash``: question + ``\\n- A) opt`` per option; ``lettered``: question, then
    ``A. opt`` lines and the letter instruction; ``prefix``: instruction first;
    ``listing``: the option strings as given, one per line, then ``The best answer is:``.
    """
    q, o = _c(question), _c(options)
    letter = lambda i: F.char(F.lit(65) + i)
    if style == "dash":
        return F.concat(q, F.array_join(F.transform(o, lambda x, i: F.concat(F.lit("\n- "), letter(i), F.lit(") "), x)), ""))
    lines = F.array_join(F.transform(o, lambda x, i: F.concat(letter(i), F.lit(". "), x, F.lit("\n"))), "")
    if style == "lettered":
        return F.concat(q, F.lit("\n"), lines, F.lit("Answer with the option's letter from the given choices directly."))
    if style == "prefix":
        return F.concat(
            F.lit("Watching the video and answer with the option's letter from the given choices directly."), q, F.lit("\n"), lines
        )
    if style == "listing":
        return F.concat(
            F.lit(
                "Select the best answer to the following multiple-choice question based on the video. "
                "Respond with only the letter (A, B, C, or D) of the correct option.\n"
            ),
            q,
            F.lit("\n"),
            F.array_join(o, "\n"),
            F.lit("\nThe best answer is:"),
        )
    raise ValueError(style)


def split_prompt(text: Column | str, images: Column | str) -> Column:
    """Text pieces around ``<image>\\n`` interleaved with images: non-empty stripped
    text first, then the image of the same index when there is one."""
    pieces = F.split(_c(text), _regex_literal(IMAGE_TOKEN + "\n"), -1)
    imgs = _c(images)
    return F.flatten(
        F.transform(
            pieces,
            lambda p, i: F.concat(
                F.when(strip_ws(p) != "", F.array(F.struct(F.lit("text").alias("kind"), strip_ws(p).alias("value")))).otherwise(
                    F.array().cast("array<struct<kind:string,value:string>>")
                ),
                F.when(i < F.size(imgs), F.array(F.struct(F.lit("image").alias("kind"), F.get(imgs, i).alias("value")))).otherwise(
                    F.array().cast("array<struct<kind:string,value:string>>")
                ),
            ),
        )
    )


def route_turns(df: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row per (human turn, task) whose question, lower-cased without
    ``<image>\\n``, starts with the task's question prefix; the next gpt turn is the
    ground truth. ``tasks`` is a table of (task, prefix); turns meet it in an equi-join on
    their beginnings, cut at the lengths that some prefix has, never in a nested loop."""
    ex = df.select("sample_id", F.col("turns").alias("turns_all"), F.posexplode("turns").alias("i", "t"))
    nxt = F.get(F.col("turns_all"), F.col("i") + 1)
    q = F.lower(F.replace(F.col("t.value"), F.lit(IMAGE_TOKEN + "\n"), F.lit("")))
    cand = ex.filter(F.col("t.from") == "human").withColumn("_q", q)
    known = tasks.select("task", F.lower("prefix").alias("_start"))
    lengths = known.agg(F.collect_set(F.length("_start")).alias("_lens")).withColumn("_one", F.lit(1))
    cut = F.transform(F.filter("_lens", lambda n: n <= F.length("_q")), lambda n: F.substring(F.col("_q"), F.lit(1), n))
    starts = cand.withColumn("_one", F.lit(1)).join(F.broadcast(lengths), "_one").withColumn("_start", F.explode(cut))
    routed = starts.join(known, "_start")
    return routed.select(
        "sample_id",
        "task",
        F.col("i").alias("turn"),
        F.col("t.value").alias("question"),
        F.when(nxt["from"] == "gpt", nxt["value"]).alias("ground_truth"),
    )


def frames_first(df: DataFrame, frames: DataFrame, video: str = "video", path: str = "path") -> DataFrame:
    """The frame files of a video folder (a manifest of (video, path), e.g. from
    ``binaryFile`` listing) become image parts before the first turn's text, whose
    image tags are removed; a video without frames gets ``error``. The per-video
    frame list is a bounded group."""
    lists = frames.groupBy(video).agg(F.array_sort(F.collect_list(path)).alias("_wf_frames"))
    j = df.join(lists, video, "left")
    fr = F.coalesce(F.col("_wf_frames"), F.array().cast("array<string>"))
    parts0 = F.concat(
        F.transform(fr, lambda p: F.struct(F.lit("image").alias("kind"), F.lit(None).cast("string").alias("text"), p.alias("path"))),
        F.array(F.struct(F.lit("text").alias("kind"), strip_ws(F.replace(F.get(F.col("turns"), 0)["value"], F.lit(IMAGE_TOKEN), F.lit(""))).alias("text"),
                         F.lit(None).cast("string").alias("path"))),
    )
    msgs = F.transform(
        F.col("turns"),
        lambda t, i: F.struct(
            t["from"].alias("from"),
            F.when(i == 0, parts0).otherwise(
                F.array(F.struct(F.lit("text").alias("kind"), t["value"].alias("text"), F.lit(None).cast("string").alias("path")))
            ).alias("parts"),
        ),
    )
    return j.withColumn("messages", msgs).withColumn("error", F.when(F.size(fr) == 0, F.lit("no frames found"))).drop("_wf_frames")
