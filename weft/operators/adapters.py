"""Dataset adapters (A01–A29): each projects one source format into the canonical Sample.

All adapters are plain projections with higher-order array functions, so they stay
inside whole-stage codegen and never shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.schema import IMAGE_TOKEN, to_sample, turn


def escape_image_tag(c: Column) -> Column:
    """A literal ``<image>`` inside a caption becomes ``<IMAGE>``."""
    return F.replace(c, F.lit(IMAGE_TOKEN), F.lit("<IMAGE>"))


def caption_samples(df: DataFrame, dataset: str, text: str = "text", image: Column | None = None,
                    id_col: str = "doc_id", row_id: str = "row_id") -> DataFrame:
    """Caption row -> human ``<image>\\n`` / gpt caption (tags in the caption escaped)."""
    turns = F.array(turn("human", F.lit(IMAGE_TOKEN + "\n")), turn("gpt", escape_image_tag(F.col(text))))
    images = F.array(image) if image is not None else F.array(F.concat(F.col(id_col).cast("string"), F.lit(".jpg")))
    return df.select(*to_sample(dataset, F.col(id_col), row_id, turns, images=images))


def _pairs_to_turns(pairs: Column, q: str, a: str) -> Column:
    """[{q, a}, ...] -> [human q, gpt a, ...]."""
    return F.flatten(F.transform(pairs, lambda p: F.array(turn("human", p[q]), turn("gpt", p[a].cast("string")))))


def _tag_first(turns: Column, tag: Column | str = IMAGE_TOKEN + "\n") -> Column:
    t = F.lit(tag) if isinstance(tag, str) else tag
    return F.transform(turns, lambda x, i: F.struct(x["from"].alias("from"), F.when(i == 0, F.concat(t, x["value"])).otherwise(x["value"]).alias("value")))


def messages_samples(df: DataFrame, dataset: str, id_col: str, messages: str = "messages", images: str = "image") -> DataFrame:
    """role/content messages; ``user`` -> human, anything else -> gpt; the
    ``<|image|>`` marker becomes ``<image>\\n``; only the first image is kept."""
    turns = F.transform(
        F.col(messages),
        lambda m: turn(F.when(m["role"] == "user", F.lit("human")).otherwise(F.lit("gpt")), F.replace(m["content"], F.lit("<|image|>"), F.lit(IMAGE_TOKEN + "\n"))),
    )
    return df.select(*to_sample(dataset, F.col(id_col), F.col(id_col), turns, images=F.slice(F.col(images), 1, 1)))


def query_response_samples(df: DataFrame, dataset: str, id_col: str, query: str = "query", response: str = "response", kind: str = "type") -> DataFrame:
    """query/response rows with a question type kept in ``extras``."""
    turns = F.array(turn("human", F.col(query)), turn("gpt", F.col(response)))
    extras = F.create_map(F.lit("question_type"), F.col(kind).cast("string"))
    return df.select(*to_sample(dataset, F.col(id_col), F.col(id_col), turns, extras=extras))


def parallel_qa_samples(df: DataFrame, dataset: str, id_col: str, questions: str = "Questions", answers: str = "Answers",
                        image: str | None = None) -> DataFrame:
    """Parallel question/answer lists (equal length required), answers as strings,
    the image tag on the first question."""
    pairs = F.arrays_zip(F.col(questions).alias("q"), F.col(answers).cast("array<string>").alias("a"))
    ok = F.size(questions) == F.size(answers)
    turns = _tag_first(_pairs_to_turns(pairs, "q", "a"))
    checked = F.when(ok, turns).otherwise(F.raise_error(F.lit("questions and answers differ in length")).cast(turns_type()))
    imgs = F.array(F.col(image)) if image else None
    return df.select(*to_sample(dataset, F.col(id_col), F.col(id_col), checked, images=imgs))


def turns_type():
    from weft.schema import TURNS

    return TURNS


def instruction_samples(df: DataFrame, dataset: str, id_col: str) -> DataFrame:
    """Instruction + inputs -> question, outputs -> answer."""
    turns = F.array(turn("human", F.concat("instruction", "inputs")), turn("gpt", F.col("outputs")))
    return df.select(*to_sample(dataset, F.col(id_col), F.col(id_col), turns))


def chart_query_samples(df: DataFrame, dataset: str) -> DataFrame:
    """Strip ``<opencqa>`` and white space from the query; the id is the image name
    without its 4-character extension."""
    q = F.trim(F.replace(F.col("query"), F.lit("<opencqa>"), F.lit("")))
    sid = F.expr("substring(imgname, 1, length(imgname) - 4)")
    turns = F.array(turn("human", F.concat(F.lit(IMAGE_TOKEN + "\n "), q)), turn("gpt", F.col("label")))
    return df.select(*to_sample(dataset, sid, F.lit(None), turns, images=F.array("imgname")))


def multi_image_texts_samples(df: DataFrame, dataset: str, id_col: str, texts: str = "texts", n_images: str = "n_images") -> DataFrame:
    """Texts [{user, assistant}]: N image tags before the first user text; an
    assistant text starting with ``Answer: `` has every ``Answer: `` removed."""
    tags = F.repeat(F.lit(IMAGE_TOKEN + "\n"), F.col(n_images))

    def one(p: Column, i: Column) -> Column:
        user = F.when(i == 0, F.concat(tags, p["user"])).otherwise(p["user"])
        a = p["assistant"]
        a = F.when(a.startswith("Answer: "), F.replace(a, F.lit("Answer: "), F.lit(""))).otherwise(a)
        return F.concat(
            F.when(p["user"].isNotNull(), F.array(turn("human", user))).otherwise(F.array().cast(turns_type())),
            F.when(p["assistant"].isNotNull(), F.array(turn("gpt", a))).otherwise(F.array().cast(turns_type())),
        )

    turns = F.flatten(F.transform(F.col(texts), one))
    images = F.transform(F.sequence(F.lit(0), F.col(n_images) - 1), lambda k: F.concat(F.col(id_col).cast("string"), F.lit("_"), k.cast("string"), F.lit(".png")))
    images = F.when(F.col(n_images) > 0, images).otherwise(F.array().cast("array<string>"))
    return df.select(*to_sample(dataset, F.col(id_col), F.col(id_col), turns, images=images))


# The questions about an artwork.
ART_FIRST = "<image>\nYou are given an image of an artwork. Please answer the following questions briefly. What is the name of the painting?"
ART_QUESTIONS = [("author", "Who is the author of the painting?"), ("genre", "What is the genre of the painting?"),
                 ("style", "What is the style of the painting?")]


def artwork_samples(df: DataFrame, dataset: str, id_col: str) -> DataFrame:
    """A10: up to 4 templated QA pairs, only for non-empty fields; rows without a
    painting name are skipped."""
    empty = F.array().cast(turns_type())
    turns = F.array(turn("human", F.lit(ART_FIRST)), turn("gpt", F.concat("painting_name", F.lit("."))))
    for field, q in ART_QUESTIONS:
        turns = F.concat(
            turns,
            F.when(F.length(field) > 0, F.array(turn("human", F.lit(q)), turn("gpt", F.concat(field, F.lit("."))))).otherwise(empty),
        )
    return df.filter(F.length("painting_name") > 0).select(*to_sample(dataset, F.col(id_col), F.col(id_col), turns, images=F.array("path")))


# Nutrition entity codes and their names.
ENTITY_NAMES = {
    "SS": "Serving Size", "CE-PS": "Calories/Energy of per serving", "CE-P1": "Calories/Energy of per 100g/ml",
    "CE-D": "Calories/Energy of % Daily Value", "CE-PP": "Calories/Energy of per package", "TF-PS": "Total Fat of per serving",
    "TF-P1": "Total Fat of per 100g/ml", "TF-D": "Total Fat of % Daily Value", "TF-PP": "Total Fat of per package",
    "SO-PS": "Sodium of per serving", "SO-P1": "Sodium of per 100g/ml", "SO-D": "Sodium of % Daily Value",
    "SO-PP": "Sodium of per package", "CAR-PS": "Total Carbohydrate of per serving",
    "CAR-P1": "Total Carbohydrate of per 100g/ml", "CAR-D": "Total Carbohydrate of % Daily Value",
    "CAR-PP": "Total Carbohydrate of per package", "PRO-PS": "Protein of per serving", "PRO-P1": "Protein of per 100g/ml",
    "PRO-D": "Protein of % Daily Value", "PRO-PP": "Protein of per package",
}


def entity_samples(df: DataFrame, dataset: str, entities: str = "entity_dict", file_name: str = "file_name") -> DataFrame:
    """Entity dictionary (code -> value) -> one QA pair per entry via the code
    name lookup; image tag on the first question; rows without entries are skipped."""
    names = F.create_map(*[F.lit(x) for kv in ENTITY_NAMES.items() for x in kv])
    q = lambda e: F.concat(F.lit("what is the value for "), F.element_at(names, e["key"]), F.lit("? Answer this question using the text in the image directly."))
    turns = _tag_first(F.flatten(F.transform(F.map_entries(entities), lambda e: F.array(turn("human", q(e)), turn("gpt", e["value"])))))
    sid = F.element_at(F.split(F.element_at(F.split(F.col(file_name), "/"), -1), r"\."), 1)
    return df.filter(F.size(entities) > 0).select(*to_sample(dataset, sid, F.lit(None), turns, images=F.array(file_name)))


# Receipt field questions.
RECEIPT_QUESTIONS = {
    "company": "what is the name of the company that issued this receipt? Answer this question using the text in the image directly.",
    "address": "where was this receipt issued? Answer this question using the text in the image directly.",
    "date": "when was this receipt issued? Answer this question using the text in the image directly.",
    "total": "what is the total amount of this receipt? Answer this question using the text in the image directly.",
}


def receipt_samples(df: DataFrame, dataset: str, fields: str = "fields", image: str = "image") -> DataFrame:
    """One sample per receipt field; id = image name without its 3-character
    extension + field."""
    qs = F.create_map(*[F.lit(x) for kv in RECEIPT_QUESTIONS.items() for x in kv])
    ex = df.select(image, F.explode(fields).alias("k", "v"))
    turns = F.array(turn("human", F.concat(F.lit(IMAGE_TOKEN + "\n"), F.element_at(qs, F.col("k")))), turn("gpt", F.col("v")))
    sid = F.concat(F.expr(f"substring({image}, 1, length({image}) - 3)"), F.col("k"))
    return ex.select(*to_sample(dataset, sid, F.lit(None), turns, images=F.array(image)))


def flan_samples(df: DataFrame, dataset: str, question: str, answer: str, sample_idx: str = "sample_idx") -> DataFrame:
    """Evenly sampled text rows (W04 gives ``sample_idx``), ids ``text_flan_%08d``."""
    turns = F.array(turn("human", F.col(question)), turn("gpt", F.col(answer)))
    sid = F.format_string("text_flan_%08d", F.col(sample_idx))
    return df.select(*to_sample(dataset, sid, F.col(sample_idx), turns))


def generic_samples(df: DataFrame, dataset: str, id_col: str, media_key: str = "media") -> DataFrame:
    """Media from ``media_key`` else ``image`` else ``video`` (file part of the
    path); turns from ``conversations`` else ``dialog`` else question/answer."""
    cols = set(df.columns)

    def c(name):
        return F.col(name) if name in cols else F.lit(None)

    media = F.coalesce(c(media_key), c("image"), c("video"))
    fname = F.element_at(F.split(media, "/"), -1)
    qa = F.array(turn("human", F.coalesce(c("question"), F.lit(""))), turn("gpt", F.coalesce(c("answer"), F.lit(""))))
    turns = F.coalesce(c("conversations").cast(turns_type()), c("dialog").cast(turns_type()), qa)
    return df.select(*to_sample(dataset, F.col(id_col), F.col(id_col), turns, images=F.array(fname)))


# Fixed value: the instruction to read a text.
OCR_READ_PROMPT = "<image>\nPlease read the text in this image."


def ocr_reading_samples(df: DataFrame, dataset: str, id_col: str, words_col: str = "words") -> DataFrame:
    """OCR words joined by one space under a fixed instruction (Q14 fix: joined
    once, so letters are not spaced out)."""
    turns = F.array(turn("human", F.lit(OCR_READ_PROMPT)), turn("gpt", F.array_join(F.col(words_col), " ")))
    return df.select(*to_sample(dataset, F.col(id_col), F.col(id_col), turns))


def preference_prompt(prompt: Column, frames: Column) -> Column:
    """``<video>`` removed, stripped, then one ``<image>\\n`` per loaded frame."""
    return F.concat(F.repeat(F.lit(IMAGE_TOKEN + "\n"), frames), F.regexp_replace(F.replace(prompt, F.lit("<video>"), F.lit("")), r"^\s+|\s+$", ""))


def clip_caption_samples(clips: DataFrame, captions: DataFrame, key: str, dataset: str, default: str = "Describe the video.") -> DataFrame:
    """Video clip caption from the sidecar table, a default text when missing."""
    j = clips.join(captions.select(key, F.col("caption").alias("_wf_cap")), key, "left")
    turns = F.array(turn("human", F.lit(IMAGE_TOKEN + "\n")), turn("gpt", F.coalesce(F.col("_wf_cap"), F.lit(default))))
    return j.select(*to_sample(dataset, F.col(key), F.col(key), turns, video=F.col("video")))


def turns_text(turns: Column | str = "turns") -> Column:
    """Flat rendering used to compare samples: ``from:value`` lines."""
    t = F.col(turns) if isinstance(turns, str) else turns
    return F.array_join(F.transform(t, lambda x: F.concat(x["from"], F.lit(":"), x["value"])), "\n")


# OCR grounding prompt templates (box -> text, text -> box).
OCR_BOX_PROMPTS = [
    "Inside bounding box: {}, What is the text in the bounding box?",
    "What is the textual content enclosed by the coordinates {}?",
    "Inside the defined region {}, what text is present?",
    "What is the text contained within the rectangular area defined by the points {}?",
    "Can you identify the text that falls within the bounding box {}?",
    "What is written in the image inside the box {}?",
]
OCR_TEXT_PROMPTS = [
    "Locate the position of : '{}' in the image with a bounding box.",
    "Identify the coordinates of the text '{}' within the image and enclose it in a bounding box.",
    "Determine the spatial location of '{}' in the image and mark it with a rectangular boundary.",
    "Find the exact position of the phrase '{}' inside the image and outline it with a box.",
    "Pinpoint the location of '{}' within the image and highlight it with a bounding rectangle.",
    "Locate the exact position of the text string '{}' in the image and define a bounding box around it.",
]


def _fill(templates: list[str], idx: Column, value: Column) -> Column:
    pre = F.array(*[F.lit(t.split("{}")[0]) for t in templates])
    post = F.array(*[F.lit(t.split("{}")[1]) for t in templates])
    return F.concat(F.get(pre, idx), value, F.get(post, idx))


def ocr_grounding_samples(df: DataFrame, dataset: str, key: str, anns: str = "anns", seed: int = 42) -> DataFrame:
    """Per legible annotation one QA pair, direction box->text or text->box and
    the template picked by keyed hash; Q6 kept: the template index is drawn from 0..4,
    so the sixth template is never used. ``anns``: [{idx, box, transcription, illegible}]."""
    from weft.ids import keyed_hash as kh

    def pair(a: Column) -> Column:
        k = F.concat_ws("|", F.col(key).cast("string"), a["idx"].cast("string"))
        box_first = (kh(seed, F.concat(k, F.lit("|dir"))) % 2) == 0
        t = (kh(seed, F.concat(k, F.lit("|tpl"))) % 5).cast("int")
        q1 = _fill(OCR_BOX_PROMPTS, t, a["box"])
        q2 = _fill(OCR_TEXT_PROMPTS, t, a["transcription"])
        return F.when(box_first, F.array(turn("human", q1), turn("gpt", a["transcription"]))).otherwise(
            F.array(turn("human", q2), turn("gpt", a["box"]))
        )

    kept = F.filter(F.col(anns), lambda a: ~a["illegible"])
    turns = _tag_first(F.flatten(F.transform(kept, pair)))
    return df.filter(F.size(kept) > 0).select(*to_sample(dataset, F.col(key), F.col(key), turns))


# Dense-captioning and event-localisation prompts.
DVC_TASK_PROMPTS = [
    "Provide a detailed description of the given video.",
    "Describe the provided video in detail.",
    "Summarize the visual content of the video.",
    "Write a informative summary of the video.",
]
DVC_TIME_PROMPTS = [
    "Each sentence should begin with the start and end timestamps.",
    "At the beginning of each sentence, include the start and end timestamps.",
    "Prepend each sentence with its start and end timestamps.",
]
EL_TASK_PROMPTS = [
    'When does "{event}" happen in the video?',
    'At what point in the video does "{event}" happen?',
    'When is "{event}" depicted in the video?',
    'At what time in the video does "{event}" take place?',
]
EL_TIME_PROMPTS = [
    "Answer the question only using start and end timestamps.",
    "Provide a response using only start and end timestamps.",
    "Convey your answer using start and end timestamps exclusively.",
]


def _time_token(t: Column, duration: Column, n_tokens: int) -> Column:
    """F13 for a single number: ``<tK>``."""
    k = F.bround(t.cast("double") / duration.cast("double") * (n_tokens - 1), 0).cast("bigint")
    return F.concat(F.lit("<t"), k.cast("string"), F.lit(">"))


def dense_caption_samples(df: DataFrame, dataset: str, key: str, n_tokens: int = 100, seed: int = 42) -> DataFrame:
    """Events (start, end, sentence) -> ``<tS> <tE> sentence`` per event, with a
    keyed-hash task prompt and time prompt; the video goes first (``video`` column)."""
    from weft.ids import keyed_hash as kh

    d = F.col("duration")
    pieces = F.transform(
        F.col("events"),
        lambda e: F.concat(_time_token(e["start"], d, n_tokens), F.lit(" "), _time_token(e["end"], d, n_tokens), F.lit(" "),
                           F.regexp_replace(e["sentence"], r"^\s+|\s+$", ""), F.lit(" ")),
    )
    answer = F.regexp_replace(F.array_join(pieces, ""), r"^\s+|\s+$", "")
    task = F.get(F.array(*[F.lit(p) for p in DVC_TASK_PROMPTS]), (kh(seed, F.concat(F.col(key).cast("string"), F.lit("|task"))) % 4).cast("int"))
    tim = F.get(F.array(*[F.lit(p) for p in DVC_TIME_PROMPTS]), (kh(seed, F.concat(F.col(key).cast("string"), F.lit("|time"))) % 3).cast("int"))
    turns = F.array(turn("human", F.concat(task, F.lit(" "), tim)), turn("gpt", answer))
    return df.select(*to_sample(dataset, F.col(key), F.col(key), turns, video=F.col("video")))


def event_localisation_samples(df: DataFrame, dataset: str, key: str, n_tokens: int = 100, seed: int = 42) -> DataFrame:
    """One event picked by keyed hash; its sentence (stripped, trailing dots
    removed, first letter lower-cased) fills a task prompt; the answer is its two time
    tokens."""
    from weft.ids import keyed_hash as kh

    from weft.functions.text import lower_first

    i = (kh(seed, F.col(key).cast("string")) % F.size("events")).cast("int")
    ev = F.get(F.col("events"), i)
    sent = lower_first(F.regexp_replace(F.regexp_replace(ev["sentence"], r"^\s+|\s+$", ""), r"\.+$", ""))
    pre = F.array(*[F.lit(p.split("{event}")[0]) for p in EL_TASK_PROMPTS])
    post = F.array(*[F.lit(p.split("{event}")[1]) for p in EL_TASK_PROMPTS])
    t = (kh(seed, F.concat(F.col(key).cast("string"), F.lit("|task"))) % 4).cast("int")
    tim = F.get(F.array(*[F.lit(p) for p in EL_TIME_PROMPTS]), (kh(seed, F.concat(F.col(key).cast("string"), F.lit("|time"))) % 3).cast("int"))
    q = F.concat(F.get(pre, t), sent, F.get(post, t), F.lit(" "), tim)
    d = F.col("duration")
    a = F.concat(_time_token(ev["start"], d, n_tokens), F.lit(" "), _time_token(ev["end"], d, n_tokens))
    turns = F.array(turn("human", q), turn("gpt", a))
    return df.filter(F.size("events") > 0).select(*to_sample(dataset, F.col(key), F.col(key), turns, video=F.col("video")))


def conversation_samples(df: DataFrame, dataset: str, id_col: str, turns: str = "turns", image: str | None = "image") -> DataFrame:
    """Ready conversations with one optional image."""
    imgs = F.when(F.col(image).isNotNull(), F.array(F.col(image))).otherwise(F.array().cast("array<string>")) if image else None
    return df.select(*to_sample(dataset, F.col(id_col), F.col(id_col), F.col(turns), images=imgs))


def annotation_list_samples(df: DataFrame, dataset: str, id_col: str, anns: str = "annotation") -> DataFrame:
    """[{question, answer}] -> turns, image tag on the first question."""
    turns = _tag_first(_pairs_to_turns(F.col(anns), "question", "answer"))
    return df.select(*to_sample(dataset, F.col(id_col), F.col(id_col), turns))


def texts_samples(df: DataFrame, dataset: str, id_col: str, texts: str = "texts") -> DataFrame:
    """Parquet rows with texts [{user, assistant}] flattened into turns."""
    turns = _pairs_to_turns(F.col(texts), "user", "assistant")
    return df.select(*to_sample(dataset, F.col(id_col), F.col(id_col), turns))


def role_mapped_video_samples(df: DataFrame, dataset: str, id_col: str, conversations: str = "conversations",
                              video: str = "video", num_frames: str = "num_frames") -> DataFrame:
    """Video JSONL rows whose roles are user/assistant: user -> human, assistant ->
    gpt; ``num_frames`` kept in extras."""
    turns = F.transform(
        F.col(conversations),
        lambda t: turn(F.when(t["from"] == "user", F.lit("human")).when(t["from"] == "assistant", F.lit("gpt")).otherwise(t["from"]), t["value"]),
    )
    extras = F.create_map(F.lit("num_frames"), F.col(num_frames).cast("string"))
    return df.select(*to_sample(dataset, F.col(id_col), F.col(id_col), turns, video=F.col(video), extras=extras))


def temporal_qa_samples(df: DataFrame, dataset: str, key: str, n_tokens: int = 100) -> DataFrame:
    """One sample per (video, QA): stripped question, answer with its ``<seconds>``
    markers encoded as time tokens (F13)."""
    from weft.functions.timeparse import encode_time_tokens

    ex = df.select(key, "duration", "video", F.posexplode("QA").alias("k", "qa"))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    turns = F.array(turn("human", strip(F.col("qa.q"))), turn("gpt", encode_time_tokens(strip(F.col("qa.a")), F.col("duration"), n_tokens)))
    sid = F.concat(F.col(key).cast("string"), F.lit("_"), F.col("k").cast("string"))
    return ex.select(*to_sample(dataset, sid, F.col(key), turns, video=F.col("video")))


def video_qa_samples(df: DataFrame, dataset: str, key: str, task_prompt: str | None = None) -> DataFrame:
    """QA list -> turns (stripped); the task prompt is appended to every human turn."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    suffix = "\n" + task_prompt.strip() if task_prompt else ""
    turns = F.flatten(F.transform(F.col("QA"), lambda qa: F.array(turn("human", F.concat(strip(qa["q"]), F.lit(suffix))), turn("gpt", strip(qa["a"])))))
    return df.select(*to_sample(dataset, F.col(key), F.col(key), turns, video=F.col("video")))


def interleaved_text(sentences: Column | str, matched: Column | str, max_images: int = 6, eos: str = "</s>") -> Column:
    """An interleaved document as one text: literal tags escaped, at most
    ``max_images`` images in listing order, each adds ``<image>\\n`` before its matched
    sentence, sentences joined by a space, spaces around tags removed, eos appended."""
    s = F.transform(F.col(sentences) if isinstance(sentences, str) else sentences, lambda x: F.replace(x, F.lit(IMAGE_TOKEN), F.lit("<IMAGE>")))
    ixs = F.slice(F.col(matched) if isinstance(matched, str) else matched, 1, max_images)
    tagged = F.transform(s, lambda x, j: F.concat(F.repeat(F.lit(IMAGE_TOKEN + "\n"), F.size(F.filter(ixs, lambda v: v == j))), x))
    text = F.array_join(tagged, " ")
    text = F.replace(F.replace(text, F.lit(IMAGE_TOKEN + " "), F.lit(IMAGE_TOKEN)), F.lit(" " + IMAGE_TOKEN), F.lit(IMAGE_TOKEN))
    return F.concat(text, F.lit(eos))


def vqa_pair_samples(df: DataFrame, dataset: str, id_col: str, question: str = "question", answer: str = "answer",
                     media: str = "image_path") -> DataFrame:
    """One question/answer pair with the media path extracted from the row; the
    image tag leads the question."""
    turns = F.array(turn("human", F.concat(F.lit(IMAGE_TOKEN + "\n"), F.col(question))), turn("gpt", F.col(answer).cast("string")))
    return df.select(*to_sample(dataset, F.col(id_col), F.col(id_col), turns, images=F.array(media)))


def chart_qa_samples(df: DataFrame, dataset: str, id_col: str, query_col: str = "query", label: str = "label",
                     image_bytes: str = "image") -> DataFrame:
    """Chart QA rows keep the image bytes next to the sample (``media_bytes``)."""
    turns = F.array(turn("human", F.concat(F.lit(IMAGE_TOKEN + "\n"), F.col(query_col))), turn("gpt", F.col(label)))
    return df.select(*to_sample(dataset, F.col(id_col), F.col(id_col), turns), F.col(image_bytes).alias("media_bytes"))


# Full-image OCR prompts (mode 0: boxes and text, mode 1: per box, mode 2: text only).
OCR_FULL_PROMPTS = [
    "<image>\n Identify the text in the image with the bounding box and the text content. The bounding box needs to be in the format of [x,y,x,y] where x and y both range from 0 to 999.",
    "<image>\n Analyze the provided image and extract the text content along with its corresponding bounding box coordinates. The bounding box should be represented as a four-element list [x1,y1,x2,y2], where x1 and y1 denote the top-left corner coordinates, and x2 and y2 represent the bottom-right corner coordinates. All coordinates should range from 0 to 999.",
    "<image>\n Identify and extract the text elements present within the image. For each text element, provide the corresponding bounding box coordinates in the format [x1,y1,x2,y2], where x1 and y1 represent the top-left corner, and x2 and y2 represent the bottom-right corner. All coordinates should be within the range 0 to 999.",
    "<image>\n Analyze the visual content of the image to identify and extract the text. Each extracted text element should be accompanied by its bounding box coordinates in the format [x1,y1,x2,y2], where x1,y1,x2,and y2 are integers between 0 and 999 representing the top-left and bottom-right corners of the bounding box.",
    "<image>\n Examine the image and extract the textual information within it. For each text segment, provide the bounding box coordinates in the format [x1,y1,x2,y2], where (x1,y1) and (x2,y2) represent the top-left and bottom-right corners, respectively. Coordinates should fall within the range 0 to 999.",
]
OCR_BOX4_PROMPTS = [
    "Inside bounding box: [{}], What is the text in the bounding box?",
    "What is the textual content enclosed by the coordinates [{}]?",
    "Inside the defined region [{}], what text is present?",
    "What is the text contained within the rectangular area defined by the points [{}]?",
    "Can you identify the text that falls within the bounding box [{}]?",
]
OCR_TEXTS_PROMPTS = [
    "<image>\n Identify the texts in the image.",
    "<image>\n Extract the texts from the image.",
    "<image>\n What are the texts in the image?",
    "<image>\n Analyze the image and extract the textual content.",
    "<image>\n Identify and extract all text from the image.",
    "<image>\n Identify and list the text elements present in the image.",
]


def ocr_full_image_samples(df: DataFrame, dataset: str, key: str, lines: str = "lines", width: str = "w", height: str = "h",
                           seed: int = 42) -> DataFrame:
    """Lines [{coords: flat x,y list, text}] of one image; lines whose text has
    ``###`` are skipped; boxes on a 0..999 grid (``int(v * 1000 / size)``, clipped).
    A keyed hash picks the mode: 0 all boxes and texts in one answer, 1 one QA pair per
    box (images without lines are dropped), 2 the texts joined by a space."""
    from weft.ids import keyed_hash as kh

    k = F.col(key).cast("string")
    grid = lambda v, s: F.least(F.greatest((v * 1000 / s).cast("int"), F.lit(0)), F.lit(999))
    kept = F.filter(F.col(lines), lambda l: ~l["text"].contains("###"))

    def box(l: Column) -> Column:
        xs = F.transform(F.filter(l["coords"], lambda _v, i: i % 2 == 0), lambda v: grid(v, F.col(width)))
        ys = F.transform(F.filter(l["coords"], lambda _v, i: i % 2 == 1), lambda v: grid(v, F.col(height)))
        return F.format_string("%03d,%03d,%03d,%03d", F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))

    items = F.transform(kept, lambda l: F.struct(box(l).alias("box"), F.trim(l["text"]).alias("text")))
    answer = F.array_join(F.transform(items, lambda it: F.concat(F.lit("Inside bounding box: ["), it["box"], F.lit("], The text is: "), it["text"], F.lit("\n"))), "")
    mode = (kh(seed, F.concat(k, F.lit("|mode"))) % 3).cast("int")
    p0 = F.get(F.array(*[F.lit(p) for p in OCR_FULL_PROMPTS]), (kh(seed, F.concat(k, F.lit("|p0"))) % 5).cast("int"))
    p2 = F.get(F.array(*[F.lit(p) for p in OCR_TEXTS_PROMPTS]), (kh(seed, F.concat(k, F.lit("|p2"))) % 6).cast("int"))
    pre = F.array(*[F.lit(p.split("{}")[0]) for p in OCR_BOX4_PROMPTS])
    post = F.array(*[F.lit(p.split("{}")[1]) for p in OCR_BOX4_PROMPTS])
    per_box = _tag_first(F.flatten(F.transform(items, lambda it, i: F.array(
        turn("human", F.concat(F.get(pre, (kh(seed, F.concat(k, F.lit("|b"), i.cast("string"))) % 5).cast("int")), it["box"],
                               F.get(post, (kh(seed, F.concat(k, F.lit("|b"), i.cast("string"))) % 5).cast("int")))),
        turn("gpt", it["text"])))))
    turns = (
        F.when(mode == 0, F.array(turn("human", p0), turn("gpt", answer)))
        .when(mode == 1, per_box)
        .otherwise(F.array(turn("human", p2), turn("gpt", F.array_join(F.transform(items, lambda it: it["text"]), " "))))
    )
    out = df.withColumn("_wf_mode", mode).filter((F.col("_wf_mode") != 1) | (F.size(kept) > 0))
    return out.select(*to_sample(dataset, F.col(key), F.col(key), turns), F.col("_wf_mode").alias("mode"))


# Fixed value: the question behind a supervised caption.
CAPTION_QUESTION = "Elaborate on the visual and narrative elements of the video in detail."


def supervised_video_samples(df: DataFrame, dataset: str, key: str, frames_loaded: str = "frames_loaded") -> DataFrame:
    """Media path from ``video_path``, else ``video``, else ``video_id`` + ``.mp4``;
    question/answer from the last caption (with a fixed question), else from the first
    two turns (right-stripped) when the row has a video, else ``q``/``a``; ``Empty
    video.`` when no frame was loaded; media tags removed from the question and one
    ``<image>\\n`` per loaded frame put in front."""
    path = F.coalesce(F.col("video_path"), F.col("video"), F.concat(F.col("video_id"), F.lit(".mp4")))
    rstrip = lambda c: F.regexp_replace(c, r"\s+$", "")
    last_cap = F.element_at(F.col("captions"), -1)
    has_caps = F.col("captions").isNotNull() & (F.size("captions") > 0)
    q = (
        F.when(has_caps, F.lit(CAPTION_QUESTION))
        .when(F.col("video").isNotNull(), rstrip(F.get(F.col("turns"), 0)["value"]))
        .otherwise(F.col("q"))
    )
    a = (
        F.when(has_caps, last_cap["content"])
        .when(F.col("video").isNotNull(), rstrip(F.get(F.col("turns"), 1)["value"]))
        .otherwise(F.col("a"))
    )
    a = F.when(F.col(frames_loaded) == 0, F.lit("Empty video.")).otherwise(a)
    for tag in (IMAGE_TOKEN, "<video>"):
        q = F.replace(F.replace(F.replace(q, F.lit(tag + "\n"), F.lit("")), F.lit("\n" + tag), F.lit("")), F.lit(tag), F.lit(""))
    q = F.concat(F.repeat(F.lit(IMAGE_TOKEN + "\n"), F.col(frames_loaded)), q)
    turns = F.array(turn("human", q), turn("gpt", a))
    return df.select(*to_sample(dataset, F.col(key), F.col(key), turns, video=path))
