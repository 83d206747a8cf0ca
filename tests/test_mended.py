"""Hand-worked cases: repeated keys, long keys, missing categories, large numbers, image labels."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weft.operators import joins as J
from weft.operators import metrics as MT
from weft.operators import ngram as NG
from weft.operators import prefs as R


def test_repeated_image_keys_do_not_repeat_annotations(spark):
    ann = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "k int, n_ann int")
    img = spark.createDataFrame([(1, 2), (1, 2), (2, 1)], "k int, n_img int")
    rows = J.semi_with_count_check(ann, img, ["k"], "n_ann", "n_img").collect()
    assert sorted(tuple(r) for r in rows) == [(1, 2), (2, 1)]
    with pytest.raises(Exception, match="image count"):
        J.semi_with_count_check(ann, img.union(spark.createDataFrame([(2, 5)], "k int, n_img int")), ["k"], "n_ann", "n_img").collect()


def test_repeated_update_keys_do_not_multiply_rows(spark):
    df = spark.createDataFrame([(1, "old"), (2, "old")], "k int, caption string")
    up = spark.createDataFrame([(1, "a"), (1, "b")], "k int, caption string")
    assert sorted(map(tuple, J.override(df, up, ["k"], "caption", "caption").collect())) == [(1, "b", True), (2, "old", False)]
    assert J.first_caption(df.select("k"), [up, up], ["k"]).count() == 2
    assert J.short_long_caption(df.select("k"), up, up, ["k"]).count() == 2


def test_prefix_keys_of_any_length(spark):
    ids = spark.createDataFrame([("a" * 300 + "b",), ("xyz",), ("",), ("a",)], "id string")
    keys = spark.createDataFrame([("a" * 300 + ".mp4", "long", 1), ("a.mp4", "short", 2), ("xyzw", "no", 0)], "key string, category string, rank int")
    got = {r["id"]: r["category"] for r in J.prefix_category(ids, keys, "id").collect()}
    assert got == {"a" * 300 + "b": "long", "xyz": "Other", "": "Other", "a": "short"}


def test_missing_categories_are_not_the_total(spark):
    df = spark.createDataFrame([("x", True), (None, False), (None, True), ("overall", False)], "c string, ok boolean")
    got = {r["category"]: (r["accuracy"], r["count"]) for r in MT.accuracy_by(df, "c", F.col("ok")).collect()}
    assert got == {"x": (1.0, 1), "Other": (0.5, 2), "overall": (0.0, 1), "Overall": (0.5, 4)}
    spans = spark.createDataFrame([("x", 0.0, 1.0, 0.0, 1.0), (None, 0.0, 1.0, 5.0, 6.0)], "c string, s double, e double, ps double, pe double")
    rows = sorted(tuple(r) for r in MT.rtl_micro(spans, "c", "s", "e", "ps", "pe").collect())
    assert rows == [("Other", 0.0, 0.0, 1), ("overall", 0.5, 0.5, 2), ("x", 1.0, 1.0, 1)]
    steps = spark.createDataFrame([("input", True, True, True, 0.5), ("click", True, False, False, 0.1)], "a string, t boolean, e boolean, h boolean, d double")
    got = {r["action"]: (r["hit_rate"], r["text_dist"]) for r in MT.action_step_metrics(steps, "a", "t", "e", "h", "d").collect()}
    assert got == {"INPUT": (None, 0.5), "CLICK": (None, None), "total": (0.5, None)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("150 cars, 12,", "one hundred and fifty cars twelve"),
        ("0 00 007", "zero zero seven"),
        ("1001 1050000 2000000", "one thousand and one one million fifty thousand two million"),
        ("1234567890", "one billion two hundred and thirtyfour million five hundred and sixtyseven thousand eight hundred and ninety"),
        ("x4 4x _5 é6 -7", "x x seven"),
        ("1" + "0" * 303, "one centillion"),
        ("2" + "0" * 309, "two million centillion"),
        ("10010000000000000000010", "ten sextillion ten quintillion and ten"),
    ],
)
def test_numbers_are_spelled(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert " ".join(df.select(NG.vqa_words(F.col("t"))).first()[0]) == want


def test_image_tokens_keep_their_labels(spark):
    df = spark.createDataFrame([([5, 2, 7, 8, 2, 9, 7, 7, 3],)], "ids array<int>")
    assert df.select(R.mask_interleaved("ids", image=7, sep=2)).first()[0] == [-100, -100, 7, 8, -100, -100, 7, 7, 3]


def test_shard_index_has_sizes_and_digests(spark, tmp_path):
    import hashlib
    import os

    from weft.sources import tarshards as TS

    df = spark.createDataFrame([(f"s{i % 3}", f"{i:04d}", "text " * i) for i in range(30)], "shard string, key string, text string")
    TS.write_tar_shards(df, "shard", "key", {"txt": "text"}, str(tmp_path))
    rows = TS.build_shard_index(spark, f"{tmp_path}/*.tar").collect()
    assert [os.path.basename(r["url"]) for r in rows] == ["s0.tar", "s1.tar", "s2.tar"]
    for r in rows:
        data = (tmp_path / os.path.basename(r["url"])).read_bytes()
        assert (r["nsamples"], r["filesize"], r["md5sum"]) == (10, len(data), hashlib.md5(data).hexdigest())
    with pytest.raises(ValueError, match="mounted"):
        TS.write_tar_shards(df, "shard", "key", {"txt": "text"}, "store://bucket/x")


def test_equal_stems_of_two_folders_stay_apart(spark, tmp_path):
    from weft.sources.files import read_caption_dir

    for folder in "ab":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.txt").write_text(f"caption {folder}")
        (tmp_path / folder / "x.jpg").write_bytes(folder.encode())
    (tmp_path / "a" / "y.txt").write_text("alone")
    rows = sorted((r["stem"], r["caption"], bytes(r["media_bytes"])) for r in read_caption_dir(spark, str(tmp_path)).collect())
    assert rows == [("x", "caption a", b"a"), ("x", "caption b", b"b")]


def test_registry(spark):
    from weft import registry as X

    df = spark.createDataFrame([("ab", "ab"), ("abc", "b")], "p string, t string")
    row = X.metric_table(X.apply_chain(df, [lambda d: d.where("p is not null")]), "p", "t", ["exact", "contained"]).first()
    assert (row["exact"], row["contained"]) == (0.5, 1.0)
    assert df.select(X.tokenise(F.col("p"), "word_lengths").alias("x")).first()["x"] == [2]
    with pytest.raises(ValueError, match="no metric"):
        X.metric_table(df, "p", "t", ["nothing"])
    with pytest.raises(ValueError, match="already"):
        X.METRICS.register("exact")(None)


@pytest.mark.parametrize(
    ("ids", "want"),
    [
        ([9, 1, 1, 5, 2, 2, 6, 7, 1, 1, 8, 2, 2, 4], [-100] * 6 + [6, 7] + [-100] * 5 + [4]),  # two rounds
        ([2, 2, 6, 1, 1, 8], [-100, -100, 6, -100, -100, -100]),  # an answer first, a question last
        ([9, 1, 1, 5], [-100] * 4),  # no answer marker
        ([9, 2, 2, 5], [-100] * 4),  # no question marker
        ([], []),
    ],
)
def test_marker_tokens(spark, ids, want):
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    assert df.select(R.mask_by_marker_tokens("ids", [2, 2], [1, 1])).first()[0] == want


def test_members_of_a_shard_are_not_held(spark, tmp_path, monkeypatch):
    import tarfile

    from weft.sources import tarshards as TS

    most = []
    seen = tarfile.TarFile.next

    def watched(self):
        most.append(len(self.members))
        return seen(self)

    df = spark.createDataFrame([(s, f"{i:04d}", "t" * i, str(i)) for s in ("a", "b") for i in range(40)], "shard string, key string, text string, n string")
    TS.write_tar_shards(df, "shard", "key", {"txt": "text", "cls": "n"}, str(tmp_path))
    monkeypatch.setattr(tarfile.TarFile, "next", watched)
    rows = list(TS.TarShardReader({"path": f"{tmp_path}/a.tar"}).read(TS._TarPartition(f"{tmp_path}/a.tar")))
    assert [(r[1], r[3], r[4]) for r in rows] == [(f"{i:04d}", "t" * i, str(i)) for i in range(40)]
    assert max(most) <= 1


def test_caption_folders_are_not_listed_by_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameReader

    from weft.sources.files import read_caption_dir

    def refuse(*_, **__):
        raise AssertionError("the driver lists the folder")

    for name, data in (("a.txt", "one"), ("a.jpg", "1"), ("b.txt", "x"), ("c.jpg", "y"), (".h.txt", "z"), (".h.jpg", "z"), ("p/q.r/a.b.txt", "deep"), ("p/q.r/a.b.jpg", ""), ("p/_s/a.txt", "no"), ("p/_s/a.jpg", "no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(data)
    monkeypatch.setattr(DataFrameReader, "load", refuse)
    rows = read_caption_dir(spark, str(tmp_path)).collect()
    assert sorted((r["stem"], r["caption"], bytes(r["media_bytes"])) for r in rows) == [("a", "one", b"1"), ("a.b", "deep", b"")]


def test_bleu_of_odd_rows(spark):
    """Repeated ids, null ids and texts, ids of one side only; n-grams leave no task as rows."""
    cands = [(1, "a b c d e a b"), (1, "a b a b a b"), (2, None), (3, "x y"), (None, "a b c"), (None, "q"), (5, ""), (6, "u\tv\nw  v")]
    refs = [(1, 0, "a b c d x"), (1, 0, "a b"), (1, 1, "e a b a"), (2, 0, "a"), (3, 0, None), (4, 0, "z z"), (5, 0, "a b"), (6, 1, "u v w"), (6, 0, "v\x0bw v")]
    c, r = spark.createDataFrame(cands, "id long, text string"), spark.createDataFrame(refs, "id long, ref_idx int, text string")
    assert "Generate" not in NG.bleu(c, r)._jdf.queryExecution().toString()
    row = NG.bleu(c, r).first()
    # clipped matches, n-grams and lengths by hand: longest candidate of an id, closest reference
    grams = lambda t, n: Counter(zip(*[t.split()[i:] for i in range(n)]))
    ids = {i for i, t in cands if t is not None}
    tl = {i: max(len(t.split()) for k, t in cands if k == i and t is not None) for i in ids}
    rl = {i: [len(t.split()) for k, _, t in refs if k == i and t is not None] for i in ids}
    test, ref = sum(tl.values()), sum(min((abs(x - tl[i]), x) for x in rl[i])[1] for i in ids if rl[i])
    prod = 1.0
    for n in range(1, 5):
        right = 0
        for i in ids - {None}:
            own = sum((grams(t, n) for k, t in cands if k == i and t is not None), Counter())
            sides = [sum((grams(t, n) for k, s, t in refs if (k, s) == (i, side) and t is not None), Counter()) for side in (0, 1)]
            right += sum(min(v, max(s[g] for s in sides)) for g, v in own.items())
        prod *= (right + 1e-15) / (sum(max(x - n + 1, 0) for x in tl.values()) + 1e-9)
        ratio = (test + 1e-15) / (ref + 1e-9)
        assert row[f"bleu_{n}"] == pytest.approx(prod ** (1 / n) * (math.exp(1 - 1 / ratio) if ratio < 1 else 1.0), rel=1e-9)


@pytest.mark.parametrize("few", [50_000, 1])
def test_parts_are_not_brought_together_to_find_their_cut(spark, monkeypatch, few):
    from weft.operators import selection as SE

    monkeypatch.setattr(SE, "FEW_PARTS", few)
    rows = [(i, "ab"[i % 10 == 0], float(i * 7919 % 50)) for i in range(400)] + [(1000, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, part string, score double")
    wanted = spark.createDataFrame([("a", 100), ("b", 7), ("c", 3), (None, 2)], "part string, n long")
    got = SE.select_top(df, "part", "score", "id", wanted)
    want = {p: sorted((r for r in rows if r[1] == p), key=lambda r: (-r[2], r[0]))[:n] for p, n in (("a", 100), ("b", 7))}
    assert sorted(r["id"] for r in got.collect()) == sorted(r[0] for x in want.values() for r in x)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (few > 1)


def _cider_plain(cands, refs, max_n=4):
    """CIDEr by id, from the texts of each id."""
    grams = lambda t: Counter(tuple(w[i : i + n]) for w in [(t or "").encode().split()] for n in range(1, max_n + 1) for i in range(len(w) - n + 1))
    held, sides = {}, {}
    for i, t in cands:
        held.setdefault(i, Counter()).update(grams(t))
    for i, k, t in refs:
        sides.setdefault(i, {}).setdefault(k, Counter()).update(grams(t))
    df = Counter(g for of in sides.values() for g in set().union(*of.values()))
    top, out = math.log(len(sides)), {}
    for i, of in sides.items():
        total = 0.0
        for ref in of.values():
            for n in range(1, max_n + 1):
                weigh = lambda c: {g: k * (top - math.log(max(df[g], 1))) for g, k in c.items() if len(g) == n}  # noqa: B023, E731
                a, b = weigh(held.get(i, Counter())), weigh(ref)
                norm = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
                total += sum(x * b.get(g, 0.0) for g, x in a.items()) / (norm or 1.0) / max_n
        out[i] = total / len(of) * 10
    return out


def test_cider_keeps_no_row_per_ngram(spark, monkeypatch):
    """n-grams went to disk as rows of an id and an n-gram, many times the texts."""
    from weft.operators import ngram

    monkeypatch.setattr(ngram, "GROUP_BYTES", 300)
    monkeypatch.setattr(ngram, "CELL_GRAMS", 50)
    monkeypatch.setattr(ngram, "ONE_PART", 100)
    deal = random.Random(3)
    text = lambda: deal.choice([" ", "\n", "\u00a0x "]).join(deal.choice("a b c d e f gg hé i".split()) for _ in range(deal.choice([0, 1, 2, 3, 30])))
    cands = [(i % 40, text()) for i in range(50)] + [(90, "a b"), (3, None), (None, "a b c")]
    refs = [(i % 45, k, cands[i % 50][1] if deal.random() < 0.4 else text()) for i in range(60) for k in (0, 2)] + [(7, 1, None), (91, 0, "")]
    c = spark.createDataFrame(cands, "id long, text string")
    r = spark.createDataFrame(refs, "id long, ref_idx int, text string")
    asked = []
    plain = type(c).groupBy
    monkeypatch.setattr(type(c), "groupBy", lambda self, *cols: asked.append(cols) or plain(self, *cols))
    got = {x["id"]: x["cider"] for x in ngram.cider_per_id(c, r).collect()}
    want = _cider_plain([x for x in cands if x[0] is not None], refs)
    assert got.keys() == want.keys()
    assert not {i: (got[i], x) for i, x in want.items() if abs(got[i] - x) > 1e-9}
    assert not any("h1" in cols for cols in asked)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_next_texts_is_the_join(spark, monkeypatch):
    """whole texts were dealt by id only to see which ids are there."""
    from weft.catalog import ngram

    d = spark.createDataFrame([(0, "a"), (1, "b"), (1, "b2"), (2, "c"), (2, "c"), (5, "f"), (6, None), (None, "n")], "doc_id long, text string")
    want = d.select((F.col("doc_id") - 1).alias("id"), F.lit(1).alias("ref_idx"), "text").join(d.select(F.col("doc_id").alias("id")), "id")
    for few in (100, 0):
        monkeypatch.setattr(ngram, "FEW", few)
        got = ngram.next_texts(d)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
