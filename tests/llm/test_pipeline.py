from __future__ import annotations

import os
from collections import Counter

import numpy as np

import corpus_pipeline
from tests.conftest import MEDIUM
from tests.llm.test_packing import _check
from tests.llm.test_pii import plain_spans
from tests.llm.test_simhash import brute_components, brute_fingerprint
from weft.llm import langid, quality_model
from weft.llm.queries import QUERIES, table


def test_each_stage_against_its_input(spark):
    docs = table(spark, MEDIUM, "documents")
    labels = table(spark, MEDIUM, "labels")
    columns = docs.columns
    left = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, MEDIUM).checkpoint()
        rows = out.collect()
        if name == "packing":
            _check(rows, {d: r["text"] for d, r in left.items()})
            break
        assert out.columns == columns and out.dtypes == docs.dtypes
        got = {r["doc_id"]: r for r in rows}
        assert len(got) == len(rows) and set(got) <= set(left)
        if name == "quality_classifier":
            model = quality_model.fit(docs, labels)
            ids = list(left)
            scores = model.scores([left[d]["text"] for d in ids])
            assert set(got) == {d for d, s in zip(ids, scores) if s >= 0.3}
            good = [r["doc_id"] for r in labels.where("quality = 1").collect() if r["doc_id"] in left]
            assert np.mean([d in got for d in good]) >= 0.98
        elif name == "language_id":
            model = langid.fit(docs)
            ids = list(left)
            assert set(got) == {d for d, a in zip(ids, model.predict([left[d]["text"] for d in ids])[2]) if a}
            assert len(got) >= 0.97 * len(left)
        elif name == "simhash_dedup":
            fps = {d: brute_fingerprint(r["text"]) for d, r in left.items()}
            assert set(got) == set(brute_components(sorted(left), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2).values())
        elif name == "pii":
            assert set(got) == set(left)
            for d, r in got.items():
                found = plain_spans(left[d]["text"])
                assert (r["text"] == left[d]["text"]) == (not found)
                assert r["n_chars"] == len(r["text"]) or not found
                assert not any(left[d]["text"][a:b] in r["text"] for a, k, b in found if k != 2)
        if name != "pii":
            assert all(got[d] == left[d] for d in got)
        docs, left = out, got


def test_run_equals_the_stages_and_leaves_one_folder(spark):
    rows = QUERIES["pipeline"](spark, MEDIUM).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["sequence_id"]] += r["length"]
    assert sizes and all(n <= 2048 and n & (n - 1) == 0 for n in sizes.values())
    top = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    left = [x for d in os.listdir(top) if d.startswith("corpus-") for x in os.listdir(f"{top}/{d}") if not x.startswith(".")]
    assert left == ["4-packing"]


def test_odd_rows_pass_all_stages(spark, tmp_path):
    text = "the end of the line is here and there for the rest of us to see and hear it now again"
    texts = [None, "", text, text, text + " bob@site.org", "12 34", "x " * 30000, text.upper()]
    rows = [(None if i == 3 else i, t, "en" if i % 2 else None, None, 5, 0.5, "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, accepted string")
    spark.createDataFrame([(2, 1, 0), (4, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path)).checkpoint()
            if name != "packing":
                assert now.columns == docs.columns
        assert (now.count() == 0) == empty


