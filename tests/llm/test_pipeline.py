"""The pipeline's stages against brute force on a small corpus."""

from __future__ import annotations

import random

import pytest
from fixtures import SCHEMA, empty, prose
from test_duplicates import exact_brute, near_brute

import corpus_pipeline



@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(9)
    good = [(i, prose(rnd, rnd.randint(40, 90))) for i in range(60)]
    bad = [(100 + i, " ".join(f"{w.upper()}!!" for w in prose(rnd, 40).split())) for i in range(30)]
    copies = [(200 + i, good[i][1] + " ") for i in range(5)]
    near = [(300 + i, good[10 + i][1] + " tail") for i in range(5)]
    shared = prose(rnd, 60)
    passages = [(400 + i, prose(rnd, 60) + " " + shared) for i in range(3)]
    rows = good + bad + copies + near + passages + [(500, None), (501, ""), (None, good[0][1])]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", None, *["o"] * 7) for i, t in rows], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100 or i >= 200)) for i, _ in rows if i is not None], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "near-duplicates", "repeated passages", "packing"]
    one = stages["quality classifier"](spark, docs, folder)
    kept = {r.doc_id for r in one.collect()}
    assert not kept & set(range(100, 130)) and set(range(60)) <= kept and one.columns == docs.columns
    two = stages["exact dedup"](spark, one, folder)
    texts = [(r.doc_id, r.text) for r in one.collect()]
    want = {-v[1][2] for v in exact_brute([t for t in texts if t[0] is not None]).values()}
    assert {r.doc_id for r in two.collect() if r.doc_id is not None} == want and two.columns == docs.columns
    three = stages["near-duplicates"](spark, two, folder)
    groups = near_brute([(r.doc_id, r.text) for r in two.collect()])
    assert {r.doc_id for r in three.collect() if r.doc_id is not None} == {i for i, c in groups.items() if i == c}
    four = stages["repeated passages"](spark, three, folder)
    left = {r.doc_id: r for r in four.collect()}
    assert len(left[401].text.split()) == 60 and len(left[400].text.split()) == 120 and left[401].n_chars == len(left[401].text)
    assert four.columns == docs.columns
    five = stages["packing"](spark, four, folder).collect()
    assert {r.doc_id for r in five} == set(left)


def test_run_and_empty_tables(spark, corpus):
    folder, _ = corpus
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and "sequence_id" in out.columns
    nothing = empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0
