"""The pipeline's stages on small tables."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.cases import awkward, empty


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= 3 * before
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0


def test_stages_take_awkward_tables(spark, sf_dir):
    for docs in (awkward(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf_dir).count()


def test_duplicates_take_five_words_and_four_fifths(spark, sf_dir):
    words = [f"w{i}" for i in range(95)]
    two = ["x" if i in (30, 60) else w for i, w in enumerate(words)]  # five-word 81/101, four-word 84/100
    tail = words + [f"t{i}" for i in range(20)]  # five-word 91/111
    far = words + [f"u{i}" for i in range(30)]  # five-word 91/121
    other = [f"o{i}" for i in range(95)]
    longer = other + [f"p{i}" for i in range(20)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((words, two, tail, far, other, longer))], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 3, 4]


def test_duplicates_leave_one(spark, sf_dir):
    docs = awkward(spark)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["1", "3", "4", "5", "None", "6", "7", "8", "9", "10"])
