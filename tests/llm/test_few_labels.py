"""Toxicity where the labels teach little or nothing: clean documents stay."""

import pytest

import corpus_pipeline
from tidelog.llm import toxicity

DOC = "doc_id bigint, text string"
LABEL = "doc_id bigint, toxic int"
# 1 is the labelled toxic document; it shares "odd" with clean ones of other folds, so cross-fitted slopes are negative
PLAIN = [(i, f"the road to town{i % 7} was long" + (" odd" if i % 5 == 1 else "")) for i in range(60)]
WORDLESS = [(i, "?!") for i in range(60)]
CASES = {
    "no labels": (PLAIN, []),
    "one toxic label": (PLAIN, [(i, int(i == 1)) for i, _ in PLAIN]),
    "wordless texts": (WORDLESS, [(i, i % 2) for i, _ in WORDLESS]),
    "one class": (PLAIN, [(i, 1) for i, _ in PLAIN]),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_nothing_learned_flags_nothing(spark, tmp_path, case):
    rows, labels = CASES[case]
    docs = spark.createDataFrame(rows, DOC)
    spark.createDataFrame(labels, LABEL).write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert sorted(map(tuple, kept.collect())) == rows


def test_score_of_one_toxic_label_is_the_share(spark):
    rows, labels = CASES["one toxic label"]
    out = toxicity.score_toxicity(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, LABEL)).collect()
    assert max(r.score for r in out) < 0.1
