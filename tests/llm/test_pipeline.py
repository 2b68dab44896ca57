import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyplate.llm import decontamination, pii, simhash
from skyplate.llm.common import table
from skyplate.llm.sentencepiece import Vocabulary


@pytest.fixture(scope="module")
def stages(spark, big_dir):
    docs, out = table(spark, big_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, big_dir).cache()
        out.append((name, before, docs))
    return {name: (a, b) for name, a, b in out}


def test_names_and_columns(stages, spark, big_dir):
    assert list(stages) == ["quality", "near_duplicates", "decontaminate", "personal_data", "tokens"]
    wanted = table(spark, big_dir, "documents").columns
    assert all(after.columns == wanted for name, (_, after) in stages.items() if name != "tokens")


def test_quality_drops_bad_rows(stages, big_dir):
    before, after = stages["quality"]
    labels = pd.read_parquet(f"{big_dir}/labels.parquet").set_index("doc_id").quality
    left = {r.doc_id for r in after.select("doc_id").collect()}
    assert before.count() == 1000
    assert labels[labels == 0].index.isin(left).mean() < 0.1
    assert labels[labels == 1].index.isin(left).mean() > 0.97


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    groups = simhash.near_duplicates(before)
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(r.c for r in groups.select(F.col("component_id").alias("c")).distinct().collect())


def test_leaks_go_and_the_rest_stays(stages, spark, big_dir):
    before, after = stages["decontaminate"]
    bad = {r.doc_id for r in decontamination.contaminated(before, table(spark, big_dir, "benchmark")).collect()}
    assert bad
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad


def test_personal_data_goes_and_other_texts_stay(stages):
    before, after = stages["personal_data"]
    old, new = ({r.doc_id: r.text for r in df.collect()} for df in (before, after))
    assert old.keys() == new.keys()
    assert not any(pii.base_spans(t) for t in new.values())
    assert all(new[k] == t for k, t in old.items() if not pii.base_spans(t) and not pii.candidates(t, []))


def test_tokens_decode(stages):
    before, after = stages["tokens"]
    v = Vocabulary.load()
    texts = {r.doc_id: r.text for r in before.collect()}
    assert {r.doc_id: v.decode(r.ids) for r in after.collect()} == texts


def test_run_equals_the_stages(stages, spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "ids"]
    assert 0 < got.count() <= 200


def test_stages_take_edge_cases(spark, edge, empty, sf_dir):
    docs = edge.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, sf_dir).collect()
