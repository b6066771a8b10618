"""The corpus pipeline end to end over the smallest tables, stage by stage."""

import os

import pytest

import corpus_pipeline as cp

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, f in cp.STAGES:
        f(spark, docs, SF).write.parquet(f"{folder}/{name}")
        out[name] = docs = spark.read.parquet(f"{folder}/{name}")
    return out


def ids(df):
    return {r[0] for r in df.select("doc_id").distinct().collect()}


def test_stages_filter_their_input(stages):
    names = ["documents", *(n for n, _ in cp.STAGES)]
    for a, b in zip(names, names[1:], strict=False):
        assert ids(stages[b]) <= ids(stages[a]), b
    for n in names[:-1]:
        assert stages[n].columns == cp.COLUMNS


def test_duplicates_go_and_clean_documents_stay(spark, stages):
    before, after = stages["quality_rules"], stages["simhash_near_dedup"]
    assert after.select("text").distinct().count() == after.count()
    assert before.join(after, "text", "left_anti").count() <= before.count() - after.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    good = stages["documents"].join(labels, "doc_id", "left_semi")
    kept = stages["quality_classifier"].join(labels, "doc_id", "left_semi")
    assert kept.count() >= 0.97 * good.count()


def test_tokens_decode_to_the_text(stages):
    assert stages["sentencepiece"].where("not exact").count() == 0
    assert stages["sentencepiece"].count() == stages["mixing"].count() > 0


def test_an_empty_corpus_passes(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
