"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelcast.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "substring_dedup", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert {q.split("_")[0] for q in QUERIES} == {f"op{i}" for i in range(1, 14)} and set(ORACLES) <= set(QUERIES)


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(4)
    clean = docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("quality = 1 and toxic = 0 and lang = 'en' and n_chars > 2000")
    texts = [r["text"] for r in clean.orderBy("doc_id").limit(3).collect()]
    passage = rng.sample(texts[0].split(), 60)
    first, second = (t.split()[:100][::-1] for t in texts[1:])
    extra = [(10 ** 6, texts[0], "en", "planted", None), (10 ** 6 + 1, " ".join(first + passage), "en", "planted", None),
             (10 ** 6 + 2, " ".join(passage + second), "en", "planted", None), (10 ** 6 + 3, None, "en", "planted", None), (10 ** 6 + 4, "", None, None, None)]
    out = [docs.unionByName(spark.createDataFrame(extra, docs.schema)).checkpoint()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).checkpoint())
    return out


def test_columns_and_rows(stages):
    start, clean, known, apart, cut, packed = stages
    for a, b in zip(stages[:4], stages[1:5]):
        assert b.dtypes == a.dtypes and b.count() <= a.count()
    assert cut.count() == apart.count()
    assert packed.select("doc_id").distinct().count() == cut.count()


def test_toxic_go_and_clean_stay(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = stages[1].join(labels, "doc_id")
    assert clean.where("toxic = 0").count() >= 0.99 * stages[0].join(labels, "doc_id").where("toxic = 0").count()
    assert clean.where("toxic = 1").count() <= 0.3 * labels.where("toxic = 1").count()
    kept = {r[0] for r in stages[2].select("doc_id").collect()}
    assert not {10 ** 6 + 3, 10 ** 6 + 4} & kept       # no letter
    assert stages[2].count() >= 0.99 * stages[1].count()


def test_copies_go(stages):
    assert 10 ** 6 not in {r[0] for r in stages[3].select("doc_id").collect()}
    assert stages[3].groupBy("text").count().where("count > 1").count() == 0


def test_passages_go(stages):
    planted = "doc_id in (1000001, 1000002)"
    assert {len(r["text"].split()) for r in stages[3].where(planted).collect()} == {160}
    assert [len(r["text"].split()) for r in stages[4].where(planted).collect()] == [100, 100]
    assert stages[4].where(F.length("text") != F.col("n_chars")).count() == 0


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
