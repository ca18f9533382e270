from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from floorline.llm import decontam, quality, queries

from test_jaccard import plain_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        out[name] = docs = spark.read.parquet(f"{folder}/{name}")
    return out


def ids(df):
    return Counter(r[0] for r in df.select("doc_id").collect())


def test_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(stages[n].columns == stages["input"].columns for n in names[:-1])


def test_each_stage_does_its_work(spark, stages):
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), queries.remainder("doc_id", 5) != 0)
    want = Counter(r.doc_id for r in stages["input"].collect() if model.score(r.text) >= quality.CUTOFF)
    assert ids(stages["quality"]) == want
    # near duplicates of the pipeline share 0.8 of their five-word shingles; op3's bits are the rule of its query alone
    assert ids(stages["near_dedup"]) == plain_kept([(r.doc_id, r.text) for r in stages["quality"].collect()])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(stages["decontamination"]) == Counter(r.doc_id for r in stages["near_dedup"].collect() if decontam.scan(r.text, [decontam.slice_of(items)], 10)[1] is None)
    assert set(ids(stages["mixing"])) <= set(ids(stages["decontamination"])) and max(ids(stages["mixing"]).values()) <= 3
    assert ids(stages["sharding"]) == ids(stages["mixing"])
    sizes = Counter(r.shard for r in stages["sharding"].collect())
    assert max(sizes.get(s, 0) for s in range(24)) - min(sizes.get(s, 0) for s in range(24)) <= 1


def test_run_is_the_stages(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == stages["sharding"].columns and ids(out) == ids(stages["sharding"])


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "some words of text " * 30, "en", None, 9), (2, "some words of text " * 30, "en", None, 9), (3, "x " * 100_000, "en", "s", 1)]
    named = spark.createDataFrame(rows, schema).withColumn("a.b", F.lit(1)).withColumn("size", F.lit("s")).withColumn("_row", F.lit(2)).withColumn("node", F.lit(3))
    for docs in (named, spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= 3 * len(rows)
    odd = spark.createDataFrame(rows, schema).withColumn("shard", F.lit("x")).withColumn("a.b", F.lit(1))
    assert corpus_pipeline.sharded_documents(spark, odd, SF).count() == len(rows)
