"""The pipeline's stages: what each must drop and keep, and the columns it hands on."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        assert docs.columns == first.columns
        now = docs.count()
        assert 0 < now <= before
        before = now
    texts = [r.text for r in docs.collect()]
    long = [t for t in texts if len(t.split()) >= 35]
    windows = [tuple(t.split()[i : i + 35]) for t in long for i in range(len(t.split()) - 34)]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in t for i in items for t in texts)
    assert len(set(windows)) >= 0.99 * len(windows)  # cutting may join what stood apart
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == before
