import re

import corpus_pipeline


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    d, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, sf)
        assert d.columns == docs.columns, name
        d = spark.createDataFrame(d.toPandas(), docs.schema)
        sizes.append(d.count())
    assert sizes[0] <= docs.count() and sizes[1] <= sizes[0] and sizes[2] == sizes[1]
    assert not d.where("text rlike 'token = \"[0-9a-f]{40}\"'").count()
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 1024 and set(out.doc_id) == {r.doc_id for r in d.collect()}
    assert re.match("quality", corpus_pipeline.STAGES[0][0])
