from rasterloom.llm import queries, sharding


def test_the_query_shards_whole_documents(spark, monkeypatch):
    seen, real = [], sharding.shuffle_into_shards
    monkeypatch.setattr(sharding, "shuffle_into_shards", lambda df, *a: seen.append(df.columns) or real(df, *a))
    assert queries.op1_sharding(spark, "/root/testdata/sf0.001").count() == 200
    assert seen == [spark.read.parquet("/root/testdata/sf0.001/documents.parquet").columns]
