"""The join of the SimHash covering goes by a shuffle: Spark takes the replicas for as small as the fingerprints."""

from pyspark.sql import functions as F

from fathomgrid.llm import simhash


def test_replicas_are_never_broadcast(spark, tmp_path):
    spark.range(2000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/fp")
    table = spark.read.parquet(f"{tmp_path}/fp")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").lower().removesuffix("b")) >= 10 << 20
    for codes in (None, simhash.TWO_BLOCKS, simhash.ALL_BLOCKS):
        links = simhash.near_links(table, codes=codes)
        before = links._jdf.queryExecution().executedPlan().toString()
        links.collect()
        after = links._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in before + after and "SortMergeJoin" in before and "SortMergeJoin" in after
