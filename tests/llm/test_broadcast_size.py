"""A side is broadcast by what its rows take in the driver, not by its compressed files, and what is not small is never broadcast."""

import pytest
from pyspark.sql import functions as F

from fathomgrid.llm import common


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["left_anti", "inner"])
def test_small_files_of_many_rows_are_shuffled(spark, kind):
    rows = 600_000  # 112 bytes each in memory; a few in the files
    side = common.materialize(spark.range(rows).select("id", (F.col("id") % 50).alias("text")), "side")
    assert common.bytes_of(side) * 8 <= common.BROADCAST_BYTES < common.broadcast_bytes(side)
    other = common.materialize(spark.range(rows - 10, rows + 10), "other")
    both = other.join(common.small_or_shuffled(side), "id", kind)
    assert both.count() == 10
    assert "Broadcast" not in _plan(both) and "SortMergeJoin" in _plan(both)


def test_few_rows_are_broadcast(spark):
    side = common.materialize(spark.range(1000).select("id", F.col("id").cast("string").cast("binary").alias("spans"), F.array("id", "id").alias("a")), "side")
    assert common.broadcast_bytes(side) == 1000 * 128 + 2890 + 16_000
    assert "BroadcastHashJoin" in _plan(spark.range(10).join(common.small_or_shuffled(side), "id"))


def test_no_rows(spark):
    side = common.materialize(spark.range(0).select("id", F.lit(None).cast("string").alias("x")), "side")
    assert common.broadcast_bytes(side) == 0
    assert spark.range(10).join(common.small_or_shuffled(side), "id", "left_anti").count() == 10
