"""The given tables as logs."""

import pytest

from logsift.sources import adapters

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(adapters.DEALT_BY))
def test_rows_are_dealt_before_lines_are_made(spark, name):
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
    dealt = adapters.batch_reader(spark, SF_DIR)(name)
    assert table.rdd.getNumPartitions() < partitions
    assert dealt.rdd.getNumPartitions() == partitions
    assert sorted(dealt.collect()) == sorted(table.collect())
