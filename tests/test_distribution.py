"""Row ranges, offsets, counters and the way to the driver."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from gridloom.operators import distribution as D
from gridloom.plans.tiles import equal_parts
from gridloom.sources.random import random_matrix


def test_row_ranges(spark):
    m = random_matrix(spark, 40, 3).repartition(4)
    ranged = D.by_row_ranges(m, 4).withColumn("p", F.spark_partition_id()).collect()
    assert [r["row_id"] for r in sorted(ranged, key=lambda r: (r["p"], r["row_id"]))] == list(range(40))


def test_parts_and_offsets(spark):
    for size, parts in ((10, 3), (3, 5), (12, 4)):
        sizes = D.part_of_rows(spark.range(size).withColumnRenamed("id", "row_id"), size, parts).groupBy("part").agg(F.count("*").alias("n"))
        got = {r["part"]: (r["off"], r["n"]) for r in D.offsets(sizes).collect()}
        assert got == {r["id"]: (r["off"], r["n"]) for r in equal_parts(spark, size, parts).collect() if r["n"]}


def test_counter_and_numpy(spark):
    seen, m = Observation("rows"), random_matrix(spark, 7, 2)
    x = D.to_numpy(D.counted(m.repartition(3), seen))
    assert seen.get["processed"] == 7
    assert x.shape == (7, 2) and np.array_equal(x, [r["values"] for r in m.orderBy("row_id").collect()])
    assert D.to_numpy(m.limit(0)).size == 0
    with pytest.raises(ValueError, match="more than 6 rows"):
        D.to_numpy(m, most=6)
