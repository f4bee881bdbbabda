"""Kernels and text functions on hand-made edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import kernels as K
from gridloom.functions import text as T


def rows(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "row_id long, values array<double>")


def one(spark, vectors, column):
    return [r[0] for r in rows(spark, vectors).orderBy("row_id").select(column).collect()]


def test_dot_tails(spark):
    vectors = [list(range(1, n + 1)) for n in range(1, 34)]
    assert one(spark, vectors, K.dot(F.col("values"), F.col("values"))) == [float(sum(x * x for x in v)) for v in vectors]


def test_short_and_constant_vectors(spark):
    vectors = [[], [5], [3, 3, 3], [1, 3], [1, 2, 4]]
    got = one(spark, vectors, K.mean_stdev(F.col("values")))
    assert [(g["mean"], g["stdev"]) for g in got[:3]] == [(None, 0.0), (5.0, 0.0), (3.0, 0.0)]
    assert math.isclose(got[4]["stdev"], np.std([1, 2, 4], ddof=1))
    z = one(spark, vectors, K.standard_score(F.col("values")))
    assert z[:3] == [[], [0.0], [0.0, 0.0, 0.0]] and np.allclose(z[3], [-(0.5**0.5), 0.5**0.5])
    p = one(spark, vectors, K.mean_stdev(F.col("values"), sample=False))
    assert math.isclose(p[3]["stdev"], 1.0) and p[1]["stdev"] == 0.0


def test_leaving_one_out(spark):
    got = one(spark, [[1, 2, 9], [1, 2, 9]], K.mean_stdev_without(F.col("values"), F.col("row_id") * 5 + 2))
    assert got[0]["mean"] == 1.5 and got[1]["mean"] == 4.0


def test_compensated_and_masked_sums(spark):
    v = [1e16, 1.0, 1.0, -1e16]
    assert one(spark, [v], K.compensated_sum(F.col("values"))) == [2.0]
    assert one(spark, [[1, 2, 4]], K.masked_sum(F.col("values"), F.array(F.lit(True), F.lit(None), F.lit(True)))) == [5.0]


def test_compose_and_dense(spark):
    double, plus = lambda v: F.transform(v, lambda x: x * 2), lambda v: F.transform(v, lambda x: x + 1)
    assert one(spark, [[1, 2]], K.compose(double, plus)(F.col("values"))) == [[3.0, 5.0]]
    cells = F.array(F.struct(F.lit(3).alias("k"), F.lit(7.0).alias("v")), F.struct(F.lit(0).alias("k"), F.lit(5.0).alias("v")))
    assert one(spark, [[1]], K.dense(cells, 6)) == [[5.0, 0.0, 0.0, 7.0, 0.0, 0.0]]


NUMBERS = {"1.5abc": 1.5, " 1.5 ": 1.5, "nan": 0.0, "inf": 0.0, "NA": 0.0, "1e400": 1e308, "1e-400": 1e-308, ".": 0.0, "1e": 1.0, "-": 0.0, "": 0.0, "-.5": -0.5, "5.": 5.0, "+3": 3.0, "0." + "1" * 25: float("0." + "1" * 25), "1e99999999999": 1e308, "2E2x": 200.0, "1d": 1.0, "\t7": 7.0, "0x1p3": 0.0, "Infinity": 0.0, "-inf": 0.0}


def test_numbers(spark):
    got = dict(spark.createDataFrame([(k,) for k in NUMBERS], "x string").select("x", T.numeric_prefix(F.col("x"))).collect())
    assert got == pytest.approx(NUMBERS)
    assert [r[0] for r in spark.createDataFrame([("1.5 ",), ("1.5x",), ("",)], "x string").select(T.strict_number(F.col("x"))).collect()] == [1.5, None, None]


def test_tokens(spark):
    texts = ["a,,b", "", ",", "x", ",a,"]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.tokens_or_empty(F.col("x")), T.tokens(F.col("x")), T.count_tokens(F.col("x")), T.count_tokens(F.col("x"), empty=True)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {"a,,b": (["a", "", "b"], ["a", "b"], 2, 3), "": ([], [], 0, 0), ",": (["", ""], [], 0, 2), "x": (["x"], ["x"], 1, 1), ",a,": (["", "a", ""], ["a"], 1, 3)}
    assert spark.range(1).select(T.trimmed(F.lit("q")), T.trimmed(F.lit(" \tab \n"))).first() == ("q", "ab")
