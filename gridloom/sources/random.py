"""Random matrices whose values depend on (seed, row, column) alone: not on partitions, executors or calls before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """[low, high), from 53 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double")
    return F.lit(low) + bits / F.lit(float(1 << 53)) * F.lit(high - low)


def uniform_int(seed: int, *keys: Column, low: int, high: int) -> Column:
    """[low, high], both included."""
    return F.lit(low) + F.floor(uniform(seed, *keys) * (high - low + 1)).cast("long")


def normal(seed: int, *keys: Column, mean: float = 0.0, stdev: float = 1.0) -> Column:
    """Box-Muller on two uniforms."""
    u, v = uniform(seed, F.lit(0), *keys), uniform(seed, F.lit(1), *keys)
    return F.lit(mean) + F.lit(stdev) * F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * F.pi() * v)


def random_matrix(spark: SparkSession, rows: int, cols: int, seed: int = 11, low: float = 0.0, high: float = 1.0, distribution: str = "uniform") -> DataFrame:
    """wide form; names "0", "1", ... For "normal", low and high are mean and standard deviation."""
    cell = {"uniform": lambda j: uniform(seed, F.col("row_id"), j, low=low, high=high), "normal": lambda j: normal(seed, F.col("row_id"), j, mean=low, stdev=high)}[distribution]
    values = F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), cell) if cols else F.array().cast("array<double>")
    return spark.range(rows).withColumnRenamed("id", "row_id").select("row_id", F.col("row_id").cast("string").alias("row_name"), values.alias("values"))


def random_vector(spark: SparkSession, size: int, **options) -> DataFrame:
    return random_matrix(spark, 1, size, **options)
