"""Transform, reduce, combine and reduce-then-transform, on the two forms of a matrix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.kernels import zscore_value


def transform(wide: DataFrame, kernel: Callable[[Column], Column]) -> DataFrame:
    """Each row's vector through a vector kernel."""
    return wide.withColumn("values", kernel(F.col("values")))


def reduce_rows(wide: DataFrame, kernel: Callable[..., Column], name: str = "value", positional: bool = False) -> DataFrame:
    """row_id and kernel(values), or kernel(row_id, values)."""
    return wide.select("row_id", (kernel(F.col("row_id"), F.col("values")) if positional else kernel(F.col("values"))).alias(name))


def reduce_columns(long: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates of `value` for each column; partial sums travel, not cells."""
    return long.groupBy("col_id").agg(*aggregates)


def row_params(long: DataFrame, sample: bool = True) -> DataFrame:
    """row_id, mean, stdev from cells."""
    stdev = F.stddev_samp("value") if sample else F.stddev_pop("value")
    return long.groupBy("row_id").agg(F.avg("value").alias("mean"), F.coalesce(stdev, F.lit(0.0)).alias("stdev"))


def row_params_without_diagonal(long: DataFrame, sample: bool = True) -> DataFrame:
    """row_params() without the cell whose column is the row's own id."""
    return row_params(long.filter(F.col("row_id") != F.col("col_id")), sample)


def zscore_cells(long: DataFrame, sample: bool = True) -> DataFrame:
    """row_id, col_id, value as z-score within the row; one shuffle for both parameters."""
    row = Window.partitionBy("row_id")
    stdev = F.stddev_samp("value") if sample else F.stddev_pop("value")
    return long.select("row_id", "col_id", zscore_value(F.col("value"), F.avg("value").over(row), stdev.over(row)).alias("value"))


def binary_op(a: DataFrame, b: DataFrame, op: Callable[[Column, Column], Column]) -> DataFrame:
    """Row i of a with row i of b, element by element; rows that either lacks are left out."""
    right = b.select("row_id", F.col("values").alias("other"))
    return a.join(right, "row_id").select("row_id", "row_name", F.zip_with("values", "other", op).alias("values"))


def reduce_transform(long: DataFrame, stats: DataFrame, op: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """op(value, row's statistics, column's statistics) for each cell of a square matrix; stats: row_id, stat (a struct)."""
    by_row = stats.select("row_id", F.col("stat").alias("row_stat"))
    by_col = stats.select(F.col("row_id").alias("col_id"), F.col("stat").alias("col_stat"))
    return long.join(by_row, "row_id").join(by_col, "col_id").select("row_id", "col_id", op(F.col("value"), F.col("row_stat"), F.col("col_stat")).alias("value"))


def clr(long: DataFrame) -> DataFrame:
    """Context likelihood of relatedness (extension): sqrt(zr^2 + zc^2), each z-score against its background without the diagonal, at least 0."""
    stats = row_params_without_diagonal(long).select("row_id", F.struct("mean", "stdev").alias("stat"))

    def op(x: Column, r: Column, c: Column) -> Column:
        zr, zc = (F.greatest(F.lit(0.0), zscore_value(x, s["mean"], s["stdev"])) for s in (r, c))
        return F.sqrt(zr * zr + zc * zc)

    return reduce_transform(long, stats, op)


def stouffer(long: DataFrame) -> DataFrame:
    """Stouffer's combination (extension): (zr + zc) / sqrt(2), each z-score against its background without the diagonal."""
    stats = row_params_without_diagonal(long).select("row_id", F.struct("mean", "stdev").alias("stat"))
    return reduce_transform(long, stats, lambda x, r, c: (zscore_value(x, r["mean"], r["stdev"]) + zscore_value(x, c["mean"], c["stdev"])) / F.sqrt(F.lit(2.0)))
