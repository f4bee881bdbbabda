"""Representations of a labelled matrix and the moves between them.

wide: row_id long, row_name string, values array<double>     long: row_id long, col_id long, value double
Ids, not the order of rows, say where a value is; they begin at 0. A cell that long form doesn't hold is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.kernels import dense


def to_long(wide: DataFrame) -> DataFrame:
    return wide.select("row_id", F.posexplode("values").alias("col_id", "value")).select("row_id", F.col("col_id").cast("long").alias("col_id"), "value")


def to_wide(long: DataFrame, n_cols: int, names: DataFrame | None = None) -> DataFrame:
    """Rows of n_cols values each, absent cells 0; names: row_id, row_name (default: the id)."""
    cells = F.collect_list(F.struct(F.col("col_id").cast("int").alias("k"), F.col("value").alias("v")))
    wide = long.filter(F.col("col_id") < n_cols).groupBy("row_id").agg(dense(cells, n_cols).alias("values"))
    if names is None:
        return wide.select("row_id", F.col("row_id").cast("string").alias("row_name"), "values")
    return wide.join(names, "row_id", "left").select("row_id", "row_name", "values")


def transpose(long: DataFrame) -> DataFrame:
    return long.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "value")


def top_left(wide: DataFrame, rows: int = 0, cols: int = 0) -> DataFrame:
    """The first rows and columns; 0 stands for all, and more than there are for all."""
    out = wide.filter(F.col("row_id") < rows) if rows else wide
    return out.withColumn("values", F.slice("values", 1, cols)) if cols else out


def resize(wide: DataFrame, rows: int, cols: int) -> DataFrame:
    """The top left overlap, filled with zeros to rows x cols."""
    kept = top_left(wide, rows, cols)
    filled = F.concat("values", F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(cols) - F.size("values"))))
    every = wide.sparkSession.range(rows).withColumnRenamed("id", "row_id")
    out = every.join(kept.select("row_id", "row_name", filled.alias("values")), "row_id", "left")
    return out.select("row_id", F.coalesce("row_name", F.col("row_id").cast("string")).alias("row_name"), F.coalesce("values", F.array_repeat(F.lit(0.0), cols)).alias("values"))


def zeros_like(wide: DataFrame) -> DataFrame:
    return wide.withColumn("values", F.transform("values", lambda x: F.lit(0.0)))


def cell(wide: DataFrame, row: int, col: int) -> DataFrame:
    """One row with the value at (row, col); none if the matrix has no such row, null if it has no such column."""
    return wide.filter(F.col("row_id") == row).select(F.get("values", F.lit(col)).alias("value"))


def checked(wide: DataFrame, n_cols: int) -> DataFrame:
    """wide, failing at run time on a row of another length."""
    ok = F.when(F.size("values") == n_cols, F.col("values")).otherwise(F.raise_error(F.concat(F.lit("row "), F.col("row_id"), F.lit(" has "), F.size("values"), F.lit(f" values, not {n_cols}"))))
    return wide.withColumn("values", ok)


def bounds(long: DataFrame) -> DataFrame:
    """The bounding box of the cells held: row_off, n_rows, col_off, n_cols."""
    out = long.agg(F.min("row_id").alias("r0"), F.max("row_id").alias("r1"), F.min("col_id").alias("c0"), F.max("col_id").alias("c1"))
    return out.select(F.col("r0").alias("row_off"), (F.col("r1") - F.col("r0") + 1).alias("n_rows"), F.col("c0").alias("col_off"), (F.col("c1") - F.col("c0") + 1).alias("n_cols"))
