"""One- and two-dimensional partitions as DataFrames of descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.kernels import dense


def equal_parts(spark: SparkSession, size: int, parts: int) -> DataFrame:
    """id, off, n: the first size % parts parts get one more."""
    base, more, k = size // parts, size % parts, F.col("id")
    return spark.range(parts).select("id", (k * base + F.least(k, F.lit(more))).alias("off"), (F.lit(base) + (k < more).cast("int")).cast("long").alias("n"))


def fixed_parts(spark: SparkSession, size: int, block: int) -> DataFrame:
    """id, off, n: parts of block, the last short."""
    k = F.col("id")
    return spark.range(-(-size // block)).select("id", (k * block).alias("off"), F.least(F.lit(block), F.lit(size) - k * block).cast("long").alias("n"))


def grid(rows: DataFrame, cols: DataFrame, n_cols: int) -> DataFrame:
    """tile_id = r * n_cols + c, r, c and extents: every part of rows with every part of cols (descriptors only, each grid point once)."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_cols - 1).cast("long")))
    r = rows.select(F.col("id").alias("r"), F.col("off").alias("row_off"), F.col("n").alias("n_rows"), every.alias("c"))
    c = cols.select(F.col("id").alias("c"), F.col("off").alias("col_off"), F.col("n").alias("n_cols"))
    return r.join(c, "c").select((F.col("r") * n_cols + F.col("c")).alias("tile_id"), "r", "c", "row_off", "n_rows", "col_off", "n_cols")


def fixed_grid(spark: SparkSession, rows: int, cols: int, tile_rows: int, tile_cols: int) -> DataFrame:
    return grid(fixed_parts(spark, rows, tile_rows), fixed_parts(spark, cols, tile_cols), -(-cols // tile_cols))


def equal_grid(spark: SparkSession, rows: int, cols: int, parts_r: int, parts_c: int) -> DataFrame:
    return grid(equal_parts(spark, rows, parts_r), equal_parts(spark, cols, parts_c), parts_c)


def upper_triangle(tiles: DataFrame, off_diagonal: int = 0) -> DataFrame:
    """Tiles with c - off >= r, numbered anew in the order of r, c (descriptors: one row for each tile, not for each cell)."""
    kept = tiles.filter(F.col("c") - off_diagonal >= F.col("r"))
    before = kept.groupBy("r").agg(F.count(F.lit(1)).alias("here"))
    before = before.select("r", (F.sum("here").over(Window.orderBy("r")) - F.col("here")).alias("before"))
    return kept.join(before, "r").withColumn("tile_id", F.col("before") + F.row_number().over(Window.partitionBy("r").orderBy("c")) - 1).drop("before")


def band_condition(r: Column, c: Column, width: int, off_diagonal: int = 0) -> Column:
    """The wrapped band that holds each unordered pair of a square grid of `width` once (for an offset of 0) and gives every row as many tiles."""
    return F.pmod(c - r - off_diagonal, F.lit(width)) * width + r < width * (width + 1) // 2


def banded(tiles: DataFrame, width: int, off_diagonal: int = 0) -> DataFrame:
    return tiles.filter(band_condition(F.col("r"), F.col("c"), width, off_diagonal))


def transposed(tiles: DataFrame, data: str = "data") -> DataFrame:
    """Tiles with rows and columns exchanged, in the descriptors and, where there is row-major data, in the block; other columns stay."""
    names = {"r": "c", "c": "r", "row_off": "col_off", "col_off": "row_off", "n_rows": "n_cols", "n_cols": "n_rows"}
    rows, cols = F.col("n_rows").cast("int"), F.col("n_cols").cast("int")
    block = F.transform(data, lambda x, k: F.get(F.col(data), (k % rows) * cols + F.floor(k / rows).cast("int")))
    # In one select, the lambda would see the exchanged n_rows and n_cols: names of a select's own list reach into lambdas.
    turned = tiles.withColumn("_turned", block) if data in tiles.columns else tiles
    return turned.select(*[F.col("_turned" if x == data else names.get(x, x)).alias(x) for x in tiles.columns])


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def reflected_diagonally(tiles: DataFrame) -> DataFrame:
    """The tiles, and the transposes of those off the diagonal."""
    return tiles.unionByName(transposed(tiles.filter("row_off <> col_off")))


def tile_bounds(tiles: DataFrame) -> DataFrame:
    r1, c1 = F.max(F.col("row_off") + F.col("n_rows")), F.max(F.col("col_off") + F.col("n_cols"))
    return tiles.agg(F.min("row_off").alias("row_off"), (r1 - F.min("row_off")).alias("n_rows"), F.min("col_off").alias("col_off"), (c1 - F.min("col_off")).alias("n_cols"))


def by_offsets(tiles: DataFrame) -> DataFrame:
    return tiles.orderBy("row_off", "col_off")


def cells_of(tiles: DataFrame, data: str = "data") -> DataFrame:
    """row_id, col_id, value of tiles whose data is a row-major array<double>."""
    at = tiles.select("row_off", "col_off", "n_cols", F.posexplode(data).alias("k", "value"))
    return at.select((F.col("row_off") + F.floor(F.col("k") / F.col("n_cols"))).cast("long").alias("row_id"), (F.col("col_off") + F.col("k") % F.col("n_cols")).cast("long").alias("col_id"), "value")


def tiles_of(long: DataFrame, tile_rows: int, tile_cols: int) -> DataFrame:
    """r, c and row-major data of fixed tiles, absent cells 0; each tile is packed by one group."""
    k = (F.col("row_id") % tile_rows) * tile_cols + F.col("col_id") % tile_cols
    keyed = long.select(F.floor(F.col("row_id") / tile_rows).cast("long").alias("r"), F.floor(F.col("col_id") / tile_cols).cast("long").alias("c"), k.cast("int").alias("k"), "value")
    packed = keyed.groupBy("r", "c").agg(dense(F.collect_list(F.struct("k", F.col("value").alias("v"))), tile_rows * tile_cols).alias("data"))
    return packed.select("r", "c", (F.col("r") * tile_rows).alias("row_off"), F.lit(tile_rows).cast("long").alias("n_rows"), (F.col("c") * tile_cols).alias("col_off"), F.lit(tile_cols).cast("long").alias("n_cols"), "data")
