"""Where rows are, and bringing them to the driver: what collectives are for elsewhere, Spark mostly plans itself."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that the driver takes at most.
MOST_ROWS = 100_000


def by_row_ranges(wide: DataFrame, parts: int) -> DataFrame:
    """Rows dealt out in ranges of row_id, in order inside each part."""
    return wide.repartitionByRange(parts, "row_id").sortWithinPartitions("row_id")


def part_of_rows(wide: DataFrame, size: int, parts: int) -> DataFrame:
    """wide with `part`, the equal part (the first size % parts get one more row) that holds the row."""
    base, more = size // parts, size % parts
    at, edge = F.col("row_id"), more * (base + 1)
    late = F.lit(more) + F.floor((at - edge) / max(1, base))
    return wide.withColumn("part", F.when(at < edge, F.floor(at / (base + 1))).otherwise(late).cast("long"))


def offsets(sizes: DataFrame, key: str = "part", size: str = "n") -> DataFrame:
    """sizes with `off`, the sum of the sizes before: one row for each part, so the ordered sum is over few rows."""
    return sizes.withColumn("off", F.sum(size).over(Window.orderBy(key)) - F.col(size))


def counted(frame: DataFrame, observation) -> DataFrame:
    """frame, reporting how many rows went through as `processed` of a pyspark.sql.Observation once an action has run."""
    return frame.observe(observation, F.count(F.lit(1)).alias("processed"))


def to_numpy(wide: DataFrame, rows: int | None = None, most: int = MOST_ROWS) -> np.ndarray:
    """The matrix on the driver, by one action, so that an Observation of wide completes. More than `most` rows are an error. rows: the rows there are, if known."""
    found = wide.select("row_id", "values").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"the matrix has more than {most} rows: too many for the driver")
    n = rows if rows is not None else max((r["row_id"] for r in found), default=-1) + 1
    out = np.zeros((n, len(found[0]["values"]) if found else 0))
    for r in found:
        out[r["row_id"]] = r["values"]
    return out
