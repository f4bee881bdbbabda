"""Sorting, ranks and rank-ordered sums within a row."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sorted_values(values: Column, ascending: bool = True) -> Column:
    """array<struct<value, index>>, stable: ties keep the order of their indexes either way."""
    pairs = F.transform(values, lambda x, i: F.struct(x.alias("value"), i.alias("index")))
    if ascending:
        return F.sort_array(pairs)
    turned = F.transform(values, lambda x, i: F.struct((-x).alias("key"), i.alias("index"), x.alias("value")))
    return F.transform(F.sort_array(turned), lambda s: F.struct(s["value"].alias("value"), s["index"].alias("index")))


def rank_cells(cells: DataFrame, ties: list[str], keys: tuple[str, ...] = ("row_id",), value: str = "value", first: int = 1, ascending: bool = True) -> DataFrame:
    """cells with dense rank `rank` (ties share) and place `pos` (from 0, ties in the order of the columns `ties`)."""
    by = F.col(value).asc() if ascending else F.col(value).desc()
    row = Window.partitionBy(*keys)
    return cells.withColumn("rank", F.dense_rank().over(row.orderBy(by)) + (first - 1)).withColumn("pos", F.row_number().over(row.orderBy(by, *ties)) - 1)


def rank_values(wide: DataFrame, first: int = 1, ascending: bool = True) -> DataFrame:
    """Each row's vector as dense ranks, as doubles: one Arrow batch at a time, no explode and no shuffle. NaN is the largest value."""

    def one(v: np.ndarray) -> np.ndarray:
        distinct, where = np.unique(v + 0.0, return_inverse=True)
        return (where if ascending else len(distinct) - 1 - where) + float(first)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("values")
            ranked = [one(np.asarray(v, float)) for v in batch.column(at).to_pylist()]
            yield batch.set_column(at, "values", pa.array(ranked, pa.list_(pa.float64())))

    fields = ", ".join(f"`{c}` {'array<double>' if c == 'values' else kind}" for c, kind in wide.dtypes)
    return wide.mapInArrow(run, fields)


def _earlier(keys: np.ndarray, weights: np.ndarray, concordant: bool) -> np.ndarray:
    """For each element the weight of earlier ones with a smaller (else a greater) key, ties left out.

    Blocks of 1, 2, 4, ... are merged in pairs, all pairs of a width at once: sorted by key, with the right half first among
    equal keys, the running weight of a pair's left half is what its right half gains.
    """
    n, at = len(keys), np.arange(len(keys))
    distinct, place = np.unique(keys, return_inverse=True)
    place = place if concordant else len(distinct) - 1 - place
    out, width = np.zeros(n), 1
    while width < n:
        pair, right = at // (2 * width), at // width % 2 == 1
        order = np.argsort((pair * len(distinct) + place) * 2 + ~right, kind="stable")
        sums = np.concatenate([[0.0], np.cumsum(np.where(right, 0.0, weights)[order])])
        gains = right[order]
        out[order[gains]] += (sums[1:] - sums[2 * width * pair[order]])[gains]
        width *= 2
    return out


def earlier_sums(cells: DataFrame, keys: list[str], order: list[str], key: str, weight: str, concordant: bool = True) -> DataFrame:
    """keys, order, and `total`: for each element the weight of those before it (in order) with a strictly smaller key, or greater if not concordant.

    Array operations, about n (log n)^2 for each row; a row is one vector and must fit in a task.
    """
    types = dict(cells.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, *order]) + ", total double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf[[*keys, *order]].assign(total=_earlier(pdf[key].to_numpy(float), pdf[weight].to_numpy(float), concordant))

    return cells.groupBy(*keys).applyInPandas(run, schema)


def inversions(cells: DataFrame, keys: list[str], order: list[str], key: str) -> DataFrame:
    """keys and n_inversions: pairs out of order (extension: the count behind Kendall's tau)."""
    found = earlier_sums(cells.withColumn("_one", F.lit(1.0)), keys, order, key, "_one", concordant=False)
    return found.groupBy(*keys).agg(F.sum("total").cast("long").alias("n_inversions"))
