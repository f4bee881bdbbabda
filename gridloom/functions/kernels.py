"""Row kernels as Column expressions on array<double>: pure functions, so they fuse into one projection.

Sums run in double. A vector of no or one element has a standard deviation of 0 where the divisor would be 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least standard deviation that divides: the machine epsilon of the element type.
EPSILON = {"double": 2.220446049250313e-16, "float": 1.1920928955078125e-07}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """The sum of products; elements without a partner count as 0."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def _spread(values: Column, mean: Column, size: Column, sample: bool) -> Column:
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    divisor = size - 1 if sample else size
    return F.when(divisor > 0, F.sqrt(squares / F.when(divisor > 0, divisor))).otherwise(F.lit(0.0))


def mean_stdev(values: Column, sample: bool = True) -> Column:
    """struct<mean, stdev>; the two-pass form doesn't cancel. No elements: mean null, stdev 0."""
    size = F.size(values)
    mean = F.when(size > 0, total(values) / F.when(size > 0, size))
    return let(mean, lambda m: F.struct(m.alias("mean"), F.coalesce(_spread(values, m, size, sample), F.lit(0.0)).alias("stdev")))


def mean_stdev_without(values: Column, index: Column, sample: bool = True) -> Column:
    """mean_stdev without the element at index (from 0); an index outside leaves nothing out."""
    rest = F.filter(values, lambda x, i: i != index)
    return let(rest, lambda v: mean_stdev(v, sample))


def zscore_value(value: Column, mean: Column, stdev: Column, epsilon: float = EPSILON["double"]) -> Column:
    """(value - mean) / stdev; 0 where the deviation is below epsilon or null."""
    usable = F.abs(F.coalesce(stdev, F.lit(0.0))) >= epsilon
    return F.when(usable, (value - mean) / F.when(usable, stdev)).otherwise(F.lit(0.0))


def standard_score(values: Column, sample: bool = True, epsilon: float = EPSILON["double"]) -> Column:
    """Each element's z-score; all 0 for a constant vector."""
    return let(mean_stdev(values, sample), lambda p: F.transform(values, lambda x: zscore_value(x, p["mean"], p["stdev"], epsilon)))


def masked_sum(values: Column, mask: Column) -> Column:
    """The sum of the elements whose mask is true."""
    return F.aggregate(F.zip_with(values, mask, lambda x, m: F.when(m, x).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)


def compensated_sum(values: Column) -> Column:
    """Kahan's sum, which carries what each addition loses."""

    def step(a: Column, x: Column) -> Column:
        term = x - a["lost"]
        after = a["sum"] + term
        return F.struct(after.alias("sum"), ((after - a["sum"]) - term).alias("lost"))

    return F.aggregate(values, F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("lost")), step, lambda a: a["sum"])


def compose(*kernels: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """compose(f, g)(x) = g(f(x)), each intermediate vector computed once."""

    def run(values: Column) -> Column:
        return kernels[0](values) if len(kernels) == 1 else let(kernels[0](values), compose(*kernels[1:]))

    return run


def dense(cells: Column, size: int) -> Column:
    """A vector of size elements from array<struct<k, v>>, absent places 0. The zeros before each cell are laid out with it, in one pass."""
    gap = lambda k, at: F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), k - at - 1))

    def build(c: Column) -> Column:
        parts = F.transform(c, lambda x, i: F.concat(gap(x["k"], F.coalesce(F.get(c, i - 1)["k"], F.lit(-1))), F.array(x["v"])))
        return F.concat(F.flatten(parts), gap(F.lit(size), F.element_at(c, -1)["k"]))

    return let(F.sort_array(cells), build)
