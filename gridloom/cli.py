"""gridloom: read or make a matrix, optionally turn it into a correlation network, and write it."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from gridloom.matrix import to_wide
from gridloom.operators.correlation import pearson, rank_correlation
from gridloom.operators.pairs import reflected
from gridloom.sources import read_matrix, write_matrix
from gridloom.sources.random import random_matrix
from gridloom.sources.text import Matrix


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("-i", "--input", help=".csv, .exp, .h5, .hdf5, .loom or .h5ad")
    source.add_argument("-r", "--random", action="store_true", help="a random matrix of -n rows and -v columns")
    p.add_argument("-n", "--num-vectors", type=int, default=0, help="rows; of an input, at most so many")
    p.add_argument("-v", "--vector-size", type=int, default=0, help="columns; of an input, at most so many")
    p.add_argument("--skip", action="store_true", help="leave out the two lines after the header (EXP)")
    for name, default in (("group", "array"), ("matrix", "block0_values"), ("gene", "axis1"), ("sample", "axis0")):
        p.add_argument(f"--hdf_{name}", default=default)
    p.add_argument("--random-seed", type=int, default=11)
    p.add_argument("--random-min", type=float, default=0.0)
    p.add_argument("--random-max", type=float, default=1.0)
    p.add_argument("-o", "--output", default="")
    p.add_argument("-m", "--method", choices=("none", "pearson", "rank"), default="none")
    p.add_argument("-s", "--single", action="store_true", help="round values to single precision")
    p.add_argument("-t", "--threads", type=int, default=0, help="local threads; by default the session's own master")
    return p


def main(args: list[str] | None = None) -> int:
    p = parser()
    o = p.parse_args(args)
    if o.random and not (o.num_vectors and o.vector_size):
        p.error("-r needs -n and -v")
    builder = SparkSession.builder.appName("gridloom")
    spark = (builder.master(f"local[{o.threads}]") if o.threads else builder).getOrCreate()
    if o.random:
        rows = random_matrix(spark, o.num_vectors, o.vector_size, o.random_seed, o.random_min, o.random_max)
        m = Matrix(rows, [str(i) for i in range(o.vector_size)])
    else:
        m = read_matrix(spark, o.input, o.num_vectors, o.vector_size, o.skip, group=o.hdf_group, names=(o.hdf_gene, o.hdf_sample, o.hdf_matrix))
    if o.single:
        m = Matrix(m.rows.withColumn("values", m.rows["values"].cast("array<float>").cast("array<double>")), m.columns)
    if o.method != "none":
        names = m.rows.select("row_id", "row_name")
        labels = [r["row_name"] for r in names.orderBy("row_id").collect()]
        kind = pearson if o.method == "pearson" else rank_correlation
        m = Matrix(to_wide(reflected(kind(m.rows, len(m.columns))), len(labels), names), labels)
    write_matrix(m.rows, m.columns, o.output, o.skip)
    return 0


if __name__ == "__main__":
    sys.exit(main())
