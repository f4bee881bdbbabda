"""HDF5 matrices in the layout of pandas frames, by the Python data source API; needs h5py and a path that every worker can open."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.sources.text import Matrix

SCHEMA = "row_id long, row_name string, values array<double>"
RANGE = 1024


def _h5py():
    try:
        import h5py
    except ImportError as error:
        raise RuntimeError("HDF5 matrices need the h5py package on the driver and every worker") from error
    return h5py


def _text(value) -> str:
    return value.decode("utf-8") if isinstance(value, bytes) else str(value)


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    """Each partition reads its own range of rows: names and values of that range only."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Rows]:
        n = int(self.options["rows"])
        return [_Rows(a, min(a + RANGE, n)) for a in range(0, n, RANGE)] or [_Rows(0, 0)]

    def read(self, partition: _Rows):
        o = self.options
        with _h5py().File(o["path"], "r") as file:
            group = file[o["group"]]
            names = group[o["row_names"]][partition.first : partition.last]
            values = group[o["values"]][partition.first : partition.last, : int(o["cols"])]
            for i, (name, row) in enumerate(zip(names, values, strict=True)):
                yield partition.first + i, _text(name), [float(x) for x in row]


class MatrixSource(DataSource):
    """spark.read.format("gridloom_hdf5")."""

    @classmethod
    def name(cls) -> str:
        return "gridloom_hdf5"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_hdf5_matrix(spark: SparkSession, path: str, rows: int = 0, cols: int = 0, group: str = "array", names: tuple[str, str, str] = ("axis1", "axis0", "block0_values")) -> Matrix:
    with _h5py().File(path, "r") as file:
        n, m = file[group][names[2]].shape
        columns = [_text(x) for x in file[group][names[1]][: cols or m]]
    spark.dataSource.register(MatrixSource)
    options = {"path": path, "group": group, "row_names": names[0], "values": names[2], "rows": str(min(rows or n, n)), "cols": str(min(cols or m, m))}
    return Matrix(spark.read.format("gridloom_hdf5").options(**options).load(), columns)


def write_hdf5_matrix(wide: DataFrame, columns: list[str], path: str, group: str = "array") -> None:
    """One writer, the driver, takes the rows in order, a partition at a time, and writes RANGE of them at once: one HDF5 file has one writer."""
    h5py = _h5py()
    n, kind = wide.count(), h5py.string_dtype("utf-8")
    with h5py.File(path, "w") as file:
        top = file.create_group(group)
        for key, value in {"CLASS": "GROUP", "TITLE": "", "VERSION": "1.0", "pandas_type": "frame", "pandas_version": "0.15.2", "encoding": "UTF-8", "ndim": 2, "nblocks": 1}.items():
            top.attrs[key] = value
        for name in ("axis0", "block0_items"):
            top.create_dataset(name, data=columns, dtype=kind)
        labels, values = top.create_dataset("axis1", (n,), dtype=kind), top.create_dataset("block0_values", (n, len(columns)), dtype="f8")
        rows = wide.orderBy("row_id").toLocalIterator()
        for at in range(0, n, RANGE):
            some = [*islice(rows, RANGE)]
            labels[at : at + len(some)] = [row["row_name"] for row in some]
            values[at : at + len(some)] = [row["values"] for row in some]
