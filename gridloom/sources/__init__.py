"""Where matrices come from and go to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.sources.text import Matrix, read_text_matrix, write_text_matrix

HDF5_SUFFIXES = (".h5", ".hdf5", "hdf5", ".loom", ".h5ad")


def read_matrix(spark: SparkSession, path: str, rows: int = 0, cols: int = 0, skip: bool = False, strict: bool = False, group: str = "array", names: tuple[str, str, str] = ("axis1", "axis0", "block0_values")) -> Matrix:
    """The matrix at path, by suffix: .csv, .exp, or HDF5. rows, cols: at most so many, 0 for all. An unknown suffix is an error."""
    if path.endswith((".csv", ".exp")):
        return read_text_matrix(spark, path, rows, cols, skip, strict)
    if path.endswith(HDF5_SUFFIXES):
        from gridloom.sources.hdf5 import read_hdf5_matrix

        return read_hdf5_matrix(spark, path, rows, cols, group, names)
    raise ValueError(f"no reader for {path}: .csv, .exp, .h5, .hdf5, .loom and .h5ad are known")


def write_matrix(wide: DataFrame, columns: list[str], path: str, skip: bool = False, single_file: bool = False) -> None:
    """Writes by suffix; .loom and .h5ad can only be read. An empty path shows the matrix."""
    if not path:
        wide.orderBy("row_id").show(truncate=False)
    elif path.endswith((".csv", ".exp")):
        write_text_matrix(wide, columns, path, skip, single_file)
    elif path.endswith((".h5", "hdf5")):
        from gridloom.sources.hdf5 import write_hdf5_matrix

        write_hdf5_matrix(wide, columns, path)
    else:
        raise ValueError(f"no writer for {path}: .csv, .exp, .h5 and .hdf5 are known")
