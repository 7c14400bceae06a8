"""Matrices in .h5ad files, where the h5py library is installed.

A file is a Spark data source with parts: x (or a layer) is read by blocks of rows, or of columns where it is stored by columns;
obs and var have all columns of their tables; obsm is an array for each observation. A block is an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from enum import Enum
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

from tesserae.plans.data import ExprData

#: Rows or columns of a partition.
ROWS = 1000
PARTS = ("x", "obs", "var", "obsm")
ARROW = {LongType(): pa.int64(), DoubleType(): pa.float64(), BooleanType(): pa.bool_(), StringType(): pa.string()}


class FileScope(Enum):
    """READ: a lazy scan; READ_WRITE: the same, as Spark writes to other files."""

    READ = 0
    READ_WRITE = 1


def _open(path: str) -> Any:
    try:
        import h5py
    except ImportError as error:
        raise ImportError("reading .h5ad needs h5py; Parquet folders x, obs and var are the native form") from error
    return h5py.File(path, "r")


def _text(value: Any) -> str | None:
    return None if value is None else value.decode("utf-8") if isinstance(value, bytes) else str(value)


def _is_group(node: Any) -> bool:
    return hasattr(node, "keys")


def _encoding(node: Any) -> str:
    return _text(node.attrs.get("encoding-type", "")) or ""


def _index(axis: Any) -> str:
    return _text(axis.attrs.get("_index", "_index")) or "_index"


def _columns(axis: Any) -> list[str]:
    """Names of an axis's columns in the order that the file gives."""
    order = axis.attrs.get("column-order")
    names = [_text(n) for n in order] if order is not None else list(axis.keys())
    return [n for n in names if n in axis.keys() and n != _index(axis) and not n.startswith("__")]


def _kind(node: Any) -> DataType:
    if _is_group(node):
        if _encoding(node) == "categorical":
            return StringType()
        node = node["values"]
    return {"b": BooleanType(), "i": LongType(), "u": LongType(), "f": DoubleType()}.get(np.dtype(node.dtype).kind, StringType())


def _values(node: Any, begin: int, end: int) -> pa.Array:
    """Some rows of a column: a plain one, a categorical one as its names, or one with a mask of nulls."""
    kind = ARROW[_kind(node)]
    if not _is_group(node):
        rows = node[begin:end]
        return pa.array([_text(v) for v in rows], kind) if kind == pa.string() else pa.array(np.asarray(rows)).cast(kind)
    if _encoding(node) == "categorical":
        names = [_text(v) for v in node["categories"][:]]
        return pa.array([names[c] if c >= 0 else None for c in node["codes"][begin:end]], kind)
    masked = np.asarray(node["mask"][begin:end], bool)
    return pa.array([None if m else _text(v) if kind == pa.string() else v for v, m in zip(node["values"][begin:end].tolist(), masked, strict=True)], kind)


def _matrix(file: Any, options: dict[str, str]) -> Any:
    layer = options.get("layer")
    return file["layers"][layer] if layer else file["X"]


def _by_columns(x: Any) -> bool:
    """Whether a sparse matrix is stored by columns; files of older writers say so by another attribute."""
    if not _is_group(x):
        return False
    told = _encoding(x) or _text(x.attrs.get("h5sparse_format", "")) or "csr"
    if told not in ("csr_matrix", "csc_matrix", "csr", "csc"):
        raise ValueError(f"a matrix with encoding {told} can't be read")
    return told.startswith("csc")


def _sizes(file: Any) -> tuple[int, int]:
    return tuple(len(file[axis][_index(file[axis])]) for axis in ("obs", "var"))


def _shape(x: Any, sizes: tuple[int, int]) -> None:
    shape = x.attrs.get("shape", x.attrs.get("h5sparse_shape")) if _is_group(x) else x.shape
    if shape is not None and tuple(int(n) for n in shape) != sizes:
        raise ValueError(f"a matrix of {tuple(shape)} doesn't fit {sizes[0]} observations and {sizes[1]} variables")


class Rows(InputPartition):
    def __init__(self, begin: int, end: int) -> None:
        self.begin, self.end = begin, end


class H5adReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.options, self.path, self.part, self.names = options, options["path"], options.get("part", "x"), schema.names

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as file:
            sizes = _sizes(file)
            n = sizes[1] if self.part == "var" else sizes[0]
            if self.part == "x":
                x = _matrix(file, self.options)
                _shape(x, sizes)
                n = sizes[1] if _by_columns(x) else n
        return [Rows(i, min(n, i + ROWS)) for i in range(0, n, ROWS)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with _open(self.path) as file:
            found = {"x": self._entries, "obsm": self._arrays}.get(self.part, self._table)(file, partition.begin, partition.end)
            yield pa.RecordBatch.from_arrays(found, self.names)

    def _table(self, file: Any, begin: int, end: int) -> list[pa.Array]:
        axis = file[self.part]
        at = pa.array(np.arange(begin, end, dtype=np.int64))
        names = pa.array([_text(v) for v in axis[_index(axis)][begin:end]], pa.string())
        return [at, at, names, *(_values(axis[c], begin, end) for c in _columns(axis))]

    def _arrays(self, file: Any, begin: int, end: int) -> list[pa.Array]:
        rows = np.asarray(file["obsm"][self.options["key"]][begin:end], dtype=np.float64)
        return [pa.array(np.arange(begin, end, dtype=np.int64)), pa.array(list(rows), pa.list_(pa.float64()))]

    def _entries(self, file: Any, begin: int, end: int) -> list[pa.Array]:
        x = _matrix(file, self.options)
        if _is_group(x):
            starts = np.asarray(x["indptr"][begin : end + 1], dtype=np.int64)
            a, b = (int(starts[0]), int(starts[-1])) if len(starts) else (0, 0)
            along, values = np.repeat(np.arange(begin, end), np.diff(starts)), np.asarray(x["data"][a:b])
            across = np.asarray(x["indices"][a:b])
            row, column = (across, along) if _by_columns(x) else (along, across)
        else:
            dense = np.asarray(x[begin:end])
            row, column = np.nonzero(dense)
            values, row = dense[row, column], row + begin
        return [pa.array(row.astype(np.int64)), pa.array(column.astype(np.int64)), pa.array(values.astype(np.float64))]


class H5ad(DataSource):
    """Options: part (x, obs, var or obsm), layer of x, key of obsm."""

    @classmethod
    def name(cls) -> str:
        return "h5ad"

    def schema(self) -> StructType:
        part = self.options.get("part", "x")
        if part not in PARTS:
            raise ValueError(f"part is one of {', '.join(PARTS)}")
        if part == "x":
            return StructType([StructField("obs_id", LongType()), StructField("var_id", LongType()), StructField("value", DoubleType())])
        if part == "obsm":
            return StructType([StructField("obs_id", LongType()), StructField("values", ArrayType(DoubleType()))])
        fields = [StructField(f"{part}_id", LongType()), StructField(f"{part}_idx", LongType()), StructField(f"{part}_name", StringType())]
        with _open(self.options["path"]) as file:
            axis = file[part]
            for name in _columns(axis):
                taken, n, own = {f.name.lower() for f in fields}, 0, name
                while own.lower() in taken:
                    n += 1
                    own = f"{name}_{n}"
                fields.append(StructField(own, _kind(axis[name])))
        return StructType(fields)

    def reader(self, schema: StructType) -> DataSourceReader:
        return H5adReader(dict(self.options), schema)


def read_h5ad(spark: SparkSession, path: str, scope: FileScope = FileScope.READ, enable_cache: bool = False) -> ExprData:
    """A container over a file that is read as it is used, with its layers and obsm; enable_cache keeps the matrix after its first use.

    Columns of obs and var keep their names; one that an id has already gets _1 appended. Categories are their names, and nulls stay."""
    spark.dataSource.register(H5ad)

    def part(name: str, **options: str):
        return spark.read.format("h5ad").options(part=name, **options).load(path)

    with _open(path) as file:
        layers, obsm = ([n for n in file[group].keys() if group == "layers" or not _is_group(file[group][n])] if group in file.keys() else [] for group in ("layers", "obsm"))
    data = ExprData(part("x"), part("obs"), part("var"), {n: part("x", layer=n) for n in layers}, {n: part("obsm", key=n) for n in obsm})
    return data.persist() if enable_cache else data


def read_h5ad_memory(spark: SparkSession, path: str) -> ExprData:
    return read_h5ad(spark, path, FileScope.READ, enable_cache=True)


read_h5ad_fast_memory = read_h5ad_memory
