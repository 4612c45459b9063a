"""Array files (Zarr, classic NetCDF) as a Spark data source: parts along the first dimension of the positions, columns and coordinate ranges decided before chunks are opened.

    array_source.load(spark, path, ["track", "t", "X", "Y"], "X", "Y", within={"X": (10, 20)})

or, without the helper,

    array_source.register(spark)
    spark.read.format("drift_arrays").options(x="X", y="Y", within='{"X": [10, 20]}').load(path)

A schema given to the reader names the columns wanted, and variables that it lacks are not
opened. With ranges a part reads the columns they are of first, the smaller variables before
the larger, ends where no row is left, and opens the others only from the first to the last
place that holds a row. Ranges are an option, not Spark's pushed filters: Spark 4.1 keeps
what was pushed with the DataFrame, so that a second query on it would miss rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from drift_engine.sources import arrays as files

NAME = "drift_arrays"
ROW = "row_index"
ARROW = {"double": pa.float64(), "string": pa.string(), "bigint": pa.int64(), "timestamp": pa.timestamp("us", "UTC")}

#: Column -> least and greatest value, both inside, None for no bound. Values that are no number are in no range.
Ranges = dict[str, tuple[float | None, float | None]]


@dataclass
class Slab(InputPartition):
    """Places of the first dimension, from first to before last."""

    first: int
    last: int


def ddl(variables: dict[str, files.Variable], columns: list[str]) -> str:
    """Columns with their types by the headers, and row_index."""

    def one(c: str) -> str:
        v = variables.get(c)
        if v is not None and " since " in str(v.attributes.get("units", "")):
            return f"`{c}` timestamp"
        return f"`{c}` {'string' if v is not None and v.dtype.kind in 'SUO' else 'double'}"

    return ", ".join([*map(one, columns), f"{ROW} long"])


class ArrayReader(DataSourceReader):
    """Slabs of one file, and of each the rows inside all ranges."""

    def __init__(self, path: str, kind: str, x: str, y: str, schema: StructType, within: Ranges, slab_values: int) -> None:
        self.path, self.kind, self.x, self.y, self.within, self.slab_values = path, kind, x, y, within, slab_values
        self.types = {f.name: f.dataType.simpleString() for f in schema.fields}
        self.columns = [c for c in self.types if c != ROW]
        if lacking := sorted({t for t in self.types.values()} - set(ARROW)):
            raise ValueError(f"columns are double, string or timestamp, not {lacking}")
        if lacking := sorted(c for c in within if self.types.get(c) != "double"):
            raise ValueError(f"ranges are of columns that hold numbers, not {lacking}")

    def partitions(self) -> list[Slab]:
        variables = files.array_variables(self.path, self.kind)
        files.flattened(variables, self.columns, self.x, self.y, 0, 0)  # raises for what cannot be read
        sizes = files.position_dims(variables, self.x, self.y)
        (outer, rows), row = next(iter(sizes.items())), math.prod(list(sizes.values())[1:])
        together = max([1, *[v.together for c, v in variables.items() if c in self.types and v.dims[:1] == [outer]]])
        slab = max(1, self.slab_values // max(row, 1))
        slab = -(-slab // together) * together
        return [Slab(a, min(a + slab, rows)) for a in range(0, rows, slab)] or [Slab(0, 0)]

    def _values(self, variables: dict[str, files.Variable], column: str, first: int, last: int) -> np.ndarray:
        found = files.flattened(variables, [column], self.x, self.y, first, last)[column]
        kind = self.types[column]
        if kind == "timestamp":
            return found.dt.tz_localize(None).to_numpy("datetime64[us]")
        return found.to_numpy(float if kind == "double" else None)

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        variables = files.array_variables(self.path, self.kind)
        first, last = partition.first, partition.last
        row = math.prod(list(files.position_dims(variables, self.x, self.y).values())[1:])
        keep, known = np.ones((last - first) * row, bool), {}
        for column, (low, high) in sorted(self.within.items(), key=lambda r: math.prod(variables[r[0]].shape) if r[0] in variables else 0):
            known[column] = self._values(variables, column, first, last)
            keep &= (known[column] >= (-np.inf if low is None else low)) & (known[column] <= (np.inf if high is None else high))
            if not keep.any():
                return
        places = np.flatnonzero(keep)
        if not len(places):
            return
        begin, end = places[0] // row, places[-1] // row + 1
        inner = places - begin * row
        out = []
        for c, t in self.types.items():
            if c == ROW:
                values = places + first * row
            elif c in known:
                values = known[c][places]
            else:
                values = self._values(variables, c, first + begin, first + end)[inner]
            out.append(pa.array(values, ARROW[t]))
        yield pa.RecordBatch.from_arrays(out, names=list(self.types))


class ArraySource(DataSource):
    """Options: path, kind (zarr, netcdf or auto), x and y (variables that hold the positions), within (ranges, as JSON), slabvalues (values of a variable read at a time)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _kind(self) -> str:
        return files.format_of(self.options["path"], self.options.get("kind", "auto"))

    def schema(self) -> str:
        variables = files.array_variables(self.options["path"], self._kind())
        dims = set(files.position_dims(variables, self.options["x"], self.options["y"]))
        return ddl(variables, [*sorted(dims - set(variables)), *sorted(c for c, v in variables.items() if set(v.dims) <= dims)])

    def reader(self, schema: StructType) -> ArrayReader:
        within = json.loads(self.options.get("within", "{}"))
        slab = int(self.options.get("slabvalues", files.SLAB_VALUES))
        return ArrayReader(self.options["path"], self._kind(), self.options["x"], self.options["y"], schema, within, slab)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, once."""
    if not getattr(spark, "_drift_arrays", False):
        spark.dataSource.register(ArraySource)
        spark._drift_arrays = True


def load(spark: SparkSession, path: str, columns: list[str], x: str, y: str, kind: str = "auto", within: Ranges | None = None) -> DataFrame:
    """Columns of an array file and row_index, of the rows inside all ranges. Executors must be able to open the path."""
    register(spark)
    variables = files.array_variables(path, files.format_of(path, kind))
    files.flattened(variables, columns, x, y, 0, 0)
    given = {"x": x, "y": y, "kind": kind, "slabvalues": files.SLAB_VALUES, "within": json.dumps(within or {})}
    return spark.read.format(NAME).options(**given).schema(ddl(variables, columns)).load(path)
