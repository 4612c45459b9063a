"""Stencils on the grid by tiles: square pieces of the grid with a halo of their neighbours' cells, a task's arrays each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from drift_engine.functions.geodesy import Grid

#: Cells along a tile's side.
SIDE = 256


@dataclass
class Tile:
    """Dense arrays of a tile and its halo, NaN where a cell is missing; rows and columns of its own cells in them."""

    halo: int
    values: dict[str, np.ndarray]
    row: np.ndarray
    column: np.ndarray

    def own(self, array: np.ndarray, up: int = 0, right: int = 0) -> np.ndarray:
        """The array at the cells so far up and right of the tile's own."""
        return array[self.row + up, self.column + right]

    def around(self, reach: int = 1, centre: bool = True) -> list[tuple[int, int]]:
        steps = range(-reach, reach + 1)
        return [(j, i) for j in steps for i in steps if centre or (j, i) != (0, 0)]


def _places(bin_: Column, n: int, side: int, halo: int, periodic: bool) -> Column:
    """The tiles along an axis that see the bin, and where: one for most bins, more beside a tile's edge or the seam."""
    seen = []
    for turn in (0, -n, n) if periodic else (0,):
        for step in (0, -halo, halo):
            tile = F.floor((bin_ + (turn + step)) / F.lit(side)).cast("int")
            local = (bin_ + turn - tile * side).cast("int")
            ends = F.least(F.lit(side), n - tile * side) + halo
            seen.append(F.when((tile >= 0) & (tile * side < n) & (local >= -halo) & (local < ends), F.struct(tile.alias("tile"), local.alias("at"))))
    return F.array_distinct(F.filter(F.array(*seen), lambda s: s.isNotNull()))


def _tiled(rows: DataFrame, grid: Grid, side: int, halo: int) -> DataFrame:
    """rows (x_bin, y_bin) with their tile and place in it: once, and again in the halos that they are in."""
    rows = rows.withColumn("_x", F.explode(_places(F.col("x_bin"), grid.nx, side, halo, grid.periodic))).withColumn("_y", F.explode(_places(F.col("y_bin"), grid.ny, side, halo, False)))
    return rows.select(*[c for c in rows.columns if c not in ("_x", "_y")], F.col("_x.tile").alias("_tx"), F.col("_y.tile").alias("_ty"), F.col("_x.at").alias("_i"), F.col("_y.at").alias("_j"))


def _arrays(table: pa.Table, fields: list[str], side: int, halo: int) -> tuple[Tile, np.ndarray]:
    i, j = (table.column(c).to_numpy().astype(np.int64) + halo for c in ("_i", "_j"))
    values = {}
    for name in fields:
        values[name] = np.full((side + 2 * halo, side + 2 * halo), np.nan)
        values[name][j, i] = table.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
    inside = (i >= halo) & (j >= halo) & (i < side + halo) & (j < side + halo)
    width, height = table.column("_width")[0].as_py(), table.column("_height")[0].as_py()
    inside &= (i < width + halo) & (j < height + halo)
    return Tile(halo, values, j[inside], i[inside]), inside


def stencil(cells: DataFrame, grid: Grid, fields: list[str], compute: Callable[[Tile], dict[str, np.ndarray]], added: str, halo: int = 1, side: int = SIDE) -> DataFrame:
    """cells (x_bin, y_bin and others) with the columns `added` (DDL) that compute() makes of the fields' arrays; NaN is NULL.

    One shuffle brings each cell to its tile, and those near an edge to the neighbours that
    see them; a tile never has more than (side + 2 * halo) squared cells. No cells give no rows.
    """
    end = lambda t, n: F.least(F.lit(side), n - F.col(t) * side)
    rows = _tiled(cells, grid, side, halo).withColumns({"_width": end("_tx", grid.nx), "_height": end("_ty", grid.ny)})
    new = cells.sparkSession.createDataFrame([], added).schema
    kept = cells.columns

    def work(table: pa.Table) -> tuple[pa.Table, dict[str, np.ndarray]]:
        tile, inside = _arrays(table, fields, side, halo)
        return table.select(kept).filter(pa.array(inside)), compute(tile)

    target = to_arrow_schema(new)

    def typed(table: pa.Table) -> pa.Table:
        own, made = work(table)
        for f in target:
            own = own.append_column(f, pa.array(made[f.name], from_pandas=True).cast(f.type))
        return own

    return rows.groupBy("_tx", "_ty").applyInArrow(typed, StructType([*cells.schema.fields, *new.fields]))


def sampled(points: DataFrame, cells: DataFrame, grid: Grid, fields: list[str], tolerance: float, side: int = SIDE) -> DataFrame:
    """points (with _gx, _gy: place in units of cells from the first centre, NULL for none) with the fields' bilinear values.

    A value is NULL unless each corner of a weight over the tolerance has it. Points meet
    the tile of their lower left corner, with one row and column of cells beyond it.
    """
    place = lambda c: F.floor(F.coalesce(c, F.lit(0.0))).cast("long")
    at_x = F.pmod(place(F.col("_gx")), F.lit(grid.nx)) if grid.periodic else place(F.col("_gx"))
    tile = lambda at, n: F.floor(F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)) / side).cast("int")
    rows = points.withColumns({"_tx": tile(at_x, grid.nx), "_ty": tile(place(F.col("_gy")), grid.ny), "_at": at_x})
    seen = _tiled(cells.select("x_bin", "y_bin", *fields), grid, side, 1)
    kept = points.columns

    def work(those: pa.Table, near: pa.Table) -> pa.Table:
        arrays = {}
        i, j = (near.column(c).to_numpy().astype(np.int64) + 1 for c in ("_i", "_j")) if len(near) else (np.zeros(0, np.int64),) * 2
        for name in fields:
            arrays[name] = np.full((side + 2, side + 2), np.nan)
            if len(near):
                arrays[name][j, i] = near.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
        gx, gy = (those.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_gx", "_gy"))
        known = ~(np.isnan(gx) | np.isnan(gy))
        fx, fy = np.where(known, gx - np.floor(gx), 0.0), np.where(known, gy - np.floor(gy), 0.0)
        i = np.where(known, those.column("_at").to_numpy() - those.column("_tx").to_numpy().astype(np.int64) * side, 0) + 1
        j = np.where(known, np.floor(np.where(known, gy, 0.0)).astype(np.int64) - those.column("_ty").to_numpy().astype(np.int64) * side, 0) + 1
        out = those.select(kept)
        for name in fields:
            total, lacking = np.zeros(len(gx)), ~known
            for up, right, w in ((0, 0, (1 - fx) * (1 - fy)), (0, 1, fx * (1 - fy)), (1, 0, (1 - fx) * fy), (1, 1, fx * fy)):
                wanted = w > tolerance
                value = arrays[name][np.minimum(j + up, side + 1), np.minimum(i + right, side + 1)]
                total += np.where(wanted, w * np.where(np.isnan(value), 0.0, value), 0.0)
                lacking |= wanted & np.isnan(value)
            out = out.append_column(name, pa.array(np.where(lacking, np.nan, total), pa.float64(), from_pandas=True))
        return out

    schema = StructType([*points.schema.fields, *[StructField(f, DoubleType()) for f in fields]])
    return rows.groupBy("_tx", "_ty").cogroup(seen.groupBy("_tx", "_ty")).applyInArrow(work, schema)
