"""Fields on the grid without dense arrays: bilinear samples, 3 x 3 means, neighbour statistics, finite differences."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drift_engine.functions.geodesy import METRES, Grid, Space
from drift_engine.operators import tiles

def sample(points: DataFrame, keys: list[str], cells: DataFrame, fields: list[str], grid: Grid, tolerance: float = 1e-10) -> DataFrame:
    """Bilinear values of the fields at points (keys, px, py): keys, boundary, and each field.

    A field is NULL unless each corner of a weight over the tolerance is in `cells` (the
    supported ones) and has it. Within half a cell of the border, and outside, a point is
    on the boundary. Points and cells meet by tile, once for all fields.
    """
    gx = (grid.branch(F.col("px")) - F.lit(grid.x_min)) / F.lit(grid.dx) - 0.5
    gy = (F.col("py") - F.lit(grid.y_min)) / F.lit(grid.dy) - 0.5
    out = (gy < -tolerance) | (gy > grid.ny - 1 + tolerance)
    if not grid.periodic:
        out = out | (gx < -tolerance) | (gx > grid.nx - 1 + tolerance)
        gx = F.least(F.greatest(gx, F.lit(0.0)), F.lit(float(grid.nx - 1)))
    gy = F.least(F.greatest(gy, F.lit(0.0)), F.lit(float(grid.ny - 1)))
    known = ~F.coalesce(out, F.lit(False)) & F.col("px").isNotNull() & F.col("py").isNotNull()
    rows = points.select(*keys, F.coalesce(out, F.lit(False)).alias("boundary"), F.when(known, gx).alias("_gx"), F.when(known, gy).alias("_gy"))
    placed = cells.select((F.col("cell_id") % grid.nx).alias("x_bin"), F.expr(f"cell_id div {grid.nx}").alias("y_bin"), *fields)
    return tiles.sampled(rows, placed, grid, fields, tolerance).drop("_gx", "_gy")


def around(cells: DataFrame, grid: Grid, reach: int = 1, centre: bool = True) -> DataFrame:
    """(cell_id, near_id) of each cell and the grid's cells within `reach` of it."""
    steps = [(i, j) for j in range(-reach, reach + 1) for i in range(-reach, reach + 1) if centre or (i, j) != (0, 0)]
    rows = cells.select("cell_id", "x_bin", "y_bin", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])).alias("s"))
    x, y = F.col("x_bin") + F.col("s.i"), F.col("y_bin") + F.col("s.j")
    inside = y.between(0, grid.ny - 1)
    if grid.periodic:
        x = F.pmod(x, F.lit(grid.nx))
    else:
        inside &= x.between(0, grid.nx - 1)
    return rows.filter(inside).select("cell_id", grid.cell_id(x, y).alias("near_id"))


#: Less than the smallest radius of curvature of an ellipsoid of the Earth, in metres.
SMALL_RADIUS = 6.3e6


def near_cells(points: DataFrame, reach: Column, grid: Grid, space: Space) -> DataFrame:
    """points (px, py) with near_id, a row for each cell of the grid whose centre may lie within `reach` of the point.

    The rows and columns that a distance can span follow from the grid; on a sphere the
    columns grow towards the poles. What is found is to be measured: no cell within reach
    is left out, some outside are in.
    """
    rows = points.withColumn("_d", reach)
    if space.geographic:
        half = F.col("_d") * F.lit(METRES[space.unit] / (2 * SMALL_RADIUS))
        up = F.degrees(2 * half) / F.lit(grid.dy)
    else:
        up = F.col("_d") / F.lit(grid.dy)
    rows = rows.withColumn("_r", (F.ceil(up) + 1).cast("int")).withColumn("_yb", F.explode(F.sequence(-F.col("_r"), F.col("_r")))).withColumn("_yb", F.col("_yb") + grid.y_bin(F.col("py")))
    rows = rows.filter(F.col("_yb").between(0, grid.ny - 1))
    if space.geographic:
        cosines = F.cos(F.radians("py")) * F.cos(F.radians(grid.y_center(F.col("_yb"))))
        share = F.least(F.lit(1.0), F.sin(F.least(half, F.lit(math.pi / 2))) / F.sqrt(F.greatest(cosines, F.lit(1e-12))))
        across = F.degrees(2 * F.asin(share)) / F.lit(grid.dx)
    else:
        across = F.col("_d") / F.lit(grid.dx)
    # On a periodic grid no more than the whole row, once.
    most = (grid.nx - 1) // 2 if grid.periodic else grid.nx
    rows = rows.withColumn("_c", F.least(F.ceil(across) + 1, F.lit(most)).cast("int"))
    low = -F.col("_c") - (F.when(F.col("_c") == most, 1 - grid.nx % 2).otherwise(0) if grid.periodic else 0)
    rows = rows.withColumn("_xb", F.explode(F.sequence(low.cast("int"), F.col("_c")))).withColumn("_xb", F.col("_xb") + grid.x_bin(F.col("px")))
    if grid.periodic:
        rows = rows.withColumn("_xb", F.pmod("_xb", F.lit(grid.nx)))
    rows = rows.filter(F.col("_xb").between(0, grid.nx - 1))
    return rows.withColumn("near_id", grid.cell_id(F.col("_xb"), F.col("_yb"))).drop("_d", "_r", "_yb", "_c", "_xb")


def smooth(cells: DataFrame, field: str, grid: Grid, name: str = "smoothed") -> DataFrame:
    """cells with the mean of the field over the supported cells of their 3 x 3 surroundings. cells: the supported ones."""

    def means(tile: tiles.Tile) -> dict[str, np.ndarray]:
        near = np.array([tile.own(tile.values[field], *step) for step in tile.around()])
        found = ~np.isnan(near)
        return {name: np.where(np.isnan(tile.own(tile.values[field])), np.nan, np.where(found, near, 0.0).sum(0) / np.maximum(found.sum(0), 1))}

    return tiles.stencil(cells, grid, [field], means, f"`{name}` double")


def consistency(cells: DataFrame, theta: str, grid: Grid, support: str | None = None, least: int = 0) -> DataFrame:
    """(cell_id, consistency, neighbours): mean cosine between a cell's angle and its neighbours', both with enough support."""
    rows = cells.filter(F.col(theta).isNotNull())
    if support:
        rows = rows.filter(F.col(support) >= least)

    def cosines(tile: tiles.Tile) -> dict[str, np.ndarray]:
        own = tile.own(tile.values[theta])
        apart = np.array([own - tile.own(tile.values[theta], *step) for step in tile.around(centre=False)])
        found = ~np.isnan(apart)
        n = found.sum(0)
        return {"consistency": np.where(n > 0, np.where(found, np.cos(np.radians(np.where(found, apart, 0.0))), 0.0).sum(0) / np.maximum(n, 1), np.nan), "neighbours": n}

    found = tiles.stencil(rows.select("cell_id", "x_bin", "y_bin", theta), grid, [theta], cosines, "consistency double, neighbours long")
    return found.filter("neighbours > 0").select("cell_id", "consistency", "neighbours")


def gradient(cells: DataFrame, field: str, grid: Grid, space: Space) -> DataFrame:
    """cells with the field's east and north derivatives per length, centred, or one-sided where a neighbour lacks it, and how each was made.

    Differences and distances are worked out tile by tile; distances come from the coordinates.
    """

    def derivatives(tile: tiles.Tile) -> dict[str, np.ndarray]:
        at = lambda name, *step: tile.own(tile.values[name], *step)
        out, here = {}, at(field)
        for axis, step in (("east", (0, 1)), ("north", (1, 0))):
            back = (-step[0], -step[1])
            up, down = ~np.isnan(at(field, *step)), ~np.isnan(at(field, *back))
            known = ~np.isnan(here) & (up | down)
            a = [np.where(down, at(c, *back), at(c)) for c in ("x", "y", field)]
            b = [np.where(up, at(c, *step), at(c)) for c in ("x", "y", field)]
            with np.errstate(all="ignore"):
                length = space.metres(a[0], a[1], b[0], b[1])
                out[f"gradient_{axis}"] = np.where(known, (b[2] - a[2]) / length, np.nan)
            out[f"gradient_{axis}_method"] = np.where(~known, "undefined", np.where(up & down, "centred", "one_sided"))
        return out

    made = "gradient_east double, gradient_east_method string, gradient_north double, gradient_north_method string"
    return tiles.stencil(cells, grid, ["x", "y", field], derivatives, made)


def along_across(cells: DataFrame, theta: str, tolerance: float = 1e-12) -> DataFrame:
    """cells with the gradient's parts along theta and to the left of it, its magnitude and the share across."""
    r = F.radians(theta)
    along = F.col("gradient_east") * F.sin(r) + F.col("gradient_north") * F.cos(r)
    across = -F.col("gradient_east") * F.cos(r) + F.col("gradient_north") * F.sin(r)
    size = F.when(F.col(theta).isNotNull(), F.hypot("gradient_east", "gradient_north"))
    return cells.withColumns({"gradient_along": along, "gradient_across": across, "gradient_magnitude": size, "gradient_across_fraction": F.when(size > tolerance, F.abs(across) / size)})
