"""Tiles of any size give what cell by cell loops give, across tile edges and the seam of a periodic grid."""

import math

import numpy as np
import pytest

from drift_engine.functions.geodesy import Grid, Space, inverse
from drift_engine.operators import gridops, tiles

GRIDS = {"plain": Grid(0, 23, 0, 17, 1, 1), "periodic": Grid(-180, 180, -60, 60, 15, 8, True), "narrow": Grid(-180, 180, 0, 30, 120, 10, True)}


def field(spark, grid, share=0.8):
    rng = np.random.default_rng(2)
    cells = {}
    for j in range(grid.ny):
        for i in range(grid.nx):
            if rng.random() < share:
                cells[i, j] = float(rng.normal()) if rng.random() < 0.9 else None
    rows = [(j * grid.nx + i, i, j, grid.x_min + (i + 0.5) * grid.dx, grid.y_min + (j + 0.5) * grid.dy, v, f"name {i}", [j]) for (i, j), v in cells.items()]
    return cells, spark.createDataFrame(rows, "cell_id long, x_bin long, y_bin long, x double, y double, v double, label string, tags array<int>")


def at(cells, grid, i, j):
    return cells.get((i % grid.nx if grid.periodic else i, j))


@pytest.mark.parametrize("side", [4, 7, 256])
@pytest.mark.parametrize("name", GRIDS)
def test_stencils(spark, name, side, monkeypatch):
    monkeypatch.setattr(tiles.stencil, "__defaults__", (1, side))
    grid = GRIDS[name]
    cells, df = field(spark, grid)
    near = lambda i, j: [(a, b) for b in (-1, 0, 1) for a in (-1, 0, 1)]
    got = {(r.x_bin, r.y_bin): r for r in gridops.smooth(df, "v", grid).collect()}
    assert set(got) == set(cells) and got[next(iter(cells))].label.startswith("name")
    angles = {(r.cell_id % grid.nx, r.cell_id // grid.nx): r for r in gridops.consistency(df, "v", grid).collect()}
    for (i, j), v in cells.items():
        found = [w for a, b in near(i, j) if (w := at(cells, grid, i + a, j + b)) is not None]
        others = [w for a, b in near(i, j) if (a, b) != (0, 0) and (w := at(cells, grid, i + a, j + b)) is not None]
        assert got[i, j].smoothed == (None if v is None else pytest.approx(sum(found) / len(found)))
        if v is None or not others:
            assert (i, j) not in angles
        else:
            want = sum(math.cos(math.radians(v - w)) for w in others) / len(others)
            assert angles[i, j].neighbours == len(others) and angles[i, j].consistency == pytest.approx(want)


@pytest.mark.parametrize("side", [5, 256])
@pytest.mark.parametrize("name", ["plain", "periodic"])
def test_gradient(spark, name, side, monkeypatch):
    monkeypatch.setattr(tiles.stencil, "__defaults__", (1, side))
    grid = GRIDS[name]
    cells, df = field(spark, grid)
    space = Space(grid.periodic, "km")
    place = lambda i, j: (grid.x_min + (i % grid.nx + 0.5) * grid.dx, grid.y_min + (j + 0.5) * grid.dy)
    for r in gridops.gradient(df, "v", grid, space).collect():
        for axis, a, b in (("east", 1, 0), ("north", 0, 1)):
            up, down = at(cells, grid, r.x_bin + a, r.y_bin + b), at(cells, grid, r.x_bin - a, r.y_bin - b)
            method = "undefined" if r.v is None or up is None and down is None else "centred" if None not in (up, down) else "one_sided"
            assert r[f"gradient_{axis}_method"] == method
            if method == "undefined":
                assert r[f"gradient_{axis}"] is None
                continue
            p = place(r.x_bin - a, r.y_bin - b) if down is not None else (r.x, r.y)
            q = place(r.x_bin + a, r.y_bin + b) if up is not None else (r.x, r.y)
            length = float(inverse(*p, *q)[2]) / 1000 if grid.periodic else math.hypot(q[0] - p[0], q[1] - p[1])
            assert r[f"gradient_{axis}"] == pytest.approx(((up if up is not None else r.v) - (down if down is not None else r.v)) / length)


@pytest.mark.parametrize("side", [4, 256])
@pytest.mark.parametrize("name", GRIDS)
def test_samples(spark, name, side, monkeypatch):
    monkeypatch.setattr(tiles.sampled, "__defaults__", (side,))
    grid = GRIDS[name]
    cells, df = field(spark, grid)
    rng = np.random.default_rng(6)
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(rng.uniform(grid.x_min - 1, grid.x_max + 1, 400), rng.uniform(grid.y_min - 1, grid.y_max + 1, 400)))]
    points += [(1000 + k, grid.x_min + (i + 0.5) * grid.dx, grid.y_min + (j + 0.5) * grid.dy) for k, (i, j) in enumerate(cells)] + [(5000, None, 1.0), (5001, 1.0, None)]
    got = {r.k: r for r in gridops.sample(spark.createDataFrame(points, "k long, px double, py double"), ["k"], df, ["v"], grid).collect()}
    assert len(got) == len(points)
    for k, x, y in points:
        if x is None or y is None:
            assert got[k].v is None
            continue
        gx, gy = (x - grid.x_min) / grid.dx - 0.5, (y - grid.y_min) / grid.dy - 0.5
        gx = gx % grid.nx if grid.periodic else gx
        out = not -1e-10 <= gy <= grid.ny - 1 + 1e-10 or not grid.periodic and not -1e-10 <= gx <= grid.nx - 1 + 1e-10
        assert got[k].boundary == out
        i, j = math.floor(gx), math.floor(gy)
        fx, fy = gx - i, gy - j
        corners = [(w, at(cells, grid, i + a, j + b)) for a, b, w in ((0, 0, (1 - fx) * (1 - fy)), (1, 0, fx * (1 - fy)), (0, 1, (1 - fx) * fy), (1, 1, fx * fy)) if w > 1e-10]
        if out or any(v is None for _, v in corners):
            assert got[k].v is None
        else:
            assert got[k].v == pytest.approx(sum(w * v for w, v in corners), abs=1e-9)


def test_no_cells(spark):
    grid = GRIDS["plain"]
    _, df = field(spark, grid)
    none = df.filter("false")
    assert gridops.smooth(none, "v", grid).count() == gridops.consistency(none, "v", grid).count() == gridops.gradient(none, "v", grid, Space()).count() == 0
    points = spark.createDataFrame([(1, 3.3, 3.3)], "k long, px double, py double")
    assert gridops.sample(points, ["k"], none, ["v"], grid).first().v is None
