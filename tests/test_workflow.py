"""Settings, readers and whole runs."""

import json
import struct
import zlib

import numpy as np
import pytest
import yaml

from drift_engine.functions.geodesy import Space
from drift_engine.operators import directional, matrix, ridge
from drift_engine.plans import config, queries, workflow
from drift_engine.sources import array_source, arrays, auxiliary, naming, trajectories
from drift_engine.storage import materialise
from test_tank import tank

SETTINGS = {
    "config_version": 1,
    "input": {"paths": ["t.csv"], "columns": {"trajectory": "track", "time": "t", "x": "X", "y": "Y"}, "time": {"kind": "numeric", "unit": "s"}},
    "matrix": {"timestep": 2, "time_unit": "s"},
    "geometry": {"coordinate_system": "cartesian", "length_unit": "m"},
    "grid": {"x_min": 0.0, "x_max": 6.0, "y_min": 0.0, "y_max": 6.0, "dx": 1.0, "dy": 1.0},
    "statistics": {"min_moving_support": 1},
    "output": {"root": "out", "run_name": "one"},
}


def changed(path, value):
    values = json.loads(json.dumps(SETTINGS))
    at = values
    for k in path[:-1]:
        at = at.setdefault(k, {})
    at[path[-1]] = value
    return values


@pytest.mark.parametrize(
    "path, value",
    [
        (("surprise",), 1),
        (("matrix", "timestep"), 0),
        (("matrix", "timestep"), True),
        (("matrix", "time_unit"), "week"),
        (("grid", "dx"), 0.7),
        (("grid", "periodic_longitude"), True),
        (("input", "time", "unit"), None),
        (("input", "columns", "y"), "X"),
        (("geometry", "ellipsoid"), "WGS84"),
        (("flux",), {"percentile": 1.5}),
        (("fronts",), {"robust_median_window_samples": 2}),
        (("transport",), {}),
        (("config_version",), 2),
    ],
)
def test_strict(path, value):
    with pytest.raises(config.ConfigError):
        config.from_dict(changed(path, value))


def test_defaults():
    c = config.from_dict(SETTINGS)
    assert c.lag == 2.0 and c.fronts.half_width_grid_scales == 5 and c.engine_grid.nx == 6
    assert config.from_dict(config.as_dict(c)) == c


def frame():
    return [(f"{k:03d}", 2.0 * t, 0.5 + t + 0.1 * k, 0.5 + k % 5) for k in range(8) for t in range(5)]


def write_zarr(root, name, data, dims, compress):
    d = root / name
    d.mkdir(parents=True)
    (d / ".zarray").write_text(json.dumps({"shape": data.shape, "chunks": data.shape, "dtype": data.dtype.str, "compressor": {"id": "zlib"} if compress else None, "fill_value": "NaN", "filters": None, "order": "C", "zarr_format": 2}))
    (d / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims}))
    (d / ".".join("0" * data.ndim)).write_bytes(zlib.compress(data.tobytes()) if compress else data.tobytes())


def write_netcdf(path, dims, variables):
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    names = list(dims)
    head = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, len(dims)) + b"".join(text(n) + struct.pack(">i", s) for n, s in dims.items()) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, len(variables))

    def table(start):
        out = b""
        for name, (data, own) in variables.items():
            out += text(name) + struct.pack(">i", len(own)) + b"".join(struct.pack(">i", names.index(d)) for d in own) + struct.pack(">ii", 0, 0) + struct.pack(">iii", 6, data.size * 8, start)
            start += data.size * 8
        return out

    size = len(head) + len(table(0))
    path.write_bytes(head + table(size) + b"".join(d.astype(">f8").tobytes() for d, _ in variables.values()))


def test_readers_agree(spark, tmp_path):
    rows = frame()
    df = spark.createDataFrame(rows, "track string, t double, X double, Y double")
    df.coalesce(1).toPandas().to_csv(tmp_path / "t.csv", index=False)
    df.coalesce(1).toPandas().to_parquet(tmp_path / "t.parquet")
    x, y = (np.array([r[i] for r in rows]).reshape(8, 5) for i in (2, 3))
    t, who = np.arange(5) * 2.0, np.arange(8.0)
    for name, compress in (("raw.zarr", False), ("packed.zarr", True)):
        for n, (data, dims) in {"X": (x, ["track", "obs"]), "Y": (y, ["track", "obs"]), "t": (t, ["obs"])}.items():
            write_zarr(tmp_path / name, n, data, dims, compress)
    write_netcdf(tmp_path / "t.nc", {"track": 8, "obs": 5}, {"X": (x, ["track", "obs"]), "Y": (y, ["track", "obs"]), "t": (t, ["obs"]), "track": (who, ["track"])})
    got = {}
    for name in ("t.csv", "t.parquet", "raw.zarr", "packed.zarr", "t.nc"):
        c = config.from_dict(changed(("input", "paths"), [str(tmp_path / name)]))
        found = trajectories.read(spark, c.input).collect()
        got[name] = sorted((r.time, r.x, r.y) for r in found)
        assert len({r.trajectory for r in found}) == 8
    assert len(set(map(tuple, got.values()))) == 1
    assert {r.trajectory for r in trajectories.read(spark, config.from_dict(changed(("input", "paths"), [str(tmp_path / "t.csv")])).input).collect()} >= {'["t.csv", "001"]'}
    with pytest.raises(FileNotFoundError):
        trajectories.resolve((str(tmp_path / "none*.csv"),))
    flat = lambda *dims: arrays.Variable(list(dims), (2,) * len(dims), np.dtype(float), {}, lambda a, b: np.zeros((2,) * len(dims))[a:b])
    with pytest.raises(ValueError):
        arrays.flattened({"X": flat("a"), "Y": flat("b")}, ["X", "Y"], "X", "Y")


def test_arrays_are_read_in_parts(spark, tmp_path, monkeypatch):
    """Parts of a few rows, of chunked Zarr and of NetCDF, give the rows of the whole, in their order."""
    monkeypatch.setattr(arrays, "SLAB_VALUES", 15)
    x, y, t = np.arange(40.0).reshape(8, 5), np.arange(40.0).reshape(8, 5) / 7, np.arange(5) * 2.0
    d = tmp_path / "c.zarr" / "X"
    write_zarr(tmp_path / "c.zarr", "Y", y, ["track", "obs"], True)
    write_zarr(tmp_path / "c.zarr", "t", t, ["obs"], False)
    d.mkdir(parents=True)
    (d / ".zarray").write_text(json.dumps({"shape": [8, 5], "chunks": [2, 3], "dtype": "<f8", "compressor": None, "fill_value": "NaN", "filters": None, "order": "C", "zarr_format": 2}))
    (d / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": ["track", "obs"]}))
    for i in range(4):
        for j in range(2):
            block = np.full((2, 3), np.nan)
            part = x[2 * i : 2 * i + 2, 3 * j : 3 * j + 3]
            block[:, : part.shape[1]] = part
            (d / f"{i}.{j}").write_bytes(block.tobytes())
    write_netcdf(tmp_path / "c.nc", {"track": 8, "obs": 5}, {"X": (x, ["track", "obs"]), "Y": (y, ["track", "obs"]), "t": (t, ["obs"])})
    for name in ("c.zarr", "c.nc"):
        found = array_source.load(spark, str(tmp_path / name), ["track", "t", "X", "Y"], "X", "Y")
        assert found.rdd.getNumPartitions() >= (1 if name == "c.zarr" else 2)
        rows = sorted((r.row_index, r.track, r.t, r.X, r.Y) for r in found.collect())
        assert rows == [(k, float(k // 5), t[k % 5], float(x.ravel()[k]), float(y.ravel()[k])) for k in range(40)]


def test_auxiliary_readers(spark, tmp_path):
    lat, lon, field = np.arange(3.0), np.array([170.0, 190.0]), np.arange(6.0).reshape(3, 2)
    line = np.array([179.0, 181.0, np.nan])
    write_netcdf(tmp_path / "m.nc", {"lat": 3, "lon": 2, "n": 3}, {"lat": (lat, ["lat"]), "lon": (lon, ["lon"]), "temp": (field, ["lat", "lon"]), "LonA": (line, ["n"]), "LatA": (lat, ["n"])})
    got = sorted((r.lat, r.lon, r.value) for r in auxiliary.gridded_field(spark, str(tmp_path / "m.nc"), "temp").collect())
    assert got == [(float(i), lon[j], float(2 * i + j)) for i in range(3) for j in range(2)]
    found = auxiliary.polylines(spark, str(tmp_path / "m.nc"), {"A": ("LonA", "LatA")}).orderBy("place").collect()
    assert [(r.line, r.lon, r.lat) for r in found] == [("A", 179.0, 0.0), ("A", -179.0, 1.0)]
    for wrong in (lambda: auxiliary.gridded_field(spark, str(tmp_path / "m.nc"), "salt"), lambda: auxiliary.gridded_field(spark, str(tmp_path / "m.nc"), "LonA"), lambda: auxiliary.polylines(spark, str(tmp_path / "m.nc"), {"B": ("LonB", "LatB")})):
        with pytest.raises(ValueError):
            wrong()


def test_load_equals_compute(spark, tmp_path):
    spark.createDataFrame(frame(), "track string, t double, X double, Y double").toPandas().to_csv(tmp_path / "t.csv", index=False)
    more = {"run_validation": True, "write_debug_outputs": True, "plotting": {"enabled": True, "vector_stride_cells": 2}, "analysis_version": "v7"}
    (tmp_path / "run.yaml").write_text(yaml.safe_dump(SETTINGS | more))
    out = workflow.run(spark, config.load(tmp_path / "run.yaml"))
    manifest = json.loads((out / "manifest.json").read_text())
    assert manifest["status"] == "completed" and manifest["rows"]["cell_statistics"] > 0 and manifest["analysis_version"] == "v7"
    assert set(workflow.FILES.values()) | {"candidate_drop_zones", "raw_cross_sections", "section_composites", "component_graph_details", "segment_front_candidates"} <= set(manifest["rows"]) and len(manifest["rows"]) == 21
    assert {"matrix", "alignment", "flux_fronts", "directional_cores", "gradient_validation", "comparison"} <= set(manifest["summaries"])
    assert (out / "analysis" / "figures" / "figures.yaml").exists()
    links = [(r.start_y_bin, r.start_x_bin, r.end_y_bin, r.end_x_bin) for r in spark.read.parquet(str(out / "matrix" / "transition_matrix.parquet")).collect()]
    assert links == sorted(links)
    again = changed(("matrix",), {"timestep": 2, "time_unit": "s", "compute": False, "path": str(out / "matrix" / "transition_matrix.parquet")}) | {"output": {"root": "out", "run_name": "two"}, "run_validation": True}
    (tmp_path / "again.yaml").write_text(yaml.safe_dump(again))
    second = workflow.run(spark, config.load(tmp_path / "again.yaml"))
    for name in ("cell_statistics", "flux_cores", "flux_fronts", "comparison"):
        a, b = (sorted(map(str, spark.read.parquet(str(o / "analysis" / f"{name}.parquet")).collect())) for o in (out, second))
        assert a == b
    with pytest.raises(FileExistsError):
        workflow.run(spark, config.load(tmp_path / "again.yaml"))
    (tmp_path / "bad.yaml").write_text(yaml.safe_dump(again | {"output": {"root": "out", "run_name": "bad"}, "matrix": {**again["matrix"], "timestep": 3}}))
    with pytest.raises(ValueError):
        workflow.run(spark, config.load(tmp_path / "bad.yaml"))
    assert json.loads((tmp_path / "out" / "bad" / "manifest.json").read_text())["status"] == "failed"


def test_rates_are_per_time_unit(spark):
    """A daily run in km: 111 km a day eastwards on the equator's row, not per second, under the names that users read."""
    rows = [(f"{k}", 86400.0 * t, 0.5 + t, 0.5) for k in range(3) for t in range(5)]
    values = changed(("matrix",), {"timestep": 1, "time_unit": "day"}) | {"geometry": {"coordinate_system": "geographic", "length_unit": "km"}}
    values["grid"] = {"longitude_min": 0.0, "longitude_max": 6.0, "latitude_min": 0.0, "latitude_max": 6.0, "dlon": 1.0, "dlat": 1.0, "periodic_longitude": False}
    cfg = config.from_dict(values)
    tracks_ = spark.createDataFrame(rows, "trajectory string, time double, x double, y double")
    table = matrix.transition_matrix(matrix.segments(matrix.require_canonical(tracks_), cfg.lag, geographic=True), cfg.engine_grid)
    found = workflow.analyse(materialise(table), cfg)
    cells = naming.public(found.cells, cfg.space, cfg.matrix.time_unit)
    assert {"start_lon_bin", "lon", "lat", "U_out_all_east_km_day", "U_out_all_magnitude_km_day", "D_out_all_north", "theta1_in_motion_destination"} <= set(cells.columns)
    assert {round(r["U_out_all_magnitude_km_day"], 2) for r in cells.filter("N_out_move > 0").collect()} == {111.32}
    fronts = naming.public(found.flux_fronts, cfg.space, cfg.matrix.time_unit)
    assert fronts.columns == ["core_cell_id", "component_id", "core_lon", "core_lat", "ridge_type", "side", "observable", "front_lon", "front_lat", "distance_from_core_km", "flux_loss_km_day", "relative_flux_loss", "front_detected", "front_status"]


def test_settings_reach_the_operators():
    """Each number of the fronts and of the validation that an operator reads changes what the operator is given."""
    plain = config.from_dict(SETTINGS)
    unread = {"normalization_atol", "probability_rtol", "probability_atol", "center_atol", "multiple_drop_similarity_fraction"}  # the matrix check reads four; nothing has a rule for the last
    for section, given in (("fronts", lambda c: c.fronts.sections()), ("validation", lambda c: c.validation.gradients())):
        for name, value in vars(getattr(plain, section)).items():
            if name not in unread:
                other = config.from_dict(changed((section,), {name: value / 2 if isinstance(value, float) or "interval" in name or "refinement" in name else value * 3}))
                assert given(other) != given(plain), name
    with pytest.raises(config.ConfigError):
        config.from_dict(changed(("fronts",), {"half_width_grid_scales": 2.5}))
    assert config.from_dict(changed(("fronts",), {"half_width_grid_scales": 2.5, "sampling_interval_grid_scales": 0.5})).fronts.sections().half_width == 2.5


def test_settings_have_an_effect(spark):
    """Every setting of the pathways changed at once, against the defaults, product by product; and a few alone on the operators that read them."""
    table = materialise(tank(spark))
    base = changed(("grid",), {"x_min": 0.0, "x_max": 11.0, "y_min": 0.0, "y_max": 11.0, "dx": 1.0, "dy": 1.0})
    other = base | {
        "directional": {"minimum_P_move": 0.3, "minimum_strength": 0.3, "maximum_step_direction_mismatch_degrees": 90.0, "maximum_neighbor_direction_difference_degrees": 10.0, "transverse_scale_grid": 2.0, "ridge_comparison_tolerance": 0.05, "ridge_plateau_tolerance": 0.5, "minimum_component_cells": 2},
        "flux": {"percentile": 0.5, "ridge_field": "smoothed", "transverse_scale_grid": 2.0, "ridge_comparison_tolerance": 0.05},
        "fronts": {"half_width_grid_scales": 3, "sampling_interval_grid_scales": 0.5, "core_refinement_grid_scales": 0.5},
        "statistics": {"min_moving_support": 12},
    }
    one, two = (workflow.analyse(table, config.from_dict(v)) for v in (base, other))
    for name in ("flux_cores", "flux_fronts", "directional_corridors", "directional_cores", "directional_fronts", "comparison"):
        a, b = (sorted(map(str, getattr(x, name).collect())) for x in (one, two))
        assert a != b, name
    cells, cfg = one.statistics, config.from_dict(base)
    grid, space = cfg.engine_grid, cfg.space
    found = cells.filter("N_out_move >= 20")
    edges = lambda **limits: directional.compatible_edges(found, grid, space, **limits).count()
    assert edges(mismatch=90.0) > edges() and edges(difference=10.0) <= edges()
    ridge_of = lambda **options: {r.cell_id: (r.core, r.threshold, r.orientation_reliable, r.orientation_ambiguous) for r in ridge.flux_ridge(cells, grid, space, 1, **options).collect()}
    plain = ridge_of()
    for option in ({"level": 0.5}, {"smoothed": True}, {"tie": 1.0}, {"reliable_r1": 1.5}, {"ambiguous_r1": 1.5}, {"policy": "two_sided_only", "scale": 3.0}):
        assert ridge_of(**option) != plain, option


def test_names():
    assert naming.public_name("U_out_all_magnitude_rate", Space(unit="km"), "day") == "U_out_all_magnitude_km_day"
    assert naming.public_name("mu_in_x", Space(True), "s") == "mu_in_east"
    assert naming.public_name("start_x_center", Space(True), "s") == "start_lon_center"


def test_oracles(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{sf}/events.parquet'")
    for name in ("san_sanitise", "mat_links_nonoverlap", "sup_counts", "s2_entropy", "dirv_vectors"):
        got, want = queries.QUERIES[name](spark, sf).toPandas(), db.execute(queries.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        order = lambda d: d[columns].sort_values(columns).reset_index(drop=True)
        for c in columns:
            a, b = order(got)[c], order(want)[c]
            assert (a.astype(str) == b.astype(str)).all() or np.allclose(a.astype(float), b.astype(float), equal_nan=True, atol=2e-6)
