"""The data source of array files: ranges and columns are decided before chunks are opened."""

import json

import numpy as np
import pytest

from drift_engine.plans import config
from drift_engine.sources import array_source, arrays, trajectories

ROWS, STEPS = 40, 6


def write(root, name, data, dims, rows, **attributes):
    """A variable in chunks of a few places of its first dimension."""
    d = root / name
    d.mkdir(parents=True)
    chunks = [rows, *data.shape[1:]]
    (d / ".zarray").write_text(json.dumps({"shape": data.shape, "chunks": chunks, "dtype": data.dtype.str, "compressor": None, "fill_value": "NaN" if data.dtype.kind == "f" else None, "filters": None, "order": "C", "zarr_format": 2}))
    (d / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims} | attributes))
    for k in range(0, len(data), rows):
        (d / ".".join([str(k // rows), *["0"] * (data.ndim - 1)])).write_bytes(np.ascontiguousarray(data[k : k + rows]).tobytes())


@pytest.fixture
def store(tmp_path):
    """40 tracks of 6 places; X grows with the track, Y repeats, one X in 7 is NaN."""
    x = np.arange(ROWS * STEPS, dtype=float).reshape(ROWS, STEPS)
    y = x % 11
    x[np.arange(ROWS * STEPS).reshape(ROWS, STEPS) % 7 == 3] = np.nan
    root = tmp_path / "s.zarr"
    for name, data in (("X", x), ("Y", y)):
        write(root, name, data, ["track", "obs"], 4)
    write(root, "t", np.arange(STEPS) * 0.5, ["obs"], STEPS, units="days since 2020-01-01")
    write(root, "who", np.array([f"n{k:02d}".encode() for k in range(ROWS)], "S3"), ["track"], 4)
    return root


def expected(store, keep):
    v = arrays.array_variables(str(store), "zarr")
    f = arrays.flattened(v, ["who", "t", "X", "Y"], "X", "Y")
    f["row_index"] = np.arange(len(f))
    return f[keep(f)]


def rows_of(df):
    return sorted((r.row_index, r.who, r.t.isoformat(), r.X if r.X == r.X else None, r.Y) for r in df.collect())


CASES = [
    {"X": (30, 61.5)},
    {"X": (200, None)},
    {"Y": (3, 3), "X": (None, 100)},
    {"Y": (None, None)},
    {"X": (None, None)},
    {"X": (-5, -1)},
]


def test_ranges_equal_plain_filters(spark, store, monkeypatch):
    monkeypatch.setattr(arrays, "SLAB_VALUES", 30)
    whole = array_source.load(spark, str(store), ["who", "t", "X", "Y"], "X", "Y")
    assert whole.rdd.getNumPartitions() == 5  # 30 values are 5 tracks; whole chunks are 8
    inf = float("inf")
    for within in CASES:

        def keep(f, within=within):
            inside = f.Y == f.Y
            for c, (low, high) in within.items():
                inside &= f[c].between(-inf if low is None else low, inf if high is None else high)
            return inside

        want = sorted((r.row_index, r.who, r.t.tz_localize(None).isoformat(), r.X if r.X == r.X else None, r.Y) for r in expected(store, keep).itertuples())
        assert rows_of(array_source.load(spark, str(store), ["who", "t", "X", "Y"], "X", "Y", within=within)) == want, within
    assert len(rows_of(whole)) == len(rows_of(whole.filter("X is not null"))) == ROWS * STEPS
    a, b = (array_source.load(spark, str(store), ["track", "Y"], "X", "Y", within={"track": (k, k + 1)}) for k in (3, 4))
    assert sorted(r.row_index for r in a.union(b).collect()) == sorted([*range(3 * STEPS, 5 * STEPS), *range(4 * STEPS, 6 * STEPS)])
    with pytest.raises(Exception, match="hold numbers"):
        array_source.load(spark, str(store), ["who", "Y"], "X", "Y", within={"who": (1, 2)}).count()


def test_ranges_skip_chunks(spark, store, monkeypatch):
    """Counted by a reader of its own; and through Spark, which never sees the broken chunks outside the range."""
    monkeypatch.setattr(arrays, "SLAB_VALUES", 30)
    opened = []
    plain = arrays.zarr_variable

    def counted(root, name):
        v = plain(root, name)
        read = v.read
        v.read = lambda a, b: (opened.append((name, a, b)) if b > a else None, read(a, b))[1]
        return v

    monkeypatch.setattr(arrays, "zarr_variable", counted)
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string("who string, track double, X double, Y double, row_index long")
    reader = array_source.ArrayReader(str(store), "zarr", "X", "Y", schema, {"track": (9, 10)}, 30)
    found = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in found) == 2 * STEPS
    assert sorted(opened) == [("X", 9, 11), ("Y", 9, 11), ("who", 9, 11)]

    for k in range(ROWS // 4):
        if k != 2:
            (store / "Y" / f"{k}.0").write_bytes(b"broken")
    load = lambda *within: array_source.load(spark, str(store), ["track", "Y"], "X", "Y", within={"track": within})
    assert load(8, 11).count() == 4 * STEPS
    with pytest.raises(Exception, match="buffer"):
        load(8, 12).count()


def test_all_formats_take_ranges(spark, store, tmp_path):
    """CSV, Parquet and Zarr give the same rows of a range, NaN outside of it."""
    f = expected(store, lambda f: f.Y == f.Y).assign(t=lambda f: f.t.astype("int64") / 1e6)
    f.to_csv(tmp_path / "s.csv", index=False)
    f.to_parquet(tmp_path / "s.parquet")
    for within in ({"X": (50, 90.5)}, {"X": (None, 90), "Y": (2, None)}):
        got = []
        for path, time in ((tmp_path / "s.csv", {"kind": "numeric", "unit": "s"}), (tmp_path / "s.parquet", {"kind": "numeric", "unit": "s"}), (store, {"kind": "datetime"})):
            given = {"paths": [str(path)], "columns": {"trajectory": "who", "time": "t", "x": "X", "y": "Y"}, "trajectory_id": {"mode": "column", "scope": "global"}, "time": time}
            got.append(sorted((r.trajectory, r.x, r.y) for r in trajectories.read(spark, config.input_of(given), within).collect()))
        assert got[0] and got[0] == got[1] == got[2]


def test_columns_and_plain_format(spark, store):
    """Variables that the given schema lacks are not opened; without one, all that positions' dimensions hold are columns."""
    array_source.register(spark)
    reader = spark.read.format(array_source.NAME).options(x="X", y="Y")
    assert [c for c, _ in reader.load(str(store)).dtypes] == ["obs", "track", "X", "Y", "t", "who", "row_index"]
    assert reader.load(str(store)).count() == ROWS * STEPS
    for f in (store / "X").iterdir():
        if not f.name.startswith("."):
            f.write_bytes(b"broken")
    assert reader.schema("Y double").load(str(store)).filter("Y = 3").count() == sum(k % 11 == 3 for k in range(ROWS * STEPS))
    with pytest.raises(Exception, match="no variable"):
        reader.schema("nothing double").load(str(store)).count()


def test_empty_arrays(spark, tmp_path):
    for name in "XY":
        write(tmp_path / "e.zarr", name, np.zeros((0, 3)), ["track", "obs"], 4)
    df = array_source.load(spark, str(tmp_path / "e.zarr"), ["track", "X", "Y"], "X", "Y")
    assert df.collect() == []
    assert array_source.load(spark, str(tmp_path / "e.zarr"), ["track", "X"], "X", "Y", within={"X": (1, None)}).collect() == []
