"""Tracks cut into parts give what whole tracks give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from drift_engine.operators import matrix, parts, tracks
from drift_engine.plans import presets, queries


def walks(spark, member=False):
    """Tracks of 1 to 400 observations with dense and sparse stretches, long gaps, times on the lag's multiples, and repeats."""
    rng = np.random.default_rng(4)
    rows = []
    for k, n in enumerate([400, 251, 90, 40, 7, 2, 1]):
        gaps = rng.choice([0.1, 0.25, 0.5, 1.0, 3.0, 40.0], n, p=[0.3, 0.3, 0.2, 0.1, 0.08, 0.02])
        t = np.cumsum(gaps) + 5.0
        x, y = np.cumsum(rng.normal(0, 8, n)) % 360 - 180, rng.uniform(-60, 60, n)
        rows += [(f"t{k}", float(a), float(b), float(c), i, f"m{k % 2}") for i, (a, b, c) in enumerate(zip(t, x, y))]
    rows += [(r[0], r[1], r[2] + 1, r[3], r[4] + 10_000, r[5]) for r in rows[::17]] + [(None, 1.0, 0.0, 0.0, 0, "m0"), ("t0", None, 0.0, 0.0, 1, "m0"), ("t1", 9.0, None, 0.0, 1, "m1")]
    df = spark.createDataFrame(rows, "trajectory string, time double, x double, y double, obs long, group_member string").repartition(3)
    return df if member else df.drop("group_member")


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("member", [False, True])
@pytest.mark.parametrize("part_rows", [25, 60])
def test_parts_are_as_the_whole(spark, part_rows, member):
    raw = walks(spark, member)
    long = parts.crowds(raw, part_rows)
    assert long.tracks == (4 if part_rows == 25 else 3)
    whole, cut = tracks.sanitise(raw), tracks.sanitise(raw, crowds=long)
    assert rows_of(cut) == rows_of(whole)
    assert rows_of(tracks.diagnostics(raw, crowds=long)) == rows_of(tracks.diagnostics(raw))
    assert rows_of(matrix.source_timestep(whole, long)) == rows_of(matrix.source_timestep(whole))
    for mode in ("non_overlapping", "every_observation"):
        for lag, gap in ((1.0, None), (0.5, 2.0), (7.0, 5.0)):
            assert rows_of(matrix.segments(whole, lag, mode, True, gap, long)) == rows_of(matrix.segments(whole, lag, mode, True, gap))


def test_a_long_track_is_spread_over_tasks(spark):
    """No range holds much more than its share, and no window orders more than a part."""
    raw = spark.range(60_000).select(F.lit("one").alias("trajectory"), (F.col("id") * 0.25).alias("time"), (F.col("id") % 97).cast("double").alias("x"), F.lit(1.0).alias("y"))
    long = parts.crowds(raw, 5_000)
    ranges = long.cut(raw, ["time"], "test-ranges").groupBy("part").count().collect()
    assert len(ranges) == 12 and max(r["count"] for r in ranges) < 10_000
    for mode in ("non_overlapping", "every_observation"):
        assert rows_of(matrix.segments(raw, 1.0, mode, False, None, long).groupBy("start", "end").count()) == rows_of(matrix.segments(raw, 1.0, mode).groupBy("start", "end").count())


def test_short_parts_share_tasks(spark):
    """The tasks of a cut, and the files it stores, come from its rows, not from how short the parts are."""
    raw = spark.range(8_000).select((F.col("id") % 40).cast("string").alias("trajectory"), (F.col("id") * 0.5).alias("time"), F.lit(0.0).alias("x"), F.lit(1.0).alias("y")).repartition(3)
    cut = parts.crowds(raw, 16).cut(raw, ["time"], "test-short")
    assert cut.select(F.input_file_name()).distinct().count() <= 2
    per = cut.groupBy("part").count().collect()
    assert 500 <= len(per) <= 504 and max(r["count"] for r in per) <= 16
    held = cut.groupBy("trajectory", "part").agg(F.min("time").alias("a"), F.max("time").alias("b")).collect()
    held = sorted((r.trajectory, r.part, r.a, r.b) for r in held)
    assert all(one[3] < two[2] for one, two in zip(held, held[1:]) if one[0] == two[0])


@pytest.mark.parametrize("name", ["mat_parts_nonoverlap", "mat_parts_every_obs", "mat_parts_gaps"])
def test_rows_are_made_once(spark, monkeypatch, name):
    """However many passes a parted query takes, it works its rows out once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return x

    rows = walks(spark).withColumn("time", F.col("time") * 40_000.0)
    monkeypatch.setattr(presets, "events_raw", lambda *_: rows.withColumn("x", counted("x")))
    found = queries.QUERIES[name](spark, "").collect()
    assert found and made.value == rows.count()
    segs = matrix.segments(tracks.sanitise(rows), presets.DAY, "every_observation" if name == "mat_parts_every_obs" else "non_overlapping", False, queries.GAP if name == "mat_parts_gaps" else None)
    whole = matrix.matrix_diagnostics(segs, presets.GRID_E) if name == "mat_parts_gaps" else matrix.transition_matrix(segs, presets.GRID_E)
    shared = [c for c in found[0].asDict() if c != "transition_probability"]
    assert sorted(tuple(r[c] for c in shared) for r in found) == sorted(tuple(r) for r in whole.select(*shared).collect())


def test_a_track_is_shuffled_once(spark):
    """Equal times with the track's first and last one, and brackets with the track's end, take one shuffle each."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    raw = walks(spark)
    assert plan(tracks.sanitise(raw)).count("Exchange hashpartitioning") == 1
    points = plan(matrix.segments(raw, 0.5, "non_overlapping", True, 2.0))
    assert points.count("Exchange hashpartitioning") == 1 and points.count(" Window [") == 2
    # Functions of arrays are worked row by row outside the generated code.
    assert "lambda" not in points


@pytest.mark.parametrize("lag, gap", [(0.1, None), (0.1, 0.7), (0.3, 2.0), (1 / 3, None), (1e6, None)])
def test_multiples_are_those_of_plain_loops(spark, lag, gap):
    """Each multiple of the lag up to the track's end is found once, in steps that rounding may shift."""
    rng = np.random.default_rng(5)
    times = {f"t{i}": [0.0, *np.cumsum(rng.choice([0.1, 0.3, 0.05, 1 / 3, 2.5], 60)).tolist()] for i in range(4)} | {"even": [k * lag for k in range(20)], "two": [0.0, 0.25]}
    rows = spark.createDataFrame([(k, float(t), float(t), 0.0) for k, ts in times.items() for t in ts], "trajectory string, time double, x double, y double")
    found = matrix.segments(rows, lag, "non_overlapping", False, gap).collect()
    counts = {k: int(np.floor(ts[-1] / lag + np.spacing(ts[-1] / lag))) for k, ts in times.items()}
    for k, n in counts.items():
        own = sorted((r.k, r.copies) for r in found if r.trajectory == k)
        assert [j for a, copies in own for j in range(a, a + copies)] == list(range(n))
        if gap is None:
            assert all(r.start.x == pytest.approx(r.k * lag, abs=1e-9) and r.end.x == pytest.approx((r.k + 1) * lag, abs=1e-9) for r in found if r.trajectory == k)


def test_no_long_tracks(spark):
    assert parts.crowds(walks(spark)) is None
    assert parts.crowds(walks(spark).filter("trajectory is null"), 0) is None
