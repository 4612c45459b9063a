"""Tracks and the transition matrix on hand-made inputs: a 4 x 4 grid of unit cells, lag 2 s."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from drift_engine.functions.geodesy import Grid, Space
from drift_engine.operators import cellstats, matrix, tracks, validate

GRID = Grid(0, 4, 0, 4, 1, 1)


def track(spark, xs, ts=None, name="a", y=0.5):
    ts = ts or list(range(len(xs)))
    return spark.createDataFrame([(name, float(t), float(x), y) for t, x in zip(ts, xs)], "trajectory string, time double, x double, y double")


def counts(segs, grid=GRID):
    return {(r.start_x_bin, r.end_x_bin): r.transition_count for r in matrix.transition_matrix(segs, grid).collect()}


def test_modes(spark):
    t = track(spark, [0.2, 0.3, 1.2, 1.3, 2.2])
    assert counts(matrix.segments(t, 2.0)) == {(0, 1): 1, (1, 2): 1}
    assert counts(matrix.segments(t, 2.0, "every_observation")) == {(0, 1): 2, (1, 2): 1}


def test_interpolation(spark):
    t = track(spark, [0.5, 1.5, 2.5], [0, 2, 4])
    segs = matrix.segments(t, 3.0)
    assert counts(segs) == {(0, 2): 1}
    d = matrix.matrix_diagnostics(segs, GRID).first()
    assert (d.exact_endpoints, d.interpolated_endpoints) == (1, 1)
    assert matrix.source_timestep(t).first().timestep == 2.0


def test_gap(spark):
    t = track(spark, [0.5] * 6, [0, 1, 5, 6, 7, 8])
    d = matrix.matrix_diagnostics(matrix.segments(t, 1.0, max_gap=1.0), GRID).first()
    assert (d.retained_segments, d.candidate_segments, d.rejected_gap, d.gap_endpoints) == (4, 8, 4, 6)


def test_outside(spark):
    t = track(spark, [0.5, 4.0])
    assert matrix.transition_matrix(matrix.segments(t, 1.0), GRID).count() == 0
    d = matrix.matrix_diagnostics(matrix.segments(t, 1.0), GRID).first()
    assert (d.rejected_outside, d.outside_start, d.outside_end) == (1, 0, 1)


@pytest.mark.parametrize("xs", [[179.0, -179.0], [359.0, 361.0]])
def test_seam(spark, xs):
    grid = Grid(-180, 180, -90, 90, 1, 1, True)
    segs = matrix.segments(track(spark, xs, [0, 2]), 1.0, geographic=True)
    got = matrix.transition_matrix(segs, grid).collect()
    assert sum(r.transition_count for r in got) == 2


def test_half_a_turn(spark):
    """Half a turn keeps its direction; one spacing of doubles more, and the other way is shorter."""
    over = 180.00000000000003
    for xs, middle in (([-85.0, 95.0], 5.0), ([95.0, -85.0], 5.0), ([0.0, over], -90.0), ([0.0, -over], 90.0), ([10.0, 370.0 + 40.0], 30.0), ([0.0, 540.0], 90.0)):
        end = matrix.segments(track(spark, xs, [0, 2]), 1.0, geographic=True).orderBy("k").first().end
        assert abs((end.x - middle + 180) % 360 - 180) < 1e-9, (xs, end.x)


def test_cells_of_half_a_turn(spark):
    """The cells of a track just over half a turn long lie on its shorter way."""
    grid = Grid(-180, 180, -90, 90, 10, 10, True)
    segs = matrix.segments(track(spark, [0.0, 180.00000000000003], [0, 2]), 1.0, geographic=True)
    links = cellstats.enriched_links(matrix.transition_matrix(segs, grid), grid, Space(True, "km"))
    cells = cellstats.cell_statistics(links, grid, 1.0)
    # From the cell of 0 by that of -90 to that of the seam; the other way leads by that of +90.
    assert sorted(r.cell_id % 36 for r in cells.collect()) == [0, 9, 18]


def test_every_observation_sorts_twice(spark):
    """A task holds the sorted track and the sorted merge of it with its targets, and no more copies."""
    segs = matrix.segments(track(spark, [0.2, 0.3, 1.2, 1.3, 2.2]), 2.0, "every_observation")
    plan = segs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2 and "Union" not in plan
    assert [(r.k, r.end.status, r.end.x) for r in segs.orderBy("k").collect()] == [(0, "exact", 1.2), (1, "exact", 1.3), (2, "exact", 2.2), (3, "missing", None)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 7), min_size=2, max_size=12), st.integers(1, 5))
def test_modes_reconcile(spark, steps, lag):
    ts = [0]
    for s in steps:
        ts.append(ts[-1] + s)
    t = track(spark, [0.5] * len(ts), ts)
    for mode in ("non_overlapping", "every_observation"):
        d = matrix.matrix_diagnostics(matrix.segments(t, float(lag), mode), GRID).first()
        fates = d.rejected_missing + d.rejected_gap + d.rejected_outside + d.retained_segments
        ends = d.exact_endpoints + d.interpolated_endpoints + d.missing_endpoints + d.gap_endpoints
        assert fates == d.candidate_segments and ends == 2 * d.candidate_segments
        assert d.candidate_segments == (ts[-1] // lag if mode == "non_overlapping" else len(ts) - 1)


def test_dirty_rows(spark):
    rows = [("1", 2.0, 0.5), ("1", 0.0, float("inf")), ("1", 0.0, 0.5), ("1", 4.0, 1.5), ("1", 4.0, 9.0), ("2", 0.0, 1.0), ("3", float("nan"), 1.0), (" ", 0.0, 1.0)]
    raw = spark.createDataFrame([(a, t, x, 0.5, i) for i, (a, t, x) in enumerate(rows)], "trajectory string, time double, x double, y double, row_index long")
    raw = raw.select(tracks.identity("trajectory").alias("trajectory"), tracks.number("time").alias("time"), tracks.number("x").alias("x"), "y", "row_index")
    got = [(r.time, r.x) for r in tracks.sanitise(raw).orderBy("time").collect()]
    assert got == [(0.0, 0.5), (2.0, 0.5), (4.0, 1.5)]
    d = tracks.diagnostics(raw).first()
    assert (d.invalid_observations, d.duplicate_observations, d.short_trajectories, d.discarded_empty_trajectories) == (3, 1, 1, 1)


def test_validation(spark):
    good = matrix.transition_matrix(matrix.segments(track(spark, [0.2, 0.3, 1.2, 1.3, 2.2]), 1.0), GRID)
    validate.validate(good, GRID)
    bad = {
        "duplicate_key": good.union(good),
        "invalid_count": good.withColumn("transition_count", -F.col("transition_count")),
        "row_normalization": good.withColumn("transition_probability", F.col("transition_probability") * 0.5),
        "grid_center": good.withColumn("start_x_center", F.col("start_x_center") + 0.1),
        "non_finite": good.withColumn("end_y_center", F.lit(float("nan"))),
    }
    for flag, table in bad.items():
        with pytest.raises(validate.MatrixError, match=flag):
            validate.validate(table, GRID)
    with pytest.raises(validate.MatrixError, match="missing_columns"):
        validate.validate(good.drop("end_x_bin"), GRID)


def test_guard(spark):
    good = track(spark, [0.5, 1.5])
    assert matrix.require_canonical(good) is good
    bad = [("a", 0.0, 0.5), ("a", 0.0, 0.6), (None, 1.0, 0.5), ("b", 0.0, float("nan"))]
    rows = spark.createDataFrame([(a, t, x, 0.5) for a, t, x in bad], "trajectory string, time double, x double, y double")
    assert matrix.check_tracks(rows).first().asDict() == {"null_identities": 1, "not_finite": 1, "repeated_times": 1, "short_tracks": 2}
    with pytest.raises(ValueError, match="repeated_times"):
        matrix.require_canonical(rows)


def test_a_year_without_observations(spark):
    """With a lag of a second, a gap of a year is counted, not listed; without a limit it is listed in parts."""
    year = 365 * 86400
    t = track(spark, [0.5, 0.5, 1.5, 1.5], [0, 1, year, year + 2])
    segs = matrix.segments(t, 1.0, max_gap=10.0)
    assert segs.count() < 20
    d = matrix.matrix_diagnostics(segs, GRID).first()
    # from second 1, which is there, all that touches the gap is rejected
    assert (d.candidate_segments, d.retained_segments, d.rejected_gap) == (year + 2, 3, year - 1)
    assert d.exact_endpoints + d.interpolated_endpoints + d.gap_endpoints == 2 * (year + 2)
    some = track(spark, [0.5, 0.5], [0, 20000])
    assert matrix.matrix_diagnostics(matrix.segments(some, 1.0), GRID).first().retained_segments == 20000


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 40), min_size=1, max_size=6), st.integers(1, 12))
def test_gaps_counted_as_listed(spark, steps, most):
    """The counters with wide gaps folded up are those of every multiple looked at alone."""
    ts = [0]
    for s in steps:
        ts.append(ts[-1] + s)
    got = matrix.matrix_diagnostics(matrix.segments(track(spark, [0.5] * len(ts), ts), 1.0, max_gap=float(most)), GRID).first()
    gap = lambda k: k not in ts and next(b - a for a, b in zip(ts, ts[1:]) if a < k < b) > most
    fates = [gap(k) or gap(k + 1) for k in range(ts[-1])]
    assert (got.candidate_segments, got.rejected_gap, got.retained_segments) == (len(fates), sum(fates), len(fates) - sum(fates))
    assert got.gap_endpoints == sum(gap(k) + gap(k + 1) for k in range(ts[-1]))


def test_long_track_every_observation(spark):
    """100 000 observations of one track: running values, not a frame for each row."""
    t = spark.range(100_000).selectExpr("'a' as trajectory", "cast(id as double) as time", "0.5 + pmod(id, 3) as x", "0.5D as y")
    d = matrix.matrix_diagnostics(matrix.segments(t, 1.5, "every_observation"), GRID).first()
    assert (d.candidate_segments, d.interpolated_endpoints) == (99_999, 99_998)
