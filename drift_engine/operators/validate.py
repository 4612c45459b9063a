"""Checks of a transition matrix: row flags, per-source normalisation, a summary; nothing is repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drift_engine.functions.angles import number
from drift_engine.functions.geodesy import Grid

BINS = ["start_x_bin", "start_y_bin", "end_x_bin", "end_y_bin"]
CENTRES = ["start_x_center", "start_y_center", "end_x_center", "end_y_center"]
COLUMNS = [*BINS, *CENTRES, "transition_count", "transition_probability"]


class MatrixError(ValueError):
    """A matrix that does not pass."""


def schema_errors(table: DataFrame) -> list[str]:
    """Missing columns, or else columns of another type than whole numbers (bins, count) and numbers."""
    if missing := [c for c in COLUMNS if c not in table.columns]:
        return [f"missing_columns:{','.join(missing)}"]
    kinds = dict(table.dtypes)
    whole = {"bigint", "int", "smallint", "tinyint"}
    wrong = [c for c in [*BINS, "transition_count"] if kinds[c] not in whole]
    wrong += [c for c in [*CENTRES, "transition_probability"] if kinds[c] not in whole | {"double", "float"}]
    return [f"invalid_dtype:{c}" for c in wrong]


def flagged(table: DataFrame, grid: Grid, normalization_atol: float = 1e-12, probability_rtol: float = 1e-10, probability_atol: float = 1e-12, center_atol: float = 1e-9) -> DataFrame:
    """table with `flags`: the names of the checks that each link fails, joined by ';'."""
    source = Window.partitionBy("start_x_bin", "start_y_bin")
    same = Window.partitionBy(*BINS)
    numbers = [number(c) for c in [*CENTRES, "transition_probability"]]
    odd = F.lit(False)
    for c in [*[F.col(b) for b in [*BINS, "transition_count"]], *numbers]:
        odd = odd | c.isNull()
    p, n = number("transition_probability"), F.col("transition_count")
    bounds = F.lit(False)
    for b in BINS:
        bounds = bounds | (F.col(b) < 0) | (F.col(b) >= (grid.nx if "_x_" in b else grid.ny))
    off = F.lit(False)
    for b, c in zip(BINS, CENTRES):
        centre = (grid.x_center if "_x_" in b else grid.y_center)(F.col(b))
        off = off | (F.abs(number(c) - centre) > center_atol)
    expected = F.try_divide(n, F.sum("transition_count").over(source))
    total = F.sum(p).over(source)
    checks = {
        "non_finite": odd,
        "invalid_count": n <= 0,
        "probability_range": (p < 0) | (p > 1),
        "duplicate_key": F.count("*").over(same) > 1,
        "bin_bounds": bounds,
        "grid_center": off,
        "count_probability": F.abs(p - expected) > probability_atol + probability_rtol * F.abs(expected),
        "row_normalization": F.abs(total - 1.0) > normalization_atol,
    }
    names = [F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]
    return table.withColumn("flags", F.concat_ws(";", *names))


def row_sums(table: DataFrame) -> DataFrame:
    """Per source cell: links, transitions, probability_sum and its residual."""
    out = table.groupBy("start_x_bin", "start_y_bin").agg(F.count("*").alias("links"), F.sum("transition_count").alias("transitions"), F.sum("transition_probability").alias("probability_sum"))
    return out.withColumn("residual", F.abs(F.col("probability_sum") - 1.0))


def summary(table: DataFrame, grid: Grid) -> DataFrame:
    """One row: links, sources, transitions, and the largest residuals of centres, of probabilities against counts, and of each source's sum of probabilities."""
    p, n = F.col("transition_probability"), F.col("transition_count")
    source = Window.partitionBy("start_x_bin", "start_y_bin")
    off = [F.abs(F.col(c) - (grid.x_center if "_x_" in b else grid.y_center)(F.col(b))) for b, c in zip(BINS, CENTRES)]
    rows = table.withColumn("_p", F.abs(p - n / F.sum(n).over(source))).withColumn("_off", F.greatest(*off))
    links = rows.agg(F.count("*").alias("links"), F.sum("transition_count").alias("transitions"), F.max("_off").alias("largest_centre_residual"), F.max("_p").alias("largest_probability_residual"))
    return links.crossJoin(F.broadcast(row_sums(table).agg(F.count("*").alias("sources"), F.max("residual").alias("largest_normalisation_residual"))))


def validate(table: DataFrame, grid: Grid, **tolerances) -> None:
    """Raises MatrixError with the counted flags if a link fails a check."""
    errors = schema_errors(table)
    if not errors:
        found = flagged(table, grid, **tolerances).filter("flags <> ''").select(F.explode(F.split("flags", ";")).alias("flag")).groupBy("flag").count().collect()
        errors = sorted(f"{r['flag']}:{r['count']}" for r in found)
        if not errors and table.isEmpty():
            errors = ["empty_transition_table"]
    if errors:
        raise MatrixError("; ".join(errors))
