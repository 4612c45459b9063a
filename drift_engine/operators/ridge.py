"""Ridges: cells whose field is not below that at either side of their direction, and the thresholds and labels on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drift_engine.functions.angles import ratio
from drift_engine.functions.geodesy import Grid, Space, with_scales
from drift_engine.operators.gridops import sample, smooth
from drift_engine.operators.ranks import quantiles
from drift_engine.storage import materialise

SIDES = (("left", -90.0), ("right", 90.0))


def side_samples(cells: DataFrame, supported: DataFrame, theta: str, field: str, grid: Grid, space: Space, scale: float = 1.0, tolerance: float = 1e-10) -> DataFrame:
    """(cell_id, left_value, left_status, right_value, right_status): the field at `scale` cells to each side of theta.

    Status: available, domain_boundary or unknown_missing_support.
    """
    step = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(t).alias("turn")) for s, t in SIDES]))
    rows = with_scales(cells.select("cell_id", "x_bin", "y_bin", "x", "y", F.col(theta).alias("_theta")), grid, space).withColumn("s", step)
    rows = rows.withColumn("p", space.forward(F.col("x"), F.col("y"), F.col("_theta") + F.col("s.turn"), F.col("scale") * F.lit(scale)))
    points = rows.select("cell_id", F.col("s.side").alias("side"), F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    found = sample(points, ["cell_id", "side"], supported, [field], grid, tolerance)
    found = found.withColumn("status", F.when(F.col("boundary"), "domain_boundary").when(F.col(field).isNull(), "unknown_missing_support").otherwise("available"))
    pick = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    return found.groupBy("cell_id").agg(*[pick(c, s).alias(f"{s}_{n}") for s, _ in SIDES for c, n in ((field, "value"), ("status", "status"))])


def transverse_ridge(cells: DataFrame, supported: DataFrame, theta: str, field: str, grid: Grid, space: Space, scale: float = 1.0, tie: float = 1e-12, tolerance: float = 1e-10) -> DataFrame:
    """cells with side values, contrasts, evaluability and ridge_type: two_sided, one_sided or not_ridge.

    A two-sided ridge is not below either side by more than `tie`, a one-sided one not
    below the only side that can be read.
    """
    # The samples are stored: their lookups would be repeated by each use of a label.
    out = cells.join(materialise(side_samples(cells, supported, theta, field, grid, space, scale, tolerance), "side-samples"), "cell_id", "left")
    v, left, right = F.col(field), F.col("left_value"), F.col("right_value")
    centre = F.col(theta).isNotNull() & v.isNotNull()
    both, one = left.isNotNull() & right.isNotNull(), left.isNotNull() != right.isNotNull()
    d_left, d_right = v - left, v - right
    only = F.when(one, F.coalesce(d_left, d_right))
    curvature = v - (left + right) / 2.0
    two = F.coalesce(centre & both & (d_left >= -tie) & (d_right >= -tie), F.lit(False))
    single = F.coalesce(centre & one & (only >= -tie), F.lit(False))
    missing = F.when(both, "none").when(left.isNotNull(), "right").when(right.isNotNull(), "left").otherwise("left_and_right")
    return out.withColumns(
        {
            "D_minus": d_left,
            "D_plus": d_right,
            "D_available": only,
            "C_perp": curvature,
            "C_perp_normalized": ratio(curvature, v),
            "C_perp_one_sided": F.when(centre & one, only),
            "C_perp_one_sided_normalized": ratio(F.when(centre & one, only), v),
            "missing_side": missing,
            "evaluability": F.when(both, "two_sided_evaluable").when(left.isNotNull(), "one_sided_evaluable_left").when(right.isNotNull(), "one_sided_evaluable_right").otherwise("no_transverse_side_evaluable"),
            "evaluable": centre & (left.isNotNull() | right.isNotNull()),
            "ridge_type": F.when(two, "two_sided").when(single, "one_sided").otherwise("not_ridge"),
        }
    )


def threshold(cells: DataFrame, field: str, level: float, bound: int | None = None) -> DataFrame:
    """One row: the linear quantile of the field over the cells that have it. bound: of the cells' number, if known."""
    return quantiles(cells, {"threshold": (F.col(field), level)}, bound)


def source_field(cells: DataFrame, grid: Grid, min_support: int, smoothed: bool = False) -> DataFrame:
    """cells with S0_field_rate, the field whose ridges are sought: the flux of supported cells, raw or averaged over 3 x 3 supported cells."""
    if not smoothed:
        return cells.withColumn("S0_field_rate", F.when(F.col("N_out_move") >= min_support, F.col("U_out_all_magnitude_rate")))
    means = smooth(cells.filter(F.col("N_out_move") >= min_support), "U_out_all_magnitude_rate", grid, "S0_field_rate")
    return cells.join(means.select("cell_id", "S0_field_rate"), "cell_id", "left")


def flux_ridge(cells: DataFrame, grid: Grid, space: Space, min_support: int, level: float = 0.9, policy: str = "boundary_aware", scale: float = 1.0, tie: float = 1e-12, tolerance: float = 1e-10, smoothed: bool = False, reliable_r1: float = 0.8, ambiguous_r1: float = 0.5, disagreement: float = 20.0) -> DataFrame:
    """All cells with the flux field's ridge labels, `candidate` (policy: boundary_aware or two_sided_only), the threshold and `core`.

    reason_* are all that hold of a cell, `reason` the first of them by rank. Orientation
    is reliable from R1 reliable_r1 on, if both kinds of direction agree within
    `disagreement` degrees, and ambiguous under ambiguous_r1.
    """
    field = "S0_field_rate"
    with_field = source_field(cells, grid, min_support, smoothed)
    supported = with_field.filter(F.col("N_out_move") >= min_support)
    ridge = transverse_ridge(supported, supported, "theta_mu_out", field, grid, space, scale, tie, tolerance)
    two, one = F.col("ridge_type") == "two_sided", F.col("ridge_type") == "one_sided"
    candidate = two if policy == "two_sided_only" else two | one
    out = ridge.crossJoin(F.broadcast(threshold(supported, field, level, grid.nx * grid.ny))).withColumn("candidate", candidate)
    out = out.withColumn("core", F.col("candidate") & (F.col(field) >= F.col("threshold")))
    out = out.withColumns({"core_two_sided": F.col("core") & two, "core_one_sided": F.col("core") & one})
    flank = F.when(two, "both_sides_observable").when(one & (F.col("missing_side") == "left"), "left_flank_not_observable").when(one, "right_flank_not_observable").otherwise("not_branch_core")
    out = out.withColumn("observability", F.when(two, "two_sided_branch_core").when(one, "one_sided_branch_core").otherwise("not_branch_core")).withColumn("flank_observability", flank)
    edge = lambda s: (F.col("left_status") == s) | (F.col("right_status") == s)
    undefined = F.col("theta_mu_out").isNull()
    needed = ["none"] if policy == "two_sided_only" else ["none", "left", "right"]
    flags = {
        "reason_theta_mu_out_undefined": undefined,
        "reason_transverse_domain_boundary": edge("domain_boundary"),
        "reason_transverse_sample_unsupported_or_missing": edge("unknown_missing_support"),
        "reason_interpolation_not_defensible": ~undefined & ~F.col("missing_side").isin(needed) & ~edge("domain_boundary") & ~edge("unknown_missing_support"),
    }
    names = [k.removeprefix("reason_").replace("transverse_domain", "analysis_domain") for k in flags]
    reason = F.when(two, "transverse_ridge_candidate" if policy == "two_sided_only" else "two_sided_transverse_ridge_candidate")
    reason = reason if policy == "two_sided_only" else reason.when(one, "one_sided_transverse_ridge_candidate")
    for name, flag in zip(names, flags.values()):
        reason = reason.when(flag, name)
    agree = F.coalesce(F.col("delta_theta_mu1_out") <= disagreement, F.lit(False))
    orientation = {
        "orientation_reliable": F.coalesce(F.col("R1_out") >= reliable_r1, F.lit(False)) & agree & ~undefined,
        "orientation_ambiguous": F.coalesce(F.col("R1_out") < ambiguous_r1, F.lit(False)) | undefined,
    }
    return out.withColumns(flags | orientation).withColumn("reason", reason.otherwise("evaluated_not_transverse_maximum"))


def directional_candidates(cells: DataFrame, min_support: int, p_move: float = 0.5, r1: float = 0.8, strength: float = 0.5) -> Column:
    """Supported cells with a direction, enough movement, concentration and strength."""
    c = F.col
    return F.coalesce((c("N_out_move") >= min_support) & c("theta1_out").isNotNull() & (c("P_move") >= p_move) & (c("R1_out") >= r1) & (c("D_out_all_magnitude") >= strength), F.lit(False))
