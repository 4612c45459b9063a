"""Cell statistics from links: support, outgoing and incoming moments, harmonics, entropy, alignment, direction vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drift_engine.functions.angles import apart, bearing_of, difference, ratio, wrap360
from drift_engine.functions.geodesy import Grid, Space
from drift_engine.operators.ranks import quantiles, tied
from drift_engine.storage import materialise


def enriched_links(table: DataFrame, grid: Grid, space: Space) -> DataFrame:
    """Links with cell ids, `moving`, distance, bearings at source and arrival, components dx and dy.

    On a regular grid the geodesic depends only on the rows and the column step, so a
    geographic matrix is measured once per distinct (step, rows) and joined back.
    """
    out = table.withColumn("start_id", grid.cell_id(F.col("start_x_bin"), F.col("start_y_bin"))).withColumn("end_id", grid.cell_id(F.col("end_x_bin"), F.col("end_y_bin")))
    out = out.withColumn("moving", F.col("start_id") != F.col("end_id"))
    ends = [F.col(c) for c in ("start_x_center", "start_y_center", "end_x_center", "end_y_center")]
    if space.geographic:
        key = ["_step", "start_y_bin", "end_y_bin"]
        out = out.withColumn("_step", F.pmod(F.col("end_x_bin") - F.col("start_x_bin"), F.lit(grid.nx)) if grid.periodic else F.col("end_x_bin") - F.col("start_x_bin"))
        kinds = out.filter("moving").select(*key).distinct()
        kinds = kinds.withColumn("_g", space.inverse(F.lit(0.0), grid.y_center(F.col("start_y_bin")), F.col("_step") * F.lit(grid.dx), grid.y_center(F.col("end_y_bin"))))
        out = out.join(kinds, key, "left").drop("_step")
    else:
        out = out.withColumn("_g", space.inverse(*ends))
    moving = F.col("moving")
    out = out.withColumn("distance", F.when(moving, F.col("_g.distance")).otherwise(0.0)).withColumn("theta_out", F.when(moving, F.col("_g.bearing"))).withColumn("theta_in_source", F.when(moving, F.col("_g.back")))
    out = out.withColumn("theta_arrival", F.when(moving, wrap360(F.col("theta_in_source") + 180.0))).drop("_g")
    r = F.radians("theta_out")
    a = F.radians("theta_arrival")
    zero = lambda c: F.when(moving, c).otherwise(0.0)
    return out.withColumns({"dx_out": zero(F.col("distance") * F.sin(r)), "dy_out": zero(F.col("distance") * F.cos(r)), "dx_in": zero(F.col("distance") * F.sin(a)), "dy_in": zero(F.col("distance") * F.cos(a))})


def support(links: DataFrame, grid: Grid) -> DataFrame:
    """A row per cell that any link touches: transition counts out and in, distinct neighbours, P_stay and P_move.

    Each link gives a row to its start and one to its end, and one aggregation by cell
    counts both, so there is a single shuffle and no outer join.
    """
    n, moving = F.col("transition_count"), F.col("moving")
    role = lambda cell, out: F.struct(F.col(cell).alias("cell_id"), F.lit(out).alias("out"))
    rows = links.select(n, moving, F.explode(F.array(role("start_id", True), role("end_id", False))).alias("r")).select("transition_count", "moving", "r.*")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("transition_count"))), F.lit(0))
    out, into = F.col("out"), ~F.col("out")
    cells = rows.groupBy("cell_id").agg(
        part(out).alias("N_out_total"),
        part(out & F.col("moving")).alias("N_out_move"),
        part(into).alias("N_in_total"),
        part(into & F.col("moving")).alias("N_in_move"),
        part(out & ~F.col("moving")).alias("C_stay"),
        F.count_if(out & F.col("moving")).alias("n_destinations"),
        F.count_if(into & F.col("moving")).alias("n_sources"),
    )
    stay = F.when(F.col("N_out_total") > 0, F.col("C_stay") / F.col("N_out_total"))
    cells = cells.withColumn("P_stay", stay).withColumn("P_move", 1.0 - F.col("P_stay"))
    x_bin, y_bin = F.pmod(F.col("cell_id"), F.lit(grid.nx)).cast("long"), F.floor(F.col("cell_id") / grid.nx).cast("long")
    return cells.withColumn("x_bin", x_bin).withColumn("y_bin", y_bin).withColumn("x", grid.x_center(F.col("x_bin"))).withColumn("y", grid.y_center(F.col("y_bin")))


def coverage(cells: DataFrame, grid: Grid, thresholds=(1, 5, 10, 30)) -> DataFrame:
    """Cells at or above each threshold of each count, as shares of the positive cells, of all seen cells and of the grid."""
    fields = ["N_out_total", "N_out_move", "N_in_total", "N_in_move"]
    long = cells.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields])).alias("r")).select("r.*")
    long = long.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    out = long.groupBy("field", "threshold").agg(F.count_if(F.col("n") >= F.col("threshold")).alias("cells"), F.count_if(F.col("n") > 0).alias("positive"), F.count("*").alias("seen"))
    return out.select("field", "threshold", "cells", ratio(F.col("cells"), F.col("positive")).alias("of_positive"), ratio(F.col("cells"), F.col("seen")).alias("of_seen"), (F.col("cells") / F.lit(grid.nx * grid.ny)).alias("of_grid"))


def support_summary(cells: DataFrame) -> DataFrame:
    counts = cells.agg(F.count("*").alias("cells"), F.count("P_stay").alias("source_cells"), F.avg("P_stay").alias("mean_P_stay"))
    return counts.crossJoin(F.broadcast(quantiles(cells, {n: (F.col("P_stay"), q) for n, q in (("median_P_stay", 0.5), ("q05_P_stay", 0.05), ("q95_P_stay", 0.95))})))


def outgoing_moments(links: DataFrame, timestep: float, tolerance: float = 1e-12) -> DataFrame:
    """First moments of displacement by source cell, over all transitions and over moving ones, and as rates per unit of the time step."""
    n = F.col("transition_count")
    m = F.when(F.col("moving"), n)
    g = links.groupBy(F.col("start_id").alias("cell_id")).agg(
        F.sum(n * F.col("dx_out")).alias("_x"), F.sum(n * F.col("dy_out")).alias("_y"), F.sum(n * F.col("distance")).alias("_d"), F.sum(n).alias("_n"), F.sum(m).alias("_m")
    )
    out = {}
    for kind, count in (("all", "_n"), ("move", "_m")):
        x, y = ratio(F.col("_x"), F.col(count)), ratio(F.col("_y"), F.col(count))
        out |= {f"mu_out_{kind}_x": x, f"mu_out_{kind}_y": y, f"mu_out_{kind}_magnitude": F.hypot(x, y)}
        out |= {f"U_out_{kind}_x_rate": x / timestep, f"U_out_{kind}_y_rate": y / timestep, f"U_out_{kind}_magnitude_rate": F.hypot(x, y) / timestep}
    out |= {"distance_mean_all": F.col("_d") / F.col("_n"), "distance_mean_move": ratio(F.col("_d"), F.col("_m"))}
    out["theta_mu_out"] = bearing_of(ratio(F.col("_x"), F.col("_m")), ratio(F.col("_y"), F.col("_m")), tolerance)
    out["retained_fraction"] = ratio(out["mu_out_move_magnitude"], out["distance_mean_move"])
    return g.withColumns(out).drop("_x", "_y", "_d", "_n", "_m")


def distance_quantiles(links: DataFrame, levels=(0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Weighted quantiles of moving distances by source: the first distance whose cumulative count reaches the level."""
    w = Window.partitionBy("start_id").orderBy("distance").rangeBetween(Window.unboundedPreceding, 0)
    rows = links.filter("moving").withColumn("_cum", F.sum("transition_count").over(w)).withColumn("_all", F.sum("transition_count").over(Window.partitionBy("start_id")))
    aggs = [F.min(F.when(F.col("_cum") >= F.col("_all") * q, F.col("distance"))).alias(f"distance_q{round(100 * q):02d}") for q in levels]
    return rows.groupBy(F.col("start_id").alias("cell_id")).agg(*aggs)


def strong_flags(cells: DataFrame, field: str = "U_out_all_magnitude_rate") -> DataFrame:
    """cells with flags for the field at or above its 95 and 99 per cent quantiles over cells that move."""
    limits = quantiles(cells.filter("N_out_move > 0"), {"_q95": (F.col(field), 0.95), "_q99": (F.col(field), 0.99)})
    flag = lambda q: F.coalesce((F.col("N_out_move") > 0) & (F.col(field) >= F.col(q)), F.lit(False))
    return cells.crossJoin(F.broadcast(limits)).withColumn("strong", flag("_q95")).withColumn("top", flag("_q99")).drop("_q95", "_q99")


def _harmonics(theta: str, p: Column, side: str) -> dict[str, Column]:
    """Sums of p * cos(k theta) and p * sin(k theta) for k = 1, 2."""
    r = F.radians(theta)
    return {f"_c{k}_{side}": F.sum(p * F.cos(k * r)) for k in (1, 2)} | {f"_s{k}_{side}": F.sum(p * F.sin(k * r)) for k in (1, 2)}


def _resultants(side: str, tolerance: float) -> dict[str, Column]:
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    r1, r2 = (F.hypot(F.col(f"_c{k}_{side}"), F.col(f"_s{k}_{side}")) for k in (1, 2))
    second = F.pmod(F.degrees(F.atan2(F.col(f"_s2_{side}"), F.col(f"_c2_{side}"))) / 2, F.lit(180.0))
    return {
        f"M1_{side}_real": F.col(f"_c1_{side}"),
        f"M1_{side}_imag": F.col(f"_s1_{side}"),
        f"R1_{side}": clip(r1),
        f"R2_{side}": clip(r2),
        f"theta1_{side}": bearing_of(F.col(f"_s1_{side}"), F.col(f"_c1_{side}"), tolerance),
        f"theta2_{side}": F.when(r2 > tolerance, second),
    }


def outgoing_harmonics(links: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Circular moments of the moving links' bearings by source, weighted by their counts, and the spread of distances."""
    moving = links.filter("moving").withColumn("_p", F.col("transition_count") / F.sum("transition_count").over(Window.partitionBy("start_id")))
    p, d = F.col("_p"), F.col("distance")
    g = moving.groupBy(F.col("start_id").alias("cell_id")).agg(
        *[c.alias(n) for n, c in _harmonics("theta_out", p, "out").items()], F.sum(p * d).alias("distance_mean"), F.sum(p * d * d).alias("_d2"), F.max("distance").alias("distance_max"), F.max(p * d).alias("_lever")
    )
    out = _resultants("out", tolerance) | {
        "distance_std": F.sqrt(F.greatest(F.col("_d2") - F.col("distance_mean") ** 2, F.lit(0.0))),
        "distance_max_over_mean": ratio(F.col("distance_max"), F.col("distance_mean")),
        "longest_leverage": ratio(F.col("_lever"), F.col("distance_mean")),
    }
    g = g.withColumns(out)
    return g.drop(*[c for c in g.columns if c.startswith("_")])


def incoming_harmonics(links: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Circular moments of arrival bearings by end cell, the mean arrival displacement, and distances."""
    moving = links.filter("moving").withColumn("_p", F.col("transition_count") / F.sum("transition_count").over(Window.partitionBy("end_id")))
    p = F.col("_p")
    g = moving.groupBy(F.col("end_id").alias("cell_id")).agg(
        *[c.alias(n) for n, c in _harmonics("theta_arrival", p, "in").items()], F.sum(p * F.col("dx_in")).alias("mu_in_x"), F.sum(p * F.col("dy_in")).alias("mu_in_y"), F.sum(p * F.col("distance")).alias("distance_in_mean"), F.max("distance").alias("distance_in_max")
    )
    g = g.withColumns(_resultants("in", tolerance)).withColumn("theta_mu_in", bearing_of(F.col("mu_in_x"), F.col("mu_in_y"), tolerance)).withColumn("delta_theta_mu1_in", apart(F.col("theta_mu_in"), F.col("theta1_in")))
    return g.drop(*[c for c in g.columns if c.startswith("_")])


def entropy(links: DataFrame, by: str, theta: str, side: str, bins: int = 36) -> DataFrame:
    """Normalised entropy of the bearing histogram of moving links, its effective and its occupied bins."""
    b = F.least(F.greatest(F.floor(F.col(theta) / F.lit(360.0 / bins)), F.lit(0)), F.lit(bins - 1))
    counts = links.filter("moving").groupBy(F.col(by).alias("cell_id"), b.alias("_b")).agg(F.sum("transition_count").alias("_n"))
    q = F.col("_n") / F.sum("_n").over(Window.partitionBy("cell_id"))
    counts = counts.withColumn("_q", q)
    h = -F.sum(F.col("_q") * F.ln("_q"))
    return counts.groupBy("cell_id").agg((h / math.log(bins)).alias(f"H_{side}"), F.exp(h).alias(f"effective_bins_{side}"), F.count("*").alias(f"occupied_bins_{side}"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's correlation of two columns over rows that have both: average ranks, then Pearson; one row (pairs, correlation, NULL where one never varies).

    Ranks are those of pairs of values, which are counted first.
    """
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).filter("a is not null and b is not null")
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "rank-rows")
    ranked = tied(rows, ["_row"], {"_ra": "a", "_rb": "b"}, least=False, descending=False)
    return ranked.agg(F.count("*").alias("pairs"), ratio(F.covar_pop("_ra", "_rb"), F.stddev_pop("_ra") * F.stddev_pop("_rb")).alias("correlation"))


def alignment(cells: DataFrame) -> DataFrame:
    """cells with cosines and signed turns (outgoing less incoming direction, -180 to 180) by both kinds of direction, and the turns' sizes."""
    out = {}
    for name, kind, cosine in (("1", "theta1", "A_io"), ("mu", "theta_mu", "A_io_mu")):
        a, b = F.col(f"{kind}_out"), F.col(f"{kind}_in")
        out |= {cosine: F.cos(F.radians(a - b)), f"delta_theta_io_{name}": difference(a, b), f"abs_delta_theta_io_{name}": apart(a, b)}
    out["abs_delta_theta_io_1_minus_mu"] = apart(out["delta_theta_io_1"], out["delta_theta_io_mu"])
    return cells.withColumns(out)


def direction_vectors(cells: DataFrame) -> DataFrame:
    """cells with D_out_move (the unit-weight mean direction) and D_out_all = P_move * D_out_move, which is 0 for cells that only stay; and the coherent flux."""
    stays = (F.col("N_out_total") > 0) & (F.col("N_out_move") == 0)
    zero = lambda c: F.when(stays, 0.0).otherwise(c)
    mx, my = F.col("M1_out_imag"), F.col("M1_out_real")
    out = {"D_out_move_x": mx, "D_out_move_y": my, "D_out_move_magnitude": F.hypot(mx, my), "D_out_all_x": zero(F.col("P_move") * mx), "D_out_all_y": zero(F.col("P_move") * my)}
    out["D_out_all_magnitude"] = F.hypot(out["D_out_all_x"], out["D_out_all_y"])
    out["S_flux_rate"] = F.col("U_out_all_magnitude_rate")
    out["U_coh_rate"] = F.col("U_out_all_magnitude_rate") * F.col("R1_out")
    return cells.withColumns(out)


def vector_identities(cells: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """One row: how many cells have direction vectors, and the largest residuals of the identities that they must meet."""
    bearing = lambda kind: difference(bearing_of(F.col(f"D_out_{kind}_x"), F.col(f"D_out_{kind}_y"), tolerance), F.col("theta1_out"))
    most = lambda c: F.max(F.abs(c))
    moving = F.col("N_out_move") > 0
    return cells.agg(
        F.count("D_out_move_magnitude").alias("cells_with_D_out_move"),
        F.count("D_out_all_magnitude").alias("cells_with_D_out_all"),
        F.count("theta1_out").alias("cells_with_defined_directional_bearing"),
        most(F.col("D_out_all_x") - F.col("P_move") * F.col("D_out_move_x")).alias("D_out_all_x_residual"),
        most(F.col("D_out_all_y") - F.col("P_move") * F.col("D_out_move_y")).alias("D_out_all_y_residual"),
        most(F.col("D_out_move_magnitude") - F.col("R1_out")).alias("D_out_move_less_R1"),
        most(F.when(moving, F.col("D_out_all_magnitude") - F.col("P_move") * F.col("R1_out"))).alias("D_out_all_less_P_move_R1"),
        most(bearing("move")).alias("D_out_move_bearing_residual"),
        most(F.when(moving, bearing("all"))).alias("D_out_all_bearing_residual"),
    )


def cell_statistics(links: DataFrame, grid: Grid, timestep: float, bins: int = 36, tolerance: float = 1e-12) -> DataFrame:
    """All statistics of every touched cell. links: of enriched_links()."""
    cells = support(links, grid)
    for part in (outgoing_moments(links, timestep, tolerance), outgoing_harmonics(links, tolerance), entropy(links, "start_id", "theta_out", "out", bins), incoming_harmonics(links, tolerance), entropy(links, "end_id", "theta_arrival", "in", bins)):
        cells = cells.join(part, "cell_id", "left")
    cells = cells.withColumn("delta_theta_mu1_out", apart(F.col("theta_mu_out"), F.col("theta1_out")))
    return direction_vectors(alignment(cells))


def moment_identities(cells: DataFrame) -> DataFrame:
    """One row: the largest differences between the moment over all transitions and P_move times that over moving ones, and of the retained flux share from P_move."""
    most = lambda c: F.max(F.abs(c))
    p = F.col("P_move")
    residual = lambda a: most(F.col(f"mu_out_all_{a}") - F.coalesce(p * F.col(f"mu_out_move_{a}"), F.lit(0.0)))
    retained = ratio(F.col("mu_out_all_magnitude"), F.col("mu_out_move_magnitude"))
    return cells.filter("N_out_total > 0").agg(residual("x").alias("x_residual"), residual("y").alias("y_residual"), most(retained - p).alias("retained_less_P_move"))


def outgoing_summary(cells: DataFrame, primary: int, sensitivity: int | None = None, high_r1: float = 0.8, low_r1: float = 0.5, high_r2: float = 0.8, split_r1: tuple[float, float] = (0.4, 0.85), split_r2: float = 0.3, large: float = 30.0) -> DataFrame:
    """One row of counters on outgoing statistics, and three rank correlations over supported cells. Raises if no cell has a moving link.

    cells: of cell_statistics() with strong_flags().
    """
    sensitivity = primary if sensitivity is None else sensitivity
    if cells.filter("N_out_move > 0").isEmpty():
        raise ValueError("no link moves")
    c = F.col
    first = c("N_out_move") >= primary
    strong = c("strong") & first
    known = {"R1_out": "R1_out", "theta1_out": "theta1_out", "R2_out": "R2_out", "theta2_out": "theta2_out", "entropy": "H_out", "delta_theta_mu1_out": "delta_theta_mu1_out"}
    flags = {
        "primary_cells": first,
        "sensitivity_cells": c("N_out_move") >= sensitivity,
        "strong_primary": strong,
        "strong_high_R1": strong & (c("R1_out") >= high_r1),
        "strong_below_high_R1": strong & (c("R1_out") < high_r1),
        "strong_large_difference": strong & (c("delta_theta_mu1_out") >= large),
        "high_R2_low_R1": first & (c("R2_out") >= high_r2) & (c("R1_out") <= low_r1),
        "candidate_split": first & c("R1_out").between(*split_r1) & (c("R2_out") <= split_r2),
    }
    out = cells.agg(*[F.count(v).alias(f"cells_with_{k}") for k, v in known.items()], *[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in flags.items()])
    for name, a, b in (("spearman_flux_R1", "U_out_all_magnitude_rate", "R1_out"), ("spearman_difference_distance_ratio", "delta_theta_mu1_out", "distance_max_over_mean"), ("spearman_difference_leverage", "delta_theta_mu1_out", "longest_leverage")):
        out = out.crossJoin(F.broadcast(spearman(cells.filter(first), a, b).select(c("correlation").alias(name))))
    return out


def harmonic_residuals(cells: DataFrame) -> DataFrame:
    """One row: how far the incoming and outgoing resultants are from the size of their harmonics, which must not be 1e-12 or more."""
    size = lambda s: F.hypot(f"M1_{s}_real", f"M1_{s}_imag")
    return cells.agg(*[F.max(F.abs(F.col(f"R1_{s}") - F.least(F.lit(1.0), size(s)))).alias(f"R1_{s}_residual") for s in ("out", "in")])


def alignment_summary(cells: DataFrame, primary: int, sensitivity: int | None = None, high_r1: float = 0.8, low_r1: float = 0.5, poor: float = 0.0) -> DataFrame:
    """One row of counters on incoming statistics and alignment, with the rank correlation and spread of both cosines over jointly supported cells.

    cells: of cell_statistics() with strong_flags(). poor: the cosine under which an alignment is poor.
    """
    sensitivity = primary if sensitivity is None else sensitivity
    c = F.col
    joint = {k: (c("N_out_move") >= n) & (c("N_in_move") >= n) for k, n in (("primary", primary), ("sensitivity", sensitivity))}
    out = c("strong") & (c("R1_out") >= high_r1)
    both = (c("R1_out") >= high_r1) & (c("R1_in") >= high_r1)
    low = c("A_io") <= poor
    count = lambda **named: [F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in named.items()]
    pairs = cells.filter(joint["primary"] & c("A_io").isNotNull() & c("A_io_mu").isNotNull())
    apart_by = F.abs(c("A_io") - c("A_io_mu"))
    spread = pairs.agg(F.expr("percentile(abs(A_io - A_io_mu), 0.5)").alias("median_alignment_difference"), F.percentile(apart_by, F.lit(0.95)).alias("q95_alignment_difference"))
    ranks = spearman(pairs, "A_io", "A_io_mu").select(c("correlation").alias("spearman_alignments"))
    known = {"R1_in": "R1_in", "theta1_in": "theta1_in", "R2_in": "R2_in", "theta2_in": "theta2_in", "H_in": "H_in", "theta_mu_in": "theta_mu_in", "delta_theta_mu1_in": "delta_theta_mu1_in", "A_io": "A_io", "A_io_mu": "A_io_mu"}
    counts = cells.agg(
        *[F.count(v).alias(f"cells_with_{k}") for k, v in known.items()],
        *count(
            incoming_primary=c("N_in_move") >= primary,
            incoming_sensitivity=c("N_in_move") >= sensitivity,
            joint_primary=joint["primary"],
            joint_sensitivity=joint["sensitivity"],
            strong_out_primary=out & joint["primary"],
            strong_both_primary=out & both & joint["primary"],
            strong_out_sensitivity=out & joint["sensitivity"],
            strong_both_sensitivity=out & both & joint["sensitivity"],
            strong_out_low_in_primary=out & (c("R1_in") <= low_r1) & joint["primary"],
            strong_both_poor_primary=out & both & low & joint["primary"],
            both_poor_primary=both & low & joint["primary"],
            both_poor_sensitivity=both & low & joint["sensitivity"],
        ),
    )
    return counts.crossJoin(F.broadcast(spread)).crossJoin(F.broadcast(ranks))
