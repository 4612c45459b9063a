"""The directional pathway: candidates, the graph of compatible neighbours, transverse ridges, plateaus, cores and fronts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drift_engine.functions.angles import apart, axial_mismatch, longitude_span, mean_bearing
from drift_engine.functions.geodesy import Grid, Space
from drift_engine.operators import graph, ridge, sections
from drift_engine.operators.ranks import numbered, tied
from drift_engine.storage import materialise


def _pairs(cells: DataFrame, grid: Grid, space: Space, value: str | None = None) -> DataFrame:
    """Touching cells (a, b) with both directions, the step between them and its mismatch at either end."""
    cols = ["x", "y", "theta1_out"] + ([value] if value else [])
    side = lambda s: cells.select(F.col("cell_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in cols])
    rows = graph.neighbour_pairs(cells, grid).join(side("a"), "a").join(side("b"), "b")
    rows = rows.withColumn("_g", space.inverse(F.col("x_a"), F.col("y_a"), F.col("x_b"), F.col("y_b")))
    return rows.withColumns(
        {
            "edge_length": F.col("_g.distance"),
            "direction_difference": apart(F.col("theta1_out_b"), F.col("theta1_out_a")),
            "mismatch_a": axial_mismatch(F.col("theta1_out_a"), F.col("_g.bearing")),
            "mismatch_b": axial_mismatch(F.col("theta1_out_b"), F.col("_g.back")),
        }
    ).drop("_g")


def compatible_edges(cells: DataFrame, grid: Grid, space: Space, difference: float = 45.0, mismatch: float = 45.0) -> DataFrame:
    """Neighbours with like directions that lie along both of them."""
    rows = _pairs(cells, grid, space).filter((F.col("direction_difference") <= difference) & (F.greatest("mismatch_a", "mismatch_b") <= mismatch))
    return rows.select("a", "b", "edge_length", "direction_difference", "mismatch_a", "mismatch_b", F.greatest("mismatch_a", "mismatch_b").alias("largest_mismatch"), F.cos(F.radians("direction_difference")).alias("compatibility"))


def candidates(cells: DataFrame, grid: Grid, space: Space, min_support: int, difference: float = 45.0, mismatch: float = 45.0, in_rounds: bool = False, **limits) -> DataFrame:
    """Candidate cells with the components of their compatible graph, degrees and classes. in_rounds: components are found as on large grids."""
    found = cells.filter(ridge.directional_candidates(cells, min_support, **limits))
    edges = compatible_edges(found, grid, space, difference, mismatch)
    return graph.degrees(graph.labelled(found, edges, None if in_rounds else grid.nx * grid.ny), edges)


def raw_ridges(cells: DataFrame, candidate_cells: DataFrame, grid: Grid, space: Space, min_support: int, **options) -> DataFrame:
    """Candidates with ridge labels; sides are read from all supported cells, not only candidates."""
    supported = cells.filter((F.col("N_out_move") >= min_support) & F.col("D_out_all_magnitude").isNotNull())
    out = ridge.transverse_ridge(candidate_cells, supported, "theta1_out", "D_out_all_magnitude", grid, space, **options)
    return out.withColumn("ridge_type", F.when(F.col("missing_side") == "left_and_right", "not_evaluable").otherwise(F.col("ridge_type"))).withColumn("raw_ridge", F.col("ridge_type").isin("two_sided", "one_sided"))


def medoid(x: np.ndarray, y: np.ndarray, space: Space, tie: float = 1e-12) -> int:
    """The first point whose sum of distances to all is within `tie` of the least.

    By the triangle inequality the sum of one point bounds those of all others: a point at
    distance d of one with sum s has |s - n d| at least. Points are taken in the order of
    their bounds, from one near the middle, until the others' are too large; so of n
    points some root of n are measured against all, not all of them.
    """
    n = len(x)
    bound, sums = np.zeros(n), np.full(n, np.inf)
    at = int(np.argmin(space.metres(x, y, np.full(n, np.median(x)), np.full(n, np.median(y)))))
    best = np.inf
    while True:
        away = space.metres(np.full(n, x[at]), np.full(n, y[at]), x, y)
        sums[at] = away.sum()
        best = min(best, sums[at])
        # Less what rounding may have added to a bound.
        bound = np.maximum(bound, np.abs(sums[at] - n * away) * (1 - 1e-12))
        bound[at] = np.inf
        at = int(np.argmin(bound))
        if not bound[at] <= best + tie:
            return int(np.argmax(sums <= best + tie))


def plateaus(ridges: DataFrame, grid: Grid, space: Space, tie: float = 1e-12, mismatch: float = 45.0) -> DataFrame:
    """Raw ridges with their plateau: neighbours of equal strength across the stream; its representative is the medoid.

    Medoid: the least sum of distances, of equals the larger N_out_move, then the smaller id.
    """
    rows = ridges.filter("raw_ridge").drop("component", "component_number")
    pairs = _pairs(rows, grid, space, "D_out_all_magnitude")
    flat = pairs.filter((F.abs(F.col("D_out_all_magnitude_a") - F.col("D_out_all_magnitude_b")) <= tie) & (F.col("mismatch_a") > mismatch) & (F.col("mismatch_b") > mismatch)).select("a", "b")
    rows = graph.labelled(rows, flat, grid.nx * grid.ny)

    def found(plateau: pd.DataFrame) -> pd.DataFrame:
        ordered = plateau.sort_values(["N_out_move", "cell_id"], ascending=[False, True])
        place = medoid(ordered["x"].to_numpy(), ordered["y"].to_numpy(), space)
        return pd.DataFrame({"component": [int(plateau["component"].iloc[0])], "plateau_size": [len(plateau)], "representative": [int(ordered["cell_id"].iloc[place])]})

    own = rows.select("component", "cell_id", "x", "y", F.col("N_out_move").cast("double").alias("N_out_move"))
    chosen = own.groupBy("component").applyInPandas(found, "component long, plateau_size long, representative long")
    rows = rows.join(chosen, "component").withColumn("plateau_id", F.format_string("directional_plateau_%05d", "component_number"))
    return rows.withColumn("is_representative", F.col("cell_id") == F.col("representative")).drop("component", "component_number")


def thinned_ridges(cells: DataFrame, grid: Grid, space: Space, min_support: int, scale: float = 1.0, tie: float = 1e-12, plateau_tie: float = 1e-12, tolerance: float = 1e-10, **limits) -> DataFrame:
    """All candidates with ridge labels, and raw ridges with their plateaus: the diagnostics that cores are chosen from, stored."""
    found = cells.filter(ridge.directional_candidates(cells, min_support, **limits))
    rows = materialise(raw_ridges(cells, found, grid, space, min_support, scale=scale, tie=tie, tolerance=tolerance), "raw-ridges")
    flat = plateaus(rows, grid, space, plateau_tie).select("cell_id", "plateau_id", "plateau_size", "representative", "is_representative")
    out = rows.join(flat, "cell_id", "left").withColumn("is_representative", F.coalesce("is_representative", F.lit(False)))
    return materialise(out.withColumn("plateau_size", F.coalesce("plateau_size", F.lit(0))), "thinned-ridges")


def connected_cores(thinned: DataFrame, grid: Grid, space: Space, difference: float = 45.0, mismatch: float = 45.0) -> DataFrame:
    """The representatives among thinned_ridges() with the components of their compatible graph, of any size."""
    reps = thinned.filter("is_representative")
    edges = compatible_edges(reps, grid, space, difference, mismatch)
    return graph.degrees(graph.labelled(reps, edges, grid.nx * grid.ny), edges)


def large_enough(connected: DataFrame, least_cells: int = 3) -> DataFrame:
    """The cores: cells of connected_cores() in components of enough cells, numbered anew."""
    rows = materialise(connected.filter(F.col("component_cells") >= least_cells).drop("component_number"), "directional-cores")
    numbers = numbered(rows.select("component").distinct(), [F.col("component")], "component_number")
    return rows.join(numbers, "component").withColumn("component_id", F.format_string("directional_core_component_%04d", "component_number"))


def cores(cells: DataFrame, grid: Grid, space: Space, min_support: int, least_cells: int = 3, difference: float = 45.0, mismatch: float = 45.0, **options) -> DataFrame:
    """Directional core cells: representatives in components of the compatible graph with enough cells, numbered anew. options: of thinned_ridges()."""
    return large_enough(connected_cores(thinned_ridges(cells, grid, space, min_support, **options), grid, space, difference, mismatch), least_cells)


def hops(core_cells: DataFrame, edges: DataFrame, most: int = 2) -> DataFrame:
    """(cell_id, other, hops) of cores within `most` steps of the graph, with themselves; one small self-join a step."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    reached = core_cells.select("cell_id", F.col("cell_id").alias("other"), F.lit(0).alias("hops"))
    edge = reached
    for k in range(1, most + 1):
        edge = edge.join(both.select(F.col("a").alias("other"), F.col("b").alias("_to")), "other").select("cell_id", F.col("_to").alias("other"), F.lit(k).alias("hops")).distinct()
        reached = reached.unionByName(edge)
    return reached.groupBy("cell_id", "other").agg(F.min("hops").alias("hops"))


#: Fields read at the samples beside the direction vector (fixed values).
SAMPLED = ("D_out_all_magnitude", "P_move", "R1_out", "N_out_move")


def neighbours_by_hops(core_cells: DataFrame, grid: Grid, space: Space, cfg: sections.SectionConfig, difference: float = 45.0, mismatch: float = 45.0) -> DataFrame:
    """(section, other) of the cores' sections within a few hops of the compatible graph, each with itself."""
    name = lambda c: F.format_string("cell%05d", c)
    return hops(core_cells, compatible_edges(core_cells, grid, space, difference, mismatch), cfg.composite_window).select(name("cell_id").alias("section"), name("other").alias("other"))


def directional_sections(core_cells: DataFrame, cells: DataFrame, grid: Grid, space: Space, min_support: int, cfg: sections.SectionConfig, difference: float = 45.0, mismatch: float = 45.0, extra: tuple[str, ...] = ()) -> DataFrame:
    """All samples of the cores' sections, with composites over cores within a few hops."""
    way = sections.DIRECTIONAL
    supported = cells.filter((F.col("N_out_move") >= min_support) & F.col("D_out_all_x").isNotNull() & F.col("D_out_all_y").isNotNull())
    context = [c for c in (*sections.CONTEXT, "x_bin", "y_bin", "x", "y", "theta1_out") if c in core_cells.columns and c not in ("segment", "sequence")]
    rows = core_cells.select("cell_id", *context).withColumn("section", F.format_string("cell%05d", "cell_id"))
    out = sections.smoothed(sections.refined(sections.samples(rows, supported, way, grid, space, cfg, extra), way, cfg), cfg)
    return sections.composites(out, neighbours_by_hops(core_cells, grid, space, cfg, difference, mismatch))


def directional_fronts(core_cells: DataFrame, rows: DataFrame, cfg: sections.SectionConfig) -> DataFrame:
    return sections.fronts(core_cells, sections.zones(rows, sections.DIRECTIONAL, cfg), sections.DIRECTIONAL)


def component_statistics(members: DataFrame, edges: DataFrame, space: Space | None = None, periodic: bool | None = None) -> DataFrame:
    """Per component of a labelled graph: cells, edges, ends, spans and centroid (on a sphere around the seam), means and medians, length and angles of edges, and ranks by length and by median strength, and by cells and summed strength."""
    geographic = space is not None and space.geographic
    inner = edges.join(members.select(F.col("cell_id").alias("a"), "component"), "a").groupBy("component").agg(
        F.count("*").alias("edges"),
        F.sum("edge_length").alias("edge_length"),
        F.avg("direction_difference").alias("mean_direction_difference"),
        F.max("direction_difference").alias("largest_direction_difference"),
        F.avg("largest_mismatch").alias("mean_step_mismatch"),
        F.max("largest_mismatch").alias("largest_step_mismatch"),
    )
    r = F.radians("theta1_out")
    median = lambda c: F.percentile(c, F.lit(0.5))
    kinds = [F.count_if(F.col("ridge_type") == k).alias(f"{k}_cells") for k in ("two_sided", "one_sided")] if "ridge_type" in members.columns else []
    g = members.groupBy("component", "component_number").agg(
        F.count("*").alias("cells"),
        F.sum("D_out_all_magnitude").alias("strength"),
        F.avg("D_out_all_magnitude").alias("mean_strength"),
        median("D_out_all_magnitude").alias("median_strength"),
        F.avg("P_move").alias("mean_P_move"),
        median("P_move").alias("median_P_move"),
        F.avg("R1_out").alias("mean_R1_out"),
        median("R1_out").alias("median_R1_out"),
        F.sum("N_out_move").alias("transitions"),
        F.hypot(F.avg(F.sin(r)), F.avg(F.cos(r))).alias("direction_concentration"),
        F.count_if("endpoint").alias("endpoints"),
        F.count_if("junction").alias("junctions"),
        (longitude_span(F.col("x")) if (geographic if periodic is None else periodic) else F.max("x") - F.min("x")).alias("x_span"),
        (F.max("y") - F.min("y")).alias("y_span"),
        (mean_bearing(F.col("x")) if geographic else F.avg("x")).alias("centroid_x"),
        F.avg("y").alias("centroid_y"),
        *kinds,
    )
    g = g.join(inner, "component", "left").fillna(0, ["edges", "edge_length"])
    g = materialise(g, "component-statistics")
    return g.join(tied(g, ["component"], {"rank_cells": "cells", "rank_strength": "strength", "rank_length": "edge_length", "rank_median_strength": "median_strength"}), "component")


def _quantiles(column: str, name: str, when=None) -> list:
    value = F.col(column) if when is None else F.when(when, F.col(column))
    return [F.percentile(value, F.lit(q)).alias(f"{name}_q{round(100 * q)}") for q in (0.1, 0.5, 0.9)]


def corridor_summary(cells: DataFrame, found: DataFrame, min_support: int) -> DataFrame:
    """One row: supported cells and quantiles over them, and the candidates of candidates() with their components."""
    s = F.col("N_out_move") >= min_support
    over = cells.agg(F.count_if(s).alias("supported_cells"), *_quantiles("P_move", "supported_P_move", s), *_quantiles("R1_out", "supported_R1", s), *_quantiles("D_out_all_magnitude", "supported_strength", s))
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    own = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidate_cells"), F.count("*").alias("candidate_components"), *_quantiles("n", "component_cells"))
    return over.crossJoin(F.broadcast(own))


def core_summary(thinned: DataFrame, connected: DataFrame, least_cells: int = 3) -> DataFrame:
    """One row of counters over thinned_ridges() and connected_cores(): ridges by type, plateaus, cores, what was too short, and quantiles."""
    kind = [F.count_if(F.col("ridge_type") == k).alias(f"{k}_cells") for k in ("two_sided", "one_sided", "not_ridge", "not_evaluable")]
    ridges = thinned.agg(F.count("*").alias("candidate_cells"), *kind, F.count_if("raw_ridge").alias("raw_ridge_cells"), F.count_distinct("plateau_id").alias("plateau_groups"), F.count_if("is_representative").alias("plateau_representatives"))
    kept = F.col("component_cells") >= least_cells
    cells = connected.agg(F.count_if(kept).alias("core_cells"), F.count_if(~kept).alias("discarded_cells"), *_quantiles("D_out_all_magnitude", "core_strength", kept))
    sizes = connected.groupBy("component").agg(F.count("*").alias("n"))
    many = F.col("n") >= least_cells
    parts = sizes.agg(F.count_if(many).alias("core_components"), F.count_if(~many).alias("discarded_components"), *_quantiles("n", "component_cells", many))
    return ridges.crossJoin(F.broadcast(cells)).crossJoin(F.broadcast(parts))


def front_summary(summaries: DataFrame, found: DataFrame) -> DataFrame:
    """One row of counters over sections with their outcomes, and over directional_fronts()."""
    two, one = F.col("detected_sides") == 2, F.col("detected_sides") == 1
    own = summaries.agg(
        F.count("*").alias("sections"),
        F.count_if(two).alias("sections_with_two_fronts"),
        F.count_if(one).alias("sections_with_one_front"),
        F.count_if(~two & ~one).alias("sections_without_front"),
        F.count_if(F.col("unsupported_samples") > 0).alias("sections_with_missing_support"),
        F.count_if("short_available_cross_section").alias("short_sections"),
        F.count_if("opposing_outer_flow").alias("sections_with_opposing_outer_signal"),
    )
    status = [F.count_if(F.col("front_status") == s).alias(n) for s, n in ((sections.DIRECTIONAL.detected, "fronts"), (sections.DIRECTIONAL.undetected, "observable_sides_without_front"), ("side_not_observable", "unobservable_sides"))]
    return own.crossJoin(F.broadcast(found.agg(*status, *_quantiles("distance_from_core", "distance"), *_quantiles("loss", "drop"), *_quantiles("relative_loss", "relative_drop"))))
