"""The library's queries on the driver's tables, by name."""

from __future__ import annotations

import json
import struct
import urllib.parse
import uuid
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drift_engine import storage
from drift_engine.functions import angles, geodesy
from drift_engine.operators import cellstats, compare, directional, flux, gradients, graph, gridops, matrix, parts, ranks, review, ridge, sections, tracks, validate
from drift_engine.plans import presets as P
from drift_engine.plans import config, tables
from drift_engine.plans.oracles import GAP, ORACLES
from drift_engine.sources import auxiliary, naming, trajectories

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(*names: str, **columns: Column) -> list[Column]:
    """Columns rounded to six places, as sums differ in their last bits by partitioning."""
    return [F.round(F.col(n), 6).alias(n) for n in names] + [F.round(c, 6).alias(n) for n, c in columns.items()]


BINS = ["start_x_bin", "start_y_bin", "end_x_bin", "end_y_bin"]


@query
def san_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.sanitise(P.dirty_raw(spark, sf_dir)).select("trajectory", *r6("time", "x", "y"))


@query
def san_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.diagnostics(P.dirty_raw(spark, sf_dir))


@query
def san_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", tracks.path_identity(F.lit("a/b"), F.col("user_id").cast("string")).alias("identity"))


@query
def mat_links_nonoverlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.matrix_e(spark, sf_dir).select(*BINS, "transition_count", *r6("start_x_center", "transition_probability"))


@query
def mat_links_every_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.transition_matrix(P.segments_e(spark, sf_dir, "every_observation"), P.GRID_E).select(*BINS, "transition_count")


@query
def mat_gap_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matrix.matrix_diagnostics(P.segments_e(spark, sf_dir, max_gap=GAP), P.GRID_E)
    return found.select("candidate_segments", "exact_endpoints", "gap_endpoints", "rejected_gap", "rejected_outside", "retained_segments")


@query
def mat_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matrix.matrix_diagnostics(P.segments_e(spark, sf_dir), P.GRID_E)
    return found.select("candidate_segments", "exact_endpoints", "interpolated_endpoints", "rejected_outside", "retained_segments", "outside_start", "outside_end")


@query
def mat_wrap_lon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.matrix_g(spark, sf_dir).select(*BINS, "transition_count")


@query
def mat_source_step_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.source_timestep(P.tracks_o(spark, sf_dir))


#: Rows from which these queries take a track in parts: small, so that most tracks of the events are cut.
PART_ROWS = 64


def _parted(spark: SparkSession, sf_dir: str, mode: str = "non_overlapping", max_gap: float | None = None) -> DataFrame:
    # Several passes read the rows and the tracks: each is made once.
    raw = storage.materialise(P.events_raw(spark, sf_dir), "parts-rows")
    long = parts.crowds(raw, PART_ROWS)
    return matrix.segments(storage.materialise(tracks.sanitise(raw, crowds=long), "parts-tracks"), P.DAY, mode, False, max_gap, long)


@query
def san_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = P.dirty_raw(spark, sf_dir)
    return tracks.sanitise(raw, crowds=parts.crowds(raw, PART_ROWS)).select("trajectory", *r6("time", "x", "y"))


@query
def mat_parts_nonoverlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.transition_matrix(_parted(spark, sf_dir), P.GRID_E).select(*BINS, "transition_count", *r6("start_x_center", "transition_probability"))


@query
def mat_parts_every_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.transition_matrix(_parted(spark, sf_dir, "every_observation"), P.GRID_E).select(*BINS, "transition_count")


@query
def mat_parts_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matrix.matrix_diagnostics(_parted(spark, sf_dir, max_gap=GAP), P.GRID_E)
    return found.select("candidate_segments", "exact_endpoints", "gap_endpoints", "rejected_gap", "rejected_outside", "retained_segments")


@query
def val_flags_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.matrix_e(spark, sf_dir)
    m = m.withColumn("transition_probability", F.when(F.col("start_y_bin") == 3, F.col("transition_probability") * 1.5).otherwise(F.col("transition_probability")))
    m = m.withColumn("transition_count", F.when((F.col("start_x_bin") + F.col("end_x_bin")) % 5 == 0, -F.col("transition_count")).otherwise(F.col("transition_count")))
    m = m.withColumn("end_y_bin", F.when((F.col("start_x_bin") + F.col("end_y_bin")) % 7 == 0, F.col("end_y_bin") + 20).otherwise(F.col("end_y_bin")))
    return validate.flagged(m, P.GRID_E, normalization_atol=1e-9).select(*BINS, "flags")


@query
def val_row_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.row_sums(P.matrix_e(spark, sf_dir)).select("start_x_bin", "start_y_bin", "links", "transitions", *r6("probability_sum"))


@query
def val_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate.summary(P.matrix_e(spark, sf_dir), P.GRID_E)
    return out.select("links", "transitions", "sources", *r6("largest_centre_residual", "largest_probability_residual", "largest_normalisation_residual"))


@query
def mat_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.check_tracks(P.dirty_raw(spark, sf_dir))


@query
def sup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cellstats.support(P.links_e(spark, sf_dir), P.GRID_E)
    return cells.select("cell_id", "N_out_total", "N_out_move", "N_in_total", "N_in_move", "C_stay", "n_destinations", "n_sources", *r6("P_move"))


@query
def sup_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cellstats.coverage(cellstats.support(P.links_e(spark, sf_dir), P.GRID_E), P.GRID_E)
    return found.select("field", "threshold", "cells", *r6("of_positive", "of_seen", "of_grid"))


@query
def sup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cellstats.support_summary(cellstats.support(P.links_e(spark, sf_dir), P.GRID_E))
    return found.select("cells", "source_cells", *r6("mean_P_stay", "median_P_stay", "q05_P_stay", "q95_P_stay"))


@query
def s1_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cellstats.outgoing_moments(P.links_e(spark, sf_dir), P.DAY)
    return m.select("cell_id", *r6("mu_out_all_x", "mu_out_all_y", "mu_out_move_x", "mu_out_move_y", "distance_mean_move", "theta_mu_out", "retained_fraction", U_out_all_magnitude_rate=F.col("U_out_all_magnitude_rate") * 1000))


@query
def s1_weighted_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = cellstats.distance_quantiles(P.links_e(spark, sf_dir))
    return q.select("cell_id", *r6(*[c for c in q.columns if c.startswith("distance_q")]))


@query
def s1_strong_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = P.links_e(spark, sf_dir)
    cells = cellstats.support(links, P.GRID_E).filter("N_out_total > 0").join(cellstats.outgoing_moments(links, P.DAY), "cell_id")
    return cellstats.strong_flags(cells).select("cell_id", "strong", "top")


@query
def s2_harmonics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cellstats.outgoing_harmonics(P.links_e(spark, sf_dir)).select("cell_id", *r6("R1_out", "R2_out", "theta1_out", "M1_out_real", "M1_out_imag"))


@query
def s2_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cellstats.entropy(P.links_e(spark, sf_dir), "start_id", "theta_out", "out")
    return e.select("cell_id", *r6("H_out", "effective_bins_out"), "occupied_bins_out")


@query
def s2_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cellstats.outgoing_harmonics(P.links_e(spark, sf_dir)).select("cell_id", *r6("distance_mean", "distance_std", "distance_max", "distance_max_over_mean", "longest_leverage"))


@query
def s2_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = P.links_e(spark, sf_dir)
    cells = cellstats.support(links, P.GRID_E).join(cellstats.outgoing_harmonics(links), "cell_id").withColumn("R1_out", F.round("R1_out", 9))
    return cellstats.spearman(cells, "R1_out", "N_out_move").select("pairs", *r6("correlation"))


@query
def s2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cellstats.strong_flags(P.cells_stored(spark, sf_dir))
    # Values that differ in their last bits by partitioning are ties.
    cells = cells.withColumns({k: F.round(k, 9) for k in ("R1_out", "delta_theta_mu1_out", "distance_max_over_mean", "longest_leverage")}).withColumn("U_out_all_magnitude_rate", F.round(F.col("U_out_all_magnitude_rate") * 1000, 9))
    out = cellstats.outgoing_summary(cells, P.MIN_SUPPORT, 5, 0.5, 0.3, 0.5)
    ranks = [k for k in out.columns if k.startswith("spearman")]
    return out.select(*[k for k in out.columns if k not in ranks], *r6(*ranks))


@query
def s3_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cellstats.harmonic_residuals(P.cells_stored(spark, sf_dir))
    return out.select(*r6(*out.columns))


@query
def s3_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cellstats.entropy(P.links_e(spark, sf_dir), "end_id", "theta_arrival", "in")
    return e.select("cell_id", *r6("H_in", "effective_bins_in"), "occupied_bins_in")


@query
def s3_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cellstats.incoming_harmonics(P.links_e(spark, sf_dir)).select("cell_id", *r6("R1_in", "R2_in", "theta1_in", "mu_in_x", "mu_in_y", "distance_in_mean", "distance_in_max"))


@query
def s3_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.cells_e(spark, sf_dir).filter("theta1_out is not null and theta1_in is not null")
    return cells.select("cell_id", *r6("A_io", "A_io_mu", "delta_theta_io_1", "delta_theta_io_mu", "abs_delta_theta_io_1", "abs_delta_theta_io_mu", "abs_delta_theta_io_1_minus_mu"))


@query
def s3_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cellstats.strong_flags(P.cells_stored(spark, sf_dir))
    out = cellstats.alignment_summary(cells, P.MIN_SUPPORT, 5, 0.5, 0.3)
    numbers = ("median_alignment_difference", "q95_alignment_difference", "spearman_alignments")
    return out.select(*[c for c in out.columns if c not in numbers], *r6(*numbers))


@query
def s1_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cellstats.moment_identities(P.cells_stored(spark, sf_dir))
    return out.select(*r6(*out.columns))


@query
def dirv_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cellstats.vector_identities(P.cells_stored(spark, sf_dir))
    return out.select(*out.columns[:3], *r6(*out.columns[3:]))


@query
def dirv_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cells_e(spark, sf_dir).filter("N_out_total > 0").select("cell_id", *r6("D_out_move_x", "D_out_move_y", "D_out_move_magnitude", "D_out_all_x", "D_out_all_y", "D_out_all_magnitude", U_coh_rate=F.col("U_coh_rate") * 1000))


@query
def cell_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the statistics of every cell."""
    columns = ["x", "y", "P_move", "R1_out", "R1_in", "theta1_out", "theta_mu_out", "theta1_in", "theta_mu_in", "D_out_all_x", "D_out_all_y"]
    return P.cells_e(spark, sf_dir).select("cell_id", "x_bin", "y_bin", "N_out_total", "N_out_move", *r6(*columns, U_out_all_magnitude_rate=F.col("U_out_all_magnitude_rate") * 1000))


@query
def nbr_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.cells_stored(spark, sf_dir)
    return gridops.consistency(cells, "theta1_out", P.GRID_E, "N_out_move", P.MIN_SUPPORT).select("cell_id", *r6("consistency"), "neighbours")


@query
def grd_smooth3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.supported_e(spark, sf_dir)
    return gridops.smooth(cells, "N_out_move", P.GRID_E).select("cell_id", *r6("smoothed"))


@query
def grd_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.supported_e(spark, sf_dir)
    points = cells.select("cell_id", (F.col("x") + 3.7).alias("px"), (F.col("y") - 2.3).alias("py"))
    return gridops.sample(points, ["cell_id"], cells, ["N_out_move"], P.GRID_E).select("cell_id", "boundary", *r6("N_out_move"))


@query
def grd_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbour_pairs(P.supported_e(spark, sf_dir), P.GRID_E)


@query
def rdg_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ridge.threshold(P.supported_e(spark, sf_dir), "U_out_all_magnitude_rate", 0.9).select(*r6(threshold=F.col("threshold") * 1000))


@query
def rdg_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ridge.flux_ridge(P.cells_stored(spark, sf_dir), P.GRID_E, P.SPACE_E, P.MIN_SUPPORT)
    return found.select("cell_id", "ridge_type", "missing_side", "left_status", "right_status", *r6(D_minus=F.col("D_minus") * 1000, D_plus=F.col("D_plus") * 1000))


@query
def rdg_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ridge.flux_ridge(P.cells_stored(spark, sf_dir), P.GRID_E, P.SPACE_E, P.MIN_SUPPORT)
    flags = ["reason_theta_mu_out_undefined", "reason_transverse_domain_boundary", "reason_transverse_sample_unsupported_or_missing", "reason_interpolation_not_defensible", "orientation_reliable", "orientation_ambiguous", "core", "core_two_sided", "core_one_sided"]
    return found.select("cell_id", "evaluability", "observability", "flank_observability", "reason", *flags, *r6("C_perp_normalized", "C_perp_one_sided_normalized", C_perp=F.col("C_perp") * 1000, C_perp_one_sided=F.col("C_perp_one_sided") * 1000))


@query
def rdg_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ridge.flux_ridge(P.cells_stored(spark, sf_dir), P.GRID_E, P.SPACE_E, P.MIN_SUPPORT, policy="two_sided_only", smoothed=True)
    return found.select("cell_id", "ridge_type", "candidate", "core", "reason", *r6(S0_field_rate=F.col("S0_field_rate") * 1000, threshold=F.col("threshold") * 1000))


@query
def dcr_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.cells_stored(spark, sf_dir)
    return cells.filter(ridge.directional_candidates(cells, P.MIN_SUPPORT, **P.LIMITS)).select("cell_id", *r6("theta1_out", "R1_out"))


@query
def dcr_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.cells_stored(spark, sf_dir)
    edges = directional.compatible_edges(cells.filter(ridge.directional_candidates(cells, P.MIN_SUPPORT, **P.LIMITS)), P.GRID_E, P.SPACE_E)
    return edges.select("a", "b", *r6("edge_length", "direction_difference", "mismatch_a", "mismatch_b"))


@query
def grf_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.cells_stored(spark, sf_dir)
    found = directional.candidates(cells, P.GRID_E, P.SPACE_E, P.MIN_SUPPORT, **P.LIMITS)
    return found.select("cell_id", "component", F.col("component_number").cast("long"), F.col("component_cells").cast("long"))


@query
def grf_components_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components as on grids too large for one task."""
    cells = P.cells_stored(spark, sf_dir)
    found = directional.candidates(cells, P.GRID_E, P.SPACE_E, P.MIN_SUPPORT, in_rounds=True, **P.LIMITS)
    return found.select("cell_id", "component", "component_number", F.col("component_cells").cast("long"))


@query
def grf_degree_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.cells_stored(spark, sf_dir)
    found = directional.candidates(cells, P.GRID_E, P.SPACE_E, P.MIN_SUPPORT, **P.LIMITS)
    return found.select("cell_id", F.col("degree").cast("long"), "endpoint", "junction", "isolated", "component_class")


@query
def dcr_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.cells_stored(spark, sf_dir)
    found = directional.candidates(cells, P.GRID_E, P.SPACE_E, P.MIN_SUPPORT, **P.LIMITS)
    out = directional.component_statistics(found, directional.compatible_edges(found, P.GRID_E, P.SPACE_E), P.SPACE_E)
    plain = ("strength", "mean_strength", "median_strength", "direction_concentration", "edge_length", "x_span", "y_span", "centroid_x", "centroid_y", "mean_P_move", "median_P_move", "mean_R1_out", "median_R1_out", "mean_direction_difference", "largest_direction_difference", "mean_step_mismatch", "largest_step_mismatch")
    return out.select("component", "cells", "edges", "transitions", "endpoints", "junctions", "rank_cells", "rank_length", "rank_median_strength", *r6(*plain))


@query
def dcr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.cells_stored(spark, sf_dir)
    out = directional.corridor_summary(cells, directional.candidates(cells, P.GRID_E, P.SPACE_E, P.MIN_SUPPORT, **P.LIMITS), P.MIN_SUPPORT)
    counts = ("supported_cells", "candidate_cells", "candidate_components")
    return out.select(*counts, *r6(*[c for c in out.columns if c not in counts]))


@query
def dco_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.cells_stored(spark, sf_dir)
    thin = directional.thinned_ridges(cells, P.GRID_E, P.SPACE_E, P.MIN_SUPPORT, **P.LIMITS)
    out = directional.core_summary(thin, directional.connected_cores(thin, P.GRID_E, P.SPACE_E))
    quantiles = [c for c in out.columns if c[-4:-2] == "_q"]
    return out.select(*[c for c in out.columns if c not in quantiles], *r6(*quantiles))


@query
def dfr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.directional_found(spark, sf_dir)
    out = directional.front_summary(found["summaries"], sections.fronts(found["cores"], found["zones"], sections.DIRECTIONAL))
    quantiles = [c for c in out.columns if c[-4:-2] == "_q"]
    return out.select(*[c for c in out.columns if c not in quantiles], *r6(*quantiles))


@query
def sec_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sections.section_summaries(P.directional_sections_e(spark, sf_dir)[1], sections.DIRECTIONAL, P.SECTIONS, P.MIN_SUPPORT)
    return out.select("section", "valid_samples", "unsupported_samples", "boundary_samples", "opposing_outer_flow", "quality_flags", *r6("total_variation", "total_variation_smoothed"))


@query
def sec_flux_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.flux_found(spark, sf_dir)["summaries"]
    return out.select("section", "valid_samples", "unsupported_samples", "boundary_samples", "opposing_outer_flow", "quality_flags", "nearby_branch_contamination", *r6(total_variation=F.col("total_variation") * 1000, total_variation_smoothed=F.col("total_variation_smoothed") * 1000))


@query
def dco_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.cells_stored(spark, sf_dir)
    found = cells.filter(ridge.directional_candidates(cells, P.MIN_SUPPORT, **P.LIMITS))
    return directional.raw_ridges(cells, found, P.GRID_E, P.SPACE_E, P.MIN_SUPPORT).select("cell_id", "ridge_type", "missing_side", *r6("left_value", "right_value"))


@query
def dco_plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.cells_stored(spark, sf_dir)
    found = cells.filter(ridge.directional_candidates(cells, P.MIN_SUPPORT, **P.LIMITS))
    out = directional.plateaus(directional.raw_ridges(cells, found, P.GRID_E, P.SPACE_E, P.MIN_SUPPORT), P.GRID_E, P.SPACE_E)
    return out.select("cell_id", "plateau_id", F.col("plateau_size").cast("long"), "representative", "is_representative")


@query
def dco_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.directional_cores_e(spark, sf_dir).select("cell_id", "component_id", "ridge_type", "missing_side", "plateau_id")


@query
def dfr_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    cores = P.directional_cores_e(spark, sf_dir)
    return directional.hops(cores, directional.compatible_edges(cores, P.GRID_E, P.SPACE_E), 2)


def _directional_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.directional_sections_e(spark, sf_dir)[1]


@query
def dfr_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _directional_sections(spark, sf_dir).select("cell_id", "i", "side", "observable", *r6("u", "u_smooth", "core_u"))


@query
def dfr_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _directional_sections(spark, sf_dir).filter("step is not null")
    return rows.select("cell_id", "step", "n_composite", F.coalesce("n_decline", F.lit(0)).cast("long").alias("n_decline"), *r6("u_composite", "u_q25", "u_q75", "fraction_decline"))


@query
def dfr_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sections.zones(_directional_sections(spark, sf_dir), sections.DIRECTIONAL, P.SECTIONS)
    return out.select("cell_id", "side", "persistent", "eligible", F.coalesce(F.col("rank").cast("long"), F.lit(0)).alias("rank"), *r6("distance", "drop", "relative_drop"))


@query
def dfr_fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = directional.directional_fronts(*P.directional_sections_e(spark, sf_dir), P.SECTIONS)
    return out.select("cell_id", "side", "observable", "front_detected", "front_status", *r6("front_x", "front_y", "distance_from_core", "loss", "relative_loss"))


@query
def grf_segments_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered segments as on grids too large for one task."""
    members = flux.oriented_segments(P.flux_cores_e(spark, sf_dir), P.GRID_E, P.SPACE_E, in_rounds=True)
    return members.select("component", "segment", "sequence", "cell_id", "closed", *r6("tangent", "mismatch", "edge_length"))


@query
def grf_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = flux.oriented_segments(P.flux_cores_e(spark, sf_dir), P.GRID_E, P.SPACE_E)
    return members.select("component", "segment", "sequence", "cell_id", "closed", *r6("tangent", "mismatch", "edge_length"))


@query
def grf_segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cores = P.flux_cores_e(spark, sf_dir)
    out = flux.segment_statistics(flux.oriented_segments(cores, P.GRID_E, P.SPACE_E), cores, P.SPACE_E)
    counts = ["cells", "endpoints", "junction_endpoints", "abrupt_mismatches", "two_sided_cells", "one_sided_cells", "orientation_reliable_cells", "orientation_ambiguous_cells", "minimum_N_out_move"]
    return out.select("component", "segment", "closed", *counts, *r6("length", "total_turn", "largest_turn", "mean_mismatch", "median_mismatch", "largest_mismatch", "x_span", "y_span", "mean_R1_out", "mean_N_out_move", integrated_strength=F.col("integrated_strength") * 1000))


@query
def grf_component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.flux_found(spark, sf_dir)
    broken = flux.interruptions(found["cores"], found["cells"].filter(F.col("N_out_move") >= P.MIN_SUPPORT), P.GRID_E)
    out = flux.component_statistics(found["cores"], found["members"], broken, P.SPACE_E)
    counts = ["cells", "segments", "endpoints", "junctions", "unsupported_interruptions", "abrupt_mismatches", "two_sided_cells", "one_sided_cells", "minimum_N_out_move", "rank_length", "rank_median_flux", "rank_integrated_strength", "rank_median_contrast", "rank_minimum_support"]
    rates = {c: F.col(c) * 1000 for c in ("mean_U_out_all_magnitude_rate", "median_U_out_all_magnitude_rate", "maximum_U_out_all_magnitude_rate", "mean_C_perp", "median_C_perp", "mean_C_perp_one_sided", "median_C_perp_one_sided", "integrated_strength")}
    plain = ("length", "total_turn", "largest_turn", "mean_mismatch", "median_mismatch", "largest_mismatch", "x_span", "y_span", "centroid_x", "centroid_y", "mean_C_perp_normalized", "mean_R1_out", "median_R1_out", "mean_R2_out", "mean_delta_theta_mu1_out", "mean_N_out_move", "mean_R1_in", "mean_N_in_move", "mean_abs_delta_theta_io_1", "mean_abs_delta_theta_io_mu")
    return out.select("component", "component_class", *counts, *r6(*plain, **rates))





@query
def grf_interruptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.cells_stored(spark, sf_dir)
    return flux.interruptions(P.flux_cores_e(spark, sf_dir, cells), cells.filter(F.col("N_out_move") >= P.MIN_SUPPORT), P.GRID_E)


@query
def sec_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.flux_sections_e(spark, sf_dir)
    return rows.select("cell_id", "i", "side", "boundary", "observable", *r6("px", "py", "distance", u=F.col("u") * 1000)).distinct()


@query
def sec_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field read at the samples of a section, and each sample's class."""
    cells, cores, _ = P.flux_e(spark, sf_dir)
    rows = flux.flux_sections(cores, cells.filter(F.col("N_out_move") >= P.MIN_SUPPORT), P.GRID_E, P.SPACE_E, P.SECTIONS, extra=flux.SAMPLED)
    rates = ("U_out_all_magnitude_rate", "U_out_move_magnitude_rate")
    return rows.select("cell_id", "i", "sample_class", *r6(*[f"at_{c}" for c in flux.SAMPLED if c not in rates], **{f"at_{c}": F.col(f"at_{c}") * 1000 for c in rates})).distinct()


@query
def dfr_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.cells_stored(spark, sf_dir)
    rows = directional.directional_sections(P.directional_cores_e(spark, sf_dir, cells), cells, P.GRID_E, P.SPACE_E, P.MIN_SUPPORT, P.SECTIONS, extra=directional.SAMPLED)
    return rows.select("cell_id", "i", "sample_class", *r6(*[f"at_{c}" for c in directional.SAMPLED]))


@query
def sec_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.flux_sections_e(spark, sf_dir)
    return rows.select("cell_id", "core_i", "core_uncertain", *r6(core_u=F.col("core_u") * 1000)).distinct()


@query
def sec_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.flux_sections_e(spark, sf_dir).select("cell_id", "i", *r6("u_relative", u_smooth=F.col("u_smooth") * 1000)).distinct()


@query
def sec_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    cores = P.flux_cores_e(spark, sf_dir).withColumn("section", F.col("cell_id"))
    return sections.contaminated(cores, cores, "theta_mu_out", P.GRID_E, P.SPACE_E, P.SECTIONS)


@query
def cmpx_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.flux_sections_e(spark, sf_dir).filter("step is not null")
    return rows.select("section", "step", "n_composite", *r6(u_composite=F.col("u_composite") * 1000, u_q25=F.col("u_q25") * 1000, u_q75=F.col("u_q75") * 1000))


@query
def cmpx_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.flux_sections_e(spark, sf_dir).filter("n_decline is not null")
    return rows.select("section", "step", "n_decline", *r6("fraction_decline"))


@query
def cmpx_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.flux_sections_e(spark, sf_dir)
    out = sections.composite_spans(rows, flux.neighbours_along(rows, P.SECTIONS.composite_window), P.SPACE_E)
    return out.select("section", "neighbour_sections", "n_neighbours", *r6("composite_span"))


@query
def drp_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sections.zones(P.flux_sections_e(spark, sf_dir), sections.FLUX, P.SECTIONS)
    return out.select("section", "side", "cell_id", "persistent", "eligible", "profile_used", F.col("n_neighbours").cast("long"), F.col("supporting_samples").cast("long"), F.col("rank").cast("long"), *r6("distance", "relative_drop", "width", "minimum_N_out_move", drop=F.col("drop") * 1000, recovery=F.col("recovery") * 1000))


@query
def drp_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.flux_found(spark, sf_dir)["sides"]
    return out.select("section", "side", "observable", "candidates", "detected", "status", "persistent", "strong_recovery", "opposing", *r6("distance_half", "distance_1e", "distance_zero", "front_distance", "relative_drop"))


@query
def drp_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.flux_found(spark, sf_dir)
    out = sections.outcome_flags(found["summaries"], sections.section_outcomes(found["sides"]))
    return out.select("section", "observable_sides", "detected_sides", "no_candidate_drop", "all_observable_have_drop", "observable_without_drop", "multiple_candidate_drops", "left_status", "right_status", "quality_flags")


@query
def drp_flanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.flux_found(spark, sf_dir)["flanks"]
    return out.select("section", "side", "cell_id", "multiple_candidate_drops", "strong_recovery", "quality_flags", *r6("front_x", "front_y", "distance"))


@query
def frt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.flux_found(spark, sf_dir)
    out = flux.front_summary(sections.outcome_flags(found["summaries"], sections.section_outcomes(found["sides"])), found["flanks"])
    rates = ("median_total_variation", "median_total_variation_smoothed", "median_drop")
    plain = ("median_left_distance", "median_right_distance", "median_distance_asymmetry", "median_variation_reduction", "persistent_fraction")
    return out.select(*[c for c in out.columns if c not in rates + plain], *r6(*plain, **{c: F.col(c) * 1000 for c in rates}))


@query
def frt_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cores, rows = P.flux_e(spark, sf_dir)
    out = flux.flux_fronts(cores, rows, P.SECTIONS)
    return out.select("cell_id", "side", "observable", "front_detected", "front_status", *r6("front_x", "front_y", "distance_from_core", "relative_loss", loss=F.col("loss") * 1000))


@query
def cmp_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.compared_e(spark, sf_dir)
    return out.select("cell_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("flux_component", "directional_component")], "class")


@query
def cmp_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare.component_overlap(P.compared_e(spark, sf_dir))
    return out.select("kind", F.col("component").cast("long"), "cells", "shared", *r6("fraction"))


@query
def cmp_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare.summary(P.compared_e(spark, sf_dir))
    return out.select("supported_cells", *compare.CLASSES, *r6(*[f"{c}_fraction" for c in compare.CLASSES]))


@query
def grv_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gridops.gradient(P.cells_stored(spark, sf_dir), "N_out_move", P.GRID_E, P.SPACE_E)
    return out.select("cell_id", "gradient_east_method", "gradient_north_method", *r6("gradient_east", "gradient_north"))


@query
def grv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.gradients_found(spark, sf_dir)["fields"]
    return out.select("cell_id", "gradient_quality_flags", *r6("gradient_across_fraction", **{c: F.col(c) * 1e6 for c in ("gradient_across", "abs_across", "gradient_along", "gradient_magnitude")}))


MICRO = ("gradient_across_at_front", "abs_across_at_front", "gradient_along_at_front", "gradient_magnitude_at_front", "abs_across_at_core")


@query
def grv_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.gradients_found(spark, sf_dir)["segment"]
    return out.select("section", "side", "class_front", "class_core", "boundary_front", "unsupported_front", *r6("gradient_across_fraction_at_front", **{c: F.col(c) * 1e6 for c in MICRO}))


@query
def grv_surroundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.gradients_found(spark, sf_dir)["segment"]
    return out.select("section", "side", "background_cells", *r6("local_max_distance", "local_max_scales", "percentile", local_max=F.col("local_max") * 1e6))


@query
def grv_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.gradients_found(spark, sf_dir)["segment"]
    return out.select("comparison_record_id", "section", "side", "gradient_observability", "core_ratio_unstable", "quality_flags", *r6("front_to_core_ratio"))


@query
def grv_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.gradients_found(spark, sf_dir)["unique"]
    return out.select("unique_comparison_id", "cell_id", "side", "n_segment_records", "comparison_record_ids", "section_ids", "gradient_observability", "duplicate_flank_disagreement", "persistent", "sample_classes", "quality_flags", *r6("front_x", "front_y", "distance", "distance_spread", "percentile", "local_max_scales", abs_across_at_front=F.col("abs_across_at_front") * 1e6))


@query
def grv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.gradients_found(spark, sf_dir)
    out = gradients.summary(found["fields"], found["segment"], found["unique"])
    tiny = ("abs_across_q50", "abs_across_q75", "abs_across_q90", "abs_across_q95", "median_at_front", "median_at_core")
    plain = ("median_percentile", "within_half_scale", "within_one_scale", "median_distance_to_max", "median_scales_to_max", "front_above_core", "opposite_signs", "spearman_loss_gradient")
    return out.select(*[c for c in out.columns if c not in tiny + plain], *r6(*plain, **{c: F.col(c) * 1e6 for c in tiny}))


@query
def grv_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.gradients_found(spark, sf_dir)
    return gradients.covered(found["fields"], found["unique"], P.GRID_E, P.SPACE_E).select("level", "cells", "with_front", *r6("fraction"))


@query
def geo_cart_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geodesy.with_scales(P.cells_stored(spark, sf_dir).select("cell_id", "x_bin", "y_bin"), P.GRID_E, P.SPACE_E).select("cell_id", *r6("x_scale", "y_scale", "scale"))


@query
def geo_geodesic(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = cellstats.enriched_links(P.matrix_g(spark, sf_dir), P.GRID_G, P.SPACE_G)
    return links.select(*BINS, *r6("distance", "theta_out", "theta_in_source"))


@query
def geo_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places reached from the events' positions on a sphere, by bearings and distances of the events."""
    space = geodesy.Space(True, "km", "sphere")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("value") * 0.5 - 40.0).alias("x"), (F.pmod(F.col("value"), F.lit(60.0)) - 30.0).alias("y"), F.pmod(F.col("event_id") * 37, F.lit(360)).cast("double").alias("bearing"), (F.col("event_id") % 5000 + 0.5).alias("distance"))
    rows = rows.withColumn("p", space.forward(F.col("x"), F.col("y"), F.col("bearing"), F.col("distance")))
    return rows.select("event_id", *r6(lon=F.col("p.x"), lat=F.col("p.y")))


def _written(spark: SparkSession, sf_dir: str, kind: str) -> list[str]:
    """The events as two folders of a kind, by user, in the shared folder: their paths."""
    out = []
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("who"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("a"), F.get_json_object("props", "$.k").cast("double").alias("b"), "event_type")
    for part in (0, 1):
        out.append(f"{storage.shared_dir(spark)}/source-{uuid.uuid4().hex}.{kind}")
        events.filter(F.pmod("who", F.lit(2)) == part).write.format(kind).option("header", True).save(out[-1])
    return out


def _read_back(spark: SparkSession, sf_dir: str, kind: str, identity: dict) -> DataFrame:
    columns = {"time": "us", "x": "a", "y": "b"} | ({"trajectory": "who"} if identity["mode"] == "column" else {})
    given = {"paths": _written(spark, sf_dir, kind), "columns": columns, "trajectory_id": identity, "time": {"kind": "numeric", "unit": "s"}}
    return trajectories.read(spark, config.input_of(given))


@query
def src_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of CSV files, tracks known by a column that holds for all files."""
    rows = _read_back(spark, sf_dir, "csv", {"mode": "column", "scope": "global"})
    return rows.groupBy("trajectory").agg(F.count("*").alias("observations"), F.round(F.sum(F.col("time") / 1e6) / F.count("*"), 3).alias("mean_time"), *[F.round(F.avg(c), 6).alias(c) for c in "xy"])


@query
def src_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of Parquet files, each path a track."""
    rows = _read_back(spark, sf_dir, "parquet", {"mode": "filename"})
    out = rows.groupBy("trajectory").agg(F.count("*").alias("observations"), F.min("x").alias("least_x"), F.max("y").alias("greatest_y"))
    return out.select("observations", *r6("least_x", "greatest_y"))


#: Places of an array that are stored together.
CHUNK_PLACES = 4096


def _as_arrays(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """The events as one-dimensional arrays in the order of their ids, in a Zarr directory or a classic NetCDF file of the shared folder: its path.

    Executors write a chunk each, so that folder must be one that all can open as files; others raise.
    """
    place = urllib.parse.urlparse(f"{storage.shared_dir(spark)}/arrays-{uuid.uuid4().hex}.{'nc' if kind == 'netcdf' else kind}")
    if place.scheme not in ("", "file"):
        raise ValueError(f"{place.geturl()}: arrays are written to a file system that all executors can open")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").cast("double").alias("who"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), F.col("value").cast("double").alias("a"), F.get_json_object("props", "$.k").cast("double").alias("b"))
    rows = ranks.numbered(events, [F.col("event_id")], "place", 0)
    n, names = events.count(), ["who", "us", "a", "b"]
    if kind == "zarr":
        for name in names:
            folder = Path(place.path, name)
            folder.mkdir(parents=True)
            (folder / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [n], "chunks": [CHUNK_PLACES], "dtype": "<f8", "compressor": {"id": "zlib"}, "fill_value": "NaN", "order": "C", "filters": None}))
            (folder / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": ["obs"]}))
        starts = {}
    else:
        text = lambda t: struct.pack(">i", len(t)) + t.encode() + b"\0" * (-len(t) % 4)
        before = b"CDF\x02" + struct.pack(">iii", 0, 10, 1) + text("obs") + struct.pack(">iiiii", n, 0, 0, 11, len(names))
        size = len(before) + sum(len(text(v)) + 36 for v in names)
        starts = {v: size + 8 * n * i for i, v in enumerate(names)}
        header = before + b"".join(text(v) + struct.pack(">iiiiiiq", 1, 0, 0, 0, 6, 8 * n, starts[v]) for v in names)
        with open(place.path, "wb") as f:
            f.write(header)
            f.truncate(size + 8 * n * len(names))

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        chunk, first = int(frame["place"].iloc[0]) // CHUNK_PLACES, int(frame["place"].iloc[0])
        for name in names:
            values = frame[name].to_numpy(float)
            if kind == "zarr":
                whole = np.full(CHUNK_PLACES, np.nan)
                whole[: len(values)] = values
                Path(place.path, name, str(chunk)).write_bytes(zlib.compress(whole.astype("<f8").tobytes()))
            else:
                with open(place.path, "r+b") as f:
                    f.seek(starts[name] + 8 * first)
                    f.write(values.astype(">f8").tobytes())
        return pd.DataFrame({"n": [len(frame)]})

    written = rows.groupBy(F.floor(F.col("place") / CHUNK_PLACES)).applyInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0
    assert written == n
    return place.path


def _array_tracks(spark: SparkSession, sf_dir: str, kind: str, within: dict) -> DataFrame:
    given = {"paths": [_as_arrays(spark, sf_dir, kind)], "columns": {"trajectory": "who", "time": "us", "x": "a", "y": "b"}, "trajectory_id": {"mode": "column", "scope": "global"}, "time": {"kind": "numeric", "unit": "s"}}
    rows = trajectories.read(spark, config.input_of(given), within)
    out = rows.groupBy("trajectory").agg(F.count("*").alias("observations"), F.sum(F.col("row_index") % 1000).alias("places"), F.round(F.sum(F.col("time") / 1e6) / F.count("*"), 3).alias("mean_time"), *[F.round(F.sum(c), 3).alias(f"sum_{c}") for c in "xy"])
    return out.withColumn("trajectory", F.col("trajectory").cast("double"))


@query
def src_zarr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of a chunked Zarr directory, those in a box of both coordinates."""
    return _array_tracks(spark, sf_dir, "zarr", {"a": (5.0, 60.0), "b": (None, 75.0)})


@query
def src_netcdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations of a classic NetCDF file."""
    return _array_tracks(spark, sf_dir, "netcdf", {})


@query
def san_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks, segments and matrix of no observations, and of all: their columns' types, and how many rows."""
    raw = P.events_raw(spark, sf_dir)
    out = None
    for rows, name in ((raw.filter("x < -1e9"), "none"), (raw, "all")):
        tracked = tracks.sanitise(rows)
        segs = matrix.segments(tracked, P.DAY)
        for what, table in (("tracks", tracked), ("segments", segs), ("matrix", matrix.transition_matrix(segs, P.GRID_E))):
            one = table.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("given"), F.lit(what).alias("made"), F.lit(",".join(t for _, t in table.dtypes)).alias("types"), "n_rows")
            out = one if out is None else out.unionByName(one)
    return out


@query
def val_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the check of columns and types says of the matrix, and of it with columns lacking or of other types, for each of its links."""
    table = P.matrix_e(spark, sf_dir)
    text = table.withColumn("transition_count", F.col("transition_count").cast("string")).withColumn("end_x_bin", F.col("end_x_bin").cast("double"))
    cases = {"good": table, "lacking": table.drop("end_y_bin", "start_x_center"), "types": text}
    found = [F.struct(F.lit(k).alias("case_name"), F.lit(";".join(validate.schema_errors(t))).alias("errors")) for k, t in cases.items()]
    return table.select("start_x_bin", "start_y_bin", "end_x_bin", "end_y_bin", F.explode(F.array(*found)).alias("c")).select("start_x_bin", "start_y_bin", "end_x_bin", "end_y_bin", "c.case_name", "c.errors")


@query
def geo_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = cellstats.enriched_links(P.matrix_g(spark, sf_dir), P.GRID_G, P.SPACE_G)
    cells = cellstats.cell_statistics(links, P.GRID_G, P.DAY)
    return cells.select("cell_id", "N_out_move", *r6("R1_out", "theta1_out", "mu_out_all_magnitude", "A_io"))


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.reviewed(P.cells_stored(spark, sf_dir), P.GRID_E, P.REVIEW)


@query
def s4_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"{c}_neigh_{side}_{kind}_{n}" for n in P.REVIEW.supports for side in ("out", "in") for kind in ("1", "mu") for c in "CN"]
    return _reviewed(spark, sf_dir).select("cell_id", "strong", "top", "substantial_turn_1", "substantial_turn_mu", *[n for n in names if n[0] == "N"], *r6(*[n for n in names if n[0] == "C"]))


@query
def s4_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = review.levels(P.cells_stored(spark, sf_dir), P.REVIEW)
    rates = {c: F.col(c) * 1000 for c in ("flux_threshold", "coherent_threshold")}
    return out.select("support", "level", "population", "flux_cells", "coherent_cells", "both", "either", *r6("jaccard", "flux_retained", "coherent_retained", "median_R1_flux", "median_R1_removed", **rates))


@query
def s4_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = review.directions(_reviewed(spark, sf_dir), P.REVIEW)
    return out.select("population", "field", "cells", "from_review", "from_substantial", *r6("q0", "q0_05", "q0_5", "q0_95", "q0_99", "q1"))


@query
def s4_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = review.persistence(_reviewed(spark, sf_dir), P.REVIEW)
    return out.select("support", "field", F.coalesce("level", F.lit(0.0)).alias("level"), "cells", "with_neighbourhood", *r6("median_consistency", "consistent_fraction", "median_R1", "median_neighbours"))


@query
def s4_low_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = review.low_alignment(_reviewed(spark, sf_dir), P.REVIEW)
    return out.select("cell_id", "interpretation", "joint_support", "reliable", "spatially_persistent", "complex_out", "complex_in", *r6("turn", "A_io"))


@query
def s4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = review.representatives(_reviewed(spark, sf_dir), P.REVIEW)
    return out.select("category", F.col("place").cast("long"), "cell_id", "fallback", *r6(score=F.col("score") * 1000))


@query
def s4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = review.summary(_reviewed(spark, sf_dir), P.REVIEW)
    numbers = ("median_R1_out", "strong_median_difference", "strong_q95_difference", "A_io_residual", "A_io_mu_residual", "spearman_flux_coherent")
    return out.select(*[c for c in out.columns if c not in numbers], *r6(*numbers))


@query
def s4_interpretations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.interpretation_counts(_reviewed(spark, sf_dir), P.REVIEW)


@query
def ang_longitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.tracks_g(spark, sf_dir).withColumn("x", F.round("x", 3))
    return g.groupBy("trajectory").agg(*r6(span=angles.longitude_span(F.col("x")), mean=angles.mean_bearing(F.col("x"))))


@query
def plt_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.cells_stored(spark, sf_dir)
    one = review.limits(cells, "R1_out", 98.0).select(F.lit("R1_out").alias("field"), *r6("low", "high"))
    return one.unionByName(review.limits(cells, "delta_theta_io_1", 95.0, True).select(F.lit("delta_theta_io_1").alias("field"), *r6("low", "high")))


@query
def plt_vector_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.vectors(P.cells_stored(spark, sf_dir), 3).select("cell_id", "x_bin", "y_bin", *r6("D_out_all_x", "D_out_all_y"))


@query
def plt_dateline_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = P.tracks_g(spark, sf_dir).select(F.col("trajectory").alias("line"), F.col("time").alias("place"), "x", "y")
    return review.dateline_parts(lines).groupBy("line", "part").agg(F.count("*").alias("points")).select("line", F.col("part").cast("long"), "points")


@query
def src_on_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    lon = F.when(F.pmod("event_id", F.lit(13)) == 0, float("nan")).otherwise(F.col("value") * 9)
    rows = e.select("event_id", lon.alias("lon"), (F.col("value") - 50.0).alias("lat"))
    return auxiliary.on_map(rows).select("event_id", *r6("lon", "lat"))


@query
def snk_public_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell table of a run as it is written, of a geographic run with kilometres and days."""
    out = naming.public(tables.cells(P.cells_e(spark, sf_dir)), geodesy.Space(True, "km"), "day")
    places, rest = ["cell_id", "start_lon_bin", "start_lat_bin", "N_out_move"], ["lon", "lat", "P_move", "R1_out", "R1_in", "D_out_all_east", "D_out_all_north", "theta1_in_motion_destination"]
    return out.select(*places, *r6(*rest, U_out_all_magnitude_km_day=F.col("U_out_all_magnitude_km_day") * 1000))


__all__ = ["ORACLES", "QUERIES"]
