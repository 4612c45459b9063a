"""The tables of a run under the names that users read, before units: each from an operator's own table.

A schema maps a table's names to the operator's columns, in the order of the file; names
and order are a fixed public contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = {"cell_id": "cell_id", "start_x_bin": "x_bin", "start_y_bin": "y_bin", "x": "x", "y": "y"}

def _sees(side: str) -> Column:
    return ~F.col("missing_side").isin(side, "left_and_right")


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def shaped(df: DataFrame, schema: dict, optional: tuple[str, ...] = ()) -> DataFrame:
    """df's columns as the schema names them. Only `optional` ones may be lacking, and are left out then; ValueError for others."""
    lacking = {source for source in schema.values() if not isinstance(source, Column) and source not in df.columns}
    if wrong := sorted(lacking - set(optional)):
        raise ValueError(f"the table lacks {wrong}")
    return df.select(*[source.alias(name) if isinstance(source, Column) else F.col(source).alias(name) for name, source in schema.items() if isinstance(source, Column) or source not in lacking])


CELLS = BINS | _same("N_out_move", "N_in_move", "P_stay", "P_move", "U_out_all_x_rate", "U_out_all_y_rate", "U_out_all_magnitude_rate", "theta_mu_out", "theta1_out", "R1_out", "R2_out") | {"angular_entropy_out": "H_out"} | _same("D_out_move_x", "D_out_move_y", "D_out_move_magnitude", "D_out_all_x", "D_out_all_y", "D_out_all_magnitude", "R1_in", "R2_in") | {"theta1_in_motion_destination": "theta1_in", "theta_mu_in_motion_destination": "theta_mu_in", "delta_theta_mu1_in": "delta_theta_mu1_in", "delta_theta_io": "delta_theta_io_1"}


def cells(df: DataFrame) -> DataFrame:
    return shaped(df, CELLS)


def flux_cores(df: DataFrame) -> DataFrame:
    schema = BINS | _same("N_out_move", "U_out_all_magnitude_rate", "theta_mu_out", "R1_out", "R2_out", "ridge_type", "missing_side", "component_id")
    return shaped(df, schema | {"left_side_observable": _sees("left"), "right_side_observable": _sees("right")})


def fronts(df: DataFrame, directional: bool = False) -> DataFrame:
    """flux_fronts() or directional_fronts(), with their cores' component_id."""
    base = {"core_cell_id": "cell_id", "component_id": "component_id", "core_x": "core_x", "core_y": "core_y", ("core_ridge_type" if directional else "ridge_type"): "ridge_type", "side": "side", "observable": "observable", "front_x": "front_x", "front_y": "front_y"}
    if directional:
        own = {"distance_from_core_axis_length": "distance_from_core", "absolute_directional_drop": "loss", "relative_directional_drop": "relative_loss"}
    else:
        own = {"distance_from_core_length": "distance_from_core", "flux_loss_rate": "loss", "relative_flux_loss": "relative_loss"}
    return shaped(df, base | own | _same("front_detected", "front_status"))


_DIRECTION = _same("N_out_move", "P_move", "R1_out", "theta1_out", "D_out_all_x", "D_out_all_y", "D_out_all_magnitude")
_TRANSVERSE = {"transverse_left_status": "left_status", "transverse_right_status": "right_status", "transverse_left_strength": "left_value", "transverse_right_strength": "right_value", "grid_effective_scale_length": "scale", "transverse_sampling_distance_length": "sampling_distance"}


def directional_cores(df: DataFrame) -> DataFrame:
    schema = {"component_id": "component_id"} | BINS | _DIRECTION | _same("ridge_type", "missing_side")
    schema |= {"left_side_observable": _sees("left"), "right_side_observable": _sees("right")} | _TRANSVERSE
    return shaped(df, schema | {"plateau_group_id": "plateau_id", "plateau_size": "plateau_size", "directional_core_graph_degree": "degree", "directional_core_graph_endpoint": "endpoint", "directional_core_graph_junction": "junction"})


def directional_corridors(df: DataFrame) -> DataFrame:
    """Candidates with their graph, ridge and plateau diagnostics, and the core that they belong to."""
    schema = {"candidate_component_id": F.format_string("directional_candidate_component_%04d", "component_number")} | BINS | _DIRECTION
    schema |= {"candidate_graph_degree": "degree", "candidate_graph_endpoint": "endpoint", "candidate_graph_junction": "junction"} | _TRANSVERSE
    schema |= {"left_side_observable": _sees("left"), "right_side_observable": _sees("right")} | _same("missing_side", "ridge_type")
    return shaped(df, schema | {"raw_ridge_candidate": "raw_ridge", "plateau_group_id": "plateau_id", "plateau_size": "plateau_size", "plateau_representative_cell_id": "representative", "plateau_representative": "is_representative", "directional_core": "directional_core", "directional_core_component_id": "core_component_id"})


def comparison(df: DataFrame) -> DataFrame:
    schema = BINS | _same("N_out_move", "U_out_all_magnitude_rate", "D_out_all_magnitude", "flux_component_id", "directional_component_id")
    return shaped(df, schema | {"flux_core": F.col("flux_component_id").isNotNull(), "directional_core": F.col("directional_component_id").isNotNull(), "structure_class": "class"})


def component_comparison(df: DataFrame) -> DataFrame:
    return shaped(df, {"structure_type": "kind", "component_id": "component_id", "n_selected_cells": "cells", "n_overlap_cells": "shared", "overlap_fraction": "fraction"})


def gradient_validation(df: DataFrame) -> DataFrame:
    """cell_sides() of the gradient validation."""
    schema = {"unique_comparison_id": "unique_comparison_id", "ridge_cell_id": "cell_id", "side": "side", "ridge_type": "ridge_type", "flank_x": "front_x", "flank_y": "front_y", "flank_distance_length": "distance", "absolute_flux_loss": "drop", "relative_flux_loss": "relative_drop", "stage6_persistence": "persistent"}
    schema |= {"G_perp_at_flank": "gradient_across_at_front", "abs_G_perp_at_flank": "abs_across_at_front", "G_parallel_at_flank": "gradient_along_at_front", "gradient_magnitude_at_flank": "gradient_magnitude_at_front", "abs_G_perp_at_core": "abs_across_at_core", "local_max_abs_G_perp": "local_max"}
    schema |= {"distance_to_local_gradient_max_length": "local_max_distance", "distance_to_local_gradient_max_L_eff": "local_max_scales", "local_abs_G_perp_percentile": "percentile", "nearby_branch_contamination": "nearby_branch_contamination", "gradient_observability": "gradient_observability", "n_segment_records": "n_segment_records", "candidate_distance_spread_length": "distance_spread"}
    return shaped(df, schema | _same("duplicate_flank_disagreement", "comparison_record_ids", "component_ids", "segment_ids", "section_ids", "quality_flags"))


def drop_zones(df: DataFrame, directional: bool = False, best: bool = False) -> DataFrame:
    """Zones; best: those of flank_points(), which have flags."""
    core, level = ("core_cell_id", "D_parallel") if directional else ("cell_id", "U")
    schema = {"section_id": "section", core: "cell_id", "side": "side", "candidate_distance_length": "distance", "candidate_x": "front_x", "candidate_y": "front_y"}
    if directional:
        schema |= {f"{level}_axis": "core_u", f"{level}_inner": "inner", f"{level}_outer": "outer", "absolute_directional_drop": "drop", "relative_directional_drop": "relative_drop", "directional_drop_per_length": -F.col("slope"), "drop_width_length": "width", "along_core_persistence": "persistent"}
    else:
        schema |= {f"{level}_core": "core_u", f"{level}_inner": "inner", f"{level}_outer": "outer", "absolute_drop": "drop", "relative_drop": "relative_drop", "drop_slope_rate_per_length": "slope", "drop_width_length": "width", "number_supporting_samples": "supporting_samples", "outer_recovery": "recovery", "along_branch_persistence": "persistent"}
    schema |= {"n_sections_with_outward_decline": "n_decline", "fraction_sections_with_outward_decline": "fraction_decline", "n_neighbor_sections": "n_neighbours"} | _same("minimum_N_out_move", *([] if directional else ["minimum_N_in_move"]), "profile_used")
    more = _same("multiple_candidate_drops", "strong_recovery", "nearby_branch_contamination", "quality_flags") if best else {}
    return shaped(df, schema | {"candidate_eligible": "eligible", "drop_rank": "rank"} | more)


def cross_sections(df: DataFrame, directional: bool = False) -> DataFrame:
    u, core, axis = ("D_parallel", "core_cell", "axis") if directional else ("U_parallel", "stage5_ridge", "core")
    sampled = {c.removeprefix("at_"): c for c in df.columns if c.startswith("at_")}
    called = {"U_out_all_magnitude_rate": "U_out_all", "U_out_move_magnitude_rate": "U_out_move"}
    schema = {"section_id": "section", ("core_cell_id" if directional else "cell_id"): "cell_id", f"offset_index_from_{core}": "offset", f"offset_index_from_refined_{axis}": F.col("outward") / F.col("scale") * F.signum("step"), f"distance_from_{core}_length": "distance", "sample_x": "px", "sample_y": "py", "side": F.when(F.col("side") == "core", axis).otherwise(F.col("side"))}
    schema |= {f"{u}_raw": "u", f"{u}_smoothed": "u_smooth", f"{u}_relative": "u_relative", "sample_valid": F.col("u").isNotNull(), "side_observable": "observable", "analysis_sample_eligible": F.col("u").isNotNull() & F.col("observable"), "sample_class": "sample_class"}
    schema |= {f"{u}_composite_median": "u_composite", f"{u}_composite_q25": "u_q25", f"{u}_composite_q75": "u_q75", "n_composite_sections": "n_composite", "n_sections_with_outward_decline": "n_decline", "fraction_sections_with_outward_decline": "fraction_decline"}
    return shaped(df, schema | {called.get(k, k): v for k, v in sampled.items()})


def section_composites(df: DataFrame, directional: bool = False) -> DataFrame:
    u, axis = ("D_parallel_axis", "axis") if directional else ("U_parallel_core", "core")
    schema = {"section_id": "section", ("core_cell_id" if directional else "cell_id"): "cell_id", f"theta{'1' if directional else '_mu'}_out_center": "theta", "grid_effective_scale_length": "scale", f"refined_{axis}_x": "refined_x", f"refined_{axis}_y": "refined_y", f"d_{axis}_grid_scales": "core_offset", u: "core_u", f"{axis}_location_uncertain": "core_uncertain"}
    schema |= {"n_valid_samples": "valid_samples", "n_missing_support_samples": "unsupported_samples", "n_missing_boundary_samples": "boundary_samples", "opposing_outer_flow": "opposing_outer_flow", "short_available_cross_section": "short_available_cross_section"}
    if not directional:
        schema |= {"profile_total_variation_raw": "total_variation", "profile_total_variation_smoothed": "total_variation_smoothed", "composite_along_branch_span_length": "composite_span"} | _same("nearby_branch_contamination", "high_local_curvature_turning", "low_R1_out")
    schema |= {"n_neighbor_sections": "neighbour_sections" if directional else "n_neighbours"}
    for s in ("left", "right"):
        schema |= {f"{s}_front_detected": f"{s}_detected", f"{s}_candidate_count": f"{s}_candidates", f"{s}_drop_distance_length": f"{s}_front_distance", f"{s}_status": f"{s}_status", f"{s}_distance_50pct_length": f"{s}_distance_half", f"{s}_distance_1e_length": f"{s}_distance_1e", f"{s}_zero_crossing_length": f"{s}_distance_zero"}
    return shaped(df, schema | _same("no_candidate_drop", "multiple_candidate_drops", "quality_flags"))


def flux_components(df: DataFrame) -> DataFrame:
    schema = {"component_id": F.format_string("component_%04d", "component_number"), "component_geometry": "component_class", "n_cells": "cells", "physical_length_length": "length", "integrated_ridge_strength_area_rate": "integrated_strength", "number_segments": "segments", "number_endpoints": "endpoints", "number_junctions": "junctions", "number_unsupported_interruptions": "unsupported_interruptions"}
    schema |= {"mean_abs_delta_theta_ridge_mu": "mean_mismatch", "median_abs_delta_theta_ridge_mu": "median_mismatch", "maximum_abs_delta_theta_ridge_mu": "largest_mismatch", "n_abrupt_tangent_mismatch_diagnostic": "abrupt_mismatches", "cumulative_abs_tangent_turn_degrees": "total_turn", "maximum_local_tangent_turn_degrees": "largest_turn", "centroid_x": "centroid_x", "centroid_y": "centroid_y", "x_span": "x_span", "y_span": "y_span"}
    schema |= {"mean_U_out_all_rate": "mean_U_out_all_magnitude_rate", "median_U_out_all_rate": "median_U_out_all_magnitude_rate", "maximum_U_out_all_rate": "maximum_U_out_all_magnitude_rate", "mean_C_perp_rate": "mean_C_perp", "median_C_perp_rate": "median_C_perp", "mean_C_perp_normalized": "mean_C_perp_normalized", "mean_C_perp_one_sided_rate": "mean_C_perp_one_sided", "median_C_perp_one_sided_rate": "median_C_perp_one_sided"}
    schema |= {**_same("mean_R1_out", "median_R1_out", "mean_R2_out", "mean_delta_theta_mu1_out", "mean_N_out_move", "minimum_N_out_move", "mean_C_neigh_out", "mean_R1_in", "mean_N_in_move", "mean_abs_delta_theta_io_1", "mean_abs_delta_theta_io_mu"), "n_orientation_reliable_diagnostic": "orientation_reliable_cells", "n_orientation_ambiguous_diagnostic": "orientation_ambiguous_cells", "n_two_sided_ridge_cells": "two_sided_cells", "n_one_sided_ridge_cells": "one_sided_cells"}
    return shaped(df, schema | {"rank_physical_length": "rank_length", "rank_median_flux": "rank_median_flux", "rank_integrated_ridge_strength": "rank_integrated_strength", "rank_median_ridge_contrast": "rank_median_contrast", "rank_minimum_support": "rank_minimum_support"}, ("mean_C_neigh_out",))


def directional_components(df: DataFrame, core: bool) -> DataFrame:
    ids = {"component_id" if core else "candidate_component_id": F.format_string(f"directional_{'core' if core else 'candidate'}_component_%04d", "component_number")}
    schema = ids | {"n_cells": "cells", "n_edges": "edges", "network_length_length": "edge_length", "number_endpoints": "endpoints", "number_junctions": "junctions"} | _same("x_span", "y_span", "centroid_y", "centroid_x", "mean_P_move", "median_P_move", "mean_R1_out", "median_R1_out")
    schema |= {"mean_directional_strength": "mean_strength", "median_directional_strength": "median_strength"}
    if core:
        schema |= {"two_sided_ridge_cells": "two_sided_cells", "one_sided_ridge_cells": "one_sided_cells"}
    else:
        schema |= {"mean_neighbor_direction_difference_degrees": "mean_direction_difference", "maximum_neighbor_direction_difference_degrees": "largest_direction_difference", "mean_step_direction_mismatch_degrees": "mean_step_mismatch", "maximum_step_direction_mismatch_degrees": "largest_step_mismatch"}
    return shaped(df, schema | {"rank_network_length": "rank_length", "rank_median_directional_strength": "rank_median_strength"})


def graph_edges(df: DataFrame) -> DataFrame:
    return shaped(df, {"first_cell_id": "a", "second_cell_id": "b", "edge_length_length": "edge_length", "direction_difference_degrees": "direction_difference", "first_step_mismatch_degrees": "mismatch_a", "second_step_mismatch_degrees": "mismatch_b", "maximum_step_mismatch_degrees": "largest_mismatch", "direction_compatibility_cosine": "compatibility"})
