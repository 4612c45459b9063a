"""Public column names, put together from what each column is declared to measure.

Inner names are free of units and of the coordinate system. A column that measures
something has its unit put after its stem, and a position or a part of a vector is called
by the axes of the run; a column that is not declared here keeps its name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from drift_engine.functions.geodesy import Space

#: How a unit is written: L is the length unit, T the time unit (fixed values).
LENGTH, RATE, AREA_RATE, GRADIENT = "_{L}", "_{L}_{T}", "_{L}2_{T}", "_{L}_{T}_per_{L}"


@dataclass(frozen=True)
class Measure:
    """A column's stem in Cartesian and in geographic runs, and its unit."""

    plain: str
    geographic: str
    unit: str = ""


#: Stems of lengths, whose inner names end with _length (fixed values).
LENGTHS = """
    candidate_distance candidate_distance_spread composite_along_branch_span directional_drop_per
    distance_from_core distance_from_core_axis distance_from_core_cell distance_from_stage5_ridge
    distance_to_local_gradient_max drop_width flank_distance grid_effective_scale
    left_distance_1e left_distance_50pct left_drop_distance left_zero_crossing
    right_distance_1e right_distance_50pct right_drop_distance right_zero_crossing
    rank_network rank_physical transverse_sampling_distance
""".split()
#: Stems whose inner names say length twice, and whose public ones have the unit twice (fixed values).
TWICE = "edge network physical".split()
#: Stems of rates whose inner names end with _rate, and of those that have no mark (fixed values).
MARKED_RATES = """
    S0_field S_flux U_coh U_out_all_magnitude U_out_move_magnitude flux_loss maximum_U_out_all mean_C_perp mean_C_perp_one_sided
    mean_U_out_all median_C_perp median_C_perp_one_sided median_U_out_all
""".split()
RATES = """
    S_flux U_core U_inner U_outer U_out_all U_out_move U_parallel_composite_median U_parallel_composite_q25
    U_parallel_composite_q75 U_parallel_core U_parallel_raw U_parallel_relative U_parallel_smoothed absolute_drop
    absolute_flux_loss outer_recovery profile_total_variation_raw profile_total_variation_smoothed
""".split()
#: Gradients of the flux: their stems, and where they are taken (fixed values).
GRADIENTS = "G_perp abs_G_perp G_parallel abs_G_parallel gradient_magnitude".split()
SITES = ["", "_at_flank", "_at_core"]
OTHER_GRADIENTS = "dS_dx dS_dy local_max_abs_G_perp".split()
#: Vectors by what their parts are: rates, or numbers and lengths that keep their stem (fixed values).
RATE_VECTORS = "U_out_all U_out_move".split()
VECTORS = "D_out_all D_out_move mu_out_all mu_out_move mu_in moment_identity directional_identity".split()
#: What has a position (fixed values).
PLACES = """
    start end core front candidate corridor ridge refined_core refined_axis sample flank local_gradient_max
    transverse_minus transverse_plus transverse_left transverse_right
""".split()
#: Inner and geographic names of the axes, and of what a position is given by.
POSITION_AXES, VECTOR_AXES, POSITION_KINDS = {"x": "lon", "y": "lat"}, {"x": "east", "y": "north"}, ["", "_bin", "_center"]


def _declared() -> dict[str, Measure]:
    out = {f"{s}_length": Measure(s, s, LENGTH) for s in LENGTHS}
    out |= {f"{s}_length_length": Measure(s, s, LENGTH + LENGTH) for s in TWICE}
    out |= {f"{s}_rate": Measure(s, s, RATE) for s in MARKED_RATES} | {s: Measure(s, s, RATE) for s in RATES}
    out |= {g + site: Measure(g + site, g + site, GRADIENT) for g in GRADIENTS for site in SITES} | {s: Measure(s, s, GRADIENT) for s in OTHER_GRADIENTS}
    out |= {"drop_slope_rate_per_length": Measure("drop_slope", "drop_slope", GRADIENT), "integrated_ridge_strength_area_rate": Measure("integrated_ridge_strength", "integrated_ridge_strength", AREA_RATE)}
    for axis, called in VECTOR_AXES.items():
        out |= {f"{v}_{axis}_rate": Measure(f"{v}_{axis}", f"{v}_{called}", RATE) for v in RATE_VECTORS} | {f"{v}_{axis}": Measure(f"{v}_{axis}", f"{v}_{called}") for v in VECTORS}
    for axis, called in POSITION_AXES.items():
        out |= {f"{p}_{axis}{kind}": Measure(f"{p}_{axis}{kind}", f"{p}_{called}{kind}") for p in PLACES for kind in POSITION_KINDS}
        out |= {axis: Measure(axis, called), f"{axis}_bin": Measure(f"{axis}_bin", f"{called}_bin")}
    for axis, span, middle, scale in (("x", "longitude_span_degrees", "centroid_lon_circular", "zonal"), ("y", "latitude_span_degrees", "centroid_lat", "meridional")):
        out |= {f"{axis}_span": Measure(f"{axis}_span", span), f"centroid_{axis}": Measure(f"centroid_{axis}", middle), f"grid_{axis}_scale_length": Measure(f"grid_{axis}_scale", f"grid_{scale}_scale", LENGTH)}
    return out


MEASURES = _declared()


def public_name(name: str, space: Space, time_unit: str) -> str:
    measure = MEASURES.get(name)
    if measure is None:
        return name
    return (measure.geographic if space.geographic else measure.plain) + measure.unit.format(L=space.unit, T=time_unit)


def public(df: DataFrame, space: Space, time_unit: str) -> DataFrame:
    """df under public names. Two columns of one name raise ValueError."""
    names = [public_name(c, space, time_unit) for c in df.columns]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"columns share a public name: {sorted(twice)}")
    return df.toDF(*names)
