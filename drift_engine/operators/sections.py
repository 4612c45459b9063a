"""Cross-sections of cores: samples, refinement, smoothing, composites, votes, drop zones and fronts, for both pathways."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drift_engine.functions.angles import difference, ratio
from drift_engine.functions.geodesy import Grid, Space, with_scales
from drift_engine.operators.gridops import near_cells, sample
from drift_engine.storage import materialise


@dataclass(frozen=True)
class Pathway:
    """What sets the flux and the directional sections apart."""

    name: str
    theta: str
    x_field: str
    y_field: str
    #: observability follows the refined side instead of the original one
    refined_sides: bool
    #: zones step over samples without a value instead of ending there
    over_gaps: bool
    #: all eligible zones have a rank, not only the best
    rank_all: bool
    detected: str
    undetected: str
    #: statuses of a section's side: not observable, with a zone, without one
    statuses: tuple[str, str, str]


FLUX = Pathway("flux", "theta_mu_out", "U_out_all_x_rate", "U_out_all_y_rate", False, True, True, "probable_flux_front", "observable_no_retained_front", ("flank_not_observable", "candidate_drop", "observable_no_candidate_drop"))
DIRECTIONAL = Pathway("directional", "theta1_out", "D_out_all_x", "D_out_all_y", True, False, False, "probable_directional_front", "observable_no_retained_directional_front", ("side_not_observable", "probable_directional_front", "observable_no_retained_directional_front"))


@dataclass(frozen=True)
class SectionConfig:
    half_width: float = 5
    interval: float = 1.0
    refinement: float = 1.0
    median_samples: int = 3
    composite_window: int = 2
    persistent_sections: int = 2
    persistent_fraction: float = 0.5
    strong_recovery: float = 0.5
    tolerance: float = 1e-10
    along_scales: float = 1.0
    cross_scales: float = 5.0
    low_r1: float = 0.5
    disagreement: float = 20.0
    high_turn: float = 60.0
    least_valid: int = 7


def _sees(side: Column, missing: Column) -> Column:
    return ~((missing == side) | (missing == "left_and_right"))


def samples(cores: DataFrame, supported: DataFrame, way: Pathway, grid: Grid, space: Space, cfg: SectionConfig, extra: tuple[str, ...] = ()) -> DataFrame:
    """A row per sample of each core's section: i (steps to the right of the core), u (the field along the core's direction), observable, sample_class, and at_<field> of the extra fields.

    cores: section (a unique id), cell_id, x_bin, y_bin, x, y, the direction, missing_side,
    and what else is to be carried. Samples are explode()d and looked up in one join.
    """
    n = round(cfg.half_width / cfg.interval)
    carried = [c for c in cores.columns if c not in ("x_scale", "y_scale", "scale")]
    rows = with_scales(cores.select(*carried), grid, space).withColumn("i", F.explode(F.sequence(F.lit(-n), F.lit(n))))
    offset = F.col("i") * F.lit(cfg.interval)
    turn = F.when(F.col("i") < 0, -90.0).otherwise(90.0)
    rows = rows.withColumn("_p", space.forward(F.col("x"), F.col("y"), F.col(way.theta) + turn, F.abs(offset) * F.col("scale")))
    rows = rows.withColumn("px", F.when(F.col("i") == 0, F.col("x")).otherwise(F.col("_p.x"))).withColumn("py", F.when(F.col("i") == 0, F.col("y")).otherwise(F.col("_p.y"))).drop("_p")
    values = supported.select("cell_id", F.col(way.x_field).alias("_ux"), F.col(way.y_field).alias("_uy"), *[F.col(f).alias(f"at_{f}") for f in extra])
    found = sample(rows.select("section", "i", "px", "py"), ["section", "i"], values, ["_ux", "_uy", *[f"at_{f}" for f in extra]], grid, cfg.tolerance)
    rows = materialise(rows.join(found, ["section", "i"]), "section-samples")
    r = F.radians(way.theta)
    u = F.col("_ux") * F.sin(r) + F.col("_uy") * F.cos(r)
    side = F.when(F.col("i") < 0, "left").when(F.col("i") > 0, "right").otherwise("core")
    unsupported = ~F.col("boundary") & (F.col("_ux").isNull() | F.col("_uy").isNull())
    kind = F.when(F.col("boundary"), "missing_because_of_boundary").when(unsupported, "missing_because_of_support").when(u.isNull(), "missing_invalid").when(F.col("i") == 0, "direct_grid_information").otherwise("interpolated")
    return rows.withColumns({"offset": offset, "distance": offset * F.col("scale"), "u": u, "raw_side": side, "observable": (side == "core") | _sees(side, F.col("missing_side")), "unsupported": unsupported, "sample_class": kind}).drop("_ux", "_uy")


def refined(rows: DataFrame, way: Pathway, cfg: SectionConfig) -> DataFrame:
    """rows with the refined core (its step core_i and value core_u: the largest near the core, the left-most of equals), steps and sides from it, and u relative to it."""
    w = Window.partitionBy("section")
    allowed = F.col("u").isNotNull() & F.col("observable") & (F.abs("offset") <= cfg.refinement + 1e-12)
    best = F.max(F.when(allowed, F.struct(F.col("u").alias("u"), (-F.col("i")).alias("n")))).over(w)
    rows = rows.withColumn("_best", best).withColumn("core_i", -F.col("_best.n")).withColumn("core_u", F.col("_best.u")).drop("_best")
    rows = rows.withColumn("step", F.col("i") - F.col("core_i"))
    side = F.when(F.col("step") < 0, "left").when(F.col("step") > 0, "right").otherwise("core")
    rows = rows.withColumn("side", side).withColumn("outward", F.abs(F.col("step")) * F.lit(cfg.interval) * F.col("scale"))
    if way.refined_sides:
        rows = rows.withColumn("observable", (F.col("side") == "core") | _sees(F.col("side"), F.col("missing_side")))
    rows = rows.withColumn("core_uncertain", F.col("core_i").isNull() | (F.abs(F.abs(F.col("core_i") * F.lit(cfg.interval)) - cfg.refinement) <= 1e-8))
    return rows.withColumn("u_relative", F.when(F.col("core_u") > 0, ratio(F.col("u"), F.col("core_u"))))


def smoothed(rows: DataFrame, cfg: SectionConfig) -> DataFrame:
    """rows with the running median of u, inside unbroken runs of values only."""
    known = F.col("u").isNotNull()
    w = Window.partitionBy("section").orderBy("i")
    rows = rows.withColumn("_run", F.when(known, F.col("i") - F.sum(F.when(known, 1).otherwise(0)).over(w)))
    h = cfg.median_samples // 2
    near = Window.partitionBy("section", "_run").orderBy("i").rowsBetween(-h, h)
    return rows.withColumn("u_smooth", F.when(known, F.percentile("u", F.lit(0.5)).over(near))).drop("_run")


def composites(rows: DataFrame, near: DataFrame) -> DataFrame:
    """rows with the profile over neighbouring sections at the same step from their cores, and the votes for a decline outward.

    near: (section, other), a section's neighbours with itself. Steps are whole numbers,
    so one equi-join and one aggregation give median, quartiles, counts and votes.
    """
    w = Window.partitionBy("section").orderBy("step")
    inner = F.when(F.col("step") > 0, F.lag("u").over(w)).when(F.col("step") < 0, F.lead("u").over(w))
    profile = rows.filter("step is not null").select(F.col("section").alias("other"), "step", F.col("u").alias("_u"), inner.alias("_inner"))
    votes = F.when(F.col("_u").isNotNull() & F.col("_inner").isNotNull(), (F.col("_inner") > F.col("_u")).cast("int"))
    joined = near.join(profile, "other")
    q = lambda p: F.percentile("_u", F.lit(p))
    found = joined.groupBy("section", "step").agg(q(0.5).alias("u_composite"), q(0.25).alias("u_q25"), q(0.75).alias("u_q75"), F.count("_u").alias("n_composite"), F.sum(votes).alias("n_decline"), F.avg(votes).alias("fraction_decline"))
    return materialise(rows.join(found, ["section", "step"], "left"), "composites")


def composite_spans(rows: DataFrame, near: DataFrame, space: Space) -> DataFrame:
    """Per section: how far its farthest neighbour's core is (composite_span), its neighbours with itself, and the largest number of them at one step (n_neighbours)."""
    places = rows.filter("i = 0").select("section", "x", "y")
    other = places.select(F.col("section").alias("other"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    pairs = near.join(places, "section").join(other, "other").withColumn("_d", space.inverse(F.col("x"), F.col("y"), F.col("_x"), F.col("_y"))["distance"])
    spans = pairs.groupBy("section").agg(F.max("_d").alias("composite_span"), F.count("*").alias("neighbour_sections"))
    counts = rows.groupBy("section").agg(F.coalesce(F.max("n_composite"), F.lit(0)).alias("n_neighbours"))
    return spans.join(counts, "section")


def _outward(rows: DataFrame, way: Pathway) -> DataFrame:
    """The usable samples of each observable side of a section, the core's with both, under zone_side."""
    sides = F.explode(F.when(F.col("side") == "core", F.array(F.lit("left"), F.lit("right"))).otherwise(F.array("side")))
    rows = rows.filter("step is not null").withColumn("zone_side", sides).filter(_sees(F.col("zone_side"), F.col("missing_side")))
    return rows.filter(F.col("u").isNotNull() if way.over_gaps else F.col("u").isNotNull() & F.col("observable"))


def zones(rows: DataFrame, way: Pathway, cfg: SectionConfig) -> DataFrame:
    """Places where the profile drops from one sample to the next outward, by section and side, with eligibility and rank."""
    largest = F.max(F.abs("u")).over(Window.partitionBy("section"))
    rows = _outward(rows.withColumn("_size", largest), way)
    w = Window.partitionBy("section", "zone_side").orderBy(F.abs("step"))
    counted = [c for c in ("at_N_out_move", "at_N_in_move") if c in rows.columns]
    value = F.struct("step", "u_composite", "u_smooth", "n_composite", "outward", "px", "py", "n_decline", "fraction_decline", *counted)
    for k in (1, 2, 3):
        rows = rows.withColumn(f"_o{k}", F.lead(value, k).over(w))
    rows = rows.filter(F.col("_o1").isNotNull())
    use_composite = F.least(F.coalesce("n_composite", F.lit(0)), F.coalesce("_o1.n_composite", F.lit(0))) >= 2
    read = lambda c: F.when(use_composite, F.col(f"{c}u_composite")).otherwise(F.col(f"{c}u_smooth"))
    nothing = F.lit(None).cast("double")
    f1, f2 = read("_o2."), read("_o3.")
    if not way.over_gaps:
        adjacent = lambda a, b: F.abs(F.col(f"{b}step")) - F.abs(F.col(f"{a}step")) == 1
        rows = rows.filter(adjacent("", "_o1."))
        f1 = F.when(adjacent("_o1.", "_o2."), f1)
        f2 = F.when(adjacent("_o1.", "_o2.") & adjacent("_o2.", "_o3."), f2)
    a, b = read(""), read("_o1.")
    after = F.filter(F.array(f1, f2), lambda v: v.isNotNull())
    median = F.when(F.size(after) == 2, (after[0] + F.try_element_at(after, F.lit(2))) / 2).when(F.size(after) == 1, F.try_element_at(after, F.lit(1))).otherwise(nothing)
    drop, width = a - b, F.col("_o1.outward") - F.col("outward")
    persistent = F.coalesce((F.col("_o1.n_decline") >= cfg.persistent_sections) & (F.col("_o1.fraction_decline") >= cfg.persistent_fraction), F.lit(False))
    # Values count as equal when they are so to twelve places of the section's largest value, in whatever unit.
    size = F.when(F.col("_size") > 0, F.col("_size")).otherwise(1.0)
    out = rows.select(
        "section",
        F.col("zone_side").alias("side"),
        "cell_id",
        F.col("_o1.outward").alias("distance"),
        F.col("_o1.px").alias("front_x"),
        F.col("_o1.py").alias("front_y"),
        F.col("core_u"),
        a.alias("inner"),
        b.alias("outer"),
        drop.alias("drop"),
        F.when(F.col("core_u") > 0, drop / F.col("core_u")).alias("relative_drop"),
        ratio(-drop, width).alias("slope"),
        width.alias("width"),
        F.when(F.size(after) > 0, F.greatest(F.lit(0.0), F.array_max(after) - b)).alias("recovery"),
        (2 + F.size(after)).alias("supporting_samples"),
        persistent.alias("persistent"),
        F.coalesce("_o1.n_decline", F.lit(0)).alias("n_decline"),
        F.col("_o1.fraction_decline").alias("fraction_decline"),
        F.least(F.coalesce("n_composite", F.lit(0)), F.coalesce("_o1.n_composite", F.lit(0))).alias("n_neighbours"),
        *[F.least(F.col(c), F.col(f"_o1.{c}")).alias(c.replace("at_", "minimum_")) for c in counted],
        F.when(use_composite, "composite_median").otherwise("smoothed").alias("profile_used"),
        F.coalesce((drop > 0) & (median <= (a + b) / 2.0 + 1e-12 * size) & ((F.coalesce("_o1.n_composite", F.lit(0)) < 2) | persistent), F.lit(False)).alias("eligible"),
        F.round(drop / size, 12).alias("_drop"),
        F.round(ratio(-drop / size, width / F.col("scale")), 12).alias("_slope"),
    ).filter("drop is not null")
    # Ties go to the steeper drop, then to the place nearest to the core.
    order = Window.partitionBy("section", "side", "eligible").orderBy(F.desc("persistent"), F.desc("_drop"), F.asc("_slope"), "distance")
    place = F.row_number().over(order)
    return out.withColumn("rank", F.when(F.col("eligible") & (F.lit(way.rank_all) | (place == 1)), place)).drop("_drop", "_slope")


def fronts(cores: DataFrame, found: DataFrame, way: Pathway) -> DataFrame:
    """A row per core cell and side: its best zone (the median over the sections that the cell has), and the status."""
    best = found.filter("rank = 1").groupBy("cell_id", "side").agg(*[F.percentile(c, F.lit(0.5)).alias(n) for c, n in (("front_x", "front_x"), ("front_y", "front_y"), ("distance", "distance_from_core"), ("drop", "loss"), ("relative_drop", "relative_loss"))])
    base = cores.select("cell_id", "component_number", F.col("x").alias("core_x"), F.col("y").alias("core_y"), "ridge_type", "missing_side").distinct()
    base = base.withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right")))).withColumn("observable", _sees(F.col("side"), F.col("missing_side"))).drop("missing_side")
    out = base.join(best, ["cell_id", "side"], "left").withColumn("front_detected", F.col("front_x").isNotNull() & F.col("observable"))
    out = out.withColumns({c: F.when(F.col("front_detected"), F.col(c)) for c in ("front_x", "front_y", "distance_from_core", "loss", "relative_loss")})
    return out.withColumn("front_status", F.when(~F.col("observable"), "side_not_observable").when(F.col("front_detected"), way.detected).otherwise(way.undetected))


def side_results(rows: DataFrame, found: DataFrame, way: Pathway, cfg: SectionConfig) -> DataFrame:
    """A row per section and side, observable or not: candidates, detected, the best zone's figures, the first distances at which u falls to a half, to 1/e and to 0 of the core, strong recovery, opposing outer flow, and the status."""
    sides = rows.select("section", "cell_id", "missing_side").distinct().withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right")))).withColumn("observable", _sees(F.col("side"), F.col("missing_side"))).drop("missing_side")
    usable = _outward(rows, way)
    last = F.row_number().over(Window.partitionBy("section", "zone_side").orderBy(F.abs("step").desc()))
    first = lambda t: F.min(F.when(F.col("u_relative") <= t, F.col("outward")))
    d = usable.withColumn("_last", last).groupBy("section", F.col("zone_side").alias("side")).agg(first(0.5).alias("distance_half"), first(0.36787944117144233).alias("distance_1e"), first(0.0).alias("distance_zero"), (F.count_if((F.col("_last") <= 2) & (F.col("u") < 0)) > 0).alias("opposing"))
    n = found.groupBy("section", "side").agg(F.count_if("eligible").alias("candidates"))
    best = found.filter("rank = 1").select("section", "side", F.col("distance").alias("front_distance"), "drop", "relative_drop", "persistent", F.coalesce(F.col("recovery") > cfg.strong_recovery * F.col("drop"), F.lit(False)).alias("strong_recovery"))
    out = sides.join(d, ["section", "side"], "left").join(n, ["section", "side"], "left").join(best, ["section", "side"], "left")
    out = out.withColumns({"candidates": F.coalesce("candidates", F.lit(0)), "persistent": F.coalesce("persistent", F.lit(False)), "strong_recovery": F.coalesce("strong_recovery", F.lit(False)), "opposing": F.coalesce("opposing", F.lit(False))})
    return out.withColumn("detected", F.col("candidates") > 0).withColumn("status", F.when(~F.col("observable"), way.statuses[0]).when(F.col("detected"), way.statuses[1]).otherwise(way.statuses[2]))


def section_outcomes(sides: DataFrame) -> DataFrame:
    """Per section of side_results(): what its observable sides have in common, detected sides, and multiple candidates."""
    seen, hit = F.col("observable"), F.col("observable") & F.col("detected")
    g = sides.groupBy("section").agg(F.count_if(seen).alias("observable_sides"), F.count_if(hit).alias("detected_sides"), (F.max("candidates") > 1).alias("multiple_candidate_drops"), *[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("left", "right") for c in ("detected", "candidates", "front_distance", "drop", "relative_drop", "persistent", "status", "distance_half", "distance_1e", "distance_zero")])
    some = F.col("observable_sides") > 0
    return g.withColumns({"no_candidate_drop": some & (F.col("detected_sides") == 0), "all_observable_have_drop": some & (F.col("detected_sides") == F.col("observable_sides")), "observable_without_drop": F.col("detected_sides") < F.col("observable_sides")})


def outcome_flags(summaries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """section_summaries() with section_outcomes(), the latter's flags put after the former's."""
    out = summaries.join(outcomes, "section")
    more = F.concat_ws(";", F.when(F.col("quality_flags") != "", F.col("quality_flags")), F.when(F.col("no_candidate_drop"), F.lit("no_candidate_drop")), F.when(F.col("observable_sides") < 2, F.lit("flank_not_observable")), F.when(F.col("multiple_candidate_drops"), F.lit("multiple_candidate_drops")))
    return out.withColumn("quality_flags", more)


def flank_points(found: DataFrame, sides: DataFrame, summaries: DataFrame) -> DataFrame:
    """The best zone of each section and side, with the section's flags and its own. summaries: of section_summaries(), before outcomes."""
    own = sides.select("section", "side", (F.col("candidates") > 1).alias("multiple_candidate_drops"), "strong_recovery", "opposing")
    out = found.filter("rank = 1").join(own, ["section", "side"]).join(summaries.select("section", "quality_flags", "nearby_branch_contamination", "component_number", "ridge_type", "missing_side", "high_local_curvature_turning", F.col("R1_out").alias("R1_out_center"), "refined_x", "refined_y", F.col("scale").alias("grid_effective_scale"), *[c for c in ("component", "segment") if c in summaries.columns]), "section")
    flags = F.concat_ws(";", F.when(F.col("quality_flags") != "", F.col("quality_flags")), *[F.when(F.col(c), F.lit(n)) for c, n in (("multiple_candidate_drops", "multiple_candidate_drops"), ("strong_recovery", "strong_outer_recovery"), ("opposing", "opposing_outer_flux"))])
    return out.withColumn("quality_flags", flags)


def contaminated(sections: DataFrame, members: DataFrame, theta: str, grid: Grid, space: Space, cfg: SectionConfig) -> DataFrame:
    """Sections with a cell of another component inside the box along and across their direction.

    The box reaches a known distance, so cells are found by their bins, as many columns
    of them as the distance spans in each row.
    """
    own = with_scales(sections.select("section", "component_number", "x_bin", "y_bin", F.col("x").alias("px"), F.col("y").alias("py"), F.col(theta).alias("_theta")), grid, space)
    reach = F.col("scale") * F.lit(math.hypot(cfg.along_scales, cfg.cross_scales) * (1 + 1e-9))
    others = members.select(F.col("cell_id").alias("near_id"), F.col("component_number").alias("_other"), F.col("x").alias("_ox"), F.col("y").alias("_oy")).distinct()
    near = near_cells(own, reach, grid, space).join(others, "near_id").filter("_other <> component_number")
    near = near.withColumn("_g", space.inverse(F.col("px"), F.col("py"), F.col("_ox"), F.col("_oy")))
    angle = F.radians(difference(F.col("_g.bearing"), F.col("_theta")))
    inside = (F.abs(F.col("_g.distance") * F.cos(angle)) <= cfg.along_scales * F.col("scale")) & (F.abs(F.col("_g.distance") * F.sin(angle)) <= cfg.cross_scales * F.col("scale"))
    return near.filter(inside).select("section").distinct()


#: What of a core is carried along its section, where its table has it.
CONTEXT = ("component", "segment", "sequence", "component_number", "ridge_type", "missing_side", "N_out_move", "N_in_move", "R1_out", "R2_out", "delta_theta_mu1_out", "endpoint", "junction", "degree", "largest_turn")


def section_summaries(rows: DataFrame, way: Pathway, cfg: SectionConfig, min_support: int = 1, crossed: DataFrame | None = None) -> DataFrame:
    """Per section: its core's context, refinement, counts of samples, total variation raw and smoothed over adjacent values, opposing outer flow, and its quality flags joined by ';'.

    Flags of columns that rows don't carry are not raised. crossed: sections of contaminated().
    """
    w = Window.partitionBy("section").orderBy("i")
    step = lambda c: F.abs(F.col(c) - F.lag(c).over(w))
    carried = [c for c in CONTEXT if c in rows.columns]
    at_core = F.col("i") == F.col("core_i")
    g = rows.withColumns({"_raw": step("u"), "_smooth": step("u_smooth")}).groupBy("section", "cell_id").agg(
        F.count("u").alias("valid_samples"),
        F.count_if("unsupported").alias("unsupported_samples"),
        F.count_if("boundary").alias("boundary_samples"),
        F.coalesce(F.sum("_raw"), F.lit(0.0)).alias("total_variation"),
        F.coalesce(F.sum("_smooth"), F.lit(0.0)).alias("total_variation_smoothed"),
        (F.count_if((F.abs(F.col("step") * F.lit(cfg.interval)) >= 2) & (F.col("u") < 0)) > 0).alias("opposing_outer_flow"),
        F.max("core_uncertain").alias("core_uncertain"),
        F.max("core_u").alias("core_u"),
        F.max(F.col("core_i") * F.lit(cfg.interval)).alias("core_offset"),
        F.max("scale").alias("scale"),
        F.max(way.theta).alias("theta"),
        F.max("x").alias("ridge_x"),
        F.max("y").alias("ridge_y"),
        F.max(F.when(at_core, F.col("px"))).alias("refined_x"),
        F.max(F.when(at_core, F.col("py"))).alias("refined_y"),
        *[F.max(c).alias(c) for c in carried],
    )
    g = g.join(crossed.select("section", F.lit(True).alias("_crossed")), "section", "left") if crossed is not None else g.withColumn("_crossed", F.lit(False))
    have = lambda c: F.col(c) if c in carried else F.lit(None)
    yes = lambda c: F.coalesce(c.cast("boolean"), F.lit(False))
    g = g.withColumns(
        {
            "nearby_branch_contamination": yes(F.col("_crossed")),
            "high_local_curvature_turning": yes(have("largest_turn") >= cfg.high_turn),
            "low_R1_out": yes(have("R1_out") < cfg.low_r1),
            "short_available_cross_section": F.col("valid_samples") < cfg.least_valid,
            "left_observable": _sees(F.lit("left"), F.col("missing_side")),
            "right_observable": _sees(F.lit("right"), F.col("missing_side")),
        }
    )
    lacking, edge, short = F.col("unsupported_samples") > 0, F.col("boundary_samples") > 0, F.col("short_available_cross_section")
    if way is FLUX:
        checks = {
            "insufficient_outgoing_support": have("N_out_move") < min_support,
            "insufficient_incoming_support": have("N_in_move") < min_support,
            "undefined_theta_mu_out": F.col("theta").isNull(),
            "low_R1_out": F.col("low_R1_out"),
            "large_delta_theta_mu1_out": have("delta_theta_mu1_out") > cfg.disagreement,
            "unsupported_transverse_sample": lacking,
            "domain_boundary": edge,
            "left_flank_not_observable": ~F.col("left_observable"),
            "right_flank_not_observable": ~F.col("right_observable"),
            "core_location_uncertain": F.col("core_uncertain"),
            "nearby_branch_contamination": F.col("nearby_branch_contamination"),
            "pixel_junction_nearby": have("junction"),
            "segment_endpoint": have("endpoint"),
            "high_local_curvature_turning": F.col("high_local_curvature_turning"),
            "short_available_cross_section": short,
        }
    else:
        checks = {
            "unsupported_transverse_sample": lacking,
            "domain_boundary": edge,
            "left_side_not_observable": ~F.col("left_observable"),
            "right_side_not_observable": ~F.col("right_observable"),
            "axis_location_uncertain": F.col("core_uncertain"),
            "directional_core_graph_junction": have("junction"),
            "directional_core_graph_endpoint": have("endpoint"),
            "short_available_cross_section": short,
        }
    flags = F.concat_ws(";", *[F.when(yes(c), F.lit(k)) for k, c in checks.items()])
    return g.withColumn("quality_flags", flags).drop("_crossed")
