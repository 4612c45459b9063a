"""The flux pathway: cores, their components and ordered segments, sections and fronts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drift_engine.functions.angles import apart, longitude_span, mean_bearing
from drift_engine.functions.geodesy import Grid, Space
from drift_engine.operators import graph, ridge, sections
from drift_engine.operators.ranks import tied
from drift_engine.storage import materialise


def cores(cells: DataFrame, grid: Grid, space: Space, min_support: int, level: float = 0.9, **options) -> DataFrame:
    """The flux core cells with components (numbered by their smallest cell), degrees and classes."""
    found = materialise(ridge.flux_ridge(cells, grid, space, min_support, level, **options).filter("core"), "flux-cores")
    edges = graph.neighbour_pairs(found, grid)
    return graph.degrees(graph.labelled(found, edges, grid.nx * grid.ny), edges).withColumn("component_id", F.format_string("component_%04d", "component_number"))


def oriented_segments(core_cells: DataFrame, grid: Grid, space: Space, in_rounds: bool = False) -> DataFrame:
    """Members of ordered segments, turned to run with theta_mu_out: sequence, tangent, mismatch, edge_length to the next.

    A segment's direction is that with the larger sum of cosines between theta and the
    path's tangent; tangents are central differences, one-sided at open ends. in_rounds:
    paths are found as on large grids.
    """
    walked = graph.ordered_segments(core_cells, graph.neighbour_pairs(core_cells, grid), None if in_rounds else grid.nx * grid.ny)
    rows = walked.join(core_cells.select("cell_id", "x", "y", "theta_mu_out", F.col("S0_field_rate").alias("_s")), "cell_id")
    key = ["component", "segment"]
    whole = Window.partitionBy(*key)
    w = whole.orderBy("sequence")
    place = F.struct("x", "y", "_s")
    n = F.count("*").over(whole)
    ends = [F.first(place).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(place).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))]
    rows = rows.withColumns({"_n": n, "_prev": F.lag(place).over(w), "_next": F.lead(place).over(w), "_first": ends[0], "_last": ends[1]})
    loop = F.col("closed") & (F.col("_n") > 2)
    rows = rows.withColumn("_prev", F.coalesce("_prev", F.when(loop, F.col("_last")))).withColumn("_next", F.coalesce("_next", F.when(loop, F.col("_first"))))
    here = F.struct("x", "y", "_s")
    a, b = F.coalesce("_prev", here), F.coalesce("_next", here)
    rows = rows.withColumn("_t", space.inverse(a["x"], a["y"], b["x"], b["y"])).withColumn("_e", space.inverse(F.col("x"), F.col("y"), F.col("_next.x"), F.col("_next.y")))
    tangent = F.when(F.col("_n") > 1, F.pmod(F.col("_t.bearing"), F.lit(360.0)))
    rows = rows.withColumn("_tangent", tangent).withColumn("_agree", F.sum(F.cos(F.radians(F.col("theta_mu_out") - F.col("_tangent")))).over(whole))
    turn = F.coalesce(F.col("_agree") < 0, F.lit(False))
    rows = rows.withColumn("reversed", turn)
    edge = F.when(F.col("_next").isNotNull(), F.col("_e.distance"))
    rows = rows.withColumn("edge_length", edge).withColumn("edge_strength", F.when(F.col("_next").isNotNull(), (F.col("_s") + F.col("_next._s")) / 2.0 * edge))
    rows = rows.withColumn("sequence", F.when(turn, F.col("_n") - 1 - F.col("sequence")).otherwise(F.col("sequence")).cast("int")).withColumn("tangent", F.when(turn, F.pmod(F.col("_tangent") + 180.0, F.lit(360.0))).otherwise(F.col("_tangent")))
    return rows.withColumn("mismatch", apart(F.col("theta_mu_out"), F.col("tangent"))).select(*key, "sequence", "cell_id", "closed", "reversed", "tangent", "mismatch", "edge_length", "edge_strength")


#: Fields of which components and segments have the mean, and those of which they have the median too (fixed values).
MEANS = ("U_out_all_magnitude_rate", "C_perp", "C_perp_normalized", "R1_out", "R2_out", "delta_theta_mu1_out", "N_out_move", "R1_in", "N_in_move", "abs_delta_theta_io_1", "abs_delta_theta_io_mu", "C_perp_one_sided")
MEDIANS = ("U_out_all_magnitude_rate", "C_perp", "R1_out", "C_perp_one_sided")


def cell_summaries(periodic: bool, neighbours: bool = False) -> list:
    """Aggregates over the cells of a segment or component. periodic: of the grid, on which a span may lie across the seam; neighbours: with C_neigh_out, the consistency of directions."""
    span = longitude_span(F.col("x")) if periodic else F.max("x") - F.min("x")
    means = [*MEANS, *(["C_neigh_out"] if neighbours else [])]
    return [
        F.count_distinct("cell_id").alias("cells"),
        span.alias("x_span"),
        (F.max("y") - F.min("y")).alias("y_span"),
        *[F.avg(c).alias(f"mean_{c}") for c in means],
        *[F.percentile(c, F.lit(0.5)).alias(f"median_{c}") for c in MEDIANS],
        F.max("U_out_all_magnitude_rate").alias("maximum_U_out_all_magnitude_rate"),
        F.min("N_out_move").alias("minimum_N_out_move"),
        F.count_if("orientation_reliable").alias("orientation_reliable_cells"),
        F.count_if("orientation_ambiguous").alias("orientation_ambiguous_cells"),
        F.count_if(F.col("ridge_type") == "two_sided").alias("two_sided_cells"),
        F.count_if(F.col("ridge_type") == "one_sided").alias("one_sided_cells"),
    ]


def _mismatches(abrupt: float) -> list:
    m = F.col("mismatch")
    return [F.avg(m).alias("mean_mismatch"), F.percentile(m, F.lit(0.5)).alias("median_mismatch"), F.max(m).alias("largest_mismatch"), F.count_if(m >= abrupt).alias("abrupt_mismatches")]


def segment_statistics(members: DataFrame, core_cells: DataFrame | None = None, space: Space | None = None, abrupt: float = 45.0, periodic: bool | None = None) -> DataFrame:
    """Per segment: cells, length, integrated strength, total and largest turn of the tangent, mismatches; and with core_cells what cell_summaries() has, and its ends.

    periodic: of the grid; that of a geographic space, if it is not given.
    """
    w = Window.partitionBy("component", "segment").orderBy("sequence")
    following = F.coalesce(F.lead("tangent").over(w), F.when(F.col("closed"), F.first("tangent").over(w)))
    rows = members.withColumn("_turn", apart(following, F.col("tangent")))
    sums = [F.max("closed").alias("closed"), F.coalesce(F.sum("edge_length"), F.lit(0.0)).alias("length"), F.coalesce(F.sum("edge_strength"), F.lit(0.0)).alias("integrated_strength"), F.coalesce(F.sum("_turn"), F.lit(0.0)).alias("total_turn"), F.coalesce(F.max("_turn"), F.lit(0.0)).alias("largest_turn"), *_mismatches(abrupt)]
    if core_cells is None:
        return rows.groupBy("component", "segment").agg(F.count("*").alias("cells"), *sums)
    carried = [c for c in core_cells.columns if c not in members.columns or c == "cell_id"]
    rows = rows.join(core_cells.select(*carried), "cell_id")
    end = (F.col("sequence") == 0) | (F.col("sequence") == F.col("_last"))
    rows = rows.withColumn("_last", F.max("sequence").over(Window.partitionBy("component", "segment")))
    ends = [F.when(F.max("closed"), 0).otherwise(F.least(F.lit(2), F.count("*"))).cast("long").alias("endpoints"), F.count_if(end & F.col("junction")).alias("junction_endpoints")]
    return rows.groupBy("component", "component_number", "segment").agg(*cell_summaries(space.geographic if periodic is None else periodic, "C_neigh_out" in core_cells.columns), *sums, *ends)


def component_statistics(core_cells: DataFrame, members: DataFrame, broken: DataFrame, space: Space, abrupt: float = 45.0, periodic: bool | None = None) -> DataFrame:
    """Per component: its cells' summaries, graph, lengths and turns over its segments, mismatches over their members, centroid, and five ranks.

    members: of oriented_segments(); broken: the cells of interruptions(). Ranks are 1 for
    the largest, equals alike, unknown last. periodic: as in segment_statistics().
    """
    centre = mean_bearing(F.col("x")) if space.geographic else F.avg("x")
    cells = core_cells.join(broken.select("cell_id", F.lit(True).alias("_broken")), "cell_id", "left")
    own = cells.groupBy("component", "component_number").agg(
        *cell_summaries(space.geographic if periodic is None else periodic, "C_neigh_out" in core_cells.columns),
        F.first("component_class").alias("component_class"),
        F.count_if("endpoint").alias("endpoints"),
        F.count_if("junction").alias("junctions"),
        F.count_if(F.col("_broken") & F.col("endpoint")).alias("unsupported_interruptions"),
        centre.alias("centroid_x"),
        F.avg("y").alias("centroid_y"),
        F.sum("U_out_all_magnitude_rate").alias("strength"),
    )
    paths = segment_statistics(members, abrupt=abrupt).groupBy("component").agg(F.count("*").alias("segments"), F.sum("length").alias("length"), F.sum("integrated_strength").alias("integrated_strength"), F.sum("total_turn").alias("total_turn"), F.max("largest_turn").alias("largest_turn"))
    out = own.join(paths, "component").join(members.groupBy("component").agg(*_mismatches(abrupt)), "component")
    ranked = {"rank_length": "length", "rank_median_flux": "median_U_out_all_magnitude_rate", "rank_integrated_strength": "integrated_strength", "rank_median_contrast": "median_C_perp", "rank_minimum_support": "minimum_N_out_move"}
    out = materialise(out, "component-statistics")
    return out.join(tied(out, ["component"], ranked), "component")


def interruptions(core_cells: DataFrame, supported: DataFrame, grid: Grid) -> DataFrame:
    """Endpoints with a neighbour in the grid that is not supported."""
    from drift_engine.operators.gridops import around

    near = around(core_cells.filter("endpoint"), grid, centre=False)
    return near.join(supported.select(F.col("cell_id").alias("near_id")), "near_id", "left_anti").select("cell_id").distinct()


#: Fields read at the samples beside the flux components (fixed values).
SAMPLED = ("U_out_all_magnitude_rate", "U_out_move_magnitude_rate", "P_move", "R1_out", "R2_out", "delta_theta_mu1_out", "N_out_move", "N_in_move", "R1_in")


def neighbours_along(rows: DataFrame, window: int) -> DataFrame:
    """(section, other) of the sections within `window` places along the same segment, each with itself. rows: (component, segment, sequence, section) of sections or their samples."""
    rows = rows.select("component", "segment", "sequence", "section").distinct()
    key = ["component", "segment"]
    own = rows.select(*key, "section", F.explode(F.sequence(F.col("sequence") - window, F.col("sequence") + window)).alias("_seq"))
    return own.join(rows.select(*key, F.col("sequence").alias("_seq"), F.col("section").alias("other")), [*key, "_seq"]).select("section", "other")


def flux_sections(core_cells: DataFrame, supported: DataFrame, grid: Grid, space: Space, cfg: sections.SectionConfig, members: DataFrame | None = None, extra: tuple[str, ...] = ("N_out_move", "N_in_move")) -> DataFrame:
    """All samples of all sections (a core has one for each segment that it lies on), with composites along segments.

    members: of oriented_segments(), if they are made already; extra: fields read at the samples too.
    """
    members = oriented_segments(core_cells, grid, space) if members is None else members
    turns = segment_statistics(members).select("component", "segment", "largest_turn")
    rows = members.select("component", "segment", "sequence", "cell_id").join(turns, ["component", "segment"])
    context = [c for c in (*sections.CONTEXT, "x_bin", "y_bin", "x", "y", "theta_mu_out") if c in core_cells.columns and c not in rows.columns]
    rows = rows.join(core_cells.select("cell_id", *context), "cell_id")
    rows = rows.withColumn("section", F.format_string("component_%04d_segment_%05d_seq%04d", "component_number", "segment", "sequence"))
    out = sections.smoothed(sections.refined(sections.samples(rows, supported, sections.FLUX, grid, space, cfg, extra), sections.FLUX, cfg), cfg)
    return sections.composites(out, neighbours_along(rows, cfg.composite_window))


def flux_fronts(core_cells: DataFrame, rows: DataFrame, cfg: sections.SectionConfig) -> DataFrame:
    return sections.fronts(core_cells, sections.zones(rows, sections.FLUX, cfg), sections.FLUX)


def front_summary(summaries: DataFrame, flanks: DataFrame) -> DataFrame:
    """One row of counters and medians over sections with their outcomes (outcome_flags()) and flank_points()."""
    c = F.col
    both, one = c("left_detected") & c("right_detected"), c("left_detected") != c("right_detected")
    median = lambda e: F.percentile(e, F.lit(0.5))
    one_sided, neither = c("observable_sides") == 1, c("no_candidate_drop")
    count = lambda **named: [F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in named.items()]
    sums = summaries.agg(
        F.count("*").alias("sections"),
        F.count_distinct("cell_id").alias("ridge_cells"),
        F.count("core_u").alias("sections_with_core"),
        *count(
            core_unchanged=c("core_offset") == 0,
            core_shifted_one_scale=F.abs("core_offset") == 1,
            two_sided_drop_sections=both,
            one_sided_drop_sections=one,
            no_drop_sections=neither,
            two_sided_core_sections=c("observable_sides") == 2,
            one_sided_core_sections=one_sided,
            one_sided_cores_with_drop=one_sided & (c("detected_sides") > 0),
            one_sided_cores_without_drop=one_sided & neither,
            nearby_branch_sections=c("nearby_branch_contamination"),
            short_sections=c("short_available_cross_section"),
            curved_sections=c("high_local_curvature_turning"),
            curved_sections_with_core=c("high_local_curvature_turning") & c("core_u").isNotNull(),
            low_R1_sections=c("low_R1_out"),
            no_drop_with_support_limitation=neither & ((c("unsupported_samples") > 0) | c("short_available_cross_section")),
            no_drop_with_nearby_branch=neither & c("nearby_branch_contamination"),
        ),
        F.sum("observable_sides").alias("observable_flanks"),
        F.sum(2 - c("observable_sides")).alias("unobservable_flanks"),
        median(c("left_front_distance")).alias("median_left_distance"),
        median(c("right_front_distance")).alias("median_right_distance"),
        median(F.abs(c("left_front_distance") - c("right_front_distance"))).alias("median_distance_asymmetry"),
        median(c("total_variation")).alias("median_total_variation"),
        median(c("total_variation_smoothed")).alias("median_total_variation_smoothed"),
        median(F.when(c("total_variation") != 0, (c("total_variation") - c("total_variation_smoothed")) / c("total_variation"))).alias("median_variation_reduction"),
    )
    flank = flanks.agg(F.count("*").alias("flanks"), median(c("drop")).alias("median_drop"), F.avg(c("persistent").cast("int")).alias("persistent_fraction"), F.count_if("nearby_branch_contamination").alias("flanks_with_nearby_branch"))
    return sums.crossJoin(F.broadcast(flank))
