"""The gradient of the flux field, and fronts held against it: samples, surroundings, sections, cell sides and a summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drift_engine.functions.angles import ratio
from drift_engine.functions.geodesy import Grid, Space, with_scales
from drift_engine.operators.cellstats import spearman
from drift_engine.operators.gridops import along_across, gradient, near_cells, sample
from drift_engine.operators.ranks import numbered
from drift_engine.storage import materialise

#: Fields of a cell's gradient that are read elsewhere (fixed values).
SAMPLED = ("gradient_across", "abs_across", "gradient_along", "abs_along", "gradient_magnitude", "gradient_across_fraction")


@dataclass(frozen=True)
class GradientConfig:
    zero: float = 1e-12
    weight: float = 1e-10
    search_scales: float = 1.0
    background_scales: float = 2.0
    disagreement_scales: float = 1.0
    ratio_floor: float = 1e-12
    direct_cells: float = 1e-8


def fields(cells: DataFrame, grid: Grid, space: Space, cfg: GradientConfig = GradientConfig(), field: str = "U_out_all_magnitude_rate", theta: str = "theta_mu_out") -> DataFrame:
    """cells with the field's gradient, its parts along and across theta with their sizes, available neighbours, and quality flags joined by ';'.

    Cells without the field, or without a neighbour along an axis, have no derivative
    there; nothing is filled in.
    """
    out = along_across(gradient(cells, field, grid, space), theta, cfg.zero)
    across, along = F.col("gradient_across"), F.col("gradient_along")
    out = out.withColumns({"abs_across": F.abs(across), "abs_along": F.abs(along)})
    checks = [(F.col(field).isNull(), "flux_undefined")]
    for axis, name in (("east", "dx"), ("north", "dy")):
        method = F.col(f"gradient_{axis}_method")
        checks += [(method == "one_sided", f"{name}_one_sided"), (method == "undefined", f"{name}_undefined")]
    checks += [(F.col(theta).isNull(), "theta_mu_out_undefined"), (F.coalesce(F.col("gradient_magnitude") <= cfg.zero, F.lit(False)), "gradient_zero_orientation_undefined")]
    return out.withColumn("gradient_quality_flags", F.concat_ws(";", *[F.when(c, F.lit(n)) for c, n in checks]))


def sampled(points: DataFrame, keys: list[str], gradients: DataFrame, grid: Grid, cfg: GradientConfig, end: str) -> DataFrame:
    """(keys, <field>_at_<end> of SAMPLED, class_<end>, boundary_<end>, unsupported_<end>) at points (keys, px, py)."""
    known = gradients.filter("abs_across is not null")
    found = sample(points, keys, known, list(SAMPLED), grid, cfg.weight)
    near = lambda g: F.abs(g - F.round(g)) <= cfg.direct_cells + 1e-5 * F.abs(F.round(g))
    gx = (grid.branch(F.col("px")) - F.lit(grid.x_min)) / F.lit(grid.dx) - 0.5
    gy = (F.col("py") - F.lit(grid.y_min)) / F.lit(grid.dy) - 0.5
    found = found.join(points.select(*keys, (near(gx) & near(gy)).alias("_direct")), keys)
    there = F.col("abs_across").isNotNull()
    kind = F.when(~there, "gradient_sample_unavailable").when(F.col("_direct"), "gradient_sample_direct").otherwise("gradient_sample_interpolated")
    lost = ~F.col("boundary") & F.array_contains(F.array(*[F.col(c).isNull() for c in SAMPLED]), True)
    return found.select(*keys, *[F.col(c).alias(f"{c}_at_{end}") for c in SAMPLED], kind.alias(f"class_{end}"), F.col("boundary").alias(f"boundary_{end}"), lost.alias(f"unsupported_{end}"))


def surroundings(points: DataFrame, gradients: DataFrame, grid: Grid, space: Space, cfg: GradientConfig) -> DataFrame:
    """(section, side, local_max, its place and distance, percentile, background_cells): the largest gradient within the search radius of the front, the nearest of equals, and the front's rank among the cells around the refined core.

    points: section, side, front_x, front_y, refined_x, refined_y, grid_effective_scale and
    abs_across_at_front. Radii are in the core's effective scales; cells are found by bins
    and measured.
    """
    key = ["section", "side"]
    values = gradients.filter("abs_across is not null").select(F.col("cell_id").alias("near_id"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("abs_across").alias("_g"))

    def within(x: str, y: str, scales: float, *carried: str) -> DataFrame:
        reach = F.col("grid_effective_scale") * F.lit(scales)
        rows = points.filter(F.col(x).isNotNull()).select(*key, F.col(x).alias("px"), F.col(y).alias("py"), reach.alias("_reach"), *carried)
        rows = near_cells(rows, F.col("_reach"), grid, space).join(values, "near_id")
        rows = rows.withColumn("_d", space.inverse(F.col("px"), F.col("py"), F.col("_x"), F.col("_y"))["distance"])
        return rows.filter("_d <= _reach")

    local = within("front_x", "front_y", cfg.search_scales).withColumn("local_max", F.max("_g").over(Window.partitionBy(*key)))
    # Equal to some digits is equal; of those the nearest, then the smallest cell.
    alike = F.abs(F.col("_g") - F.col("local_max")) <= 1e-8 + 1e-5 * F.abs("local_max")
    best = local.filter(alike).groupBy(*key, "local_max").agg(F.min(F.struct("_d", "near_id", "_x", "_y")).alias("b"))
    best = best.select(*key, "local_max", F.col("b._x").alias("local_max_x"), F.col("b._y").alias("local_max_y"), F.col("b._d").alias("local_max_distance"))
    back = within("refined_x", "refined_y", cfg.background_scales, "abs_across_at_front").groupBy(*key).agg(F.avg((F.col("_g") <= F.col("abs_across_at_front")).cast("int")).alias("percentile"), F.count("*").alias("background_cells"))
    out = points.select(*key, "grid_effective_scale").join(best, key, "left").join(back, key, "left")
    return out.withColumn("background_cells", F.coalesce("background_cells", F.lit(0))).withColumn("local_max_scales", F.when(F.col("grid_effective_scale") > 0, F.col("local_max_distance") / F.col("grid_effective_scale"))).drop("grid_effective_scale")


def segment_comparison(flanks: DataFrame, gradients: DataFrame, grid: Grid, space: Space, cfg: GradientConfig = GradientConfig()) -> DataFrame:
    """Each front of sections.flank_points() with the gradient at it and at its refined core, their ratio, its surroundings, and flags."""
    key = ["section", "side"]
    flanks = materialise(flanks, "flanks")
    at = lambda x, y: flanks.filter(F.col(x).isNotNull()).select(*key, F.col(x).alias("px"), F.col(y).alias("py"))
    out = flanks.join(sampled(at("front_x", "front_y"), key, gradients, grid, cfg, "front"), key, "left").join(sampled(at("refined_x", "refined_y"), key, gradients, grid, cfg, "core").select(*key, "abs_across_at_core", "class_core"), key, "left")
    out = materialise(out, "front-gradients")
    out = out.join(surroundings(out, gradients, grid, space, cfg), key, "left")
    unstable = F.coalesce(F.col("abs_across_at_core") <= cfg.ratio_floor, F.lit(False))
    there = F.col("abs_across_at_front").isNotNull()
    out = out.withColumns(
        {
            "core_ratio_unstable": unstable,
            "front_to_core_ratio": F.when(~unstable, F.col("abs_across_at_front") / (F.col("abs_across_at_core") + cfg.ratio_floor)),
            "gradient_observability": F.when(there, "gradient_observable").otherwise("gradient_not_observable"),
        }
    )
    checks = ((~there, "gradient_not_observable"), (F.coalesce("boundary_front", F.lit(False)), "gradient_sample_boundary"), (F.coalesce("unsupported_front", F.lit(False)), "gradient_sample_missing_support"), (F.col("abs_across_at_core").isNull(), "core_gradient_not_observable"), (F.col("core_ratio_unstable"), "core_gradient_ratio_unstable"))
    flags = F.concat_ws(";", F.when(F.col("quality_flags") != "", F.col("quality_flags")), *[F.when(c, F.lit(n)) for c, n in checks])
    out = numbered(out.withColumn("quality_flags", flags), [F.col(c) for c in ("component_number", "section", "side")], "_number", 0)
    return out.withColumn("comparison_record_id", F.format_string("segment_flank_%05d", "_number")).drop("_number")


#: What a cell side has the median of, over its sections (fixed values).
MEDIANS = ("front_x", "front_y", "distance", "drop", "relative_drop", "gradient_across_at_front", "abs_across_at_front", "gradient_along_at_front", "abs_along_at_front", "gradient_magnitude_at_front", "gradient_across_fraction_at_front", "abs_across_at_core", "front_to_core_ratio", "local_max", "local_max_distance", "local_max_scales", "percentile", "grid_effective_scale", "R1_out_center")


def cell_sides(segment: DataFrame, cfg: GradientConfig = GradientConfig()) -> DataFrame:
    """segment_comparison() by cell and side: medians over the sections that the cell has, spread and disagreement of distances, and the sorted ids and flags."""
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ";")
    spread = F.max("distance") - F.min("distance")
    out = segment.groupBy("cell_id", "side").agg(
        F.first("ridge_type").alias("ridge_type"),
        F.first("missing_side").alias("missing_side"),
        F.count("*").alias("n_segment_records"),
        names("comparison_record_id").alias("comparison_record_ids"),
        names("section").alias("section_ids"),
        names(F.col("component").cast("string")).alias("component_ids"),
        names(F.concat_ws("_", "component", "segment")).alias("segment_ids"),
        spread.alias("distance_spread"),
        F.avg(F.col("persistent").cast("int")).alias("persistence_fraction"),
        F.max("nearby_branch_contamination").alias("nearby_branch_contamination"),
        F.max("high_local_curvature_turning").alias("high_local_curvature_turning"),
        names("class_front").alias("sample_classes"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.split("quality_flags", ";"))))).alias("_flags"),
        *[F.percentile(c, F.lit(0.5)).alias(c) for c in MEDIANS],
    )
    scale = F.col("grid_effective_scale")
    apart = (F.col("n_segment_records") > 1) & (F.col("distance_spread") > cfg.disagreement_scales * scale)
    flags = F.filter(F.when(F.col("duplicate_flank_disagreement"), F.sort_array(F.concat("_flags", F.array(F.lit("duplicate_flank_disagreement"))))).otherwise(F.col("_flags")), lambda f: f != "")
    out = out.withColumns({"duplicate_flank_disagreement": F.coalesce(apart, F.lit(False)), "distance_spread_scales": F.when(scale > 0, F.col("distance_spread") / scale), "persistent": F.col("persistence_fraction") >= 0.5, "gradient_observability": F.when(F.col("abs_across_at_front").isNotNull(), "gradient_observable").otherwise("gradient_not_observable"), "unique_comparison_id": F.format_string("cell%05d_%s", "cell_id", "side")})
    return out.withColumn("quality_flags", F.array_join(flags, ";")).drop("_flags")


def covered(gradients: DataFrame, unique: DataFrame, grid: Grid, space: Space, levels=(0.9, 0.95)) -> DataFrame:
    """Per level: the cells whose gradient across reaches that quantile, and those with a front within one effective scale of them."""
    known = with_scales(gradients.filter("abs_across is not null").select("cell_id", "x_bin", "y_bin", "x", "y", "abs_across"), grid, space)
    cut = known.agg(*[F.percentile("abs_across", F.lit(q)).alias(f"q{i}") for i, q in enumerate(levels)])
    limits = cut.select(F.explode(F.array(*[F.struct(F.lit(q).alias("level"), F.col(f"q{i}").alias("_cut")) for i, q in enumerate(levels)])).alias("l")).select("l.*")
    strong = known.join(F.broadcast(limits), F.col("abs_across") >= F.col("_cut"))
    fronts = unique.filter("front_x is not null").select(grid.cell_id(grid.x_bin(F.col("front_x")), grid.y_bin(F.col("front_y"))).alias("near_id"), F.col("front_x").alias("_fx"), F.col("front_y").alias("_fy"))
    # A front lies within half a cell of the centre of the cell that it is in.
    points = strong.select("level", "cell_id", F.col("x").alias("px"), F.col("y").alias("py"), "scale", (F.col("scale") + F.hypot("x_scale", "y_scale")).alias("_reach"))
    near = near_cells(points, F.col("_reach"), grid, space).join(fronts, "near_id").withColumn("_d", space.inverse(F.col("px"), F.col("py"), F.col("_fx"), F.col("_fy"))["distance"])
    hit = near.filter("_d <= scale").select("level", "cell_id").distinct().withColumn("_hit", F.lit(True))
    out = strong.join(hit, ["level", "cell_id"], "left").groupBy("level").agg(F.count("*").alias("cells"), F.count("_hit").alias("with_front"))
    return out.withColumn("fraction", ratio(F.col("with_front"), F.col("cells")))


def summary(gradients: DataFrame, segment: DataFrame, unique: DataFrame) -> DataFrame:
    """One row: cells by method and levels of the gradient, fronts by observability, medians and shares, opposite signs on both sides of a core, and the rank correlation of loss and gradient."""
    c = F.col
    median = lambda e: F.percentile(e, F.lit(0.5))
    share = lambda e: F.avg(e.cast("int"))
    methods = [F.count_if(c(f"gradient_{a}_method") == m).alias(f"{n}_{m}_cells") for a, n in (("east", "dx"), ("north", "dy")) for m in ("centred", "one_sided", "undefined")]
    cells = gradients.agg(F.count("*").alias("cells"), F.count("S_flux_rate").alias("flux_cells"), F.count("abs_across").alias("gradient_cells"), *methods, *[F.percentile("abs_across", F.lit(q)).alias(f"abs_across_q{round(100 * q)}") for q in (0.5, 0.75, 0.9, 0.95)])
    there = c("abs_across_at_front").isNotNull()
    paired = there & c("abs_across_at_core").isNotNull()
    near = lambda limit: share(F.when(there, F.coalesce(c("local_max_scales") <= limit, F.lit(False))))
    sides = unique.agg(
        F.count("*").alias("cell_sides"),
        F.count_if("duplicate_flank_disagreement").alias("disagreements"),
        F.count_if(there).alias("observable"),
        F.count_if(~there).alias("not_observable"),
        median(c("abs_across_at_front")).alias("median_at_front"),
        median(F.when(paired, c("abs_across_at_core"))).alias("median_at_core"),
        median(F.when(there, c("percentile"))).alias("median_percentile"),
        near(0.5).alias("within_half_scale"),
        near(1.0).alias("within_one_scale"),
        median(F.when(there, c("local_max_distance"))).alias("median_distance_to_max"),
        median(F.when(there, c("local_max_scales"))).alias("median_scales_to_max"),
        share(F.when(paired, c("abs_across_at_front") > c("abs_across_at_core"))).alias("front_above_core"),
    )
    signs = unique.groupBy("cell_id").agg(F.count("gradient_across_at_front").alias("n"), *[F.max(F.when(c("side") == s, c("gradient_across_at_front"))).alias(s) for s in ("left", "right")]).filter("n = 2 and left is not null and right is not null")
    opposite = signs.agg(F.count("*").alias("cells_with_both_signs"), share(c("left") * c("right") < 0).alias("opposite_signs"))
    loss = spearman(unique.filter(there), "drop", "abs_across_at_front").select(c("correlation").alias("spearman_loss_gradient"))
    records = segment.agg(F.count("*").alias("segment_sides"))
    out = cells
    for part in (records, sides, opposite, loss):
        out = out.crossJoin(F.broadcast(part))
    return out.withColumn("duplicate_records", c("segment_sides") - c("cell_sides"))
