"""Reviews of cell statistics and the data behind figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drift_engine.functions.angles import ratio
from drift_engine.functions.geodesy import Grid
from drift_engine.operators.cellstats import spearman, strong_flags
from drift_engine.operators.gridops import consistency
from drift_engine.storage import materialise


@dataclass(frozen=True)
class ReviewConfig:
    """Limits of the review; shares of cells and angles in degrees."""

    primary: int = 10
    sensitivity: int = 20
    levels: tuple[float, ...] = (0.9, 0.95, 0.99)
    high_r1: float = 0.8
    low_r1: float = 0.5
    high_r2: float = 0.8
    split_r1: tuple[float, float] = (0.4, 0.85)
    split_r2: float = 0.3
    persistent: float = 0.8
    substantial: float = 60.0
    low_alignment: float = 90.0
    reversal: float = 150.0
    disagreement: float = 20.0
    representatives: int = 3

    @property
    def supports(self) -> tuple[int, ...]:
        return tuple(dict.fromkeys((self.primary, self.sensitivity)))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def reviewed(cells: DataFrame, grid: Grid, cfg: ReviewConfig = ReviewConfig()) -> DataFrame:
    """cells of cell_statistics() with strong flags, substantial turns, and for each support the consistency of outgoing and incoming directions with their neighbours', stored."""
    out = strong_flags(cells)
    out = out.withColumns({f"substantial_turn_{k}": _yes(F.col(f"abs_delta_theta_io_{k}") >= cfg.substantial) for k in ("1", "mu")})
    for n in cfg.supports:
        for side, field in (("out", "N_out_move"), ("in", "N_in_move")):
            for kind, theta in (("1", "theta1"), ("mu", "theta_mu")):
                found = consistency(cells, f"{theta}_{side}", grid, field, n)
                out = out.join(found.select("cell_id", F.col("consistency").alias(f"C_neigh_{side}_{kind}_{n}"), F.col("neighbours").alias(f"N_neigh_{side}_{kind}_{n}")), "cell_id", "left").fillna(0, [f"N_neigh_{side}_{kind}_{n}"])
    return materialise(out, "reviewed")


def with_levels(cells: DataFrame, cfg: ReviewConfig = ReviewConfig()) -> DataFrame:
    """A row per cell, support that it has, and quantile level, with both thresholds and whether the flux and the coherent flux (U_coh_rate) reach them."""
    rows = cells.filter(F.col("U_out_all_magnitude_rate").isNotNull() & F.col("U_coh_rate").isNotNull())
    rows = rows.withColumn("support", F.explode(F.array(*map(F.lit, cfg.supports)))).filter(F.col("N_out_move") >= F.col("support"))
    q = [F.percentile(c, F.lit(p)).alias(f"{n}{i}") for i, p in enumerate(cfg.levels) for c, n in (("U_out_all_magnitude_rate", "u"), ("U_coh_rate", "s"))]
    limits = rows.groupBy("support").agg(*q)
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("level"), F.col(f"u{i}").alias("flux_threshold"), F.col(f"s{i}").alias("coherent_threshold")) for i, p in enumerate(cfg.levels)]))
    limits = limits.select("support", each.alias("x")).select("support", "x.*")
    rows = rows.join(F.broadcast(limits), "support")
    return rows.withColumns({"in_flux": F.col("U_out_all_magnitude_rate") >= F.col("flux_threshold"), "in_coherent": F.col("U_coh_rate") >= F.col("coherent_threshold")})


def levels(cells: DataFrame, cfg: ReviewConfig = ReviewConfig()) -> DataFrame:
    """Per support and level: cells that reach the flux's and the coherent flux's quantile, how far both agree, and the median R1 of the selected and of those that only the flux selects."""
    u, s = F.col("in_flux"), F.col("in_coherent")
    median = lambda c: F.percentile(F.when(c, F.col("R1_out")), F.lit(0.5))
    out = with_levels(cells, cfg).groupBy("support", "level", "flux_threshold", "coherent_threshold").agg(
        F.count("*").alias("population"), F.count_if(u).alias("flux_cells"), F.count_if(s).alias("coherent_cells"), F.count_if(u & s).alias("both"), F.count_if(u | s).alias("either"), median(u).alias("median_R1_flux"), median(u & ~s).alias("median_R1_removed")
    )
    return out.withColumns({"jaccard": ratio(F.col("both"), F.col("either")), "flux_retained": ratio(F.col("both"), F.col("flux_cells")), "coherent_retained": ratio(F.col("both"), F.col("coherent_cells"))})


DIRECTION_FIELDS = ("delta_theta_mu1_out", "delta_theta_mu1_in", "abs_delta_theta_io_1", "abs_delta_theta_io_mu", "abs_delta_theta_io_1_minus_mu")


def directions(cells: DataFrame, cfg: ReviewConfig = ReviewConfig()) -> DataFrame:
    """Per population (supported; strong and concentrated outwards; and inwards too; at both supports) and angle: cells, those from the review and the substantial limit on, and quantiles. cells: of reviewed()."""
    c = F.col
    populations = {}
    for name, n in (("primary", cfg.primary), ("sensitivity", cfg.sensitivity)):
        out = c("strong") & (c("R1_out") >= cfg.high_r1) & (c("N_out_move") >= n)
        populations |= {f"outgoing_{name}": c("N_out_move") >= n, f"strong_out_{name}": out, f"strong_through_{name}": out & (c("R1_in") >= cfg.high_r1) & (c("N_in_move") >= n)}
    member = F.filter(F.array(*[F.when(_yes(v), F.lit(k)) for k, v in populations.items()]), lambda p: p.isNotNull())
    fields = F.array(*[F.struct(F.lit(f).alias("field"), c(f).alias("v")) for f in DIRECTION_FIELDS])
    long = cells.select(F.explode(member).alias("population"), fields.alias("f")).select("population", F.explode("f").alias("f")).select("population", "f.*")
    at = (0.0, 0.05, 0.5, 0.95, 0.99, 1.0)
    found = long.groupBy("population", "field").agg(F.count("v").alias("cells"), F.count_if(c("v") >= cfg.disagreement).alias("from_review"), F.count_if(c("v") >= cfg.substantial).alias("from_substantial"), *[F.percentile("v", F.lit(q)).alias(f"q{q:g}".replace(".", "_")) for q in at])
    # A population without a cell has its rows all the same.
    names = [(p, f) for p in populations for f in DIRECTION_FIELDS]
    out = cells.sparkSession.createDataFrame(names, "population string, field string").join(found, ["population", "field"], "left")
    return out.fillna(0, ["cells", "from_review", "from_substantial"])


def persistence(cells: DataFrame, cfg: ReviewConfig = ReviewConfig()) -> DataFrame:
    """Per support, field and level, and over all supported cells (field all, level null): cells, those with a neighbourhood, and medians of consistency, R1 and neighbours."""
    rows = with_levels(cells, cfg)
    of_support = lambda name: F.coalesce(*[F.when(F.col("support") == n, F.col(f"{name}_{n}")) for n in cfg.supports])
    one = rows.select("support", "level", F.explode(F.filter(F.array(F.when(F.col("in_flux"), F.lit("flux")), F.when(F.col("in_coherent"), F.lit("coherent"))), lambda f: f.isNotNull())).alias("field"), "R1_out", of_support("C_neigh_out_1").alias("c"), of_support("N_neigh_out_1").alias("n"))
    every = cells.withColumn("support", F.explode(F.array(*map(F.lit, cfg.supports)))).filter(F.col("N_out_move") >= F.col("support"))
    every = every.select("support", F.lit(None).cast("double").alias("level"), F.lit("all").alias("field"), "R1_out", of_support("C_neigh_out_1").alias("c"), of_support("N_neigh_out_1").alias("n"))
    median = lambda c: F.percentile(c, F.lit(0.5))
    return one.unionByName(every).groupBy("support", "field", "level").agg(F.count("*").alias("cells"), F.count("c").alias("with_neighbourhood"), median("c").alias("median_consistency"), F.avg(_yes(F.col("c") >= cfg.persistent).cast("int")).alias("consistent_fraction"), median("R1_out").alias("median_R1"), median("n").alias("median_neighbours"))


def low_alignment(cells: DataFrame, cfg: ReviewConfig = ReviewConfig()) -> DataFrame:
    """Cells that turn by the low-alignment limit or more by either direction, with the evidence and its reading. cells: of reviewed().

    Readings, the first that holds: insufficient support; reliable directions in a
    persistent neighbourhood, near-reversal or not; complex angular geometry by R1 and R2;
    ambiguous directions; unresolved.
    """
    c = F.col
    joint = (c("N_out_move") >= cfg.primary) & (c("N_in_move") >= cfg.primary)
    reliable = _yes((c("R1_out") >= cfg.high_r1) & (c("R1_in") >= cfg.high_r1))
    spatial = _yes((c(f"C_neigh_out_1_{cfg.primary}") >= cfg.persistent) & (c(f"C_neigh_in_1_{cfg.primary}") >= cfg.persistent))
    complex_ = lambda s: _yes((c(f"R1_{s}").between(*cfg.split_r1) & (c(f"R2_{s}") <= cfg.split_r2)) | ((c(f"R1_{s}") <= cfg.low_r1) & (c(f"R2_{s}") >= cfg.high_r2)))
    turn = F.greatest("abs_delta_theta_io_1", "abs_delta_theta_io_mu")
    rows = cells.filter(turn >= cfg.low_alignment).withColumns({"joint_support": joint, "reliable": reliable, "spatially_persistent": spatial, "complex_out": complex_("out"), "complex_in": complex_("in"), "turn": turn})
    label = F.when(~c("joint_support"), "insufficient_primary_joint_support").when(c("reliable") & c("spatially_persistent") & (turn >= cfg.reversal), "coherent_reversal_like_turning_geometry").when(c("reliable") & c("spatially_persistent"), "coherent_turning_geometry")
    label = label.when(c("complex_out") | c("complex_in"), "possible_split_merge_or_axial_geometry").when(_yes((c("R1_out") < cfg.high_r1) | (c("R1_in") < cfg.high_r1)), "directionally_ambiguous_turning")
    return rows.withColumn("interpretation", label.otherwise("supported_unresolved_turning_geometry"))


def representatives(cells: DataFrame, cfg: ReviewConfig = ReviewConfig()) -> DataFrame:
    """The k first cells of each category by its score: flux selected with and without the coherent flux, strong but disagreeing directions (where a category is empty, the first of the pool it was sought in), and the largest flux of each reading of low alignment."""
    c = F.col
    u = c("U_out_all_magnitude_rate")
    at95 = with_levels(cells, cfg).filter((c("support") == cfg.primary) & (c("level") == 0.95)).select("cell_id", "in_flux", "in_coherent")
    rows = cells.join(at95, "cell_id", "left").withColumns({"in_flux": _yes(c("in_flux")), "in_coherent": _yes(c("in_coherent"))})
    strong = _yes(c("strong") & (c("R1_out") >= cfg.high_r1) & (c("N_out_move") >= cfg.primary))
    kinds = {
        "flux_backbone_stable_under_coherence_weighting": (c("in_flux") & c("in_coherent"), u, c("in_flux")),
        "coherence_weighting_suppresses_flux_cell": (c("in_flux") & ~c("in_coherent"), u * (1.0 - c("R1_out")), c("in_flux")),
        "strong_direction_convention_disagreement": (strong & _yes(c("delta_theta_mu1_out") >= cfg.disagreement), u * c("delta_theta_mu1_out"), strong),
    }
    each = F.array(*[F.when(pool, F.struct(F.lit(k).alias("category"), mask.alias("inside"), score.alias("score"))) for k, (mask, score, pool) in kinds.items()])
    pools = rows.select("cell_id", u.alias("flux"), F.explode(F.filter(each, lambda e: e.isNotNull())).alias("e")).select("cell_id", "flux", "e.*")
    some = F.max("inside").over(Window.partitionBy("category"))
    pools = pools.withColumn("fallback", ~some).filter(c("inside") | c("fallback")).drop("inside")
    turning = low_alignment(cells, cfg).select("cell_id", u.alias("flux"), F.concat(F.lit("low_alignment_"), c("interpretation")).alias("category"), u.alias("score"), F.lit(False).alias("fallback"))
    every = pools.unionByName(turning)
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), F.desc("flux"), "cell_id"))
    return every.withColumn("place", place).filter(c("place") <= cfg.representatives)


def summary(cells: DataFrame, cfg: ReviewConfig = ReviewConfig()) -> DataFrame:
    """A row per support: counters of reliable, persistent and turning cells, medians of direction differences, how flux and coherent flux rank alike, and the residuals of the alignments' cosines."""
    c = F.col
    out = None
    turn = lambda limit: _yes(c("abs_delta_theta_io_1") >= limit)
    for n in cfg.supports:
        mask = c("N_out_move") >= n
        joint = mask & (c("N_in_move") >= n)
        both = _yes(joint & (c("R1_out") >= cfg.high_r1) & (c("R1_in") >= cfg.high_r1))
        lasting = both & _yes((c(f"C_neigh_out_1_{n}") >= cfg.persistent) & (c(f"C_neigh_in_1_{n}") >= cfg.persistent))
        strong = _yes(mask & (c("R1_out") >= cfg.high_r1) & c("strong"))
        through = strong & _yes((c("R1_in") >= cfg.high_r1) & (c("N_in_move") >= n))
        low = turn(cfg.low_alignment) | _yes(c("abs_delta_theta_io_mu") >= cfg.low_alignment)
        identity = lambda a, d: F.max(F.when(joint, F.abs(c(a) - F.cos(F.radians(d)))))
        row = cells.agg(
            F.lit(n).alias("support"),
            F.percentile(F.when(mask, c("R1_out")), F.lit(0.5)).alias("median_R1_out"),
            F.count_if(strong).alias("strong_reliable_out"),
            F.percentile(F.when(strong, c("delta_theta_mu1_out")), F.lit(0.5)).alias("strong_median_difference"),
            F.percentile(F.when(strong, c("delta_theta_mu1_out")), F.lit(0.95)).alias("strong_q95_difference"),
            F.count_if(strong & _yes(c("delta_theta_mu1_out") >= cfg.disagreement)).alias("strong_from_review"),
            F.count_if(through).alias("strong_reliable_through"),
            F.count_if(through & turn(cfg.substantial)).alias("strong_through_substantial"),
            F.count_if(joint).alias("joint_cells"),
            F.count_if(lasting).alias("persistent_through"),
            F.count_if(lasting & turn(cfg.substantial)).alias("persistent_substantial"),
            F.count_if(lasting & turn(cfg.low_alignment)).alias("persistent_low_alignment"),
            F.count_if(lasting & turn(cfg.reversal)).alias("persistent_reversal"),
            F.count_if(joint & low).alias("low_alignment_cells"),
            identity("A_io", "delta_theta_io_1").alias("A_io_residual"),
            identity("A_io_mu", "delta_theta_io_mu").alias("A_io_mu_residual"),
        )
        ranks = spearman(cells.filter(mask), "U_out_all_magnitude_rate", "U_coh_rate").select(c("correlation").alias("spearman_flux_coherent"))
        row = row.crossJoin(F.broadcast(ranks))
        out = row if out is None else out.unionByName(row)
    return out


def interpretation_counts(cells: DataFrame, cfg: ReviewConfig = ReviewConfig()) -> DataFrame:
    """Cells of each reading of low alignment, of all and of those with each joint support."""
    rows = low_alignment(cells, cfg)
    at = [F.count_if((F.col("N_out_move") >= n) & (F.col("N_in_move") >= n)).alias(f"cells_{k}") for k, n in (("primary", cfg.primary), ("sensitivity", cfg.sensitivity))]
    return rows.groupBy("interpretation").agg(F.count("*").alias("cells"), *at)


def vectors(cells: DataFrame, stride: int) -> DataFrame:
    """Every stride-th cell in both directions that has a direction vector."""
    return cells.filter((F.pmod("x_bin", F.lit(stride)) == 0) & (F.pmod("y_bin", F.lit(stride)) == 0) & F.col("D_out_all_x").isNotNull())


def limits(cells: DataFrame, field: str, percentile: float = 100.0, symmetric: bool = False) -> DataFrame:
    """One row: the colour limits of a field's map, 0 and the percentile of its values; symmetric: of their sizes, on both sides of 0."""
    value = F.abs(field) if symmetric else F.col(field)
    high = F.percentile(value, F.lit(percentile / 100.0))
    return cells.agg((-high if symmetric else F.lit(0.0)).alias("low"), high.alias("high"))


def dateline_parts(lines: DataFrame) -> DataFrame:
    """Points (line, place, x, y) with the part of their line: a new one starts where longitude steps over 180 degrees; parts of one point are dropped."""
    w = Window.partitionBy("line").orderBy("place")
    cut = F.when(F.abs(F.col("x") - F.lag("x").over(w)) > 180, 1).otherwise(0)
    rows = lines.withColumn("_cut", cut).withColumn("part", F.sum("_cut").over(w)).drop("_cut")
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("line", "part"))).filter("_n >= 2").drop("_n")
