"""A whole run: settings to matrix, statistics, cores, fronts, comparison and files."""

from __future__ import annotations

import dataclasses
import hashlib
import importlib.metadata
import json
import logging
import math
import subprocess
import time
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drift_engine import storage
from drift_engine.functions.geodesy import with_scales
from drift_engine.operators import cellstats, compare, directional, flux, gradients, gridops, matrix, parts, review, sections, tracks, validate
from drift_engine.plans import config as settings
from drift_engine.plans import tables
from drift_engine.plans.config import Config
from drift_engine.sources import naming, trajectories
from drift_engine.storage import materialise

log = logging.getLogger(__name__)


#: Tables of a run, by the product's name (fixed values).
FILES = {
    "cells": "cell_statistics",
    "flux_cores": "flux_cores",
    "flux_fronts": "flux_fronts",
    "directional_corridors": "directional_corridors",
    "directional_cores": "directional_cores",
    "directional_fronts": "directional_fronts",
    "comparison": "comparison",
    "component_comparison": "component_comparison",
    "gradient_validation": "gradient_validation",
}


@dataclass(frozen=True)
class Analysis:
    """The products of analyse(), each a DataFrame of plans.tables' columns; debug tables by file name, and summaries by subject, of a row or a few."""

    cells: DataFrame
    flux_cores: DataFrame
    flux_fronts: DataFrame
    directional_corridors: DataFrame
    directional_cores: DataFrame
    directional_fronts: DataFrame
    comparison: DataFrame
    component_comparison: DataFrame
    gradient_validation: DataFrame | None = None
    debug: dict[str, DataFrame] = field(default_factory=dict)
    summaries: dict[str, DataFrame] = field(default_factory=dict)
    statistics: DataFrame | None = None


@contextmanager
def stage(name: str):
    start = time.perf_counter()
    yield
    log.info("%s: %.2f s", name, time.perf_counter() - start)


def _public_to_inner(table: DataFrame) -> DataFrame:
    """Longitude and latitude names of a geographic matrix as x and y."""
    for a, b in (("lon", "x"), ("lat", "y")):
        for end in ("start", "end"):
            for what in ("bin", "center"):
                if f"{end}_{a}_{what}" in table.columns:
                    table = table.withColumnRenamed(f"{end}_{a}_{what}", f"{end}_{b}_{what}")
    return table


def compute_matrix(spark: SparkSession, cfg: Config) -> tuple[DataFrame, dict]:
    """The transition matrix of the configured files, stored, and its counters."""
    geographic = cfg.space.geographic
    raw = materialise(trajectories.read(spark, cfg.input), "observations")
    long = parts.crowds(raw)
    canon = matrix.require_canonical(materialise(tracks.sanitise(raw, geographic, crowds=long), "tracks"))
    m = cfg.matrix
    segs = matrix.segments(canon, cfg.lag, m.segment_mode, geographic, None if m.max_interpolation_gap is None else m.max_interpolation_gap * tracks.SECONDS[m.time_unit], long)
    segs = materialise(segs, "segments")
    counters = tracks.diagnostics(raw, geographic, crowds=long).first().asDict() | matrix.matrix_diagnostics(segs, cfg.engine_grid).first().asDict()
    step = matrix.source_timestep(canon, long).first()
    counters["source_timestep_seconds"] = None if step is None else step["timestep"]
    return materialise(matrix.transition_matrix(segs, cfg.engine_grid), "matrix"), counters


#: Version of matrix_summary.yaml (fixed value).
SUMMARY_VERSION = 1


def described(cfg: Config) -> dict:
    """What a summary has to say of the run that a matrix is of."""
    own = settings.as_dict(cfg)
    return {"coordinate_system": cfg.geometry.coordinate_system, "geometry": own["geometry"], "grid": own["grid"], "elapsed_seconds": cfg.lag}


def load_matrix(spark: SparkSession, cfg: Config) -> DataFrame:
    """The matrix at matrix.path. A summary beside it must be of version 1, have the matrix's digest, and agree on coordinate system, geometry, grid and lag."""
    path = Path(cfg.matrix.path)
    side = path.parent / "matrix_summary.yaml"
    if side.exists():
        told = yaml.safe_load(side.read_text())
        if not isinstance(told, dict) or told.get("summary_version") != SUMMARY_VERSION:
            raise validate.MatrixError(f"{side}: not a summary of version {SUMMARY_VERSION}")
        if told.get("matrix_sha256") != digest(spark, path):
            raise validate.MatrixError(f"{side}: the digest is not that of the matrix")
        for k, v in described(cfg).items():
            if told.get(k) != v:
                raise validate.MatrixError(f"{side}: {k} is {told.get(k)}, not {v}")
    return materialise(_public_to_inner(spark.read.parquet(str(path))), "matrix")


def analyse(table: DataFrame, cfg: Config) -> Analysis:
    """All products of a validated matrix. Rates are per matrix.time_unit."""
    grid, space, least = cfg.engine_grid, cfg.space, cfg.statistics.min_moving_support
    v, d, f = cfg.validation, cfg.directional, cfg.flux
    debug: dict[str, DataFrame] = {}
    validate.validate(table, grid, normalization_atol=v.normalization_atol, probability_rtol=v.probability_rtol, probability_atol=v.probability_atol, center_atol=v.center_atol)
    with stage("cell statistics"):
        links = materialise(cellstats.enriched_links(table, grid, space), "links")
        cells = materialise(cellstats.cell_statistics(links, grid, cfg.matrix.timestep, cfg.statistics.angular_bins, cfg.statistics.direction_zero_tolerance), "cells")
    summaries = {
        "matrix": validate.summary(table, grid),
        "support": cellstats.support_summary(cells),
        "outgoing": cellstats.outgoing_summary(cellstats.strong_flags(cells), least, least, cfg.statistics.high_R1, cfg.statistics.low_R1),
        "harmonics": cellstats.harmonic_residuals(cells),
        "moment_identities": cellstats.moment_identities(cells),
        "vector_identities": cellstats.vector_identities(cells, cfg.statistics.direction_zero_tolerance),
        "alignment": cellstats.alignment_summary(cellstats.strong_flags(cells), least, least, cfg.statistics.high_R1, cfg.statistics.low_R1),
    }
    graph_limits = (d.maximum_neighbor_direction_difference_degrees, d.maximum_step_direction_mismatch_degrees)
    limits = {"p_move": d.minimum_P_move, "r1": d.minimum_R1, "strength": d.minimum_strength}
    with stage("directional pathway"):
        cut = cfg.fronts.sections(d.interpolation_weight_tolerance)
        corridors = directional.candidates(cells, grid, space, least, *graph_limits, **limits)
        thin = directional.thinned_ridges(cells, grid, space, least, d.transverse_scale_grid, d.ridge_comparison_tolerance, d.ridge_plateau_tolerance, d.interpolation_weight_tolerance, **limits)
        connected = materialise(directional.connected_cores(thin, grid, space, *graph_limits), "connected")
        dcores = materialise(directional.large_enough(connected, d.minimum_component_cells), "directional-cores")
        drows = directional.directional_sections(dcores, cells, grid, space, least, cut, *graph_limits, extra=directional.SAMPLED if cfg.write_debug_outputs else ())
        dzones = materialise(sections.zones(drows, sections.DIRECTIONAL, cut), "directional-zones")
        dfronts = materialise(sections.fronts(dcores, dzones, sections.DIRECTIONAL), "directional-fronts")
        dsections = sections.section_summaries(drows, sections.DIRECTIONAL, cut, least)
        dsides = sections.side_results(drows, dzones, sections.DIRECTIONAL, cut)
        dsections = materialise(dsections.join(sections.section_outcomes(dsides), "section"), "directional-summaries")
    summaries |= {"directional_corridors": directional.corridor_summary(cells, corridors, least), "directional_cores": directional.core_summary(thin, connected, d.minimum_component_cells), "directional_fronts": directional.front_summary(dsections, dfronts)}
    sampling = lambda t: with_scales(t, grid, space).withColumn("sampling_distance", F.col("scale") * F.lit(d.transverse_scale_grid))
    graph_columns = ["cell_id", "component_number", "degree", "endpoint", "junction"]
    diagnosed = sampling(thin).join(corridors.select(*graph_columns), "cell_id").join(dcores.select("cell_id", F.col("component_id").alias("core_component_id")), "cell_id", "left").withColumn("directional_core", F.col("core_component_id").isNotNull())
    supported = cells.filter(F.col("N_out_move") >= least)
    with stage("flux pathway"):
        cut = cfg.fronts.sections(f.interpolation_weight_tolerance)
        fcores = materialise(
            flux.cores(cells, grid, space, least, f.percentile, scale=f.transverse_scale_grid, tie=f.ridge_comparison_tolerance, tolerance=f.interpolation_weight_tolerance, smoothed=f.ridge_field == "smoothed", reliable_r1=f.orientation_reliable_R1, ambiguous_r1=f.orientation_ambiguous_R1, disagreement=f.direction_disagreement_degrees),
            "flux-cores",
        )
        members = materialise(flux.oriented_segments(fcores, grid, space), "members")
        frows = flux.flux_sections(fcores, supported, grid, space, cut, members, flux.SAMPLED if cfg.write_debug_outputs else ("N_out_move", "N_in_move"))
        fzones = materialise(sections.zones(frows, sections.FLUX, cut), "flux-zones")
        ffronts = materialise(sections.fronts(fcores, fzones, sections.FLUX), "flux-fronts")
        centres = frows.filter("i = 0").select("section", "cell_id", "component_number", "x_bin", "y_bin", "x", "y", "theta_mu_out")
        crossed = sections.contaminated(centres, fcores, "theta_mu_out", grid, space, cut)
        first = materialise(sections.section_summaries(frows, sections.FLUX, cut, least, crossed), "flux-summaries")
        fsides = materialise(sections.side_results(frows, fzones, sections.FLUX, cut), "flux-sides")
        flanks = materialise(sections.flank_points(fzones, fsides, first), "flux-flanks")
        fsections = materialise(sections.outcome_flags(first, sections.section_outcomes(fsides)), "flux-outcomes")
    summaries["flux_fronts"] = flux.front_summary(fsections, flanks)
    compared = materialise(compare.comparison(cells, fcores, dcores, least), "comparison")
    summaries["comparison"] = compare.summary(compared)
    gradients_table = None
    if cfg.run_validation:
        with stage("gradient validation"):
            cfg_g = v.gradients()
            g = materialise(gradients.fields(cells, grid, space, cfg_g), "gradients")
            segment = materialise(gradients.segment_comparison(flanks, g, grid, space, cfg_g), "segment-gradients")
            unique = materialise(gradients.cell_sides(segment, cfg_g), "side-gradients")
            gradients_table = tables.gradient_validation(unique)
            summaries |= {"gradient_validation": gradients.summary(g, segment, unique), "gradient_coverage": gradients.covered(g, unique, grid, space)}
    if cfg.write_debug_outputs:
        with stage("debug tables"):
            spans = lambda rows, near: sections.composite_spans(rows, near, space)
            fspans = spans(frows, flux.neighbours_along(frows, cut.composite_window))
            dspans = spans(drows, directional.neighbours_by_hops(dcores, grid, space, cut, *graph_limits))
            edges = lambda t: directional.compatible_edges(t, grid, space, *graph_limits)
            broken = flux.interruptions(fcores, supported, grid)
            near = gridops.consistency(cells, "theta1_out", grid, "N_out_move", least).select("cell_id", F.col("consistency").alias("C_neigh_out"))
            debug |= {
                "candidate_drop_zones": tables.drop_zones(fzones),
                "raw_cross_sections": tables.cross_sections(frows),
                "section_composites": tables.section_composites(fsections.join(fspans, "section")),
                "component_graph_details": tables.flux_components(flux.component_statistics(fcores.join(near, "cell_id", "left"), members, broken, space, f.abrupt_tangent_mismatch_degrees, grid.periodic)),
                "segment_front_candidates": tables.drop_zones(flanks, best=True),
                "directional_candidate_drop_zones": tables.drop_zones(dzones, True),
                "directional_raw_cross_sections": tables.cross_sections(drows, True),
                "directional_section_composites": tables.section_composites(dsections.join(dspans, "section"), True),
                "directional_corridor_components": tables.directional_components(directional.component_statistics(corridors, edges(corridors), space, grid.periodic), False),
                "directional_corridor_graph_edges": tables.graph_edges(edges(corridors)),
                "directional_core_components": tables.directional_components(directional.component_statistics(dcores, edges(dcores), space, grid.periodic), True),
                "directional_core_graph_edges": tables.graph_edges(edges(dcores)),
            }
    named = lambda t, cores: t.join(cores.select("cell_id", "component_id"), "cell_id")
    return Analysis(
        tables.cells(cells),
        tables.flux_cores(fcores),
        tables.fronts(named(ffronts, fcores)),
        tables.directional_corridors(diagnosed),
        tables.directional_cores(sampling(dcores)),
        tables.fronts(named(dfronts, dcores), True),
        tables.comparison(compared),
        tables.component_comparison(compare.component_overlap(compared)),
        gradients_table,
        debug,
        summaries,
        cells,
    )


def figure_data(cells: DataFrame, cfg: Config, out: Path) -> None:
    """What figures are drawn from: vectors at the stride, colour limits, and the settings of their look. No figure is drawn."""
    p = cfg.plotting
    out.mkdir()
    naming.public(tables.cells(review.vectors(cells, p.vector_stride_cells)), cfg.space, cfg.matrix.time_unit).coalesce(1).write.parquet(str(out / "vectors.parquet"))
    fields = {"U_out_all_magnitude_rate": False, "D_out_all_magnitude": False, "R1_out": False, "delta_theta_io_1": True}
    limits = {name: review.limits(cells, name, p.structure_map_max_percentile, symmetric).first().asDict() for name, symmetric in fields.items()}
    look = {k: v for k, v in dataclasses.asdict(p).items() if k != "enabled"}
    (out / "figures.yaml").write_text(yaml.safe_dump(_finite({"limits": limits, "settings": look}), sort_keys=False))


def digest(spark: SparkSession, path: Path) -> str:
    """SHA-256 of a matrix: of a single file's bytes, or of the rows of a folder that Spark wrote.

    The rows' is that of their number and the sums of their own digests' four quarters, so
    it doesn't depend on files, order or tasks, and executors add it up. A row's digest is
    of its values as text, column by column in the order of names.
    """
    if not path.is_dir():
        h = hashlib.sha256()
        with path.open("rb") as data:
            while block := data.read(1 << 20):
                h.update(block)
        return h.hexdigest()
    table = spark.read.parquet(str(path))
    text = F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in sorted(table.columns)])
    own = F.sha2(text, 256)
    quarters = [F.sum(F.conv(F.substring(own, 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    found = table.agg(F.count("*").cast("string"), *quarters).first()
    return hashlib.sha256("|".join(v or "0" for v in found).encode()).hexdigest()


def _finite(v):
    if isinstance(v, dict):
        return {k: _finite(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_finite(x) for x in v]
    return None if isinstance(v, float) and not math.isfinite(v) else v


def _git() -> dict:
    try:
        ask = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True, timeout=10, cwd=Path(__file__).parent).stdout.strip()
        return {"commit": ask("rev-parse", "HEAD") or None, "changed": bool(ask("status", "--porcelain"))}
    except OSError:
        return {"commit": None, "changed": None}


def run(spark: SparkSession, cfg: Config) -> Path:
    """Everything into a new folder <root>/<run_name>; a run that fails leaves a manifest that says so and raises. Intermediate tables are removed."""
    out = Path(cfg.output.root) / cfg.output.run_name
    out.mkdir(parents=True)
    since = storage.mark(spark)
    manifest = {"run_name": cfg.output.run_name, "status": "running", "analysis_version": cfg.analysis_version, "versions": {p: importlib.metadata.version(p) for p in ("pyspark", "numpy", "pandas", "pyarrow")}, "git": _git()}
    try:
        (out / "resolved_config.yaml").write_text(yaml.safe_dump(settings.as_dict(cfg), sort_keys=False))
        summary = {"summary_version": SUMMARY_VERSION, "mode": "computed" if cfg.matrix.compute else "loaded"} | described(cfg) | {"segment_mode": cfg.matrix.segment_mode}
        (out / "matrix").mkdir()
        if cfg.matrix.compute:
            table, counters = compute_matrix(spark, cfg)
            # Ranges of links, a file each: in the order of file names the matrix is sorted.
            table.repartitionByRange(*matrix.LINK_KEYS).sortWithinPartitions(*matrix.LINK_KEYS).write.parquet(str(out / "matrix" / "transition_matrix.parquet"))
            summary |= counters | {"matrix_sha256": digest(spark, out / "matrix" / "transition_matrix.parquet")}
        else:
            table = load_matrix(spark, cfg)
        (out / "matrix" / "matrix_summary.yaml").write_text(yaml.safe_dump(_finite(summary), sort_keys=False))
        found = analyse(table, cfg)
        (out / "analysis").mkdir()
        rows = {}
        for name, df in ({v: getattr(found, k) for k, v in FILES.items()} | found.debug).items():
            if df is not None:
                target = str(out / "analysis" / f"{name}.parquet")
                naming.public(df, cfg.space, cfg.matrix.time_unit).coalesce(1).write.parquet(target)
                rows[name] = spark.read.parquet(target).count()
        if cfg.plotting.enabled:
            figure_data(found.statistics, cfg, out / "analysis" / "figures")
        said = {name: [r.asDict() for r in df.collect()] for name, df in found.summaries.items()}
        manifest |= {"status": "completed", "rows": rows, "summaries": {name: r[0] if len(r) == 1 else r for name, r in said.items()}}
    except BaseException as e:
        manifest |= {"status": "failed", "error": f"{type(e).__name__}: {e}"[:2000]}
        raise
    finally:
        (out / "manifest.json").write_text(json.dumps(_finite(manifest), indent=2))
        storage.release(spark, since)
    return out
