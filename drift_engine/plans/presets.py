"""Ready inputs on the driver's tables: E, events as Cartesian tracks; G, the same on a sphere's grid; O, orders as tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drift_engine.functions.angles import number
from drift_engine.functions.geodesy import Grid, Space
from drift_engine.operators import cellstats, compare, directional, flux, gradients, matrix, review, sections, tracks
from drift_engine.storage import materialise

GRID_E = Grid(0.0, 120.0, 0.0, 100.0, 10.0, 10.0)
GRID_G = Grid(-180.0, 180.0, -80.0, -30.0, 10.0, 5.0, True)
SPACE_E = Space()
SPACE_G = Space(True, "km")
DAY = 86400.0
MIN_SUPPORT = 3


def events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("user_id").cast("string").alias("trajectory"), tracks.seconds(F.col("ts").cast("timestamp"), "datetime").alias("time"), number("value").alias("x"), number(F.get_json_object("props", "$.k")).alias("y"))


def dirty_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with rows made wrong by rule: blank identities, missing positions, repeats."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id"), F.col("user_id").cast("string").alias("trajectory"), tracks.seconds(F.col("ts").cast("timestamp"), "datetime").alias("time"), number("value").alias("x"), number(F.get_json_object("props", "$.k")).alias("y"))
    rows = e.withColumn("trajectory", F.when(F.pmod("event_id", F.lit(97)) == 0, F.lit(" ")).otherwise(F.col("trajectory"))).withColumn("x", F.when(F.pmod("event_id", F.lit(89)) == 0, None).otherwise(F.col("x")))
    again = rows.filter(F.pmod("event_id", F.lit(53)) == 0).withColumn("x", F.col("x") + 1.0).withColumn("row_index", F.lit(1))
    rows = rows.withColumn("row_index", F.lit(0)).unionByName(again).withColumn("trajectory", tracks.identity("trajectory"))
    return rows.select("trajectory", "time", "x", "y", "row_index")


def tracks_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.sanitise(events_raw(spark, sf_dir))


def tracks_g(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tracks_e(spark, sf_dir)
    return e.withColumn("x", F.pmod(F.col("x") * 3.0, F.lit(360.0)) - 180.0).withColumn("y", F.col("y") * 0.5 - 80.0)


def tracks_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    raw = o.select(F.col("o_custkey").cast("string").alias("trajectory"), tracks.seconds(F.col("o_orderdate").cast("timestamp"), "datetime").alias("time"), number("o_totalprice").alias("x"), number(F.substring("o_orderpriority", 1, 1)).alias("y"), F.col("o_orderkey").alias("obs"))
    return tracks.sanitise(raw)


def segments_e(spark: SparkSession, sf_dir: str, mode: str = "non_overlapping", max_gap: float | None = None) -> DataFrame:
    return matrix.segments(tracks_e(spark, sf_dir), DAY, mode, False, max_gap)


def matrix_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.transition_matrix(segments_e(spark, sf_dir), GRID_E)


def matrix_g(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.transition_matrix(matrix.segments(tracks_g(spark, sf_dir), DAY, "non_overlapping", True), GRID_G)


def links_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cellstats.enriched_links(matrix_e(spark, sf_dir), GRID_E, SPACE_E)


def cells_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cellstats.cell_statistics(links_e(spark, sf_dir), GRID_E, DAY)


#: Directional limits for these data, which are less concentrated than the defaults ask for.
LIMITS = {"p_move": 0.5, "r1": 0.5, "strength": 0.4}
SECTIONS = sections.SectionConfig()
#: Rates of these data are some 1e-5 a second, so gradients are compared with a floor far under them.
GRADIENTS = gradients.GradientConfig(zero=1e-15, ratio_floor=1e-15)
REVIEW = review.ReviewConfig(primary=MIN_SUPPORT, sensitivity=5, high_r1=0.5, low_r1=0.3, persistent=0.3)


def cells_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(cells_e(spark, sf_dir), "cells-e")


def supported_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_stored(spark, sf_dir).filter(F.col("N_out_move") >= MIN_SUPPORT)


def flux_cores_e(spark: SparkSession, sf_dir: str, cells: DataFrame | None = None) -> DataFrame:
    return flux.cores(cells or cells_stored(spark, sf_dir), GRID_E, SPACE_E, MIN_SUPPORT)


def directional_cores_e(spark: SparkSession, sf_dir: str, cells: DataFrame | None = None) -> DataFrame:
    return directional.cores(cells or cells_stored(spark, sf_dir), GRID_E, SPACE_E, MIN_SUPPORT, **LIMITS)


def flux_e(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells, flux cores and the samples of their sections, each made once."""
    cells = cells_stored(spark, sf_dir)
    cores = flux_cores_e(spark, sf_dir, cells)
    return cells, cores, flux.flux_sections(cores, cells.filter(F.col("N_out_move") >= MIN_SUPPORT), GRID_E, SPACE_E, SECTIONS)


def flux_found(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The flux pathway's tables, each made once: cells, cores, members, rows, zones, sides, summaries (before outcomes), flanks."""
    cells = cells_stored(spark, sf_dir)
    cores = materialise(flux_cores_e(spark, sf_dir, cells), "flux-cores")
    members = materialise(flux.oriented_segments(cores, GRID_E, SPACE_E), "members")
    rows = flux.flux_sections(cores, cells.filter(F.col("N_out_move") >= MIN_SUPPORT), GRID_E, SPACE_E, SECTIONS, members)
    zones = materialise(sections.zones(rows, sections.FLUX, SECTIONS), "zones")
    centres = rows.filter("i = 0").select("section", "cell_id", "component_number", "x_bin", "y_bin", "x", "y", "theta_mu_out")
    crossed = sections.contaminated(centres, cores, "theta_mu_out", GRID_E, SPACE_E, SECTIONS)
    summaries = materialise(sections.section_summaries(rows, sections.FLUX, SECTIONS, MIN_SUPPORT, crossed), "summaries")
    sides = materialise(sections.side_results(rows, zones, sections.FLUX, SECTIONS), "sides")
    return {"cells": cells, "cores": cores, "members": members, "rows": rows, "zones": zones, "summaries": summaries, "sides": sides, "flanks": sections.flank_points(zones, sides, summaries)}


def directional_found(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The directional pathway's tables: cells, cores, rows, zones, and summaries with their outcomes."""
    cells = cells_stored(spark, sf_dir)
    cores = materialise(directional_cores_e(spark, sf_dir, cells), "directional-cores")
    rows = directional.directional_sections(cores, cells, GRID_E, SPACE_E, MIN_SUPPORT, SECTIONS)
    zones = materialise(sections.zones(rows, sections.DIRECTIONAL, SECTIONS), "zones")
    summaries = sections.section_summaries(rows, sections.DIRECTIONAL, SECTIONS, MIN_SUPPORT)
    outcomes = sections.section_outcomes(sections.side_results(rows, zones, sections.DIRECTIONAL, SECTIONS))
    return {"cells": cells, "cores": cores, "rows": rows, "zones": zones, "summaries": summaries.join(outcomes, "section")}


def gradients_found(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Gradient fields, the fronts' comparison by section, and by cell side."""
    found = flux_found(spark, sf_dir)
    fields = materialise(gradients.fields(found["cells"], GRID_E, SPACE_E, GRADIENTS), "gradients")
    segment = materialise(gradients.segment_comparison(found["flanks"], fields, GRID_E, SPACE_E, GRADIENTS), "segment")
    return {"fields": fields, "segment": segment, "unique": gradients.cell_sides(segment, GRADIENTS)}


def flux_sections_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flux_e(spark, sf_dir)[2]


def directional_sections_e(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Directional cores and the samples of their sections."""
    cells = cells_stored(spark, sf_dir)
    cores = directional_cores_e(spark, sf_dir, cells)
    return cores, directional.directional_sections(cores, cells, GRID_E, SPACE_E, MIN_SUPPORT, SECTIONS)


def compared_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cells_stored(spark, sf_dir)
    return compare.comparison(cells, flux_cores_e(spark, sf_dir, cells), directional_cores_e(spark, sf_dir, cells), MIN_SUPPORT)
