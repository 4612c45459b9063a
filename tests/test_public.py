"""Public names, the shape of tables, summaries beside a matrix, and spans."""

import hashlib
from pathlib import Path

import pytest
import yaml
from pyspark.sql import functions as F
from test_workflow import SETTINGS, changed

from drift_engine.functions.geodesy import Space
from drift_engine.operators import directional, flux
from drift_engine.operators.validate import MatrixError
from drift_engine.plans import config, tables, workflow
from drift_engine.sources import naming

#: Inner name: its public names of a Cartesian run in m and s, and of a geographic one in km and day (fixed values).
NAMES = {
    "start_x_bin": ("start_x_bin", "start_lon_bin"),
    "x_bin": ("x_bin", "lon_bin"),
    "core_x": ("core_x", "core_lon"),
    "centroid_x": ("centroid_x", "centroid_lon_circular"),
    "x_span": ("x_span", "longitude_span_degrees"),
    "U_out_all_x_rate": ("U_out_all_x_m_s", "U_out_all_east_km_day"),
    "U_out_all_magnitude_rate": ("U_out_all_magnitude_m_s", "U_out_all_magnitude_km_day"),
    "D_out_all_y": ("D_out_all_y", "D_out_all_north"),
    "mu_in_x": ("mu_in_x", "mu_in_east"),
    "distance_from_core_length": ("distance_from_core_m", "distance_from_core_km"),
    "integrated_ridge_strength_area_rate": ("integrated_ridge_strength_m2_s", "integrated_ridge_strength_km2_day"),
    "drop_slope_rate_per_length": ("drop_slope_m_s_per_m", "drop_slope_km_day_per_km"),
    "edge_length_length": ("edge_m_m", "edge_km_km"),
    "U_core": ("U_core_m_s", "U_core_km_day"),
    "absolute_drop": ("absolute_drop_m_s", "absolute_drop_km_day"),
    "absolute_directional_drop": ("absolute_directional_drop", "absolute_directional_drop"),
    "spearman_flux_loss_vs_abs_G_perp": ("spearman_flux_loss_vs_abs_G_perp", "spearman_flux_loss_vs_abs_G_perp"),
    "abs_G_perp_at_flank": ("abs_G_perp_at_flank_m_s_per_m", "abs_G_perp_at_flank_km_day_per_km"),
    "flank_to_core_abs_G_perp_ratio": ("flank_to_core_abs_G_perp_ratio", "flank_to_core_abs_G_perp_ratio"),
    "grid_x_scale_length": ("grid_x_scale_m", "grid_zonal_scale_km"),
    "S_flux": ("S_flux_m_s", "S_flux_km_day"),
    "theta_mu_out": ("theta_mu_out", "theta_mu_out"),
    "transverse_left_y": ("transverse_left_y", "transverse_left_lat"),
}


def test_names_of_declared_measures(spark):
    for name, (plain, geographic) in NAMES.items():
        assert naming.public_name(name, Space(unit="m"), "s") == plain
        assert naming.public_name(name, Space(True, "km"), "day") == geographic
    assert naming.public_name("anything_else_rate", Space(), "s") == "anything_else_rate"
    with pytest.raises(ValueError, match="share a public name"):
        naming.public(spark.createDataFrame([(1, 2)], "x int, lon int"), Space(True), "s")


def test_tables_do_not_lose_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert tables.shaped(df, {"one": "a", "two": F.col("b") + 1, "three": "c"}, ("c",)).columns == ["one", "two"]
    with pytest.raises(ValueError, match="lacks"):
        tables.shaped(df, {"one": "a", "three": "c"})


def test_summaries_beside_a_matrix(spark, tmp_path):
    """Version, digest, coordinate system, geometry, grid and lag are each required; a single file's digest is that of its bytes."""
    rows = [(0, 0, 1, 0, 0.5, 0.5, 1.5, 0.5, 4, 1.0), (1, 0, 1, 0, 1.5, 0.5, 1.5, 0.5, 2, 1.0)]
    ddl = "start_x_bin long, start_y_bin long, end_x_bin long, end_y_bin long, start_x_center double, start_y_center double, end_x_center double, end_y_center double, transition_count long, transition_probability double"
    path = tmp_path / "m.parquet"
    spark.createDataFrame(rows, ddl).toPandas().to_parquet(path)
    cfg = config.from_dict(changed(("matrix",), {"timestep": 2, "time_unit": "s", "compute": False, "path": str(path)}))
    good = {"summary_version": 1, "matrix_sha256": hashlib.sha256(path.read_bytes()).hexdigest()} | workflow.described(cfg)
    side = Path(tmp_path / "matrix_summary.yaml")
    assert workflow.load_matrix(spark, cfg).count() == 2  # without a summary
    side.write_text(yaml.safe_dump(good))
    assert workflow.load_matrix(spark, cfg).count() == 2
    for key in good:
        for wrong in ({k: v for k, v in good.items() if k != key}, good | {key: "other"}):
            side.write_text(yaml.safe_dump(wrong))
            with pytest.raises(MatrixError):
                workflow.load_matrix(spark, cfg)
    side.write_text("")
    with pytest.raises(MatrixError):
        workflow.load_matrix(spark, cfg)


def test_digest_of_rows(spark, tmp_path):
    """The same for any number of files and any order, another for another row."""
    df = spark.range(1000).select("id", (F.col("id") * 0.1).alias("v"))
    for name, out in (("one", df.coalesce(1)), ("many", df.repartition(7, "v")), ("other", df.withColumn("v", F.when(F.col("id") == 5, 9.0).otherwise(F.col("v"))))):
        out.write.parquet(str(tmp_path / name))
    found = {name: workflow.digest(spark, tmp_path / name) for name in ("one", "many", "other")}
    assert found["one"] == found["many"] != found["other"] and len(found["one"]) == 64


def test_spans_cross_the_seam_of_periodic_grids_only(spark):
    rows = [(i, 1, 1, x, 0.0, 0.5, 1.0, 90.0, 1.0, 5, False, False) for i, x in enumerate((-170.0, -60.0, 60.0, 170.0))]
    cells = spark.createDataFrame(rows, "cell_id long, component long, component_number long, x double, y double, P_move double, R1_out double, theta1_out double, D_out_all_magnitude double, N_out_move long, endpoint boolean, junction boolean")
    edges = spark.createDataFrame([(0, 1, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "a long, b long, edge_length double, direction_difference double, mismatch_a double, mismatch_b double, largest_mismatch double, compatibility double")
    span = lambda periodic: directional.component_statistics(cells, edges, Space(True, "km"), periodic).first().x_span
    assert span(False) == 340.0 and span(True) == span(None) == 240.0
    assert str(flux.cell_summaries(False)[1]) != str(flux.cell_summaries(True)[1])
