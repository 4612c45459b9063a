"""The tank: an 11 x 11 jet whose products are known."""

import pytest
from pyspark.sql import functions as F

from drift_engine.functions import geodesy
from drift_engine.functions.geodesy import Grid, Space
from drift_engine.operators import cellstats, compare, directional, flux, gradients, gridops, ridge, sections, validate

from drift_engine.storage import materialise as stored

PROFILE = [0.05, 0.10, 0.20, 0.40, 0.65, 0.90, 0.65, 0.40, 0.20, 0.10, 0.05]
GRID = Grid(0.0, 11.0, 0.0, 11.0, 1.0, 1.0)
CFG = sections.SectionConfig()


def tank(spark):
    rows = []
    for y, share in enumerate(PROFILE):
        n = round(100 * share)
        for x in range(11):
            to = x + 1 if x < 10 else x - 1
            for end, count in ((x, 100 - n), (to, n)):
                rows.append((x, y, end, y, x + 0.5, y + 0.5, end + 0.5, y + 0.5, count, count / 100))
    return spark.createDataFrame(rows, "start_x_bin long, start_y_bin long, end_x_bin long, end_y_bin long, start_x_center double, start_y_center double, end_x_center double, end_y_center double, transition_count long, transition_probability double")


@pytest.fixture(scope="module")
def cartesian(spark):
    table = tank(spark)
    validate.validate(table, GRID)
    space = Space(unit="cm")
    return stored(cellstats.cell_statistics(cellstats.enriched_links(table, GRID, space), GRID, 1.0)), GRID, space


@pytest.fixture(scope="module")
def geographic(spark):
    space = Space(True, "km")
    return stored(cellstats.cell_statistics(cellstats.enriched_links(tank(spark), GRID, space), GRID, 1.0)), GRID, space


def counted(df, c):
    return {r[c]: r["count"] for r in df.groupBy(c).count().collect()}


@pytest.mark.parametrize("system", ["cartesian", "geographic"])
def test_tank(system, request):
    cells, grid, space = request.getfixturevalue(system)
    geo = system == "geographic"
    level = ridge.threshold(cells, "U_out_all_magnitude_rate", 0.9).first()[0]
    assert level == pytest.approx(72.13609519418833 if geo else 0.65, rel=1e-9)
    found = directional.candidates(cells, grid, space, 1)
    assert found.count() == 33
    assert found.select("component").distinct().count() == 4
    raw = counted(directional.raw_ridges(cells, found.drop("component", "component_number"), grid, space, 1), "ridge_type")
    assert (raw.get("two_sided", 0), raw.get("one_sided", 0)) == ((9, 4) if geo else (11, 0))
    cores = directional.cores(cells, grid, space, 1).cache()
    assert cores.count() == (11 if geo else 10)
    assert cores.select("component").distinct().count() == 1
    rows = directional.directional_sections(cores, cells, grid, space, 1, CFG)
    status = counted(directional.directional_fronts(cores, rows, CFG), "front_status")
    assert status["probable_directional_front"] == 20
    assert status.get("side_not_observable", 0) == (2 if geo else 0)
    flux_cores = flux.cores(cells, grid, space, 1).cache()
    assert flux_cores.count() == (13 if geo else 11)
    classes = counted(compare.comparison(cells, flux_cores, cores, 1), "class")
    assert classes == ({"flux_and_directional": 11, "flux_only": 2, "neither": 108} if geo else {"flux_and_directional": 10, "flux_only": 1, "neither": 110})
    supported = cells.filter("N_out_move >= 1")
    members = stored(flux.oriented_segments(flux_cores, grid, space))
    rows = flux.flux_sections(flux_cores, supported, grid, space, CFG, members)
    zones = stored(sections.zones(rows, sections.FLUX, CFG))
    assert zones.filter("rank = 1").count() == (30 if geo else 22)
    fronts = sections.fronts(flux_cores, zones, sections.FLUX)
    assert fronts.filter("front_detected").count() == 22
    summaries = stored(sections.section_summaries(rows, sections.FLUX, CFG, 1))
    sides = stored(sections.side_results(rows, zones, sections.FLUX, CFG))
    assert sides.filter("observable").count() == zones.select("section", "side").distinct().count()
    assert counted(sides, "status")["candidate_drop"] == (30 if geo else 22)
    unique = gradients.cell_sides(gradients.segment_comparison(sections.flank_points(zones, sides, summaries), stored(gradients.fields(cells, grid, space)), grid, space))
    assert unique.count() == 22


def test_gradient_methods(cartesian):
    cells, grid, space = cartesian
    out = gridops.along_across(gridops.gradient(cells, "U_out_all_magnitude_rate", grid, space), "theta_mu_out")
    for axis in ("east", "north"):
        assert counted(out, f"gradient_{axis}_method") == {"centred": 99, "one_sided": 22}
    q = out.agg(*[F.percentile(F.abs("gradient_across"), F.lit(p)) for p in (0.5, 0.75, 0.9, 0.95)]).first()
    assert list(q) == pytest.approx([0.15, 0.225, 0.25, 0.25])


def test_scale():
    assert (geodesy.inverse(0.0, 5.0, 0.0, 6.0)[2] * geodesy.inverse(-0.5, 5.5, 0.5, 5.5)[2]) ** 0.5 / 1000 == pytest.approx(110.69739071131, rel=1e-9)


def test_near_cells_leave_none_out(spark):
    """Boxes and circles by bins against all pairs, towards the pole and over the seam."""
    space, grid = Space(True, "km"), Grid(-180.0, 180.0, -88.0, -60.0, 4.0, 2.0, True)
    cells = stored(spark.range(grid.nx * grid.ny).selectExpr("id as cell_id", f"id % {grid.nx} as x_bin", f"id div {grid.nx} as y_bin"))
    cells = stored(cells.select("*", grid.x_center(F.col("x_bin")).alias("x"), grid.y_center(F.col("y_bin")).alias("y")))
    points = cells.filter("cell_id % 37 = 5").select("cell_id", F.col("x").alias("px"), F.col("y").alias("py"))
    reach = 600.0
    other = cells.select(F.col("cell_id").alias("near_id"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    measured = lambda df: df.withColumn("_d", space.inverse(F.col("px"), F.col("py"), F.col("_x"), F.col("_y"))["distance"]).filter(F.col("_d") <= reach).select("cell_id", "near_id")
    got = measured(gridops.near_cells(points, F.lit(reach), grid, space).join(other, "near_id"))
    want = measured(points.crossJoin(other))
    assert got.count() == got.distinct().count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_contamination_near_the_pole(spark):
    space, grid = Space(True, "km"), Grid(-180.0, 180.0, -80.0, -30.0, 1.0, 1.0, True)
    rng = [(c, c * 7919 % 360, (c * 104729 % 50), c % 4 + 1, (c * 37) % 360 * 1.0) for c in range(700)]
    rows = spark.createDataFrame([(y * 360 + x, x, y, -179.5 + x, -79.5 + y, n, t) for _, x, y, n, t in rng], "cell_id long, x_bin long, y_bin long, x double, y double, component_number long, theta double").dropDuplicates(["cell_id"]).withColumn("section", F.col("cell_id"))
    rows = stored(rows)
    got = {r.section for r in sections.contaminated(rows, rows, "theta", grid, space, CFG).collect()}
    other = rows.select(F.col("component_number").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    pairs = geodesy.with_scales(rows, grid, space).crossJoin(other).filter("o <> component_number").withColumn("g", space.inverse(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")))
    angle = F.radians(F.col("g.bearing") - F.col("theta"))
    inside = (F.abs(F.col("g.distance") * F.cos(angle)) <= F.col("scale")) & (F.abs(F.col("g.distance") * F.sin(angle)) <= 5 * F.col("scale"))
    want = {r.section for r in pairs.filter(inside).select("section").distinct().collect()}
    assert got == want and any(r.y < -75 for r in rows.filter(F.col("section").isin(list(want))).collect())
