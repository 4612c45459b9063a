"""Readers of what maps are overlaid with: gridded fields, core cells and named polylines, as tables in longitude and latitude."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drift_engine.functions.angles import number
from drift_engine.sources import array_source
from drift_engine.sources.arrays import array_variables, format_of


def wrapped(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def on_map(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """points with finite positions, longitudes in [-180, 180)."""
    rows = points.withColumn(lon, wrapped(number(lon))).withColumn(lat, number(lat))
    return rows.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())


def gridded_field(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(lat, lon, value) of a field on (lat, lon) of a NetCDF or Zarr file, read part by part. Other dimensions, or a field that is not there, raise."""
    kind = format_of(path)
    variables = array_variables(path, kind)
    if field not in variables:
        raise ValueError(f"{path}: no field {field}; there are {sorted(variables)}")
    if set(variables[field].dims) != {"lat", "lon"}:
        raise ValueError(f"{field}: dimensions lat and lon expected, not {variables[field].dims}")
    rows = array_source.load(spark, path, ["lat", "lon", field], field, field, kind)
    return rows.select("lat", "lon", number(F.col(f"`{field}`")).alias("value"))


def core_points(spark: SparkSession, path: str) -> DataFrame:
    """The core cells of a geographic run's table, on the map."""
    cores = spark.read.parquet(path)
    if lacking := sorted({"lon", "lat", "component_id"} - set(cores.columns)):
        raise ValueError(f"{path}: missing columns {lacking}")
    return on_map(cores)


def polylines(spark: SparkSession, path: str, names: dict[str, tuple[str, str]]) -> DataFrame:
    """(line, place, lon, lat) of the named lines, each two variables of a NetCDF or Zarr file; points without a position are left out."""
    variables = array_variables(path, format_of(path))
    frames = []
    for line, (x, y) in names.items():
        if x not in variables or y not in variables:
            raise ValueError(f"{path}: no {x} or no {y}")
        lon, lat = (np.asarray(variables[v].read(0, variables[v].shape[0]), float) for v in (x, y))
        frames.append(pd.DataFrame({"line": line, "place": np.arange(len(lon)), "lon": lon, "lat": lat}))
    rows = spark.createDataFrame(pd.concat(frames), "line string, place long, lon double, lat double")
    return on_map(rows)
