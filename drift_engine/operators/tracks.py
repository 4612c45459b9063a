"""Observations to canonical tracks: identities, validity, order, duplicates, elapsed time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drift_engine.functions.angles import number
from drift_engine.operators.parts import Crowds, small, track_ids as _ids

SECONDS = {"s": 1.0, "min": 60.0, "h": 3600.0, "day": 86400.0}


def identity(c: str) -> Column:
    """The column as text, blank as NULL."""
    text = F.col(c).cast("string")
    return F.when(F.trim(text) != "", text)


def path_identity(path: Column, inner: Column | None = None) -> Column:
    """JSON text of a file's path, and of an identity within it: ["path", "id"]."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    if inner is None:
        return F.concat(F.lit("["), quoted(path), F.lit("]"))
    return F.concat(F.lit("["), quoted(path), F.lit(", "), quoted(inner), F.lit("]"))


def seconds(time: Column, kind: str, unit: str = "s") -> Column:
    """Seconds of a time column: datetimes count from 1970 UTC, numbers are scaled by their unit."""
    if kind == "datetime":
        return F.unix_micros(time.try_cast("timestamp")).cast("double") / 1e6
    return number(time) * F.lit(SECONDS[unit])


def with_validity(raw: DataFrame, geographic: bool = False) -> DataFrame:
    """raw (trajectory, time, x, y as doubles, optional group_member) with `valid`."""
    ok = F.col("trajectory").isNotNull() & F.col("time").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    if geographic:
        ok &= F.coalesce(F.col("y").between(-90, 90), F.lit(False))
    if "group_member" in raw.columns:
        ok &= F.col("group_member").isNotNull()
    return raw.withColumn("valid", ok)


def _canonical(raw: DataFrame, geographic: bool, order: list[str], crowds: Crowds | None = None) -> DataFrame:
    """Valid rows with their place among those of the same identity and time, and the first and the last time of the track: two observations are left where these differ.

    The track's window comes first, as its shuffle serves both. The tracks of `crowds` have their times from a table of partial sums, not from a window.
    """
    ids = _ids(raw)
    rows = with_validity(raw, geographic).filter("valid")
    rank = [F.col(c).asc_nulls_last() for c in order if c in raw.columns] or [F.lit(0)]
    ends = {"_first": F.min("time"), "_end": F.max("time")}
    numbered = lambda rows: rows.withColumn("_same", F.row_number().over(Window.partitionBy(*ids, "time").orderBy(*rank)))
    if crowds:
        long, rows = crowds.split(rows)
        parted = numbered(long).join(small(long.groupBy(*ids).agg(*[c.alias(n) for n, c in ends.items()]), crowds.tracks), ids)
    found = numbered(rows.select("*", *[c.over(Window.partitionBy(*ids)).alias(n) for n, c in ends.items()]))
    return found.unionByName(parted) if crowds else found


def sanitise(raw: DataFrame, geographic: bool = False, order: tuple[str, ...] = ("obs", "file_rank", "row_index"), crowds: Crowds | None = None) -> DataFrame:
    """Canonical tracks: first of equal times, tracks of two observations at least, time from the track's first one on.

    order: the columns that tell which of equal times came first; those that raw has.
    crowds: the tracks of raw that are too long for one task.
    """
    rows = _canonical(raw, geographic, list(order), crowds).filter("_same = 1 and _first < _end")
    return rows.withColumn("time", F.col("time") - F.col("_first")).select(*_ids(raw), "time", "x", "y")


def diagnostics(raw: DataFrame, geographic: bool = False, order: tuple[str, ...] = ("obs", "file_rank", "row_index"), crowds: Crowds | None = None) -> DataFrame:
    """One row of counters of what sanitise() reads, drops and keeps."""
    ids = F.struct(*_ids(raw))
    known = F.when(F.col("trajectory").isNotNull(), ids)
    flagged = with_validity(raw, geographic)
    read = flagged.agg(F.count("*").alias("source_observations"), F.count_if(~F.col("valid")).alias("invalid_observations"), F.count_distinct(known).alias("source_trajectories"))
    rows = _canonical(raw, geographic, list(order), crowds)
    lone = F.col("_first") == F.col("_end")
    kept = rows.agg(
        F.count_if(F.col("_same") > 1).alias("duplicate_observations"),
        F.count_if((F.col("_same") == 1) & lone).alias("short_observations"),
        F.count_if((F.col("_same") == 1) & ~lone).alias("retained_observations"),
        F.count_distinct(F.when(lone, ids)).alias("short_trajectories"),
        F.count_distinct(F.when(~lone, ids)).alias("retained_trajectories"),
    )
    empty = F.col("source_trajectories") - F.col("short_trajectories") - F.col("retained_trajectories")
    return read.crossJoin(kept).withColumn("discarded_empty_trajectories", empty)
