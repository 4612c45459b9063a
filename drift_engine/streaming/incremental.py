"""An extension beyond the batch engine: transition counts kept up to date from a stream of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drift_engine.functions.geodesy import Grid
from drift_engine.operators.matrix import LINK_KEYS, with_fate

SEGMENT_SCHEMA = "trajectory string, k long, start struct<status:string,x:double,y:double>, end struct<status:string,x:double,y:double>"


def link_counts(segments: DataFrame, grid: Grid) -> DataFrame:
    """Counts by link of a segment table or stream; the state of a stream has one row a link, as many as the matrix."""
    kept = with_fate(segments, grid).filter("fate = 'retained'")
    bins = [(grid.x_bin if a == "x" else grid.y_bin)(F.col(f"{e}.{a}")).alias(f"{e}_{a}_bin") for e in ("start", "end") for a in "xy"]
    return kept.select(*bins).groupBy(*LINK_KEYS).agg(F.count("*").alias("transition_count"))


def probabilities(counts: DataFrame) -> DataFrame:
    """The stored counts with each source's probabilities."""
    total = F.sum("transition_count").over(Window.partitionBy("start_y_bin", "start_x_bin"))
    return counts.withColumn("transition_probability", F.col("transition_count") / total)


def start(segments: DataFrame, grid: Grid, table: str, checkpoint: str):
    """A query that keeps the in-memory table of counts complete after each micro-batch; for a file or table sink use foreachBatch in its place."""
    return link_counts(segments, grid).writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).start()
