"""Finds out at which lag a transition matrix may be taken as one step of a Markov chain.

A matrix of lag T should, applied twice, give that of lag 2 T. For every lag of the config
the job makes the matrix of T, its square and the matrix of 2 T, and compares both row by
row: half the sum of absolute differences is the probability that they put elsewhere, 0 if
they agree and 1 if they have no cell in common.

    python -m jobs.markov_check --source PATH --target PATH [--config FILE]

It leaves under the target, each partitioned by lag (whole seconds) and replaced lag by lag
when run again,

    links/lag=T        the matrix of every lag that occurs, singly or doubled
    cells/lag=T        per start cell: support at T and 2 T, mass that leaves the matrix, distance
    summary/lag=T      one row: cells compared, mean and greatest distance, by support too
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drift_engine import session, storage
from drift_engine.operators import matrix, tracks
from jobs.common import config, grid, say

NAME = "markov_check"
CELLS = "lag long, start_x_bin long, start_y_bin long, support long, support_twice long, lost double, distance double"
LINKS = "lag long, start_x_bin long, start_y_bin long, end_x_bin long, end_y_bin long, transition_count long, transition_probability double"
SUMMARY = "lag long, cells long, mean_distance double, supported_cells long, mean_supported_distance double, greatest_supported_distance double"
START, END = ["start_y_bin", "start_x_bin"], ["end_y_bin", "end_x_bin"]


def squared(links: DataFrame) -> DataFrame:
    """(start, end, p) of two steps, each with the probabilities of links; a step from a cell that no link starts from is lost."""
    first = links.select(*START, F.col("end_y_bin").alias("mid_y"), F.col("end_x_bin").alias("mid_x"), F.col("transition_probability").alias("p"))
    second = links.select(F.col("start_y_bin").alias("mid_y"), F.col("start_x_bin").alias("mid_x"), *END, F.col("transition_probability").alias("q"))
    return first.join(second, ["mid_y", "mid_x"]).groupBy(*START, *END).agg(F.sum(F.col("p") * F.col("q")).alias("p"))


def distances(once: DataFrame, twice: DataFrame) -> DataFrame:
    """Per cell from which both matrices have links: supports, the square's lost mass, and the distance of its row from that of twice."""
    rows = squared(once).select(*START, *END, F.col("p"), F.lit(0.0).alias("q"))
    rows = rows.unionByName(twice.select(*START, *END, F.lit(0.0).alias("p"), F.col("transition_probability").alias("q")))
    apart = rows.groupBy(*START, *END).agg(F.sum("p").alias("p"), F.sum("q").alias("q")).groupBy(*START)
    apart = apart.agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("apart"), F.sum("p").alias("mass"))
    support = lambda links, name: links.groupBy(*START).agg(F.sum("transition_count").alias(name))
    both = support(once, "support").join(support(twice, "support_twice"), START).join(apart, START)
    lost = F.greatest(F.lit(0.0), 1 - F.col("mass"))
    # Mass that the square lost is somewhere else than twice has it: half of it is not yet in the sum.
    return both.select(*START, "support", "support_twice", lost.alias("lost"), (F.col("apart") + lost / 2).alias("distance"))


def run(spark: SparkSession, source: str, target: str, settings: dict) -> DataFrame:
    """Writes the three tables and returns that of the cells."""
    target, since, cells = target.rstrip("/"), storage.mark(spark), grid(settings)
    rows = spark.read.parquet(source)
    given = rows.select(F.expr(settings["track"]).alias("trajectory"), *[F.expr(settings[c]).alias(c) for c in ("time", "x", "y")])
    given = given.withColumn("trajectory", tracks.identity("trajectory"))
    tracked = storage.materialise(tracks.sanitise(given), "tracks")
    say(NAME, f"read {source}", observations=tracked.count())

    def write(df: DataFrame, table: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lag").parquet(f"{target}/{table}")

    lags = sorted({lag * n for lag in map(float, settings["lags"]) for n in (1, 2)})
    if any(lag != int(lag) or lag <= 0 for lag in lags):
        raise ValueError("lags are whole seconds above 0")
    for lag in lags:
        links = matrix.transition_matrix(matrix.segments(tracked, lag, settings["mode"], False, settings["max_gap"]), cells)
        write(links.withColumn("lag", F.lit(int(lag))), "links")
    stored = spark.read.schema(LINKS).parquet(f"{target}/links")
    of = lambda lag: stored.filter(F.col("lag") == int(lag)).drop("lag")
    for lag in sorted(set(map(float, settings["lags"]))):
        write(distances(of(lag), of(2 * lag)).withColumn("lag", F.lit(int(lag))), "cells")
    out = spark.read.schema(CELLS).parquet(f"{target}/cells").filter(F.col("lag").isin([int(x) for x in settings["lags"]]))
    known = F.least("support", "support_twice") >= settings["min_support"]
    weighted = lambda c: F.sum(F.col(c) * F.col("support_twice")) / F.sum("support_twice")
    summary = out.groupBy("lag").agg(
        F.count("*").alias("cells"),
        weighted("distance").alias("mean_distance"),
        F.count_if(known).alias("supported_cells"),
        F.avg(F.when(known, F.col("distance"))).alias("mean_supported_distance"),
        F.max(F.when(known, F.col("distance"))).alias("greatest_supported_distance"),
    )
    write(summary, "summary")
    for r in spark.read.schema(SUMMARY).parquet(f"{target}/summary").orderBy("lag").collect():
        say(NAME, f"wrote {target}", **r.asDict())
    storage.release(spark, since)
    return out


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--source", required=True)
    parser.add_argument("--target", required=True)
    parser.add_argument("--config")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName(NAME).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.ship_package(spark)
    run(spark, args.source, args.target, config(NAME, args.config))
    spark.stop()


if __name__ == "__main__":
    main()
