"""Keeps a transition matrix up to date from files of observations that keep arriving.

By its config a conversation is a track in the plane of a turn's length and its lines, and
the matrix says from which kind of turn conversations go to which; any table whose rows
have a track, a time and two positions will do.

    python -m jobs.conversation_flow --source PATH --target PATH [--config FILE]

Each run takes the files that the checkpoint has not seen, in micro-batches, and leaves
under the target

    observations/batch=N/bucket=B   the batch's usable observations, first of equal times
    open/slot=S                     observations whose target time is still to come, after batch N (S: N mod 2)
    links/batch=N                   what the batch adds to (or takes from) each link's count
    report/batch=N                  what was read, left out and counted
    matrix/start_y_bin=Y            the matrix as it stands

A batch that is run again, after a failure, writes the same places again. An observation
earlier than its track's last one reopens the track: the track's history is read from the
buckets concerned, its old segments are taken off and its new ones put on. So the matrix is
that of all observations, however they were dealt over files and runs; only between
observations of one track and time does order decide (the first batch wins, within a batch
the smallest position).
"""

from __future__ import annotations

import argparse
import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drift_engine import session, storage
from drift_engine.operators import matrix, tracks
from drift_engine.streaming import incremental
from jobs.common import config, grid, say

NAME = "conversation_flow"
OBSERVED = "trajectory string, time double, x double, y double"
LINKS = ", ".join(f"{c} long" for c in (*matrix.LINK_KEYS, "transition_count"))
COUNTS = ("rows", "invalid", "repeated", "late", "retained", "rejected_gap", "rejected_outside", "open")


def observations(rows: DataFrame, settings: dict) -> DataFrame:
    """(trajectory, time, x, y, valid) by the config's expressions; infinite values and NaN are not valid."""
    given = rows.select(*[F.expr(settings[k]).alias(n) for k, n in (("track", "trajectory"), ("time", "time"), ("x", "x"), ("y", "y"))])
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c))
    return tracks.with_validity(given.select(tracks.identity("trajectory").alias("trajectory"), *[finite(c).alias(c) for c in ("time", "x", "y")]))


def segments_of(tracked: DataFrame, settings: dict) -> DataFrame:
    return matrix.segments(tracked, float(settings["lag"]), "every_observation", False, settings["max_gap"])


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or none of its rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _take(batch: DataFrame, number: int, target: str, settings: dict) -> None:
    """One micro-batch: everything it writes stands under its own number."""
    spark, since, cells = batch.sparkSession, storage.mark(batch.sparkSession), grid(settings)
    here = lambda table: f"{target}/{table}/batch={number}"

    given = storage.materialise(observations(batch, settings), "given")
    firsts = given.filter("valid").groupBy("trajectory", "time").agg(F.min(F.struct("x", "y")).alias("at"), F.count("*").alias("copies"))
    left = spark.read.parquet(f"{target}/open/slot={(number - 1) % 2}") if number else spark.createDataFrame([], f"{OBSERVED}, batch long")
    if wrong := left.filter(F.col("batch") != number - 1).limit(1).collect():
        raise RuntimeError(f"the target's open observations are of batch {wrong[0]['batch']}, the checkpoint is at {number}; use both of one job")
    upto = left.groupBy("trajectory").agg(F.max("time").alias("upto"))
    bucket = F.pmod(F.xxhash64("trajectory"), F.lit(settings["buckets"])).cast("int")
    new = firsts.join(upto, "trajectory", "left").select("trajectory", "time", "at.x", "at.y", "copies", F.coalesce(F.col("time") <= F.col("upto"), F.lit(False)).alias("late"), bucket.alias("bucket"))
    new = storage.materialise(new, "new")

    # Tracks with an observation before their last one are worked out anew, with and without this batch.
    late = new.filter("late").select("trajectory", "bucket").distinct()
    touched = [r["bucket"] for r in late.select("bucket").distinct().collect()]
    known = spark.createDataFrame([], OBSERVED)
    if touched:
        stored = spark.read.schema(f"{OBSERVED}, batch int, bucket int").parquet(f"{target}/observations")
        known = stored.filter((F.col("batch") < number) & F.col("bucket").isin(touched)).join(late.select("trajectory"), "trajectory", "left_semi").select("trajectory", "time", "x", "y")
        known = storage.materialise(known, "known")
    again = new.join(known.select("trajectory", "time", F.lit(True).alias("seen")), ["trajectory", "time"], "left").filter("seen is null").drop("seen")
    again.drop("copies", "late").write.mode("overwrite").partitionBy("bucket").parquet(here("observations"))
    fresh = _read(spark, here("observations"), f"{OBSERVED}, bucket int").drop("bucket")

    # The open observations of a reopened track are among the known ones.
    work = left.drop("batch").join(late.select("trajectory"), "trajectory", "left_anti").unionByName(known).unionByName(fresh)
    work = work.withColumn("k", F.row_number().over(Window.partitionBy("trajectory").orderBy("time")).cast("long") - 1)
    work = storage.materialise(work, "work")
    found = storage.materialise(segments_of(work.drop("k"), settings), "segments")
    before = storage.materialise(segments_of(known, settings), "before")

    counted = incremental.link_counts(found, cells).unionByName(incremental.link_counts(before, cells).withColumn("transition_count", -F.col("transition_count")))
    counted.groupBy(*matrix.LINK_KEYS).agg(F.sum("transition_count").alias("transition_count")).filter("transition_count <> 0").write.mode("overwrite").parquet(here("links"))
    ends = found.select("trajectory", "k", F.col("end.status").alias("status"))
    still = work.join(ends, ["trajectory", "k"], "left").filter("status is null or status = 'missing'")
    still.select("trajectory", "time", "x", "y", F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{target}/open/slot={number % 2}")

    fate = lambda segs: segs.transform(matrix.with_fate, cells).agg(*[F.count_if(F.col("fate") == f).alias(f) for f in ("retained", "gap", "outside")]).first()
    plus, minus = fate(found), fate(before)
    read = given.agg(F.count("*").alias("rows"), F.count_if(~F.col("valid")).alias("invalid")).first()
    taken = new.agg(F.count_if("late").alias("late")).first()["late"]
    kept = fresh.count()
    row = (read["rows"], read["invalid"], read["rows"] - read["invalid"] - kept, taken, *(plus[f] - minus[f] for f in ("retained", "gap", "outside")), spark.read.parquet(f"{target}/open/slot={number % 2}").count())
    spark.createDataFrame([row], ", ".join(f"{c} long" for c in COUNTS)).coalesce(1).write.mode("overwrite").parquet(here("report"))
    say(NAME, f"batch {number}", **dict(zip(COUNTS, row)))
    storage.release(spark, since)


def run(spark: SparkSession, source: str, target: str, settings: dict) -> DataFrame:
    """Takes what is new in source (a folder, or a pattern of files), and returns the matrix as it then stands."""
    target = target.rstrip("/")
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", settings["max_files"]).parquet(source)
    started = stream.writeStream.foreachBatch(lambda batch, number: _take(batch, number, target, settings)).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    done = [p for p in started.recentProgress if p.numInputRows]
    say(NAME, f"read {source}", batches=len(done), rows=sum(p.numInputRows for p in done))
    links = _read(spark, f"{target}/links", f"{LINKS}, batch int")
    counts = links.groupBy(*matrix.LINK_KEYS).agg(F.sum("transition_count").alias("transition_count")).filter("transition_count > 0")
    incremental.probabilities(counts).write.mode("overwrite").partitionBy("start_y_bin").parquet(f"{target}/matrix")
    out = spark.read.schema(f"{LINKS}, transition_probability double").parquet(f"{target}/matrix")
    say(NAME, f"wrote {target}/matrix", links=out.count())
    return out


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--source", required=True)
    parser.add_argument("--target", required=True)
    parser.add_argument("--config")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName(NAME).getOrCreate()
    session.ship_package(spark)
    run(spark, args.source, args.target, config(NAME, args.config))
    spark.stop()


if __name__ == "__main__":
    main()
