from drift_engine.functions.geodesy import Grid
from drift_engine.operators import matrix
from drift_engine.streaming import incremental

GRID = Grid(0, 8, 0, 8, 1, 1)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"t{i}", float(t), 0.5 + (i + t) % 8, 0.5 + i % 8) for i in range(12) for t in range(6)]
    segs = matrix.segments(spark.createDataFrame(rows, "trajectory string, time double, x double, y double"), 1.0)
    for part in (0, 1):
        segs.filter(f"pmod(hash(trajectory), 2) = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(incremental.SEGMENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.start(stream, GRID, "live_counts", str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    got = incremental.probabilities(spark.table("live_counts")).select(*matrix.LINK_KEYS, "transition_count", "transition_probability")
    want = matrix.transition_matrix(segs, GRID).select(*matrix.LINK_KEYS, "transition_count", "transition_probability")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
