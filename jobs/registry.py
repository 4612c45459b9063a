"""The jobs as queries: each runs its job twice into a new folder and returns what then stands there; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drift_engine import storage
from drift_engine.plans.oracles import POINTS, TRACKS, _links
from jobs import conversation_flow, markov_check
from jobs.common import config


def _twice(job, spark: SparkSession, source: str) -> DataFrame:
    target = f"{storage.shared_dir(spark)}/{job.NAME}-{uuid.uuid4().hex}"
    settings = config(job.NAME)
    job.run(spark, source, target, settings)
    return job.run(spark, source, target, settings)


def job1_conversation_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _twice(conversation_flow, spark, f"{sf_dir}/conversations*.parquet")
    return out.withColumn("transition_probability", F.round("transition_probability", 6))


def job2_markov_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _twice(markov_check, spark, f"{sf_dir}/events.parquet")
    return out.withColumns({c: F.round(c, 6) for c in ("lost", "distance")})


QUERIES = {f.__name__: f for f in (job1_conversation_flow, job2_markov_check)}

_POINTS = POINTS.removeprefix(TRACKS + ", ")


def _matrix(lag: float) -> str:
    return f"m{int(lag)} AS (WITH {_POINTS.replace('86400.0', repr(float(lag)))}, {_links()} SELECT start_x_bin AS sx, start_y_bin AS sy, end_x_bin AS ex, end_y_bin AS ey, n, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY sid) AS p FROM links)"


def _compared(lag: float) -> str:
    one, two = f"m{int(lag)}", f"m{int(2 * lag)}"
    square = f"(SELECT a.sx, a.sy, b.ex, b.ey, sum(a.p * b.p) AS p FROM {one} a JOIN {one} b ON b.sx = a.ex AND b.sy = a.ey GROUP BY ALL)"
    return f"""SELECT {int(lag)}::BIGINT AS lag, s.sx AS start_x_bin, s.sy AS start_y_bin, s.n::BIGINT AS support, t.n::BIGINT AS support_twice, round(greatest(0, 1 - c.mass), 6) AS lost, round(c.apart + greatest(0, 1 - c.mass) / 2, 6) AS distance
FROM (SELECT sx, sy, sum(n) AS n FROM {one} GROUP BY ALL) s JOIN (SELECT sx, sy, sum(n) AS n FROM {two} GROUP BY ALL) t USING (sx, sy)
JOIN (SELECT sx, sy, sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) / 2 AS apart, coalesce(sum(a.p), 0) AS mass FROM {square} a FULL JOIN {two} b USING (sx, sy, ex, ey) GROUP BY ALL) c USING (sx, sy)"""


_LAGS = config(markov_check.NAME)["lags"]

ORACLES = {
    "job1_conversation_flow": """WITH o AS (SELECT conv_id, turn, min(struct_pack(x := length(text)::DOUBLE, y := len(string_split(text, chr(10)))::DOUBLE)) AS at FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL GROUP BY conv_id, turn),
s AS (SELECT a.at.x AS sx, a.at.y AS sy, b.at.x AS ex, b.at.y AS ey FROM o a JOIN o b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
l AS (SELECT floor(sx / 100)::BIGINT AS start_x_bin, floor(sy / 2)::BIGINT AS start_y_bin, floor(ex / 100)::BIGINT AS end_x_bin, floor(ey / 2)::BIGINT AS end_y_bin, count(*) AS transition_count FROM s
WHERE greatest(sx, ex) < 2000 AND greatest(sy, ey) < 20 GROUP BY ALL)
SELECT *, round(transition_count / sum(transition_count) OVER (PARTITION BY start_x_bin, start_y_bin), 6) AS transition_probability FROM l""",
    "job2_markov_check": f"WITH {TRACKS}, " + ", ".join(_matrix(lag) for lag in sorted({x * n for x in _LAGS for n in (1, 2)})) + " " + " UNION ALL ".join(_compared(x) for x in _LAGS),
}
