"""The jobs on copies that grow, arrive out of order, are run again after a failure, and hold odd rows; against whole runs and plain counts."""

import json
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from drift_engine.operators import matrix
from drift_engine.streaming import incremental
from jobs import conversation_flow, markov_check
from jobs.common import config, grid

SF = "/root/testdata/sf0.001"
DDL = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def turns(spark):
    return spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()


def put(spark, rows, folder):
    spark.createDataFrame([tuple(r) for r in rows], DDL).coalesce(1).write.mode("append").parquet(str(folder))


def plain(rows, settings):
    """Link counts of all rows by the definition: of equal times the smallest position, and pairs one turn apart."""
    g, at = settings["grid"], {}
    for conv, turn, _, text in rows:
        if conv is not None and turn is not None and text is not None:
            place = (float(len(text)), float(text.count("\n") + 1))
            at[conv, turn] = min(at.get((conv, turn), place), place)
    found = Counter()
    for (conv, turn), (x, y) in at.items():
        if (conv, turn + 1) in at:
            ex, ey = at[conv, turn + 1]
            if max(x, ex) < g["x_max"] and max(y, ey) < g["y_max"]:
                found[int(y // g["y_step"]), int(x // g["x_step"]), int(ey // g["y_step"]), int(ex // g["x_step"])] += 1
    return found


def counts(out):
    return Counter({tuple(r[k] for k in matrix.LINK_KEYS): r["transition_count"] for r in out.collect()})


def everything(out):
    return sorted(map(tuple, out.select(sorted(out.columns)).collect()))


def total(spark, target, column):
    return spark.read.parquet(f"{target}/report").agg({column: "sum"}).first()[0]


def test_two_runs_over_growing_input(spark, turns, tmp_path):
    settings, source, target = config("conversation_flow"), tmp_path / "in", str(tmp_path / "out")
    early, rest = [r for r in turns if r["turn"] < 2], [r for r in turns if r["turn"] >= 2]
    put(spark, early, source)
    assert counts(conversation_flow.run(spark, str(source), target, settings)) == plain(early, settings)
    put(spark, rest, source)
    out = conversation_flow.run(spark, str(source), target, settings)
    assert counts(out) == plain(turns, settings)
    got, columns = everything(out), out.columns
    # The second run has read the second file only.
    assert [r["rows"] for r in spark.read.parquet(f"{target}/report").orderBy("batch").collect()] == [len(early), len(rest)]
    assert total(spark, target, "late") == 0
    once = conversation_flow.run(spark, str(source), str(tmp_path / "once"), settings)
    assert got == everything(once)
    # Nothing new: nothing changes, and no batch is made.
    assert everything(conversation_flow.run(spark, str(source), target, settings)) == everything(once)
    assert spark.read.parquet(f"{target}/report").count() == 2
    # The library's batch matrix over the same observations.
    tracked = conversation_flow.observations(spark.createDataFrame(turns, DDL), settings).filter("valid").drop("valid")
    batch = matrix.transition_matrix(conversation_flow.segments_of(tracked, settings), grid(settings))
    assert everything(batch.select(columns)) == got


def test_any_order_of_arrival(spark, turns, tmp_path):
    """Files of scattered turns, one a batch: tracks are reopened, and repeated observations count once."""
    settings, source, target = config("conversation_flow") | {"max_files": 1, "buckets": 3}, tmp_path / "in", str(tmp_path / "out")
    for part in (2, 0, 1):
        put(spark, [r for i, r in enumerate(turns) if i * 7 % 3 == part], source)
    put(spark, turns[:5], source)
    out = conversation_flow.run(spark, str(source), target, settings)
    assert counts(out) == plain(turns, settings)
    assert total(spark, target, "late") > 0 and total(spark, target, "rows") == len(turns) + 5 and total(spark, target, "repeated") == 5
    assert total(spark, target, "retained") == sum(counts(out).values())


def test_a_batch_that_failed_is_run_again(spark, turns, tmp_path):
    settings, source, target = config("conversation_flow"), tmp_path / "in", tmp_path / "out"
    put(spark, [r for r in turns if r["turn"] < 2], source)
    conversation_flow.run(spark, str(source), str(target), settings)
    put(spark, [r for r in turns if r["turn"] >= 2], source)
    want = everything(conversation_flow.run(spark, str(source), str(target), settings))
    for name in ("1", ".1.crc"):  # as if the run had ended before the batch was marked done
        (target / "checkpoint" / "commits" / name).unlink()
    assert everything(conversation_flow.run(spark, str(source), str(target), settings)) == want
    assert spark.read.parquet(str(target / "report")).count() == 2


def test_rows_with_nulls_repeats_and_none(spark, tmp_path):
    settings, target = config("conversation_flow"), str(tmp_path / "out")
    rows = [(1, 0, "u", "a"), (1, 1, "a", "b" * 150), (1, 1, "a", "b" * 50), (1, 3, "u", "far"), (None, 0, "u", "x"), (2, None, "u", "x"), (2, 0, None, None), (2, 1, "u", ""), (2, 2, "u", "\n" * 90), (3, 0, "u", "alone"), (4, 0, "u", "z" * 5000), (4, 1, "u", "y")]
    put(spark, rows, tmp_path / "in")
    assert counts(conversation_flow.run(spark, str(tmp_path / "in"), target, settings)) == plain(rows, settings) == Counter({(0, 0, 0, 0): 1})
    report = spark.read.parquet(f"{target}/report").first().asDict()
    assert {k: report[k] for k in ("rows", "invalid", "repeated", "retained", "rejected_gap", "rejected_outside")} == {"rows": 12, "invalid": 3, "repeated": 1, "retained": 1, "rejected_gap": 1, "rejected_outside": 2}
    put(spark, [], tmp_path / "none")
    assert conversation_flow.run(spark, str(tmp_path / "none"), str(tmp_path / "none_out"), settings).count() == 0


def test_state_of_another_job_is_refused(spark, turns, tmp_path):
    settings, source = config("conversation_flow"), tmp_path / "in"
    put(spark, turns[:40], source)
    conversation_flow.run(spark, str(source), str(tmp_path / "a"), settings)
    put(spark, turns[40:], source)
    spark.createDataFrame([("1", 0.0, 1.0, 1.0, 9)], f"{conversation_flow.OBSERVED}, batch long").write.mode("overwrite").parquet(str(tmp_path / "a" / "open" / "slot=0"))
    with pytest.raises(Exception, match="open observations are of batch 9"):
        conversation_flow.run(spark, str(source), str(tmp_path / "a"), settings)


def test_config_files(tmp_path):
    path = Path(tmp_path / "own.json")
    path.write_text(json.dumps({"lag": 2.0}))
    assert config("conversation_flow", str(path))["lag"] == 2.0 and config("conversation_flow")["lag"] == 1.0
    path.write_text(json.dumps({"lags": [1]}))
    with pytest.raises(ValueError, match="unknown settings"):
        config("conversation_flow", str(path))


def chain_rows(cells, start=0):
    return [(start, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", float(10 * c + 5), 5) for i, c in enumerate(cells)]


EVENTS = "user_id long, ts string, value double, k long"
SETTINGS = {"track": "cast(user_id AS string)", "y": "cast(k AS double)", "lags": [1.0], "min_support": 1}


def test_markov_distances(spark, tmp_path):
    """Cycles are Markov; a walk that remembers where it came from is not. Twice the same, and against plain matrices."""
    settings = config("markov_check") | SETTINGS
    walks = [[0, 1, 2] * 12, [3, 4, 5, 4] * 9, [6, 7, 8, 9, 11, 9, 8, 0] * 5]
    rows = [r for i, w in enumerate(walks) for r in chain_rows(w, i)]
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, EVENTS).selectExpr("user_id", "cast(ts AS timestamp) AS ts", "value", "to_json(named_struct('k', k)) AS props").write.parquet(source)
    settings["y"] = "cast(get_json_object(props, '$.k') AS double)"
    out = markov_check.run(spark, source, target, settings)
    found = {r["start_x_bin"]: (r["support"], r["support_twice"], r["lost"], r["distance"]) for r in out.collect()}

    def steps(lag):
        by = defaultdict(Counter)
        for w in walks:
            for k in range((len(w) - 1) // lag):
                by[w[k * lag]][w[(k + 1) * lag]] += 1
        return by

    one, two = steps(1), steps(2)
    p = {a: {b: n / sum(r.values()) for b, n in r.items()} for a, r in one.items()}
    for a in set(one) & set(two):
        row = Counter()
        for m, q in p[a].items():
            for b, r in p.get(m, {}).items():
                row[b] += q * r
        goal = {b: n / sum(two[a].values()) for b, n in two[a].items()}
        lost = 1 - sum(row.values())
        apart = sum(abs(row[b] - goal.get(b, 0)) for b in {*row, *goal}) / 2 + max(lost, 0) / 2
        assert found[a] == (sum(one[a].values()), sum(two[a].values()), pytest.approx(lost, abs=1e-12), pytest.approx(apart, abs=1e-12))
    assert set(found) == set(one) & set(two)
    assert found[1][3] == pytest.approx(0) and max(v[3] for v in found.values()) > 0.2

    want = everything(out)
    assert everything(markov_check.run(spark, source, target, settings)) == want
    # Another lag is put beside those there are; each stands in its own partition.
    both = markov_check.run(spark, source, target, settings | {"lags": [1.0, 3.0]})
    assert everything(both.filter("lag = 1")) == want and both.filter("lag = 3").count() > 0
    assert {r["lag"] for r in spark.read.parquet(f"{target}/links").select("lag").distinct().collect()} == {1, 2, 3, 6}
    assert spark.read.parquet(f"{target}/summary").filter("lag = 1").first()["cells"] == len(found)


def test_markov_of_no_rows_and_bad_lags(spark, tmp_path):
    settings = config("markov_check") | SETTINGS
    source = str(tmp_path / "in")
    spark.createDataFrame([], "user_id long, ts timestamp, value double, k long").write.parquet(source)
    with pytest.raises(ValueError, match="whole seconds"):
        markov_check.run(spark, source, str(tmp_path / "bad"), settings | {"lags": [0.5]})
    assert markov_check.run(spark, source, str(tmp_path / "out"), settings).count() == 0


@pytest.mark.parametrize("job, table, out", [("conversation_flow", "conversations*.parquet", "matrix"), ("markov_check", "events.parquet", "cells")])
def test_command_line(spark, tmp_path, job, table, out):
    """The command line writes what the function does, with a config file of its own."""
    own = {"conversation_flow": {"buckets": 2}, "markov_check": {"lags": [86400.0]}}[job]
    (tmp_path / "own.json").write_text(json.dumps(own))
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--source", f"{SF}/{table}", "--target", str(tmp_path / "cli"), "--config", str(tmp_path / "own.json")], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "wrote" in done.stderr
    run = {"conversation_flow": conversation_flow, "markov_check": markov_check}[job].run
    want = run(spark, f"{SF}/{table}", str(tmp_path / "here"), config(job, str(tmp_path / "own.json")))
    columns = sorted(want.columns)
    got = spark.read.schema(want.schema).parquet(str(tmp_path / "cli" / out))
    near = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(columns).collect())
    assert near(got) == near(want)
