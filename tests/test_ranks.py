"""Distributed places, tied ranks, quantiles, components and ordered paths against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from drift_engine.functions.geodesy import Space
from drift_engine.operators import cellstats, directional, graph, ranks


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    rows = [(i, None if i % 13 == 0 else float(rng.integers(0, 40)), None if i % 7 == 0 else float(rng.normal()), 1.5) for i in range(900)]
    return rows, spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(5)


def test_tied_ranks(spark, table):
    rows, df = table
    for least in (True, False):
        for descending in (True, False):
            got = {r.id: r for r in ranks.tied(df, ["id"], {"ra": "a", "rb": "b", "rc": "c"}, least, descending).collect()}
            for name, at in (("ra", 1), ("rb", 2), ("rc", 3)):
                key = lambda v: (v is None, 0 if v is None else -v if descending else v)  # noqa: B023, E731
                ordered = sorted(key(r[at]) for r in rows)
                for r in rows:
                    first = ordered.index(key(r[at]))
                    n = ordered.count(key(r[at]))
                    assert got[r[0]][name] == (first + 1 if least else first + (n + 1) / 2)
    assert ranks.tied(df.filter("false"), ["id"], {"ra": "a"}).count() == 0


def test_places_and_running_totals(spark, table):
    rows, df = table
    order = [F.col("b").asc_nulls_last(), F.col("id")]
    want = sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0]))
    assert [(r.id, r.at) for r in ranks.numbered(df, order, "at").orderBy("at").collect()] == [(r[0], k) for k, r in enumerate(want, 1)]
    total, got = 0, {r.id: r.before for r in ranks.with_running(df, order, F.col("id"), "before").collect()}
    for r in want:
        assert got[r[0]] == total
        total += r[0]


@pytest.mark.parametrize("most", [1_000_000, 5, 1])
def test_quantiles(spark, table, most):
    """One aggregation, or brackets that are narrowed until they hold few values: the same."""
    rows, df = table
    wanted = {f"{c}{i}": (F.col(c), q) for c in "abc" for i, q in enumerate((0.0, 0.05, 0.31, 0.5, 0.95, 1.0))}
    got = ranks.quantiles(df, wanted, most=most).first()
    for at, c in ((1, "a"), (2, "b"), (3, "c")):
        values = [r[at] for r in rows if r[at] is not None]
        for i, q in enumerate((0.0, 0.05, 0.31, 0.5, 0.95, 1.0)):
            assert got[f"{c}{i}"] == pytest.approx(float(np.quantile(values, q)), abs=1e-12)
    assert ranks.quantiles(df.filter("false"), {"q": (F.col("a"), 0.5)}, 10, 1).first().q is None


def test_spearman_of_ties(spark, table):
    rows, df = table
    both = [(r[1], r[2]) for r in rows if r[1] is not None and r[2] is not None]

    def mean_ranks(values):
        ordered = sorted(values)
        return [ordered.index(v) + (ordered.count(v) + 1) / 2 for v in values]

    x, y = mean_ranks([b[0] for b in both]), mean_ranks([b[1] for b in both])
    got = cellstats.spearman(df, "a", "b").first()
    assert got.pairs == len(both) and got.correlation == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert cellstats.spearman(df, "a", "c").first().correlation is None


def graph_of(spark, edges, lone=()):
    """Members with components by plain search, and the edges."""
    parent = {v: v for e in edges for v in e} | {v: v for v in lone}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    members = [(v, root(v)) for v in parent]
    return members, spark.createDataFrame(members, "cell_id long, component long"), spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")


def test_ranked_paths_are_the_walked_ones(spark):
    """Paths, loops, junctions, parallel paths, a path that comes back to its junction, lone cells; and random trees and grids."""
    rng = np.random.default_rng(9)
    names = rng.permutation(4000)
    edges = [(0, 1), (1, 2), (2, 3), (10, 11), (11, 12), (12, 10), (20, 21), (21, 22), (22, 23), (23, 20), (23, 24), (30, 31), (31, 32), (30, 33), (33, 32), (30, 32), (34, 30), (32, 35)]
    edges += [(40 + k, 41 + k) for k in range(700)] + [(1000 + k, 1000 + (k + 1) % 500) for k in range(500)]
    edges += [(2000 + k, 2000 + int(rng.integers(max(0, k - 3), k))) for k in range(1, 300)]
    edges += [(3000 + 20 * j + i, 3000 + 20 * j + i + 1) for j in range(12) for i in range(19) if rng.random() < 0.5] + [(3000 + 20 * j + i, 3020 + 20 * j + i) for j in range(11) for i in range(20) if rng.random() < 0.5]
    edges = list({(min(a, b), max(a, b)) for a, b in ((int(names[x]), int(names[y])) for x, y in edges)})
    members, m, e = graph_of(spark, edges, [int(names[v]) for v in (3990, 3991)])
    rows = lambda df: sorted(map(tuple, df.select("component", "segment", "sequence", "cell_id", "closed").collect()))
    got, want = rows(graph.ordered_segments(m, e)), rows(graph.ordered_segments(m, e, 4000))
    assert got == want and len({r[0] for r in want}) > 10 and any(r[4] for r in want)
    labels = graph.labelled(m.drop("component"), e)
    assert sorted((r.cell_id, r.component) for r in labels.collect()) == sorted(members)
    numbers = {r.component: r.component_number for r in labels.collect()}
    assert [numbers[c] for c in sorted(numbers)] == list(range(1, len(numbers) + 1))


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    """A path of 60,000 cells: some log2 of them rounds, in the path's order."""
    n, rounds = 60_000, []
    stored = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: rounds.append(name) or stored(df, name))
    cells = spark.range(n).select(((F.col("id") * 7919) % n).alias("cell_id"), F.col("id").alias("place"))
    edges = cells.join(cells.select(F.col("cell_id").alias("other"), (F.col("place") - 1).alias("place")), "place").select(F.least("cell_id", "other").alias("a"), F.greatest("cell_id", "other").alias("b"))
    found = graph.ordered_segments(cells.select("cell_id", F.lit(0).cast("long").alias("component")), edges)
    assert rounds.count("arcs") <= 18
    turned = found.join(cells, "cell_id")
    assert turned.count() == n and turned.select("segment").distinct().count() == 1
    assert turned.filter("sequence <> place").isEmpty() or turned.filter(F.col("sequence") != n - 1 - F.col("place")).isEmpty()


@pytest.mark.parametrize("geographic", [False, True])
def test_medoid_is_the_exhaustive_one(geographic):
    """Random clouds, grids full of ties, repeated points and single ones, against all pairs."""
    space, rng = Space(geographic, "km"), np.random.default_rng(3)
    clouds = [rng.normal(size=(n, 2)) * 5 for n in (1, 2, 3, 7, 60, 150)] + [np.array([(i, j) for i in range(6) for j in range(5)], float), np.zeros((4, 2)), np.array([(0, 0), (0, 0), (1, 0), (1, 0)], float)]
    for cloud in clouds:
        x, y = cloud[:, 0], cloud[:, 1]
        sums = np.array([space.metres(np.full(len(x), a), np.full(len(x), b), x, y).sum() for a, b in cloud])
        assert directional.medoid(x, y, space) == int(np.argmax(sums <= sums.min() + 1e-12))


def test_medoid_of_a_large_plateau_measures_few(monkeypatch):
    """100,000 cells: a few hundred of them are measured against all."""
    calls = []
    plain = Space.metres
    monkeypatch.setattr(Space, "metres", lambda self, *a: calls.append(1) or plain(self, *a))
    x, y = (v.ravel().astype(float) for v in np.meshgrid(np.arange(400), np.arange(250)))
    at = directional.medoid(x, y, Space())
    assert abs(x[at] - 199.5) <= 1 and abs(y[at] - 124.5) <= 1 and len(calls) < 2000
