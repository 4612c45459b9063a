"""Graphs over cells: neighbours, components, degrees, ordered segments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drift_engine.functions.geodesy import Grid
from drift_engine.operators.ranks import numbered
from drift_engine.storage import materialise

#: On a grid of up to so many cells components are found in one task.
SMALL_CELLS = 4096
AROUND = [(i, j) for j in (-1, 0, 1) for i in (-1, 0, 1) if (i, j) != (0, 0)]


def neighbour_pairs(cells: DataFrame, grid: Grid, both: bool = False) -> DataFrame:
    """(a, b) of cells of the table (cell_id, x_bin, y_bin) that touch, also across the seam of a periodic grid; a < b unless both."""
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in AROUND]))
    rows = cells.select(F.col("cell_id").alias("a"), "x_bin", "y_bin", step.alias("s"))
    x, y = F.col("x_bin") + F.col("s.i"), F.col("y_bin") + F.col("s.j")
    inside = y.between(0, grid.ny - 1)
    x = F.pmod(x, F.lit(grid.nx)) if grid.periodic else x
    if not grid.periodic:
        inside &= x.between(0, grid.nx - 1)
    rows = rows.filter(inside).select("a", grid.cell_id(x, y).alias("b")).filter("a <> b" if both else "a < b").distinct()
    return rows.join(cells.select(F.col("cell_id").alias("b")), "b", "left_semi").select("a", "b")


def _find(pdf: pd.DataFrame) -> pd.DataFrame:
    """Components of edges (a, b), and of lone nodes, whose b is missing: (node, component, component_number)."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    lone = pdf["b"].isna()
    for v in pdf.loc[lone, "a"].astype("int64").tolist():
        root(v)
    edges = pdf[~lone]
    for a, b in zip(edges["a"].astype("int64").tolist(), edges["b"].astype("int64").tolist()):
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = list(parent)
    out = pd.DataFrame({"node": nodes, "component": [root(v) for v in nodes]}, dtype="int64")
    return out.assign(component_number=out["component"].rank(method="dense").astype("int64"))


def _small_components(edges: DataFrame) -> DataFrame:
    """(node, component, component_number) in one task."""
    return edges.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(_find, "node long, component long, component_number long")


def connected_components(edges: DataFrame, name: str = "components", small_edges: int = 0) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node of its part.

    edges: (a, b) longs, undirected. In each round every node points to its smallest
    neighbour and that one's pointer in turn, and the edges are drawn between what they
    point to; rounds go on until no edge is left, some log of the longest path. Each
    round's tables are written to the shared folder; nothing comes to the driver but
    the number of edges. Up to small_edges edges are done in one task instead.
    """
    edges = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    if small_edges and edges.count() <= small_edges:
        return _small_components(edges).drop("component_number")
    labels = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        points = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("to"))
        ahead = points.select(F.col("node").alias("to"), F.col("to").alias("next"))
        points = materialise(points.join(ahead, "to").select("node", F.col("next").alias("to")), f"{name}-points")
        if labels is None:
            labels = points.select("node", F.col("to").alias("component"))
        else:
            moved = points.select(F.col("node").alias("component"), "to")
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = materialise(labels, f"{name}-labels")
        pa, pb = points.select(F.col("node").alias("a"), F.col("to").alias("ta")), points.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        edges = edges.join(pa, "a").join(pb, "b").filter("ta <> tb")
        edges = materialise(edges.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), f"{name}-edges")
        if edges.isEmpty():
            return labels


def labelled(vertices: DataFrame, edges: DataFrame, cells: int | None = None) -> DataFrame:
    """vertices (a stored table with cell_id) with component (its smallest cell) and component_number (from 1, in that order); lone vertices are their own.

    cells: of the grid that the vertices are of. On a grid of SMALL_CELLS or fewer, which
    has no more than four edges a cell, components are found in one task; on others,
    or without that bound, round by round. The result is stored: later operators read it
    several times.
    """
    if cells is not None and cells <= SMALL_CELLS:
        rows = edges.select("a", "b").unionByName(vertices.select(F.col("cell_id").alias("a"), F.lit(None).cast("long").alias("b")))
        return materialise(vertices.join(_small_components(rows).withColumnRenamed("node", "cell_id"), "cell_id"), "labelled")
    found = connected_components(edges).withColumnRenamed("node", "cell_id")
    out = materialise(vertices.join(found, "cell_id", "left").withColumn("component", F.coalesce("component", "cell_id")), "components")
    numbers = numbered(out.select("component").distinct(), [F.col("component")], "component_number")
    return materialise(out.join(numbers, "component"), "labelled")


def degrees(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members (cell_id, component) with degree, endpoint, junction, isolated and the component's class and size."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    d = both.groupBy(F.col("a").alias("cell_id")).agg(F.count("*").alias("degree"))
    out = members.join(d, "cell_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    w = Window.partitionBy("component")
    out = out.withColumns({"endpoint": F.col("degree") == 1, "junction": F.col("degree") >= 3, "isolated": F.col("degree") == 0, "component_cells": F.count("*").over(w)})
    kind = F.when(F.col("component_cells") == 1, "isolated_cell").when(F.max(F.col("degree")).over(w) >= 3, "junction_network").when(F.min(F.col("degree")).over(w) == 2, "loop")
    return out.withColumn("component_class", kind.otherwise("simple_path"))


def walk_segments(edges: list[tuple[int, int]], nodes: list[int]) -> list[tuple[list[int], bool]]:
    """A component's edges as paths between nodes of a degree other than 2, and closed loops for what is left.

    Paths leave such nodes in ascending order along ascending neighbours; a loop starts
    with its smallest edge.
    """
    if len(nodes) == 1:
        return [(nodes, False)]
    near: dict[int, list[int]] = {v: [] for v in nodes}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    for v in near:
        near[v].sort()
    free = {(min(e), max(e)) for e in edges}
    ends = {v for v in nodes if len(near[v]) != 2}
    out: list[tuple[list[int], bool]] = []

    def go(a: int, b: int, stop: set[int], loop: bool) -> tuple[list[int], bool]:
        path = [a, b]
        free.discard((min(a, b), max(a, b)))
        while path[-1] not in stop:
            last, here = path[-2], path[-1]
            onward = next((v for v in near[here] if v != last and (min(here, v), max(here, v)) in free), None)
            if onward is None:
                break
            free.discard((min(here, onward), max(here, onward)))
            if loop and onward == a:
                return path, True
            path.append(onward)
        return path, False

    for start in sorted(ends):
        out += [go(start, v, ends, False) for v in near[start] if (min(start, v), max(start, v)) in free]
    while free:
        a, b = min(free)
        out.append(go(a, b, set(), True))
    return out


def _ranked_arcs(arcs: DataFrame) -> DataFrame:
    """arcs (a, b: an edge in one direction; na, nb: the arc that follows, NULL at an end) with la, lb, the last arc of its path, and `ahead`, the arcs after it.

    Pointer jumping: each round every arc points to what the arc it points to pointed to,
    so a path takes the logarithm of its length in rounds. An arc at its path's end is
    done; the others each point to an arc of their own, so no key is hot.
    """
    last = F.col("nb").isNull()
    state = materialise(arcs.select("a", "b", F.coalesce("na", "a").alias("la"), F.coalesce("nb", "b").alias("lb"), F.when(last, 0).otherwise(1).cast("long").alias("ahead"), last.alias("done")), "arcs")
    while not state.filter("not done").isEmpty():
        next_ = state.select(F.col("a").alias("la"), F.col("b").alias("lb"), F.col("la").alias("_la"), F.col("lb").alias("_lb"), F.col("ahead").alias("_ahead"), F.col("done").alias("_done"))
        moved = state.filter("not done").join(next_, ["la", "lb"]).select("a", "b", F.col("_la").alias("la"), F.col("_lb").alias("lb"), (F.col("ahead") + F.col("_ahead")).alias("ahead"), F.col("_done").alias("done"))
        state = materialise(state.filter("done").unionByName(moved), "arcs")
    return state.drop("done")


def _ranked_segments(members: DataFrame, edges: DataFrame) -> DataFrame:
    """ordered_segments() by list ranking, for components of any size.

    An edge is two arcs. An arc is followed by the one that goes on at a cell of degree 2;
    a component of such cells only is a loop, cut at its smallest cell. The arcs before an
    arc are those after its reverse, so both ends of its path are known. A path runs from
    its smaller end, one that comes back to its start by the smaller neighbour.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))), "arcs-both")
    degree = both.groupBy("a").agg(F.count("*").alias("degree"), F.sum("b").alias("both"))
    # Whether all of a component's cells have degree 2, and its smallest cell.
    own = members.select(F.col("cell_id").alias("a"), "component").join(degree, "a", "left")
    loops = own.groupBy("component").agg((F.min(F.coalesce("degree", F.lit(0))) == 2).alias("_low"), (F.max(F.coalesce("degree", F.lit(0))) == 2).alias("_high"), F.min("a").alias("_cut"))
    nodes = own.join(loops, "component").withColumn("closed", F.col("_low") & F.col("_high"))
    nodes = materialise(nodes.select("a", "component", "closed", "both", ((F.col("degree") != 2) | F.col("degree").isNull() | (F.col("closed") & (F.col("a") == F.col("_cut")))).alias("end")), "arc-nodes")
    at = nodes.select(F.col("a").alias("b"), F.col("end").alias("_end"), F.col("both").alias("_both"))
    arcs = both.join(at, "b").select("a", "b", F.when(~F.col("_end"), F.col("b")).alias("na"), F.when(~F.col("_end"), F.col("_both") - F.col("a")).alias("nb"))
    ranked = _ranked_arcs(arcs)
    reverse = ranked.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("lb").alias("start"), F.col("la").alias("first"), F.col("ahead").alias("place"))
    rows = ranked.join(reverse, ["a", "b"]).withColumn("_turn", F.when(F.col("start") == F.col("lb"), F.col("first") < F.col("la")).otherwise(F.col("start") < F.col("lb"))).filter("_turn")
    rows = materialise(rows.join(nodes.select("a", "component", "closed"), "a").select("component", "closed", "start", "first", "place", "a", "b", "ahead"), "arc-paths")
    firsts = numbered(rows.filter("place = 0").select("component", "start", "first"), [F.col(c) for c in ("component", "start", "first")], "_number")
    zero = firsts.groupBy("component").agg(F.min("_number").alias("_zero"))
    firsts = firsts.join(zero, "component").select("component", "start", "first", (F.col("_number") - F.col("_zero")).cast("int").alias("segment"))
    rows = rows.join(firsts, ["component", "start", "first"])
    heads = rows.filter("place = 0").select("component", "segment", F.lit(0).alias("sequence"), F.col("a").alias("cell_id"), "closed")
    # A loop's last arc comes back to the cell that it began with.
    tails = rows.filter("not closed or ahead > 0").select("component", "segment", (F.col("place") + 1).cast("int").alias("sequence"), F.col("b").alias("cell_id"), "closed")
    lone = members.join(degree.select(F.col("a").alias("cell_id")), "cell_id", "left_anti").select("component", F.lit(0).alias("segment"), F.lit(0).alias("sequence"), "cell_id", F.lit(False).alias("closed"))
    return materialise(heads.unionByName(tails).unionByName(lone), "ranked-segments")


def ordered_segments(members: DataFrame, edges: DataFrame, cells: int | None = None) -> DataFrame:
    """(component, segment, sequence, cell_id, closed): a component's edges as paths between cells of a degree other than 2, and loops, in the order of walk_segments().

    cells: of the grid. On a grid of SMALL_CELLS or fewer a component is walked in one
    task; on others, or without that bound, paths are ranked round by round.
    """
    if cells is None or cells > SMALL_CELLS:
        return _ranked_segments(members, edges)
    tagged = edges.join(members.select(F.col("cell_id").alias("a"), "component"), "a").select("component", "a", "b")
    rows = tagged.unionByName(members.select("component", F.col("cell_id").alias("a"), F.lit(None).cast("long").alias("b")))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = pdf[pdf["b"].notna()]
        found = walk_segments(list(zip(pairs["a"].astype(int).tolist(), pairs["b"].astype(int).tolist())), sorted(pdf.loc[pdf["b"].isna(), "a"].astype(int)))
        return pd.DataFrame([(int(pdf["component"].iloc[0]), s, k, v, closed) for s, (path, closed) in enumerate(found) for k, v in enumerate(path)], columns=["component", "segment", "sequence", "cell_id", "closed"])

    return materialise(rows.groupBy("component").applyInPandas(walk, "component long, segment int, sequence int, cell_id long, closed boolean"), "walked")
