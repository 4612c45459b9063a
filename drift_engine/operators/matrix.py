"""Tracks to fixed-lag segments and the sparse transition matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drift_engine.functions.angles import ulp
from drift_engine.functions.geodesy import Grid
from drift_engine.operators.parts import Crowds, before, everywhere, in_part, track_ids as _ids
from drift_engine.storage import materialise

SNAP_ULPS = 8.0
LINK_KEYS = ["start_y_bin", "start_x_bin", "end_y_bin", "end_x_bin"]


def _status(t: Column, a: str, b: str, max_gap: float | None) -> Column:
    """How the position at time t comes from the observations a and b (structs t, x, y; b may be NULL): exact, interpolated, or not: missing, gap."""
    at, bt = F.col(f"{a}.t"), F.col(f"{b}.t")
    nt = F.when(at.isNull(), bt).when(_first(t, a, b), at).otherwise(bt)
    exact = F.abs(nt - t) <= SNAP_ULPS * ulp(F.greatest(F.abs(t), F.abs(nt)))
    between = at.isNotNull() & bt.isNotNull() & (at <= t) & (t <= bt)
    gap = (bt - at > max_gap) if max_gap is not None else F.lit(False)
    return F.when(exact, "exact").when(~between | between.isNull(), "missing").when(gap, "gap").otherwise("interpolated")


def _first(t: Column, a: str, b: str) -> Column:
    """Whether a is nearer to time t than b."""
    at, bt = F.col(f"{a}.t"), F.col(f"{b}.t")
    return bt.isNull() | (F.abs(t - at) < F.abs(bt - t))


def _located(t: Column, a: str, b: str, geographic: bool, status: Column) -> Column:
    """struct(status, x, y) at time t between the observations a and b, of that status.

    The nearer observation is taken if it is within some spacings of doubles; else the
    position lies on the line between both, along the shorter arc of longitude.
    """
    at, ax, ay = (F.col(f"{a}.{c}") for c in ("t", "x", "y"))
    bt, bx, by = (F.col(f"{b}.{c}") for c in ("t", "x", "y"))
    share = (t - at) / (bt - at)
    step = bx - ax
    if geographic:
        # A remainder loses no bits, so that what is just over half a turn goes the other way.
        turn = step % F.lit(360.0)
        step = F.when(turn > 180.0, turn - 360.0).when(turn < -180.0, turn + 360.0).otherwise(turn)
    use_a = F.coalesce(_first(t, a, b), F.lit(True)) & at.isNotNull()
    x = F.when(status == "exact", F.when(use_a, ax).otherwise(bx)).when(status == "interpolated", ax + share * step)
    y = F.when(status == "exact", F.when(use_a, ay).otherwise(by)).when(status == "interpolated", ay + share * (by - ay))
    return F.struct(status.alias("status"), x.alias("x"), y.alias("y"))


def _observation() -> Column:
    return F.struct(F.col("time").alias("t"), "x", "y")


def check_tracks(tracks: DataFrame) -> DataFrame:
    """One row that counts what canonical tracks (trajectory or group ids, time, x, y) must not have: null ids, values that are no finite number, repeated times, and tracks of one observation."""
    ids = _ids(tracks)
    if lacking := sorted({"trajectory", "time", "x", "y"} - set(tracks.columns)):
        raise ValueError(f"canonical tracks lack {lacking}")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    null_id = F.greatest(*[F.col(c).isNull() for c in ids]) if len(ids) > 1 else F.col(ids[0]).isNull()
    rows = tracks.select(*ids, "time", null_id.alias("_null"), (~(finite("time") & finite("x") & finite("y"))).alias("_wrong"))
    times = rows.groupBy(*ids, "time").agg(F.count("*").alias("_n"), F.count_if("_null").alias("_null"), F.count_if("_wrong").alias("_wrong"))
    per = times.groupBy(*ids).agg(F.sum("_n").alias("n"), F.sum("_null").alias("_null"), F.sum("_wrong").alias("_wrong"), F.sum(F.col("_n") - 1).alias("_again"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return per.agg(zero(F.sum("_null")).alias("null_identities"), zero(F.sum("_wrong")).alias("not_finite"), zero(F.sum("_again")).alias("repeated_times"), F.count_if(F.col("n") < 2).alias("short_tracks"))


def require_canonical(tracks: DataFrame) -> DataFrame:
    """tracks, if check_tracks() finds nothing; else ValueError."""
    found = check_tracks(tracks).first().asDict()
    if any(found.values()):
        raise ValueError(f"tracks are not canonical: {found}")
    return tracks


#: Multiples of the lag that a row makes at once.
CHUNK = 4096


def _points(rows: DataFrame, lag: float, geographic: bool, max_gap: float | None) -> DataFrame:
    """The positions at the multiples k of the lag, of brackets a to b of tracks that last until _last.

    The multiples that fall in a bracket come out of the row itself. A bracket wider than
    max_gap gives its first and last two multiples, and the number of those between, which
    all lie in the gap; any other gives them CHUNK by CHUNK.
    """
    keys = [*_ids(rows), *(["part"] if "part" in rows.columns else [])]
    q = F.col("_last") / F.lit(lag)
    n = F.floor(F.when(q > 0, q + ulp(q)).otherwise(q)).cast("long")
    rows = rows.withColumn("n", n)
    low = F.ceil(F.col("a.t") / F.lit(lag)).cast("long")
    high = F.when(F.col("b").isNull(), F.col("n")).otherwise(F.least(F.col("n"), F.ceil(F.col("b.t") / F.lit(lag)).cast("long") - 1))
    rows = rows.withColumns({"_lo": low, "_hi": high})
    inside = lambda k: (F.col("n") > 0) & (k >= 0) & (k * F.lit(lag) >= F.col("a.t")) & (k <= F.col("n")) & (F.col("b").isNull() | (k * F.lit(lag) < F.col("b.t")))
    # Plain columns, no functions of arrays, and no filter, which would work all this out once more: explode() drops a row without multiples.
    found = lambda *ks: F.coalesce(*[F.when(inside(k), k) for k in ks])
    lo, hi = F.col("_lo"), F.col("_hi")
    # ceil() may step over a multiple by rounding: one more on each side is looked at.
    rows = rows.withColumns({"_lo": found(lo - 1, lo, lo + 1), "_hi": found(hi + 1, hi, hi - 1)}).withColumn("_hi", F.greatest(hi, lo))
    wide = (hi - lo > 4) & F.coalesce(F.col("b.t") - F.col("a.t") > max_gap, F.lit(False)) if max_gap is not None else F.lit(False)
    starts = F.when(wide, F.array(F.lit(-1).cast("long"))).when(lo.isNotNull(), F.sequence(lo, hi, F.lit(CHUNK).cast("long")))
    rows = rows.withColumn("_from", F.explode(starts))
    run = F.sequence(F.col("_from"), F.greatest(F.col("_from"), F.least(F.col("_from") + CHUNK - 1, hi)))
    rows = rows.withColumn("k", F.explode(F.when(F.col("_from") < 0, F.array(lo, lo + 1, hi - 1, hi)).otherwise(run)))
    copies = F.when((F.col("_from") < 0) & (F.col("k") == lo + 1), hi - lo - 2).otherwise(1).cast("long")
    t = F.col("k") * F.lit(lag)
    rows = rows.withColumn("_status", _status(t, "a", "b", max_gap))
    return rows.select(*keys, "n", "k", copies.alias("copies"), _located(t, "a", "b", geographic, F.col("_status")).alias("start"))


def segments_non_overlapping(tracks: DataFrame, lag: float, geographic: bool = False, max_gap: float | None = None, crowds: Crowds | None = None) -> DataFrame:
    """Segments k: from k * lag to (k + 1) * lag, for as many as the track's duration holds; `copies` segments from k on are alike.

    Each observation gives the bracket up to the next one: one sort of each track, no as-of
    join. The tracks of `crowds` are sorted in parts, and their brackets and segments across
    a cut end with what the next part hands on.
    """
    made = lambda points, end: points.withColumn("end", end).filter("k < n").select(*ids, "k", "start", "end", "copies")
    ids = _ids(tracks)
    if crowds:
        long, tracks = crowds.split(tracks)
        rows = crowds.cut(long.withColumn("a", _observation()), ["time"], "track-parts")
        rows = crowds.handed(rows, {"first": F.min("a"), "end": F.max("time")}, {"_next": lambda w: F.lead("first").over(w), "_last": lambda w: F.max("end").over(everywhere(w))})
        rows = rows.withColumn("b", F.coalesce(F.lead("a").over(in_part(rows, "time")), "_next"))
        points = materialise(_points(rows, lag, geographic, max_gap), "track-points")
        points = crowds.handed(points, {"first": F.min(F.struct("k", "start"))}, {"_next": lambda w: F.lead("first").over(w)})
        parted = made(points, F.coalesce(F.lead("start").over(in_part(points, "k")), "_next.start"))
    w = Window.partitionBy(*ids).orderBy("time")
    rows = tracks.withColumn("a", _observation()).select("*", F.lead("a").over(w).alias("b"), F.max("time").over(everywhere(w)).alias("_last"))
    found = made(_points(rows, lag, geographic, max_gap), F.lead("start").over(Window.partitionBy(*ids).orderBy("k")))
    return found.unionByName(parted) if crowds else found


def _merged(rows: DataFrame, lag: float) -> DataFrame:
    """Observations, each with the bracket o from it to its successor, and the targets one lag after those that have one, in common columns: one pass over rows (time, x, y, k, b)."""
    t, x, y = F.col("time"), F.col("x"), F.col("y")
    row = lambda t, k, x, y, o: F.struct(t.alias("t"), k.cast("long").alias("k"), x.cast("double").alias("x"), y.cast("double").alias("y"), o.alias("o"))
    bracket = F.struct(t.alias("at"), x.alias("ax"), y.alias("ay"), F.col("b.t").alias("bt"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
    none = F.lit(None)
    seen = row(t, none, none, none, bracket)
    wanted = row(t + F.lit(lag), F.col("k"), x, y, none.cast("struct<at:double,ax:double,ay:double,bt:double,bx:double,by:double>"))
    return rows.select(*_ids(rows), F.explode(F.when(F.col("b").isNotNull(), F.array(seen, wanted)).otherwise(F.array(seen))).alias("_row")).select(*_ids(rows), "_row.*")


def segments_every_observation(tracks: DataFrame, lag: float, geographic: bool = False, max_gap: float | None = None, crowds: Crowds | None = None) -> DataFrame:
    """A segment from each observation but the track's last one to the position one lag later.

    Observations and targets are merged in one order per track; the last observation
    before a target and that one's successor are its bracket, read as one running value.
    The tracks of `crowds` are merged in parts, which hand on the last observation to the
    parts after them.
    """
    ids = _ids(tracks)
    merging = ["t", F.col("k").asc_nulls_first()]
    last = lambda w: F.last("o", True).over(w.rowsBetween(Window.unboundedPreceding, 0))

    def made(merged: DataFrame) -> DataFrame:
        start = F.struct(F.lit("exact").alias("status"), "x", "y")
        bracket = {e: F.struct(*[F.col(f"o.{e}{c}").alias(c) for c in "txy"]) for e in "ab"}
        # As a generated row the position is worked out once; as a projection it would be copied into each filter above.
        end = F.explode(F.array(_located(F.col("t"), "a", "b", geographic, _status(F.col("t"), "a", "b", max_gap))))
        return merged.filter("k is not null").withColumns(bracket).select(*ids, "k", start.alias("start"), end.alias("end"), F.lit(1).cast("long").alias("copies"))

    if crowds:
        long, tracks = crowds.split(tracks)
        rows = crowds.cut(long.withColumn("a", _observation()), ["time"], "track-parts")
        rows = crowds.handed(rows, {"n": F.count("*"), "first": F.min("a")}, {"_before": lambda w: F.coalesce(F.sum("n").over(before(w)), F.lit(0)), "_next": lambda w: F.lead("first").over(w)})
        rows = rows.withColumn("k", F.col("_before") + F.row_number().over(in_part(rows, "time")) - 1).withColumn("b", F.coalesce(F.lead("a").over(in_part(rows, "time")), "_next"))
        merged = crowds.cut(_merged(rows, lag), merging, "track-merged", times=2)
        merged = crowds.handed(merged, {"high": F.max("o")}, {"_o": lambda w: F.last("high", True).over(before(w))}, times=2)
        parted = made(merged.withColumn("o", F.coalesce(last(in_part(merged, *merging)), "_o")))
    order = Window.partitionBy(*ids).orderBy("time")
    rows = tracks.withColumn("b", F.lead(_observation()).over(order)).withColumn("k", F.row_number().over(order).cast("long") - 1)
    found = made(_merged(rows, lag).withColumn("o", last(Window.partitionBy(*ids).orderBy(*merging))))
    return found.unionByName(parted) if crowds else found


def segments(tracks: DataFrame, lag: float, mode: str = "non_overlapping", geographic: bool = False, max_gap: float | None = None, crowds: Crowds | None = None) -> DataFrame:
    make = {"non_overlapping": segments_non_overlapping, "every_observation": segments_every_observation}[mode]
    return make(tracks, lag, geographic, max_gap, crowds)


def with_fate(segs: DataFrame, grid: Grid) -> DataFrame:
    """segs with `fate`: missing, gap, outside or retained, in that order, and what of each end is outside."""
    status = F.array("start.status", "end.status")
    located = ~F.array_contains(status, "missing") & ~F.array_contains(status, "gap")
    out = lambda e: located & ~F.coalesce(grid.inside(F.col(f"{e}.x"), F.col(f"{e}.y")), F.lit(False))
    segs = segs.withColumn("outside_start", out("start")).withColumn("outside_end", out("end"))
    fate = F.when(F.array_contains(status, "missing"), "missing").when(F.array_contains(status, "gap"), "gap").when(F.col("outside_start") | F.col("outside_end"), "outside")
    return segs.withColumn("fate", fate.otherwise("retained"))


def transition_matrix(segs: DataFrame, grid: Grid) -> DataFrame:
    """The sparse matrix: bins, centres, transition_count, transition_probability."""
    kept = with_fate(segs, grid).filter("fate = 'retained'")
    bins = {f"{e}_{a}_bin": (grid.x_bin if a == "x" else grid.y_bin)(F.col(f"{e}.{a}")) for e in ("start", "end") for a in "xy"}
    links = kept.select(*[c.alias(n) for n, c in bins.items()]).groupBy(*LINK_KEYS).agg(F.count("*").alias("transition_count"))
    total = F.sum("transition_count").over(Window.partitionBy("start_y_bin", "start_x_bin"))
    centres = [(grid.x_center if a == "x" else grid.y_center)(F.col(f"{e}_{a}_bin")).alias(f"{e}_{a}_center") for e in ("start", "end") for a in "xy"]
    return links.select("start_x_bin", "start_y_bin", "end_x_bin", "end_y_bin", *centres, "transition_count", (F.col("transition_count") / total).alias("transition_probability"))


def matrix_diagnostics(segs: DataFrame, grid: Grid) -> DataFrame:
    """One row of counters; shared boundaries of segments count for each segment that evaluates them."""
    rows = with_fate(segs, grid)
    total = lambda c: F.coalesce(F.sum(c * F.col("copies")), F.lit(0))
    each = [total((F.col("start.status") == s).cast("long") + (F.col("end.status") == s).cast("long")).alias(f"{s}_endpoints") for s in ("exact", "interpolated", "missing", "gap")]
    fates = [total((F.col("fate") == f).cast("long")).alias(n) for f, n in (("missing", "rejected_missing"), ("gap", "rejected_gap"), ("outside", "rejected_outside"), ("retained", "retained_segments"))]
    return rows.agg(total(F.lit(1)).alias("candidate_segments"), *each, *fates, total(F.col("outside_start").cast("long")).alias("outside_start"), total(F.col("outside_end").cast("long")).alias("outside_end"))


def source_timestep(tracks: DataFrame, crowds: Crowds | None = None) -> DataFrame:
    """The commonest gap between observations, the smallest of equals: (timestep, observations)."""
    step = lambda rows, later: rows.select((later - F.col("time")).alias("timestep"))
    if crowds:
        long, tracks = crowds.split(tracks)
        rows = crowds.cut(long, ["time"], "track-parts")
        rows = crowds.handed(rows, {"first": F.min("time")}, {"_next": lambda w: F.lead("first").over(w)})
        parted = step(rows, F.coalesce(F.lead("time").over(in_part(rows, "time")), "_next"))
    gaps = step(tracks, F.lead("time").over(Window.partitionBy(*_ids(tracks)).orderBy("time")))
    gaps = (gaps.unionByName(parted) if crowds else gaps).filter("timestep is not null")
    return gaps.groupBy("timestep").agg(F.count("*").alias("observations")).orderBy(F.desc("observations"), "timestep").limit(1)
