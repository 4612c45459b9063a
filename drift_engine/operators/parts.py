"""Long tracks in parts: a range shuffle cuts their order, and what crosses a cut is handed on by a small table of parts.

A window over a track takes the whole track into one task. For tracks of more rows than a
task should sort, the functions here give the same values from windows over (track, part):
each part is summed up in one row, those rows are ordered, and every part gets what it
needs of the parts before and after it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from drift_engine.storage import materialise

#: Rows of a track that one task orders.
PART_ROWS = 1_000_000
#: Rows for which a cut takes another task, where parts are shorter: a task then holds many parts.
RANGE_ROWS = 100_000
#: A side is broadcast only when its counted rows stay under this.
BROADCAST_ROWS = 200_000


def track_ids(df: DataFrame) -> list[str]:
    return [c for c in ("trajectory", "group_member") if c in df.columns]


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows prove that it is small; else df, for a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class Crowds:
    """The tracks with more rows than a task should order."""

    ids: DataFrame
    tracks: int
    rows: int
    part_rows: int

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of these tracks, and all others."""
        own = track_ids(df)
        those = small(self.ids, self.tracks)
        return df.join(those, own, "left_semi"), df.join(those, own, "left_anti")

    def ranges(self, times: int = 1) -> int:
        """The tasks of a cut: as many as its rows ask for, however short the parts."""
        return max(1, ceil(times * self.rows / max(self.part_rows, RANGE_ROWS)))

    def cut(self, df: DataFrame, order: list, name: str, times: int = 1) -> DataFrame:
        """df, of `times` rows for each of these tracks' at most, stored with `part`: runs of part_rows rows at most in the order of (track, order), each within one task."""
        by = [*track_ids(df), *order]
        ranged = df.repartitionByRange(self.ranges(times), *by).sortWithinPartitions(*by)
        # This id counts the rows of a partition in their order, and rises from partition to partition.
        return materialise(ranged.withColumn("part", F.expr(f"monotonically_increasing_id() div {self.part_rows}")), name)

    def handed(self, df: DataFrame, sums: dict[str, Column], over: dict[str, Callable[[WindowSpec], Column]], times: int = 1) -> DataFrame:
        """df with the columns `over`: each a function of the window that holds, in order, one row of `sums` for each part of a track."""
        ids = track_ids(df)
        w = Window.partitionBy(*ids).orderBy("part")
        borders = df.groupBy(*ids, "part").agg(*[c.alias(n) for n, c in sums.items()]).select(*ids, "part", *[f(w).alias(n) for n, f in over.items()])
        # A part that ends in a track and begins another gives a row for each; the first and the last part of a task may be short.
        return df.join(small(borders, self.tracks + ceil(times * self.rows / self.part_rows) + 2 * self.ranges(times)), [*ids, "part"])


def crowds(rows: DataFrame, part_rows: int = PART_ROWS) -> Crowds | None:
    """The tracks with more than part_rows rows, by one aggregation with partial counts; None if there are none. Rows without identity are no track."""
    ids = track_ids(rows)
    found = rows.dropna(subset=ids).groupBy(*ids).agg(F.count("*").alias("n")).filter(F.col("n") > part_rows)
    found = materialise(found, "crowded")
    total = found.agg(F.count("*").alias("tracks"), F.sum("n").alias("rows")).first()
    return Crowds(found.select(*ids), total["tracks"], total["rows"], part_rows) if total["tracks"] else None


def in_part(df: DataFrame, *order) -> WindowSpec:
    return Window.partitionBy(*track_ids(df), "part").orderBy(*order)


def before(w: WindowSpec) -> WindowSpec:
    """All earlier parts."""
    return w.rowsBetween(Window.unboundedPreceding, -1)


def everywhere(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
