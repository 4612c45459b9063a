"""Places, tied ranks and exact quantiles of a whole table, without a task that holds it."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drift_engine.operators.parts import small
from drift_engine.storage import materialise

#: Distinct values of a column that one task, or the driver, may hold.
SMALL_VALUES = 1_000_000
#: percentile_approx() is off by no more than one in so many ranks.
ACCURACY = 10_000


def _sorted(df: DataFrame, order: list, weight: Column, name: str) -> tuple[DataFrame, DataFrame, int]:
    """df stored in ranges of its order, with `part`; (part, _base: weight of all parts before); and the parts."""
    table = materialise(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    bases, total = [], 0
    for part, n in sorted(table.groupBy("part").agg(F.sum(weight)).collect()):
        bases.append((part, total))
        total += n
    return table, df.sparkSession.createDataFrame(bases, "part int, _base long"), len(bases)


def with_running(df: DataFrame, order: list, weight: Column, before: str, name: str = "running") -> DataFrame:
    """df with the sum of `weight` over all rows before each, in an order without ties.

    One range shuffle sorts, sums run inside a range, and the driver adds up one sum a range.
    """
    table, bases, parts = _sorted(df, order, weight, name)
    own = F.coalesce(F.sum(weight).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table.withColumn("_own", own).join(small(bases, parts), "part").withColumn(before, (F.col("_base") + F.col("_own")).cast("long")).drop("part", "_own", "_base")


def numbered(df: DataFrame, order: list, name: str, start: int = 1) -> DataFrame:
    """df with its place in an order without ties, counted from `start`."""
    return with_running(df, order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) + start)


def tied(df: DataFrame, keys: list[str], columns: dict[str, str], least: bool = True, descending: bool = True) -> DataFrame:
    """keys (one row each) with ranks by the columns: {rank: column}. Null comes last; of equals all get the least of their places, or with least=False their mean.

    Values are counted before they are sorted, all columns in one sort; rows meet their
    value's rank by a join that splits where many have one value.
    """
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("v")) for k, c in columns.items()])).alias("r")).select(*keys, "r.k", "r.v")
    order = [F.col("k"), F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_last()]
    counts = materialise(with_running(long.groupBy("k", "v").agg(F.count("*").alias("n")), order, F.col("n"), "before", "rank-values"), "rank-totals")
    starts = counts.groupBy("k").agg(F.min("before").alias("start"))
    place = F.col("before") - F.col("start")
    ranks = counts.join(small(starts, len(columns)), "k").select(F.col("k").alias("_k"), F.col("v").alias("_v"), (place + 1 if least else place + (F.col("n") + 1) / 2).alias("rank"))
    found = long.join(ranks, (F.col("k") == F.col("_k")) & F.col("v").eqNullSafe(F.col("_v")))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("k") == k, F.col("rank"))).alias(k) for k in columns])


def _order_statistics(values: DataFrame, places: list[int], n: int, most: int) -> dict[int, float]:
    """The values of one column `v`, without nulls, at the 0-based places of its order.

    A sketch brackets each place, what is in the bracket is counted by value, and where
    that is still more than `most` values the bracket is looked at in the same way.
    """
    out = {}
    for k in sorted(set(places)):
        low, high, below, inside = None, None, 0, n
        rows = values
        while k not in out:
            at = [max(0.0, (k - below) / inside - 2 / ACCURACY), min(1.0, (k - below + 1) / inside + 2 / ACCURACY)]
            cut = rows.agg(F.percentile_approx("v", at, ACCURACY)).first()[0]
            low, high = (cut[0] if at[0] > 0 else low), (cut[1] if at[1] < 1 else high)
            near = values
            if low is not None:
                near = near.filter(F.col("v") >= low)
            if high is not None:
                near = near.filter(F.col("v") <= high)
            below = n - values.filter(F.col("v") >= low).count() if low is not None else 0
            counts = near.groupBy("v").agg(F.count("*").alias("n"))
            sums = counts.agg(F.count("*").alias("kinds"), F.sum("n").alias("rows")).first()
            if sums["kinds"] <= most or sums["rows"] == inside:
                upto = below
                for r in counts.orderBy("v").toLocalIterator():
                    upto += r["n"]
                    if k < upto:
                        out[k] = r["v"]
                        break
            rows, inside = near, sums["rows"]
    return out


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]], bound: int | None = None, most: int = SMALL_VALUES) -> DataFrame:
    """One row of exact quantiles, linear between values: {name: (column, level)}; nulls don't count, no value gives NULL.

    bound: how many rows there can be, if it is known. Up to `most` rows it is one
    aggregation; beyond it values are found by _order_statistics(), column by column.
    """
    if (df.count() if bound is None else bound) <= most:
        return df.agg(*[F.percentile(c, F.lit(q)).alias(n) for n, (c, q) in wanted.items()])
    by_column: dict[str, list[str]] = {}
    for name, (column, _) in wanted.items():
        by_column.setdefault(str(column), []).append(name)
    found: dict[str, float | None] = {}
    for names in by_column.values():
        values = df.select(wanted[names[0]][0].cast("double").alias("v")).filter("v is not null")
        n = values.count()
        at = {name: wanted[name][1] * (n - 1) for name in names}
        known = _order_statistics(values, [f(p) for p in at.values() for f in (floor, ceil)], n, most) if n else {}
        for name, p in at.items():
            low, high = known.get(floor(p)), known.get(ceil(p))
            found[name] = None if low is None else low if low == high else (ceil(p) - p) * low + (p - floor(p)) * high
    return df.sparkSession.createDataFrame([tuple(found[n] for n in wanted)], ", ".join(f"`{n}` double" for n in wanted))
