"""Joins on time: points in intervals, and the last or nearest row as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityloom.sources.lineage import stored


def interval_join(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of points with those of intervals that hold them (start <= at < end; whole numbers).

    An interval lies in one or two bins of the least power of two that is as wide as it is;
    a point asks one bin of each width there is (64 at most).  So it is an equi join whose
    rows follow the intervals' number, however long they are.  Empty intervals and nulls
    match nothing.
    """
    length = F.col(end) - F.col(start)
    level = F.when(length == 1, 0).otherwise(F.length(F.bin(length - 1))).cast("int")
    held = intervals.where(length > 0).withColumn("_level", level)
    widths = sorted(r[0] for r in held.select("_level").distinct().collect())  # 64 at most
    bins = F.array_distinct(F.array(_bin(F.col(start), F.col("_level")), _bin(F.col(end) - 1, F.col("_level"))))
    held = held.withColumn("_bin", F.explode(bins))
    asked = points.withColumn("_level", F.explode(F.array(*map(F.lit, widths)).cast("array<int>")))
    asked = asked.withColumn("_bin", _bin(F.col(at), F.col("_level")))
    return asked.join(held, ["_level", "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_level", "_bin")


def _bin(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x.cast("long"), level)


def as_of(left: DataFrame, at: str, right: DataFrame, time: str, by: tuple[str, ...] = (), direction: str = "backward") -> DataFrame:
    """left with ``found``, a struct of right's columns: its last row no later than at
    (backward), its first no earlier (forward), or the nearer of them (nearest; of equals
    the earlier), among those with equal by; null where there is none.

    All rows are dealt to tasks by ranges of (by, time), equal times too; each range finds
    its own matches, and what the ranges before and after it carry over, one row for each
    range and key, fills the rest.  So neither a key nor a time with many rows meets in
    one task.  Of right's rows with equal by and time, the same one is taken each time.
    Rows whose time is null match nothing.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"no such direction: {direction}")
    lefts, rights = F.struct(*left.columns), F.struct(*right.columns)
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))] or ["_all"]
    kinds = dict(left.withColumn("_l", lefts).dtypes)["_l"], dict(right.withColumn("_r", rights).dtypes)["_r"]
    given = right.where(F.col(time).isNotNull())
    everything = (lambda df: df) if by else (lambda df: df.withColumn("_all", F.lit(0)))
    asked = everything(left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), lefts.alias("_l"), F.lit(None).cast(kinds[1]).alias("_r")))
    sides = {"backward": (0,), "forward": (2,), "nearest": (0, 2)}[direction]
    rows = asked
    for side in sides:
        rows = rows.unionByName(everything(given.select(*keys, F.col(time).alias("_t"), F.lit(side).alias("_side"), F.lit(None).cast(kinds[0]).alias("_l"), rights.alias("_r"))))
    rows = rows.withColumn("_h", F.xxhash64("_l", "_r"))
    order = ["_t", "_side", "_h"]
    dealt = stored(rows.repartitionByRange(*names, *order).withColumn("_range", F.spark_partition_id()), "as-of")
    own, along = Window.partitionBy("_range", *names), Window.partitionBy(*names)
    # Both ways look back, the later one along the reversed order: a frame that runs to the
    # end of its rows would be gone through anew for each row.
    ways = {0: (own.orderBy(*order), along.orderBy("_range"), F.max_by), 2: (own.orderBy(*map(F.desc, order)), along.orderBy(F.desc("_range")), F.min_by)}
    found, ends, place = dealt, [], F.struct(*order)
    for side in sides:
        row = F.when(F.col("_side") == side, F.col("_r"))
        found = found.withColumn(f"_in{side}", F.last(row, ignorenulls=True).over(ways[side][0].rowsBetween(Window.unboundedPreceding, 0)))
        ends.append(ways[side][2](row, F.when(F.col("_side") == side, place)).alias(f"_end{side}"))
    carried = dealt.groupBy(*names, "_range").agg(*ends).select(
        *[F.col(n).alias("c" + n) for n in names], F.col("_range").alias("c_range"),
        *[F.last(f"_end{side}", ignorenulls=True).over(ways[side][1].rowsBetween(Window.unboundedPreceding, -1)).alias(f"_out{side}") for side in sides],
    )
    same = F.col("_range") == F.col("c_range")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col("c" + n))
    found = found.where("_side = 1").join(carried, same)
    b, a = (F.coalesce(f"_in{side}", f"_out{side}") if side in sides else None for side in (0, 2))
    if direction == "nearest":
        pick = F.when(b.isNull(), a).when(a.isNull() | (F.col("_t") - b[time] <= a[time] - F.col("_t")), b).otherwise(a)
    else:
        pick = b if a is None else a
    return found.select("_l.*", F.when(F.col("_t").isNotNull(), pick).alias("found"))
