"""Running sums and exact percentiles over whole tables, without all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityloom.sources.lineage import stored


def running_sum(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over rows up to each one in the order of by (unique).

    Rows are dealt to tasks by ranges of by; a task sums up its own rows, and the sums
    of the ranges before it, one row a task, are added.
    """
    dealt = stored(df.repartitionByRange(F.col(by)).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_s")).select("_range", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(sums), "_range").withColumn(name, F.col("_before") + inside).drop("_range", "_before")


#: Entries of a sketch: it tells a rank to 1 / ACCURACY of a group's rows.
ACCURACY = 10_000


#: Rows of small groups that a task sorts.
ROWS = 1_000_000


def ranked(df: DataFrame, keys: list[str], value: Column, shares: list[float], ranks, accuracy: int = ACCURACY) -> DataFrame:
    """keys, n, low, high, found: for each group its number of values, the least and largest,
    and the values of the ranks (from 0) that ranks(n, share) names for each share, in order.

    One pass makes mergeable sketches, which bracket all shares of all groups; a second one
    counts equal values within the brackets, and of those between only how many there are.
    So what is sorted of a group is at most 4 / accuracy of its rows for each share, less
    what is equal.  A group of up to 2 accuracy rows is sorted whole, without a sketch, in
    as many tasks as such rows need.  Nulls and not-a-numbers don't count.
    """
    rows = df.select(*keys, value.cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    shares = sorted(shares)
    if not keys:
        return _sketched(rows, keys, shares, ranks, accuracy)
    sizes = stored(rows.groupBy(*keys).agg(F.count("*").alias("_n")), "group-sizes")
    many = F.col("_n") > 2 * accuracy
    for k in keys:  # a group without a key joins nothing, so it is sorted
        many = many & F.col(k).isNotNull()
    few = sizes.where(~many).agg(F.sum("_n")).first()[0]
    large = stored(sizes.where(many).select(*keys), "large-groups")
    if not large.limit(1).count():
        return _sorted(rows, keys, shares, ranks, few)
    sketched = _sketched(rows.join(large, keys, "left_semi"), keys, shares, ranks, accuracy)
    return sketched if not few else sketched.unionByName(_sorted(rows.join(large, keys, "left_anti"), keys, shares, ranks, few))


def _sorted(rows: DataFrame, keys: list[str], shares: list[float], ranks, count: int | None) -> DataFrame:
    """ranked for groups that are small: one exchange, in tasks of about ROWS rows."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), (count or 0) // ROWS + 1)
    group = Window.partitionBy(*keys)
    placed = rows.repartition(tasks, *keys).withColumn("_at", F.row_number().over(group.orderBy("_v")) - 1).withColumn("_n", F.count("*").over(group))
    asked = [F.max(F.when(F.col("_at") == r, F.col("_v"))) for s in shares for r in ranks(F.col("_n"), s)]
    return placed.groupBy(*keys).agg(F.max("_n").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.array(*asked).alias("found"))


def _sketched(rows: DataFrame, keys: list[str], shares: list[float], ranks, accuracy: int) -> DataFrame:
    slack = 2 / accuracy
    points = [p for s in shares for p in (max(0.0, s - slack), min(1.0, s + slack))]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.percentile_approx("_v", points, accuracy).alias("_p"))
    few = F.col("_n") <= 2 * accuracy  # where a step of a sketch is less than two rows
    spans = [(F.when(few | F.lit(s - slack <= 0), F.col("_low")).otherwise(F.col("_p")[2 * i]), F.when(few | F.lit(s + slack >= 1), F.col("_high")).otherwise(F.col("_p")[2 * i + 1])) for i, s in enumerate(shares)]
    sketch = stored(sketch.where("_n > 0").select(*keys, "_n", "_low", "_high", F.array(*[a for a, _ in spans]).alias("_from"), F.array(*[b for _, b in spans]).alias("_to")), "sketches")
    held = rows.join(sketch, keys) if keys else rows.crossJoin(F.broadcast(sketch))  # one row
    within, after = F.lit(False), F.lit(0)
    for i in range(len(shares)):
        within = within | F.col("_v").between(F.col("_from")[i], F.col("_to")[i])
        after = after + (F.col("_v") > F.col("_to")[i]).cast("int")
    kinds = held.groupBy(*keys, "_n", "_low", "_high", F.when(within, F.col("_v")).alias("_x"), F.when(~within, after).alias("_gap")).agg(F.min("_v").alias("_at"), F.count("*").alias("_c"))
    upto = kinds.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_at")))
    asked = [r for s in shares for r in ranks(F.col("_n"), s)]
    first = [F.min(F.when(F.col("_upto") > r, F.struct("_at", F.col("_gap").isNotNull().alias("gap")))) for r in asked]
    sure = [F.when(~c["gap"], c["_at"]).otherwise(F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")) for c in first]
    return upto.groupBy(*keys, "_n", "_low", "_high").agg(F.array(*sure).alias("found")).withColumnsRenamed({"_n": "n", "_low": "low", "_high": "high"})


def quantiles(df: DataFrame, keys: list[str], value: Column, shares: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """keys and a column for each of shares (name to share): the exact, linearly
    interpolated quantiles of each group's values."""
    names = sorted(shares, key=shares.get)
    place = lambda n, s: F.lit(s) * (n - 1)
    both = lambda n, s: (F.floor(place(n, s)), F.least(F.floor(place(n, s)) + 1, n - 1))
    found = ranked(df, keys, value, list(shares.values()), both, accuracy)

    def between(i: int, s: float) -> Column:
        a, b = F.col("found")[2 * i], F.col("found")[2 * i + 1]
        return a + (place(F.col("n"), s) - F.floor(place(F.col("n"), s))) * (b - a)

    made = {name: between(i, shares[name]) for i, name in enumerate(names)}
    return found.select(*keys, *[made[name].alias(name) for name in shares])


def percentile(df: DataFrame, value: Column, share: float) -> float | None:
    """The exact, linearly interpolated percentile of the non-null values; None without any."""
    row = quantiles(df, [], value, {"q": share}).first()
    return row["q"] if row else None
