"""Exact percentiles of groups of any size: equal values are counted once, and counts added up over ranges of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.scan import running_sums
from lanewise.operators.storage import saved

#: Ranges that values are cut into, and rows that one task may put in order.
RANGES, MOST_ROWS = 256, 4_000_000
#: Accuracy of the quantile sketch: ranks are off by rows / ACCURACY at most.
ACCURACY = 10_000


def narrowed(values: DataFrame, targets: DataFrame, most: int = MOST_ROWS, ranges: int = RANGES) -> tuple[DataFrame, DataFrame]:
    """``values`` (k, v) and ``targets`` (k, rank from 0), cut down to ranges of about ``most`` rows that hold the wanted ranks.

    In each round a mergeable quantile sketch gives every group's splitters, so ranges hold about
    equally many rows however the values are spread; rows by range are counted exactly, and only ranges with
    a wanted rank stay, as groups of their own. A value that many rows share becomes a splitter, and its rows a
    range that needs no order: rounds end when all other ranges are small.
    """
    grid = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    targets = targets.select("k", "rank", F.col("k").alias("of"), F.col("rank").alias("asked"))
    while True:
        sizes = values.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        if sizes.where((F.col("n") > most) & (F.col("lo") < F.col("hi"))).isEmpty():
            return values, targets
        cuts = values.groupBy("k").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", grid, F.lit(ACCURACY)))).alias("cuts"))
        # A value's range: the splitters below it, and whether it is one itself, so that a frequent value stands alone.
        below = F.size(F.filter("cuts", lambda c: c < F.col("v")))
        number = 2 * below + F.array_contains("cuts", F.col("v")).cast("int")
        placed = values.join(cuts, "k").select("k", number.alias("range"), "v")
        counts = placed.groupBy("k", "range").agg(F.count("*").alias("here"))
        until = F.sum("here").over(Window.partitionBy("k").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("until", until).withColumn("before", F.col("until") - F.col("here"))
        met = targets.join(counts, "k").where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("until")))
        inner = F.concat_ws("/", "k", F.col("range").cast("string"))
        targets = saved(met.select(inner.alias("k"), (F.col("rank") - F.col("before")).alias("rank"), "of", "asked"), "targets")
        values = saved(placed.withColumn("k", inner).join(targets.select("k").distinct(), "k", "left_semi").select("k", "v"), "ranges")


def exact_percentiles(rows: DataFrame, by: str, value: str, wanted: dict[str, float], most: int = MOST_ROWS, ranges: int = RANGES) -> DataFrame:
    """(by, one column for each of ``wanted``): percentiles with linear interpolation, as of the sorted values.

    Null and NaN values take no part; groups without others have no row. Rows are read once: equal values are
    counted in each task before they are shuffled, and all that follows reads distinct values only. Where a group has
    more than ``most`` of them, their counts are added up in ``ranges`` ranges of values, so that no group is one task's.
    """
    v = F.col(value).cast("double")
    counts = rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(F.col(by).alias("g"), v.alias("v")).agg(F.count("*").alias("n"))
    counts = saved(counts.select(F.to_json(F.struct("g")).alias("k"), "g", "v", "n"), "counts")
    totals = counts.groupBy("k").agg(F.first("g").alias("g"), F.sum("n").alias("total"), F.count("*").alias("distinct"))
    at = lambda q: F.lit(q) * (F.col("total") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at(q)).cast("long"), F.ceil(at(q)).cast("long")) for q in wanted.values()])))
    if totals.where(F.col("distinct") > most).isEmpty():
        ended = counts.withColumn("end", F.sum("n").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        ended = running_sums(counts.select("k", "v", "n"), ["k"], [F.col("v")], {"end": "n"}, ranges)
    found = ended.join(totals.select("k", ranks.alias("asked")), "k").select("k", "v", F.explode(F.filter("asked", lambda r: (r < F.col("end")) & (r >= F.col("end") - F.col("n")))).alias("rank"))
    known = found.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("known")).join(totals, "k")

    def percentile(q: float):
        low, high = F.floor(at(q)).cast("long"), F.ceil(at(q)).cast("long")
        a, b = F.element_at("known", low), F.element_at("known", high)
        return a + (b - a) * (at(q) - low)

    return known.select(F.col("g").alias(by), *[percentile(q).alias(name) for name, q in wanted.items()])
