"""Order-dependent columns without a task per group: rank, previous row and islands over range buckets.

A group may hold a third of all rows. Rows are therefore cut into buckets that follow the order (a day, a
range of ids); windows run inside (group, bucket), and only one summary row per bucket is carried over.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"


def _named(order: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in order]


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys are equal; the result has the keys of ``left``."""
    other = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    test = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_same_{k}`")) for k in keys])
    return left.join(other, test, how).drop(*[f"_same_{k}" for k in keys])


def bucketed_rank(df: DataFrame, group: Sequence[str], order: Sequence[str], bucket: Column,
                  name: str = "rank") -> DataFrame:
    """Row number within the group; ``bucket`` must never fall when the order rises."""
    rows = df.withColumn(BUCKET, bucket)
    inner = Window.partitionBy(*group, BUCKET).orderBy(*_named(order))
    local = rows.withColumn("_local", F.row_number().over(inner))
    before = Window.partitionBy(*group).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*group, BUCKET).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = same_keys(local, sizes, [*group, BUCKET])
    return joined.withColumn(name, F.col("_local") + F.col("_before")).drop("_local", "_before", BUCKET)


def bucketed_neighbour(df: DataFrame, group: Sequence[str], order: Sequence[str], bucket: Column,
                       values: dict[str, str], step: int = -1) -> DataFrame:
    """Values of the previous (``step=-1``) or next (``step=1``) row of the group, NULL at its end.

    ``values`` maps new columns to the columns they are taken from.
    """
    rows = df.withColumn(BUCKET, bucket)
    inner = Window.partitionBy(*group, BUCKET).orderBy(*_named(order))
    pick = F.struct(*[F.col(src).alias(new) for new, src in values.items()])
    # the nearest row of the bucket that comes before (or after) this one in the group
    edge = (F.max_by if step < 0 else F.min_by)(pick, F.struct(*_named(order)))
    per_bucket = rows.groupBy(*group, BUCKET).agg(edge.alias("_edge"))
    outer = Window.partitionBy(*group).orderBy(BUCKET)
    shift = F.lag if step < 0 else F.lead
    per_bucket = per_bucket.withColumn("_far", shift("_edge").over(outer)).drop("_edge")
    near = rows.withColumn("_near", shift(pick).over(inner))
    found = same_keys(near, per_bucket, [*group, BUCKET]).withColumn("_found", F.coalesce("_near", "_far"))
    return found.withColumns({new: F.col("_found")[new] for new in values}).drop("_near", "_far", "_found", BUCKET)


def id_ranges(ids: DataFrame, column: str, bucket_size: int = 1_000_000) -> DataFrame:
    """Islands of consecutive ids as (start, end), of a set of ids of any size.

    Inside a bucket of ids an island is what keeps ``id - row_number`` equal. Islands that touch the two
    sides of a bucket border are stitched over the bucket summaries, at most two rows per bucket.
    """
    c = F.col(column)
    rows = ids.select(c).where(c.isNotNull()).distinct().withColumn(BUCKET, F.floor(c / bucket_size))
    inner = Window.partitionBy(BUCKET).orderBy(c)
    local = (
        rows.withColumn("_island", c - F.row_number().over(inner))
        .groupBy(BUCKET, "_island")
        .agg(F.min(c).alias("start"), F.max(c).alias("end"))
    )
    low, high = F.col(BUCKET) * bucket_size, (F.col(BUCKET) + 1) * bucket_size - 1
    at_border = (F.col("start") == low) | (F.col("end") == high)
    inside = local.where(~at_border).select("start", "end")
    # border islands only: their number is bounded by the number of buckets, not of ids
    border = local.where(at_border).select("start", "end")
    order = Window.orderBy("start")
    breaks = F.coalesce((F.col("start") > F.lag("end").over(order) + 1).cast("int"), F.lit(1))
    stitched = (
        border.withColumn("_new", breaks)
        .withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("_run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("_run")
    )
    return inside.unionByName(stitched)


def range_rule(ids: DataFrame, column: str, bucket_size: int = 1_000_000) -> DataFrame:
    """One row that says how an id set is best written: ``ranges``, ``range_with_gaps`` or ``ids``."""
    found = id_ranges(ids, column, bucket_size).agg(
        F.count("*").alias("n_ranges"),
        F.sum(F.col("end") - F.col("start") + 1).alias("n_ids"),
        F.min("start").alias("lowest"), F.max("end").alias("highest"))
    span = F.col("highest") - F.col("lowest") + 1
    gaps = span - F.col("n_ids")
    # The thresholds of the rule.
    one_range = (F.col("n_ids") >= 20) & (F.col("n_ids") / span >= 0.5) & (gaps < F.col("n_ids") / 4)
    few_ranges = (F.col("n_ids") > 500) & (F.col("n_ranges") < F.col("n_ids") / 3)
    rule = F.when(one_range, F.lit("range_with_gaps")).when(few_ranges, F.lit("ranges")).otherwise(F.lit("ids"))
    return found.withColumns({"n_gaps": gaps, "form": rule})


def exact_median(df: DataFrame, group: Sequence[str], value: str, name: str = "median", buckets: int = 128,
                 weight: str | None = None) -> DataFrame:
    """(group, median) over the non-NULL values, exact as doubles, without sorting a group in one task.

    With ``weight`` the rows are distinct values of a group already, and the column says how often each occurs.

    Equal values are counted first. A group's distinct values are cut at approximate quantiles of theirs, so that
    outliers crowd no bucket; the bucket of the middle rank is found from the bucket counts, and only its distinct
    values are ranked. Rows of the NULL group are a group.
    """
    group = list(group)
    present = df.where(F.col(value).isNotNull())
    v = F.col(value).cast("double").alias("_v")
    if weight is None:
        counted = present.groupBy(*group, v).agg(F.count("*").alias("_n"))
    else:
        counted = present.select(*group, v, F.col(weight).alias("_n"))
    cuts = F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], F.lit(100 * buckets))
    spans = counted.groupBy(*group).agg(F.sum("_n").alias("_total"), F.array_distinct(cuts).alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda cut: cut <= F.col("_v")))
    placed = same_keys(counted, spans, group).withColumn(BUCKET, below).drop("_cuts")
    per_bucket = placed.groupBy(*group, BUCKET).agg(F.sum("_n").alias("_m"), F.max("_total").alias("_total"))
    before = Window.partitionBy(*group).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("_start", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    first, second = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    end = F.col("_start") + F.col("_m")
    middle = per_bucket.where(((first >= F.col("_start")) & (first < end)) | (
        (second >= F.col("_start")) & (second < end))).select(*group, BUCKET, "_start")
    inner = Window.partitionBy(*group, BUCKET).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = same_keys(placed, middle, [*group, BUCKET]).withColumn("_end", F.col("_start") + F.sum("_n").over(inner))
    holds = [(rank >= F.col("_end") - F.col("_n")) & (rank < F.col("_end")) for rank in (first, second)]
    return ranked.groupBy(*group).agg(
        ((F.max(F.when(holds[0], F.col("_v"))) + F.max(F.when(holds[1], F.col("_v")))) / 2).alias(name))
