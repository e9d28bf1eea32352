"""Choices that depend on the size of the data: broadcast or shuffle, salting of hot keys, checkpoints.

Nothing here drops or caps rows: a wrong guess costs time, never a result row.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 128 * 1024 * 1024

HOT_KEYS = 512  # a key outside the 512 hottest holds less than 1/512 of the rows
SAMPLE_ONE_IN = 100
HOT_SAMPLE_ROWS = 20_000  # about two million rows of one key
MAX_SALTS = 256

SALT = "_salt"


def row_id(columns: Sequence[str]) -> Column:
    """A repeatable hash of the row's key; a retried task salts every row as before."""
    return F.xxhash64(*[F.col(c) for c in columns])


def hot_keys(df: DataFrame, keys: Sequence[str], identity: Sequence[str], one_in: int = SAMPLE_ONE_IN,
             floor: int = HOT_SAMPLE_ROWS) -> DataFrame:
    """The hottest keys with the number of salts each gets, at most ``HOT_KEYS`` rows.

    They are looked for in a hash sample of the rows, which only steers the distribution of work: every
    row is still joined.
    """
    sample = df.where(F.pmod(row_id(identity), F.lit(one_in)) == 0) if one_in > 1 else df
    n = F.col("count")
    return (
        sample.groupBy(*keys)
        .count()
        .where(n >= floor)
        .orderBy(n.desc(), *keys)
        .limit(HOT_KEYS)
        .select(*keys, F.least(F.ceil(n * 4 / floor), F.lit(MAX_SALTS)).cast("int").alias("_salts"))
    )


def salt_sides(left: DataFrame, right: DataFrame, keys: Sequence[str], identity: Sequence[str], hot: DataFrame
               ) -> tuple[DataFrame, DataFrame]:
    """Spread the rows of hot keys of ``left`` over salts and repeat the matching ``right`` rows.

    ``hot`` holds the keys and ``_salts``, at most ``HOT_KEYS`` rows, so it is broadcast. Both results carry
    ``_salt``, which the join adds to its keys. ``right`` rows of other keys are not repeated.
    """
    hot = F.broadcast(hot)
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    # a NULL key matches nothing, so its rows may go to any salt
    salts = F.when(no_key, F.lit(MAX_SALTS)).otherwise(F.coalesce(F.col("_salts"), F.lit(1)))
    spread = F.pmod(row_id(identity), salts).cast("int")
    salted = left.join(hot, list(keys), "left").withColumn(SALT, spread).drop("_salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    repeated = right.join(hot, list(keys), "left").withColumn(SALT, copies).drop("_salts")
    return salted, repeated


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Counts the rows (partial counts per task, one number to the driver)."""
    return df.count() <= max_rows


def sized_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, identity: Sequence[str],
               strategy: str = "auto", max_rows: int = BROADCAST_ROWS, one_in: int = SAMPLE_ONE_IN,
               floor: int = HOT_SAMPLE_ROWS) -> DataFrame:
    """Equi-join for ``inner``, ``left``, ``left_semi`` and ``left_anti``.

    ``auto`` leaves the choice to Catalyst and to adaptive execution, which broadcasts a side that turns out
    small and splits skewed partitions of ``left``. In sessions without it, and for ``strategy="sized"``,
    ``right`` is counted: few rows are broadcast, otherwise the hot keys of ``left`` are salted.
    ``broadcast`` and ``shuffle`` take one of these ways without a count.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    if strategy == "auto":
        conf = left.sparkSession.conf
        adaptive = all(conf.get(f"spark.sql.adaptive.{k}", "true") == "true" for k in ("enabled", "skewJoin.enabled"))
        if adaptive:
            return left.join(right, list(keys), how)
        strategy = "sized"
    if strategy == "sized":
        strategy = "broadcast" if fits_broadcast(right, max_rows) else "shuffle"
    if strategy == "broadcast":
        return left.join(F.broadcast(right), list(keys), how)
    salted, repeated = salt_sides(left, right, keys, identity, hot_keys(left, keys, identity, one_in, floor))
    return salted.join(repeated, [*keys, SALT], how).drop(SALT)


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder named by the cluster; a temporary one only in local mode."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder is None and sc.getCheckpointDir() is None and sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="geosieve-checkpoint-")
    if folder is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder or sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame that is read more than once; lazy as before without a shared folder."""
    return df.checkpoint() if checkpoint_dir(df.sparkSession) else df
