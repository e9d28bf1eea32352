"""Filters on streams: bounded batches, geofence, latest filter per layer."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geosieve.layer import Layer
from geosieve.operators.spatial import JoinPlan, plan_join, spatial_filter


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    """A stream of the files of a folder, at most ``max_files`` of them per batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)


def export_stream(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                  transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Filters what has arrived and appends it to files, batch by batch; progress is the query's own."""
    return (
        transform(stream).writeStream.format(fmt).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).outputMode("append").start(path)
    )


def geofence(points: Layer, fences: Layer, predicates=("intersects",), radius=None, plan: JoinPlan | None = None
             ) -> DataFrame:
    """Points, boxes or shapes of a stream that stand in a fence: a semi-join of each batch with the static fences.

    It keeps no state, so every row is judged once, however late it comes and whatever batch it is in. The fences
    are measured once, and joined on grid cells in every batch. Boxes and shapes may have any size up to 4 ** 15 units.
    """
    plan = replace(plan or plan_join(points, fences, radius), hot=())  # cells crowded once need not stay so
    return spatial_filter(points, fences, predicates, radius, plan=plan)


def latest_stream(log: DataFrame, path: str, checkpoint: str, key: Sequence[str] = ("project", "layer"),
                  order: str = "seq_order", merge_every: int = 16) -> StreamingQuery:
    """Keeps the latest entry per key of an append-only stream.

    Every batch is reduced to one row per key and written to a folder of its own, overwritten when the batch is
    retried. Each ``merge_every`` batches are merged with the state before them into one of two state folders by
    turns; batch folders are used anew once two states hold what is in them. So there are never more than
    ``2 * merge_every + 2`` folders, and ``read_latest`` takes the maximum over them.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        latest = latest_of(batch, key, order)
        folder = lambda i: f"{path}/slot=batch{i % (2 * merge_every)}"
        latest.write.mode("overwrite").parquet(folder(batch_id))
        block, place = divmod(batch_id, merge_every)
        if place == merge_every - 1:
            parts = [folder(i) for i in range(block * merge_every, batch_id + 1)]
            parts += [f"{path}/slot=state{(block - 1) % 2}"] if block else []
            whole = batch.sparkSession.read.schema(latest.schema).parquet(*parts)
            latest_of(whole, key, order).write.mode("overwrite").parquet(f"{path}/slot=state{block % 2}")

    return (
        log.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latest_of(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_e")).select(*key, "_e.*")


def read_latest(spark: SparkSession, path: str, key: Sequence[str] = ("project", "layer"),
                order: str = "seq_order") -> DataFrame:
    return latest_of(spark.read.parquet(path).drop("slot"), key, order)
