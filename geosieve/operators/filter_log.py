"""Queries over the filter history, layer properties and saved filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geosieve.layer import Layer
from geosieve.operators.windows import bucketed_neighbour

LAYER_KEY = ("project", "layer")
SEQ_BUCKET = 1_000_000


def last_filters(log: DataFrame, n: int = 1, key: Sequence[str] = LAYER_KEY) -> DataFrame:
    """The last ``n`` entries per layer.

    One entry is a plain aggregate. More of them are a ranked window, which Spark cuts to ``n`` rows per
    layer and task before the shuffle, so that a busy layer stays small.
    """
    if n == 1:
        rest = [c for c in log.columns if c not in key]
        last = F.max_by(F.struct(*rest), "seq_order")
        return log.groupBy(*key).agg(last.alias("_e")).select(*key, "_e.*").select(*log.columns)
    newest = Window.partitionBy(*key).orderBy(F.col("seq_order").desc())
    return log.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")


def reset_filter(layer: Layer, log: DataFrame, key: dict[str, object]) -> Layer:
    """The layer under its last saved filter; ``key`` says which entries of the log are the layer's.

    One row of the log reaches the driver. A layer without an entry, or with an empty one, is unfiltered.
    """
    own = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in key.items()])
    saved = log.where(own).agg(F.max_by("subset_string", "seq_order")).first()[0]
    return layer.where(saved) if saved and saved.strip() else layer


def filter_counts(log: DataFrame, key: Sequence[str] = LAYER_KEY) -> DataFrame:
    return log.groupBy(*key).agg(F.count("*").alias("n_entries"))


def with_previous(log: DataFrame, key: Sequence[str] = LAYER_KEY) -> DataFrame:
    """Every entry with the filter that was set before it on the same layer."""
    return bucketed_neighbour(log, key, ["seq_order"], F.floor(F.col("seq_order") / SEQ_BUCKET),
                              {"previous_subset": "subset_string"})


def latest_properties(properties: DataFrame, order: str, key: Sequence[str] = (*LAYER_KEY, "meta_type", "meta_key"),
                      value: str = "meta_value") -> DataFrame:
    """Last write wins: one value per property."""
    return properties.groupBy(*key).agg(F.max_by(value, order).alias(value))


def properties_wide(latest: DataFrame, names: Sequence[str], key: Sequence[str] = LAYER_KEY) -> DataFrame:
    """One row per layer, one column per property name."""
    return latest.groupBy(*key).pivot("meta_key", list(names)).agg(F.first("meta_value", ignorenulls=True))


def search_favourites(favourites: DataFrame, text: str) -> DataFrame:
    """Text found in the name, the expression or any tag, whatever the case."""
    q = F.lit(text.lower())
    found = lambda c: F.contains(F.lower(c), q)
    hit = found(F.col("name")) | found(F.col("expression")) | F.exists("tags", found)
    return favourites.where(hit)


def recent_favourites(favourites: DataFrame, k: int = 10) -> DataFrame:
    used = favourites.where(F.col("last_used_at").isNotNull())
    return used.orderBy(F.col("last_used_at").desc(), "id").limit(k)


def most_used_favourites(favourites: DataFrame, k: int = 10) -> DataFrame:
    return favourites.orderBy(F.col("use_count").desc(), "id").limit(k)


def usage_summary(favourites: DataFrame) -> DataFrame:
    """Total, sum of uses, most used and last used favourite; ties go to the lowest id."""
    by_use = F.struct(F.col("use_count"), -F.col("id"))
    by_time = F.struct(F.col("last_used_at"), -F.col("id"))
    used = F.col("last_used_at").isNotNull()
    return favourites.agg(
        F.count("*").alias("total_count"), F.sum("use_count").alias("total_uses"),
        F.max_by("name", by_use).alias("most_used"), F.max("use_count").alias("most_used_count"),
        F.max_by("name", F.when(used, by_time)).alias("recently_used"))


def import_favourites(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing favourites and the new ones; a name that exists, or came before, is skipped."""
    rest = [c for c in incoming.columns if c != "name"]
    first = incoming.groupBy("name").agg(F.min_by(F.struct(*rest), "id").alias("_f")).select("name", "_f.*")
    fresh = first.join(existing.select("name").distinct(), "name", "left_anti")
    return existing.unionByName(fresh.select(*existing.columns), allowMissingColumns=True)
