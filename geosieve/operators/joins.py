"""Key joins: lookups of related layers, counts of related rows, orphans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geosieve.layer import Layer
from geosieve.sizing import sized_join


def in_subquery(layer: Layer, sub: DataFrame, on: dict[str, str], negate: bool = False,
                strategy: str = "auto") -> DataFrame:
    """Rows with (or without) a match: ``EXISTS`` / ``NOT EXISTS``; ``on`` maps layer to sub columns."""
    keys = sub.select(*[F.col(right).alias(left) for left, right in on.items()]).dropna().distinct()
    how = "left_anti" if negate else "left_semi"
    return sized_join(layer.df, keys, list(on), how, layer.pk, strategy)


def value_relation(layer: Layer, column: str, related: DataFrame, key: str, value: str, alias: str | None = None,
                   strategy: str = "auto") -> DataFrame:
    """Adds the value a related layer shows for ``column``; its key must be unique."""
    lookup = related.select(F.col(key).alias(column), F.col(value).alias(alias or f"{column}_value"))
    return sized_join(layer.df, lookup, [column], "left", layer.pk, strategy)


def related_aggregates(parent: Layer, child: DataFrame, on: dict[str, str], aggregates: Sequence[Column],
                       strategy: str = "auto") -> DataFrame:
    """Every parent row with aggregates over its child rows (NULL without any).

    The child is aggregated before the join, so a parent with very many rows stays one row per task.
    """
    keys = [F.col(right).alias(left) for left, right in on.items()]
    per_key = child.groupBy(*keys).agg(*aggregates)
    return sized_join(parent.df, per_key, list(on), "left", parent.pk, strategy)


def related_counts(parent: Layer, child: DataFrame, on: dict[str, str], name: str = "n",
                   strategy: str = "auto") -> DataFrame:
    counted = related_aggregates(parent, child, on, [F.count("*").alias(name)], strategy)
    return counted.withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def orphans(child: Layer, parent: DataFrame, on: dict[str, str], strategy: str = "auto") -> DataFrame:
    """Child rows whose parent does not exist (a NULL reference counts as one)."""
    return in_subquery(child, parent, on, negate=True, strategy=strategy)
