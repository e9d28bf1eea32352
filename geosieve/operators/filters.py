"""Attribute filters, selections and the combination of filters by key sets."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geosieve.functions.expressions import as_column, condition, operator_name
from geosieve.layer import Layer
from geosieve.sizing import sized_join

INLINE_IDS = 500  # longer id lists become a table


def where(layer: Layer, expression: Column | str) -> Layer:
    return layer.where(as_column(expression))


def by_ids(layer: Layer, ids: DataFrame | Iterable, strategy: str = "auto") -> DataFrame:
    """Rows whose key is in the ids: up to 500 values inline, more of them (or a frame) as a semi-join."""
    if isinstance(ids, DataFrame):
        keys = ids.select(*layer.pk).dropna().distinct()
        return sized_join(layer.df, keys, layer.pk, "left_semi", layer.pk, strategy)
    (pk,) = layer.pk
    values = [v for v in dict.fromkeys(ids) if v is not None]
    if len(values) <= INLINE_IDS:
        return layer.df.where(F.col(pk).isin(values))
    kind = layer.df.schema[pk].dataType
    keys = layer.df.sparkSession.createDataFrame([(v,) for v in values], f"{pk} {kind.simpleString()}")
    return layer.df.join(F.broadcast(keys), pk, "left_semi")  # the list came from the driver, so it is small


def by_values(layer: Layer, column: str, values: DataFrame | Iterable, strategy: str = "auto") -> DataFrame:
    """Rows whose field is one of the values; NULL and empty text are no values."""
    if isinstance(values, DataFrame):
        found = values.select(F.col(values.columns[0]).alias(column)).where(F.col(column).cast("string") != "")
        return sized_join(layer.df, found.distinct(), [column], "left_semi", layer.pk, strategy)
    kept = [v for v in values if v is not None and v != ""]
    return layer.df.where(F.col(column).isin(kept)) if kept else layer.df.where(F.lit(False))


# --- key sets --------------------------------------------------------------------------------------


def combine(layer: Layer, old: DataFrame | None, new: DataFrame, op: str | None = None,
            strategy: str = "auto") -> DataFrame:
    """Rows of the layer after combining two filter results: AND (default), OR, AND NOT, REPLACE.

    ``old`` and ``new`` need the key columns only.
    """
    keys = combine_keys(layer, old, new, op)
    return sized_join(layer.df, keys, layer.pk, "left_semi", layer.pk, strategy)


def combine_keys(layer: Layer, old: DataFrame | None, new: DataFrame, op: str | None = None) -> DataFrame:
    name = operator_name(op)
    pk = list(layer.pk)
    new = new.select(*pk)
    if old is None or name == "REPLACE":
        return new.distinct()
    old = old.select(*pk)
    if name == "AND":
        return old.intersect(new)
    return old.union(new).distinct() if name == "OR" else old.subtract(new)


def set_combine(layer: Layer, old: DataFrame, new: DataFrame, set_op: str, strategy: str = "auto") -> DataFrame:
    """``UNION``, ``INTERSECT`` or ``EXCEPT`` of two key sets, as rows of the layer."""
    op = {"UNION": "OR", "INTERSECT": "AND", "EXCEPT": "AND NOT"}[set_op.upper()]
    return combine(layer, old, new, op, strategy)


def select_method(layer: Layer, current: DataFrame | None, found: DataFrame, method: int | str,
                  strategy: str = "auto") -> DataFrame:
    """Selection methods 0 new, 1 add, 2 within the current selection, 3 remove from it."""
    op = {0: "REPLACE", "new": "REPLACE", 1: "OR", "add": "OR", 2: "AND", "within": "AND", 3: "AND NOT",
          "remove": "AND NOT"}[method]
    return combine(layer, current, found, op, strategy)


# --- source selection ------------------------------------------------------------------------------


def resolve_source(layer: Layer, ids=None, selection: DataFrame | None = None, subset: Column | str | None = None,
                   field: tuple[str, Iterable] | None = None, expr: Column | str | None = None) -> Layer:
    """The source rows of a filter; the first argument given decides, none of them means all rows."""
    if ids is not None:
        return layer.with_df(by_ids(layer, ids))
    if selection is not None:
        return layer.with_df(by_ids(layer, selection))
    if subset is not None:
        return layer.where(as_column(subset))
    if field is not None:
        return layer.with_df(by_values(layer, *field))
    return layer.with_df(custom(layer, expr))


def single(layer: Layer, value) -> DataFrame:
    (pk,) = layer.pk
    return layer.df.where(F.col(pk) == value)


def custom(layer: Layer, expr: Column | str | None) -> DataFrame:
    """Rows for which a boolean expression holds; a field or display expression keeps all rows."""
    test = condition(layer.df, expr)
    return layer.df if test is None else layer.df.where(test)


# --- typed filter chain -----------------------------------------------------------------------------

# Filter kinds and their priorities.
PRIORITIES = {
    "materialized_view": 100,
    "bbox_filter": 90,
    "spatial_selection": 80,
    "fid_list": 70,
    "buffer_intersect": 60,
    "spatial_relation": 60,
    "field_condition": 50,
    "user_selection": 40,
    "custom_expression": 30,
}
STRATEGIES = ("priority_and", "priority_or", "custom", "replace")


@dataclass(frozen=True)
class Filter:
    """One filter of a chain: a boolean Column, or a frame with the keys that pass."""

    kind: str
    test: Column | str | DataFrame
    op: str = "AND"
    priority: int | None = None

    def __post_init__(self):
        if self.kind not in PRIORITIES:
            raise ValueError(f"unknown filter kind {self.kind!r}")
        if isinstance(self.test, str) and not self.test.strip():
            raise ValueError("empty filter")
        if self.priority is None:
            object.__setattr__(self, "priority", PRIORITIES[self.kind])


@dataclass(frozen=True)
class FilterChain:
    """Filters of several kinds on one layer, combined in the order of their priority."""

    layer: Layer
    strategy: str = "priority_and"
    filters: tuple[Filter, ...] = field(default=())

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}")

    def add(self, new: Filter, replace_kind: bool = False) -> FilterChain:
        kept = self.remove(new.kind).filters if replace_kind else self.filters
        return replace(self, filters=(*kept, new))

    def remove(self, kind: str) -> FilterChain:
        return replace(self, filters=tuple(f for f in self.filters if f.kind != kind))

    def clear(self) -> FilterChain:
        return replace(self, filters=())

    def ordered(self) -> Sequence[Filter]:
        return sorted(self.filters, key=lambda f: -f.priority)

    def apply(self) -> DataFrame:
        """The layer's rows that pass.

        When every filter must hold, key frames are semi-joins and Catalyst orders the rest. Otherwise each
        key frame becomes a flag column through a left join on its distinct keys.
        """
        df, columns, pk = self.layer.df, self.layer.df.columns, self.layer.pk
        steps = self.ordered()
        if not steps:
            return df
        all_must = self.strategy in ("priority_and", "replace") or all(
            operator_name(f.op) == "AND" for f in steps[1:]) and self.strategy == "custom"
        if all_must:
            for f in steps:
                if isinstance(f.test, DataFrame):
                    df = sized_join(df, f.test.select(*pk).distinct(), pk, "left_semi", pk)
                else:
                    df = df.where(as_column(f.test))
            return df
        result = None
        for i, f in enumerate(steps):
            if isinstance(f.test, DataFrame):
                flag = f"_hit{i}"
                keys = f.test.select(*pk).distinct().withColumn(flag, F.lit(True))
                df = sized_join(df, keys, pk, "left", pk)
                test = F.coalesce(F.col(flag), F.lit(False))
            else:
                test = as_column(f.test)
            if result is None:
                result = test
            elif self.strategy == "priority_or":
                result = result | test
            else:
                name = operator_name(f.op)
                result = {"AND": lambda: result & test, "OR": lambda: result | test,
                          "AND NOT": lambda: result & ~test, "NOT": lambda: result & ~test,
                          "REPLACE": lambda: test}[name]()
        return df.where(result).select(*columns)
