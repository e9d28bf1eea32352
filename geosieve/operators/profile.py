"""Statistics of layers and filters, each in one pass over the data."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geosieve.functions.expressions import as_column, as_number
from geosieve.layer import Layer
from geosieve.operators.aggregates import extent

# Names of key fields and of display fields.
KEY_NAMES = ("id", "fid", "pk", "gid", "ogc_fid", "objectid", "oid", "rowid")
UUID_PARTS = ("uuid", "guid")
ID_PARTS = ("_id", "id_", "identifier", "feature_id", "object_id")
DISPLAY_PARTS = ("name", "nom", "label", "titre", "title", "description", "desc", "libelle", "libellé",
                 "bezeichnung", "nombre", "nome", "naam", "display_name", "displayname", "full_name", "fullname")
KEY_PARTS = ("id", "pk", "fid", "ogc_fid", "gid", "uid", "uuid", "oid", "objectid", "object_id", "_id", "rowid",
             "row_id")
BYTES_PER_ROW = 100


def layer_stats(layer: Layer) -> DataFrame:
    """Rows, extent and its area, geometry types, mean vertices and complexity of a layer."""
    g = layer.geometry
    x0, y0, x1, y1 = g.bbox()
    kind = F.upper(F.lit({"point": "POINT", "box": "POLYGON"}.get(g.kind))) if g.kind != "shape" else \
        F.col(g.name)["type"]
    n_vertices = F.when(g.present(), g.n_vertices())
    stats = layer.df.agg(
        F.count("*").alias("n_rows"), F.min(x0).alias("xmin"), F.min(y0).alias("ymin"), F.max(x1).alias("xmax"),
        F.max(y1).alias("ymax"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("geometry_types"),
        F.avg(n_vertices).alias("mean_vertices"))
    return stats.withColumns({
        "extent_area": (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")),
        "complexity": F.greatest(F.lit(1.0), F.col("mean_vertices") / 10)})


def column_stats(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """(column, n_distinct, null_frac) for every column.

    The distinct counts are sketches by default, mergeable partial aggregates in one pass. ``exact`` counts
    (column, value) pairs instead, which shuffles each distinct value once.
    """
    columns = list(columns or df.columns)
    if exact:
        cells = F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
        counted = df.select(cells.alias("_c")).select("_c.*").groupBy("column", "value").agg(F.count("*").alias("_n"))
        nulls = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("_n"))), F.lit(0))
        return counted.groupBy("column").agg(
            F.count("value").alias("n_distinct"), (nulls / F.sum("_n")).alias("null_frac"))
    wide = df.agg(*[x for c in columns for x in (
        F.approx_count_distinct(F.col(c)).alias(f"d_{c}"),
        F.avg(F.col(c).isNull().cast("double")).alias(f"n_{c}"))])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"d_{c}").alias("n_distinct"), F.col(f"n_{c}").alias("null_frac"))
        for c in columns])).alias("s")).select("s.*")


def selectivity(df: DataFrame, expression: Column | str, fraction: float | None = None, seed: int = 7) -> DataFrame:
    """Share of rows that pass; on a random sample only where a fraction is given."""
    rows = df.sample(fraction=fraction, seed=seed) if fraction else df
    return rows.agg(F.avg(F.when(as_column(expression), 1.0).otherwise(0.0)).alias("selectivity"))


def spatial_selectivity(source: Layer, target: Layer, predicate: str = "intersects") -> DataFrame:
    """Share of the target's extent under the source's, adjusted to the predicate."""
    s = extent(source).withColumnsRenamed({c: f"s_{c}" for c in ("xmin", "ymin", "xmax", "ymax")})
    both = extent(target).withColumn("_one", F.lit(1)).join(s.withColumn("_one", F.lit(1)), "_one")
    c = F.col
    w = F.least("xmax", "s_xmax") - F.greatest("xmin", "s_xmin")
    h = F.least("ymax", "s_ymax") - F.greatest("ymin", "s_ymin")
    area = (c("xmax") - c("xmin")) * (c("ymax") - c("ymin"))
    share = w * h / area
    # How much stricter than intersects the predicates are, and the bounds of the estimate.
    if predicate in ("contains", "within"):
        share = share * 0.5
    elif predicate == "touches":
        share = share * 0.1
    elif predicate == "disjoint":
        share = 1.0 - share
    clamped = F.greatest(F.lit(0.001), F.least(F.lit(1.0), share))
    return both.select(F.when((w <= 0) | (h <= 0), F.lit(0.0)).when(area <= 0, F.lit(0.5)).otherwise(clamped)
                       .alias("selectivity"))


def key_candidates(df: DataFrame) -> list[tuple[int, str]]:
    """Columns that may be the key with the rank of their rule, best first; read from the schema alone."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}

    def rank(name: str) -> int:
        low = name.lower()
        if low in KEY_NAMES:
            return 1
        if any(p in low for p in UUID_PARTS):
            return 2
        if name in numeric and any(p in low for p in ID_PARTS):
            return 3
        return 4 if name in numeric else 5

    return sorted(((rank(c), c) for c in df.columns), key=lambda rc: rc[0])


def key_report(df: DataFrame) -> DataFrame:
    """The inferred key column and whether it is unique.

    Values are counted per value and the counts are summed, so no task sees all of them.
    """
    rank, name = key_candidates(df)[0]
    per_value = df.groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))
    return per_value.agg(
        F.lit(name).alias("key_column"), F.lit(rank).alias("rule"), F.sum("n").alias("n_rows"),
        F.count("v").alias("n_distinct"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
    ).withColumn("is_unique", (F.col("n_distinct") == F.col("n_rows")))


def text_columns_report(df: DataFrame) -> DataFrame:
    """(column, n_values, numeric_share, numeric_in_disguise) for every text column, in one pass."""
    columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    wide = df.agg(*[x for c in columns for x in (
        F.count(F.when(F.col(c) != "", F.col(c))).alias(f"v_{c}"),
        F.count(as_number(F.col(c))).alias(f"n_{c}"))])
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"v_{c}").alias("n_values"), F.col(f"n_{c}").alias("n_numeric"))
        for c in columns])).alias("s")).select("s.*")
    share = F.when(F.col("n_values") > 0, F.col("n_numeric") / F.col("n_values"))
    return long.select("column", "n_values", share.alias("numeric_share"),
                       F.coalesce(share == 1.0, F.lit(False)).alias("numeric_in_disguise"))


def display_field(df: DataFrame) -> DataFrame:
    """The column to show for a row: a name-like one, else a text one, else the key; it must have values."""
    key = key_candidates(df)[0][1]
    is_text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    plain = [c for c in df.columns if not any(p in c.lower() for p in KEY_PARTS)]
    named = [c for c in plain if any(p in c.lower() for p in DISPLAY_PARTS)]
    ordered = list(dict.fromkeys([*named, *[c for c in plain if c in is_text], key, *df.columns]))
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in ordered])
    first = F.coalesce(*[F.when(F.col(c) > 0, F.lit(c)) for c in ordered])
    return counts.select(first.alias("display_field"))


def reduction_report(df: DataFrame, steps: Sequence[tuple[str, Column | str]]) -> DataFrame:
    """What each step of a filter plan leaves: (step, name, candidates, reduction, saved_mb), in one pass."""
    tests = [as_column(e) for _, e in steps]
    passed = [reduce(lambda a, b: a & b, tests[: i + 1]) for i in range(len(tests))]
    counts = df.agg(F.count("*").alias("n_0"), *[F.count_if(p).alias(f"n_{i + 1}") for i, p in enumerate(passed)])
    rows = []
    for i, (name, _) in enumerate(steps):
        before, after = F.col(f"n_{i}"), F.col(f"n_{i + 1}")
        rows.append(F.struct(
            F.lit(i + 1).alias("step"), F.lit(name).alias("name"), after.alias("candidates"),
            (1.0 - after / F.greatest(before, F.lit(1))).alias("reduction"),
            ((F.col("n_0") - after) * BYTES_PER_ROW / (1024 * 1024)).alias("saved_mb")))
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def filter_type_report(df: DataFrame, expression: str) -> DataFrame:
    """(column, operator, column_type, suggestion, n_values, fitting_share): comparisons of a filter that need a cast.

    A text column compared with a number, or a numeric column compared with a pattern. ``fitting_share`` says which part
    of the column's values survive the suggested cast, so a code like ``B7`` in a text of numbers is seen beforehand.
    Columns inside a cast are not reported; the values of all columns are judged in one pass.
    """
    bare = re.sub(r"'(?:[^']|'')*'", "''", expression)
    number, found = r"-?\d+(?:\.\d+)?", {}
    for f in df.schema:
        name = rf"(?<![\w.])[`\"]?\b{re.escape(f.name)}\b[`\"]?\s*"
        text, numeric = isinstance(f.dataType, T.StringType), isinstance(f.dataType, T.NumericType)
        if text:
            for m in re.finditer(name + rf"(<=|>=|<>|!=|=|<|>|(?:NOT\s+)?BETWEEN)\s*{number}", bare, re.IGNORECASE):
                found[f.name, " ".join(m[1].upper().split())] = "double"
        if numeric:
            for m in re.finditer(name + r"((?:NOT\s+)?(?:LIKE|ILIKE|RLIKE))\b", bare, re.IGNORECASE):
                found[f.name, " ".join(m[1].upper().split())] = "string"
    columns = sorted({c for c, _ in found})
    schema = "column string, operator string, column_type string, suggestion string, n_values long, fitting_share double"
    if not found:
        return df.sparkSession.createDataFrame([], schema)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    fits = {c: F.count(as_number(F.col(f"`{c}`"))) if types[c] == "string" else F.count(F.col(f"`{c}`")) for c in columns}
    sums = df.agg(*[x for i, c in enumerate(columns) for x in (
        F.count(F.nullif(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(f"n{i}"), fits[c].alias(f"f{i}"))])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(op).alias("operator"), F.lit(types[c]).alias("column_type"),
                     F.lit(f"try_cast({c} AS {cast})" if cast == "double" else f"cast({c} AS string)").alias("suggestion"),
                     F.col(f"n{columns.index(c)}").alias("n_values"),
                     (F.col(f"f{columns.index(c)}") / F.nullif(F.col(f"n{columns.index(c)}"), F.lit(0))).alias("fitting_share"))
            for (c, op), cast in sorted(found.items())]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
