"""Registered queries: scans, exports, attribute filters, key joins, combinations, selections."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from geosieve.functions import expressions as ex
from geosieve.functions import geometry as geo
from geosieve.functions.crs import METRIC
from geosieve.functions.wkb import to_wkb
from geosieve.layer import Layer
from geosieve.operators import filter_log as lg
from geosieve.operators import filters as fl
from geosieve.operators import joins as jn
from geosieve.plans import layers as ly
from geosieve.plans.registering import register
from geosieve.sizing import checkpoint_dir
from geosieve.sources import readers as rd
from geosieve.sources import writers as wr

col = F.col


def plain(spark, sf_dir, name: str, *pk: str) -> Layer:
    return Layer(ly.table(spark, sf_dir, name), pk, None, "", name)


def customers(spark, sf_dir):
    return plain(spark, sf_dir, "customer", "c_custkey")


def parts(spark, sf_dir):
    return plain(spark, sf_dir, "part", "p_partkey")


def orders(spark, sf_dir):
    return plain(spark, sf_dir, "orders", "o_orderkey")


# --- scans and sinks ---------------------------------------------------------------------------------


@register("s1_scan_layer", f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, x, y FROM {ly.ORDER_POINTS} t")
def s1(spark, sf_dir):
    df = rd.read_table(spark, "parquet", f"{sf_dir}/orders.parquet")
    layer = ly.order_points(spark, sf_dir).with_df(df.withColumns({
        "x": ((col("o_orderkey") * 7919 + col("o_custkey") * 31) % 10000) / 10,
        "y": ((col("o_custkey") * 104729 + col("o_orderkey") * 17) % 10000) / 10}))
    return rd.scan(layer, fields=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])


@register("s1_wkb_layer", f"""
SELECT p_partkey, CASE kind WHEN 'holed' THEN 260 WHEN 'ell' THEN 224 ELSE 324 END * unit * unit AS area,
  CASE kind WHEN 'holed' THEN 10 WHEN 'ell' THEN 7 ELSE 5 END AS corners, x0 + unit AS xmin, y0 + unit AS ymin
FROM {ly.PART_SHAPES} s""")
def s1_wkb(spark, sf_dir):
    """Shapes written as WKB in Parquet, as databases and GeoParquet hold them, and read back as a layer."""
    shapes, folder = ly.part_shapes(spark, sf_dir), f"{checkpoint_dir(spark)}/wkb-{uuid.uuid4().hex}"
    shapes.df.select("p_partkey", to_wkb(col("geom")).alias("geometry")).write.parquet(folder)
    layer = rd.read_layer(spark, "geoparquet", folder, ("p_partkey",))
    xmin, ymin, *_ = geo.bbox(col("geom"))
    return layer.df.select("p_partkey", geo.area(col("geom")).alias("area"), geo.num_points(col("geom")).alias("corners"),
                           xmin.alias("xmin"), ymin.alias("ymin"))


@register("s2_projected_scan", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000
ORDER BY o_orderkey LIMIT 1000""")
def s2(spark, sf_dir):
    return rd.scan(ly.order_points(spark, sf_dir), "o_orderstatus = 'F' AND o_totalprice > 100000",
                   ["o_orderkey", "o_totalprice"], limit=1000, geometry=False, order_by=["o_orderkey"])


def _batch_totals(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"rows": [len(batch)], "quantity": [batch["l_quantity"].sum()]})


@register("s3_batches", "SELECT count(*) AS n_rows, sum(l_quantity) AS quantity FROM lineitem")
def s3(spark, sf_dir):
    df = ly.table(spark, sf_dir, "lineitem").select("l_quantity")
    batches = rd.map_batches(df, _batch_totals, "rows long, quantity double", 10000)
    return batches.agg(F.sum("rows").alias("n_rows"), F.sum("quantity").alias("quantity"))


@register("s4_export_reprojected", f"""
SELECT o_orderkey, round(lon * (6378137.0 * pi() / 180), 4) AS lon,
  round(ln(tan(pi() / 4 + lat * pi() / 360)) * 6378137.0, 4) AS lat
FROM {ly.LONLAT_POINTS} t WHERE o_orderstatus = 'O'""")
def s4(spark, sf_dir):
    layer = ly.lonlat_points(spark, sf_dir).where("o_orderstatus = 'O'")
    return wr.export_frame(layer, METRIC).select("o_orderkey", F.round("lon", 4).alias("lon"),
                                                 F.round("lat", 4).alias("lat"))


@register("s5_field_mapping", "SELECT o_orderkey AS order_id, o_totalprice AS price, o_orderdate FROM orders")
def s5(spark, sf_dir):
    layer = ly.order_points(spark, sf_dir)
    named = wr.export_frame(layer, rename={"o_orderkey": "order_id", "o_totalprice": "price"})
    return named.select("order_id", "price", "o_orderdate")


@register("s6_geojson_lines", f"""
SELECT '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || CAST(x AS VARCHAR) || ',' ||
  CAST(y AS VARCHAR) || ']}},"properties":{{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus ||
  '"}}}}' AS value FROM {ly.ORDER_POINTS} t""")
def s6(spark, sf_dir):
    layer = ly.order_points(spark, sf_dir)
    return wr.export_frame(layer.with_df(layer.df.select("o_orderkey", "o_orderstatus", "x", "y")), fmt="geojson")


@register("s7_csv_wkt", f"""
SELECT o_orderkey, 'POINT (' || regexp_replace(printf('%.3f', x), '\\.?0+$', '') || ' ' ||
  regexp_replace(printf('%.3f', y), '\\.?0+$', '') || ')' AS wkt FROM {ly.ORDER_POINTS} t""")
def s7(spark, sf_dir):
    return wr.export_frame(ly.order_points(spark, sf_dir), fmt="csv").select("o_orderkey", "wkt")


@register("s8_batch_export_summary", """
SELECT 'orders: points' AS layer, 'orders_ points' AS file, count(*) AS rows, count(*) * 716 AS bytes FROM orders
UNION ALL SELECT 'parts', 'parts', count(*), count(*) * 780 FROM part""")
def s8(spark, sf_dir):
    return wr.export_summary({"orders: points": ly.order_points(spark, sf_dir), "parts": ly.part_boxes(spark, sf_dir)})


@register("s9_package", f"""
SELECT 'orders' AS layer, o_orderkey, x, y, NULL::BIGINT AS s_suppkey FROM {ly.ORDER_POINTS} t
UNION ALL SELECT 'suppliers', NULL, x, y, s_suppkey FROM {ly.SUPPLIER_POINTS} s""")
def s9(spark, sf_dir):
    both = wr.package({"orders": ly.order_points(spark, sf_dir), "suppliers": ly.supplier_points(spark, sf_dir)})
    return both.select("layer", "o_orderkey", "x", "y", "s_suppkey")


@register("s10_export_estimate", "SELECT count(*) AS rows, CAST(sum(700 + 16) AS BIGINT) AS bytes FROM lineitem")
def s10(spark, sf_dir):
    return wr.export_estimate(ly.line_points(spark, sf_dir))


# --- filters and scalar expressions ------------------------------------------------------------------


@register("f1_attribute_filter", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def f1(spark, sf_dir):
    return fl.where(customers(spark, sf_dir), "c_mktsegment = 'BUILDING' AND c_acctbal > 0").df.select(
        "c_custkey", "c_name")


@register("f2_comparisons", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_quantity BETWEEN 10 AND 20
  AND l_discount NOT BETWEEN 0.02 AND 0.05 AND l_linenumber <> 3 AND l_tax <= 0.06""")
def f2(spark, sf_dir):
    df = ly.table(spark, sf_dir, "lineitem")
    test = ex.all_of([
        ex.compare(col("l_quantity"), "BETWEEN", 10, 20), ex.compare(col("l_discount"), "NOT BETWEEN", 0.02, 0.05),
        ex.compare(col("l_linenumber"), "<>", 3), ex.compare(col("l_tax"), "<=", 0.06)])
    return df.where(test).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("f3_in_list", """
SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#17') AND p_size NOT IN (1, 2, 3)""")
def f3(spark, sf_dir):
    found = fl.by_values(parts(spark, sf_dir), "p_brand", ["Brand#1", "Brand#2", "Brand#17"])
    return found.where(~col("p_size").isin(1, 2, 3)).select("p_partkey", "p_brand")


@register("f4_large_id_list", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (
  SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def f4(spark, sf_dir):
    ids = ly.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(col("l_orderkey").alias("o_orderkey"))
    return fl.by_ids(orders(spark, sf_dir), ids).select("o_orderkey", "o_custkey")


@register("f5_field_values", """
SELECT p_partkey, p_type FROM part WHERE p_type IN (
  SELECT p_type FROM part WHERE p_size > 45 AND p_type IS NOT NULL AND p_type <> '')""")
def f5(spark, sf_dir):
    layer = parts(spark, sf_dir)
    return fl.by_values(layer, "p_type", layer.df.where("p_size > 45").select("p_type")).select("p_partkey", "p_type")


@register("f6_text_patterns", """
SELECT p_partkey, p_name FROM part WHERE (p_name LIKE 'red%' OR p_name ILIKE '%BOLT' OR regexp_matches(p_name, '(?i)^SMALL'))
  AND NOT p_name LIKE '%widget' AND NOT regexp_matches(p_name, 'ring$')""")
def f6(spark, sf_dir):
    name = col("p_name")
    test = ex.any_of([ex.matches(name, "LIKE", "red%"), ex.matches(name, "ILIKE", "%BOLT"),
                      ex.matches(name, "~*", "^SMALL")])
    test = test & ex.matches(name, "NOT LIKE", "%widget") & ex.matches(name, "!~", "ring$")
    return parts(spark, sf_dir).df.where(test).select("p_partkey", "p_name")


@register("f6_similar_to", r"""
SELECT p_partkey, p_brand FROM part WHERE regexp_full_match(p_brand, 'Brand#(1|2).*')""")
def f6_similar(spark, sf_dir):
    return parts(spark, sf_dir).df.where(ex.matches(col("p_brand"), "SIMILAR TO", "Brand#(1|2)%")).select(
        "p_partkey", "p_brand")


@register("f6_similar_to_literal_dots", r"""
SELECT p_partkey FROM part WHERE regexp_full_match(p_brand || '.' || p_size, 'Brand#.*1\.1.')""")
def f6_dots(spark, sf_dir):
    text = F.concat("p_brand", F.lit("."), "p_size")
    return parts(spark, sf_dir).df.where(ex.matches(text, "SIMILAR TO", "Brand#%1.1_")).select("p_partkey")


@register("f7_null_tests", """
SELECT o_orderkey, l_returned IS NULL AS is_missing, l_returned IS NOT NULL AS is_known FROM (
  SELECT o_orderkey, max(l_shipdate) AS l_returned FROM orders
  LEFT JOIN (SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_returnflag = 'R') r ON l_orderkey = o_orderkey GROUP BY 1)
WHERE l_returned IS NULL OR l_returned < TIMESTAMP '1998-01-01'""")
def f7(spark, sf_dir):
    returned = ly.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    df = jn.related_aggregates(orders(spark, sf_dir), returned, {"o_orderkey": "l_orderkey"},
                               [F.max("l_shipdate").alias("l_returned")])
    day = col("l_returned")
    return df.where(day.isNull() | (day < F.lit("1998-01-01").cast("timestamp"))).select(
        "o_orderkey", day.isNull().alias("is_missing"), day.isNotNull().alias("is_known"))


@register("f8_conditionals", """
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 15 THEN 'medium' ELSE 'small' END AS size_class,
  CASE WHEN p_retailprice > 1000 THEN 50 ELSE 1 END AS radius FROM part""")
def f8(spark, sf_dir):
    return parts(spark, sf_dir).df.select(
        "p_partkey", F.when(col("p_size") > 40, "large").when(col("p_size") > 15, "medium").otherwise("small")
        .alias("size_class"), F.when(col("p_retailprice") > 1000, 50).otherwise(1).alias("radius"))


@register("f9_text_as_number", """
SELECT p_partkey, p_brand FROM part WHERE TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) >= 15""")
def f9(spark, sf_dir):
    number = ex.as_number(F.replace(col("p_brand"), F.lit("Brand#"), F.lit("")))
    return parts(spark, sf_dir).df.where(number >= 15).select("p_partkey", "p_brand")


@register("f10_number_as_text", "SELECT o_orderkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) LIKE '%77%'")
def f10(spark, sf_dir):
    return orders(spark, sf_dir).df.where(ex.matches(col("o_orderkey").cast("string"), "LIKE", "%77%")).select(
        "o_orderkey")


@register("f12_text_functions", r"""
SELECT p_partkey, concat_ws(' / ', p_brand, p_type) AS label, coalesce(p_name, '') AS name, upper(p_name) AS up,
  lower(p_type) AS low, trim('  ' || p_name || ' ') AS trimmed, substr(p_name, 2, 3) AS part_text,
  replace(p_name, ' ', '_') AS under, CAST(length(p_name) AS INTEGER) AS n_chars, regexp_matches(p_name, '^[a-m]') AS first_half,
  regexp_replace(p_brand, '[^0-9]+', '', 'g') AS digits, CAST(p_size AS VARCHAR) AS size_text,
  CAST(regexp_replace(p_brand, '[^0-9]+', '', 'g') AS INTEGER) AS brand_no FROM part""")
def f12(spark, sf_dir):
    digits = F.regexp_replace("p_brand", "[^0-9]+", "")
    return parts(spark, sf_dir).df.select(
        "p_partkey", F.concat_ws(" / ", "p_brand", "p_type").alias("label"),
        F.coalesce("p_name", F.lit("")).alias("name"), F.upper("p_name").alias("up"), F.lower("p_type").alias("low"),
        F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"),
        F.substring("p_name", 2, 3).alias("part_text"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("under"),
        F.length("p_name").alias("n_chars"), F.regexp_like("p_name", F.lit("^[a-m]")).alias("first_half"),
        digits.alias("digits"), col("p_size").cast("string").alias("size_text"),
        digits.try_cast("int").alias("brand_no"))


@register("f13_formats", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%d/%m/%Y') AS day_text,
  printf('%.2f', o_totalprice) AS price FROM orders WHERE o_totalprice < 1000000""")
def f13(spark, sf_dir):
    return orders(spark, sf_dir).df.where("o_totalprice < 1000000").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day_text"),
        F.replace(F.format_number("o_totalprice", 2), F.lit(","), F.lit("")).alias("price"))


@register("f14_arithmetic", """
SELECT p_partkey, round((p_retailprice * 1.2 - p_size) / 3 + 1, 6) AS score,
  TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) * 2 AS double_brand FROM part""")
def f14(spark, sf_dir):
    number = ex.as_number(F.replace(col("p_brand"), F.lit("Brand#"), F.lit("")))
    return parts(spark, sf_dir).df.select(
        "p_partkey", F.round((col("p_retailprice") * 1.2 - col("p_size")) / 3 + 1, 6).alias("score"),
        (number * 2).alias("double_brand"))


@register("f15_combinators", """
SELECT p_partkey FROM part WHERE (p_size > 40 OR p_brand = 'Brand#3' OR p_name LIKE 'blue%')
  AND NOT (p_type = 'ECONOMY' OR p_retailprice > 1500)""")
def f15(spark, sf_dir):
    some = ex.any_of(["p_size > 40", "p_brand = 'Brand#3'", "p_name LIKE 'blue%'"])
    return parts(spark, sf_dir).df.where(some & ex.none_of(["p_type = 'ECONOMY'", "p_retailprice > 1500"])).select(
        "p_partkey")


@register("f16_negation", """
SELECT p_partkey FROM part WHERE NOT (nullif(p_size, 7) > 20)""")
def f16(spark, sf_dir):
    return parts(spark, sf_dir).df.where(ex.none_of([F.nullif(col("p_size"), F.lit(7)) > 20])).select("p_partkey")


# --- key joins -----------------------------------------------------------------------------------------


@register("j13_not_exists", """
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def j13(spark, sf_dir):
    urgent = ly.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return jn.in_subquery(customers(spark, sf_dir), urgent, {"c_custkey": "o_custkey"}, negate=True).select(
        "c_custkey", "c_name")


@register("j14_in_subquery", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def j14(spark, sf_dir):
    dear = ly.table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return jn.in_subquery(customers(spark, sf_dir), dear, {"c_custkey": "o_custkey"}).select("c_custkey", "c_name")


@register("j15_value_relation", """
SELECT c_custkey, c_nationkey, n_name AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
WHERE n_name IN ('NATION_3', 'NATION_7', 'NATION_11')""")
def j15(spark, sf_dir):
    shown = jn.value_relation(customers(spark, sf_dir), "c_nationkey", ly.table(spark, sf_dir, "nation"),
                              "n_nationkey", "n_name", "nation")
    return shown.where(col("nation").isin("NATION_3", "NATION_7", "NATION_11")).select(
        "c_custkey", "c_nationkey", "nation")


@register("j16_related_counts", """
SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def j16(spark, sf_dir):
    counted = jn.related_counts(customers(spark, sf_dir), ly.table(spark, sf_dir, "orders"),
                                {"c_custkey": "o_custkey"}, "n_orders")
    return counted.select("c_custkey", "n_orders")


@register("j16_orphans", """
SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (
  SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 1000)""")
def j16_orphans(spark, sf_dir):
    rich = customers(spark, sf_dir).df.where("c_acctbal > 1000")
    return jn.orphans(orders(spark, sf_dir), rich, {"o_custkey": "c_custkey"}).select("o_orderkey", "o_custkey")


# --- combinations --------------------------------------------------------------------------------------

OLD, NEW = "o_totalprice > 200000", "o_orderstatus = 'F'"


def _combined(spark, sf_dir, op):
    return orders(spark, sf_dir).df.where(ex.combine_exprs(OLD, NEW, op)).select("o_orderkey")


for _name, _op, _sql in (
    ("c1_combine_and", "AND", f"({OLD}) AND ({NEW})"),
    ("c1_combine_or", "OR", f"({OLD}) OR ({NEW})"),
    ("c1_combine_and_not", "AND NOT", f"({OLD}) AND NOT ({NEW})"),
    ("c1_combine_replace", "REPLACE", NEW),
    ("c2_default_and", None, f"({OLD}) AND ({NEW})"),
    ("c6_operator_names", "oder", f"({OLD}) OR ({NEW})"),
):
    register(_name, f"SELECT o_orderkey FROM orders WHERE {_sql}")(
        lambda spark, sf_dir, op=_op: _combined(spark, sf_dir, op))


def _key_sets(spark, sf_dir):
    layer = orders(spark, sf_dir)
    lines = ly.table(spark, sf_dir, "lineitem")
    old = lines.where("l_returnflag = 'R'").select(col("l_orderkey").alias("o_orderkey"))
    new = lines.where("l_quantity > 40").select(col("l_orderkey").alias("o_orderkey"))
    return layer, old, new


OLD_KEYS = "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'"
NEW_KEYS = "SELECT l_orderkey FROM lineitem WHERE l_quantity > 40"

for _set in ("UNION", "INTERSECT", "EXCEPT"):
    def _sets(spark, sf_dir, set_op=_set):
        layer, old, new = _key_sets(spark, sf_dir)
        return fl.set_combine(layer, old, new, set_op).select("o_orderkey", "o_totalprice")

    register(f"c3_{_set.lower()}", f"""
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN ({OLD_KEYS} {_set} {NEW_KEYS})""")(_sets)

for _method, _sql in (
    ("new", f"o_orderkey IN ({NEW_KEYS})"),
    ("add", f"o_orderkey IN ({OLD_KEYS}) OR o_orderkey IN ({NEW_KEYS})"),
    ("within", f"o_orderkey IN ({OLD_KEYS}) AND o_orderkey IN ({NEW_KEYS})"),
    ("remove", f"o_orderkey IN ({OLD_KEYS}) AND o_orderkey NOT IN ({NEW_KEYS})"),
):
    def _select(spark, sf_dir, method=_method):
        layer, old, new = _key_sets(spark, sf_dir)
        return fl.select_method(layer, old, new, method).select("o_orderkey")

    register(f"c4_select_{_method}", f"SELECT o_orderkey FROM orders WHERE {_sql}")(_select)


def _chain(spark, sf_dir, strategy):
    layer, old, _ = _key_sets(spark, sf_dir)
    return (
        fl.FilterChain(layer, strategy)
        .add(fl.Filter("custom_expression", "o_totalprice > 350000", "OR"))
        .add(fl.Filter("field_condition", "o_orderstatus = 'O'", "AND"))
        .add(fl.Filter("field_condition", "o_orderstatus = 'F'", "AND"), replace_kind=True)
        .add(fl.Filter("fid_list", old, "AND"))
        .apply().select("o_orderkey")
    )


for _strategy, _sql in (
    ("priority_and", f"o_orderkey IN ({OLD_KEYS}) AND o_orderstatus = 'F' AND o_totalprice > 350000"),
    ("priority_or", f"o_orderkey IN ({OLD_KEYS}) OR o_orderstatus = 'F' OR o_totalprice > 350000"),
    ("custom", f"(o_orderkey IN ({OLD_KEYS}) AND o_orderstatus = 'F') OR o_totalprice > 350000"),
    ("replace", f"o_orderkey IN ({OLD_KEYS}) AND o_orderstatus = 'F' AND o_totalprice > 350000"),
):
    register(f"c5_chain_{_strategy}", f"SELECT o_orderkey FROM orders WHERE {_sql}")(
        lambda spark, sf_dir, strategy=_strategy: _chain(spark, sf_dir, strategy))


@register("c7_unfilter", "SELECT o_orderkey FROM orders")
def c7(spark, sf_dir):
    chain = fl.FilterChain(orders(spark, sf_dir)).add(fl.Filter("field_condition", NEW))
    return chain.clear().apply().select("o_orderkey")


@register("c7_reset", """
SELECT o_orderkey FROM orders WHERE o_orderstatus = (
  SELECT CASE event_id % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END FROM events WHERE user_id % 7 = 2
  ORDER BY ts DESC, event_id DESC LIMIT 1)""")
def c7_reset(spark, sf_dir):
    """The last filter that was saved for one layer of the log."""
    status = F.when(col("event_id") % 3 == 0, "F").when(col("event_id") % 3 == 1, "O").otherwise("P")
    log = ly.table(spark, sf_dir, "events").select(
        (col("user_id") % 7).alias("layer"), F.struct("ts", "event_id").alias("seq_order"),
        F.concat(F.lit("o_orderstatus = '"), status, F.lit("'")).alias("subset_string"))
    return lg.reset_filter(orders(spark, sf_dir), log, {"layer": 2}).df.select("o_orderkey")


# --- selections ------------------------------------------------------------------------------------------


@register("sel1_resolve_subset", "SELECT p_partkey, p_name FROM part WHERE p_size < 10")
def sel1(spark, sf_dir):
    return fl.resolve_source(parts(spark, sf_dir), subset="p_size < 10", expr="p_size > 40").df.select(
        "p_partkey", "p_name")


@register("sel1_resolve_field", "SELECT p_partkey FROM part WHERE p_type IN ('SMALL', 'ECONOMY')")
def sel1_field(spark, sf_dir):
    return fl.resolve_source(parts(spark, sf_dir), field=("p_type", ["SMALL", "ECONOMY", "", None])).df.select(
        "p_partkey")


@register("sel1_resolve_selection", """
SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.09)""")
def sel1_selection(spark, sf_dir):
    picked = ly.table(spark, sf_dir, "lineitem").where("l_discount >= 0.09").select(
        col("l_partkey").alias("p_partkey"))
    return fl.resolve_source(parts(spark, sf_dir), selection=picked, subset="p_size < 10").df.select("p_partkey")


@register("sel1_resolve_all", "SELECT p_partkey FROM part")
def sel1_all(spark, sf_dir):
    return fl.resolve_source(parts(spark, sf_dir)).df.select("p_partkey")


@register("sel2_single", "SELECT * FROM part WHERE p_partkey = 77")
def sel2(spark, sf_dir):
    return fl.single(parts(spark, sf_dir), 77)


@register("sel3_multiple", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (3, 14, 15, 92, 65)")
def sel3(spark, sf_dir):
    return fl.by_ids(parts(spark, sf_dir), [3, 14, 15, 92, 65, None, 3]).select("p_partkey", "p_name")


@register("sel4_custom_expression", "SELECT p_partkey FROM part WHERE p_size * 2 > 60")
def sel4(spark, sf_dir):
    layer = parts(spark, sf_dir)
    shown = layer.with_df(fl.custom(layer, "concat(p_brand, p_type)"))  # a display expression filters nothing
    return fl.custom(shown, "p_size * 2 > 60").select("p_partkey")


@register("sel5_stored_ids", """
SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT event_id FROM events WHERE event_type = 'purchase')""")
def sel5(spark, sf_dir):
    stored = ly.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        col("event_id").alias("o_orderkey"))
    return fl.by_ids(orders(spark, sf_dir), stored).select("o_orderkey")
