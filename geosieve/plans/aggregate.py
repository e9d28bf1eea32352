"""Registered queries: aggregates, profiling, id ranges, filter log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.layer import BoxColumns, Layer, ShapeColumn
from geosieve.operators import aggregates as ag
from geosieve.operators import filter_log as lg
from geosieve.operators import joins as jn
from geosieve.operators import overlay as ov
from geosieve.operators import profile as pf
from geosieve.operators import windows as wn
from geosieve.plans import layers as ly
from geosieve.plans.attribute import customers, parts
from geosieve.plans.registering import register

col = F.col


# --- aggregates ------------------------------------------------------------------------------------


@register("a1_unique_values", "SELECT DISTINCT CAST(p_size AS VARCHAR) AS value FROM part WHERE p_size IS NOT NULL")
def a1(spark, sf_dir):
    return ag.unique_values(ly.table(spark, sf_dir, "part"), "p_size")


@register("a2_display_list", """
SELECT p_partkey, p_name || ' (' || p_brand || ')' AS display, p_size > 25 AS in_subset FROM part""")
def a2(spark, sf_dir):
    layer = parts(spark, sf_dir)
    return ag.display_list(layer, "concat(p_name, ' (', p_brand, ')')", "DESC", layer.df.where("p_size > 25"))


@register("a3_search", "SELECT c_custkey, c_name AS display FROM customer WHERE contains(lower(c_name), 'r#0000000')")
def a3(spark, sf_dir):
    listed = ag.display_list(customers(spark, sf_dir), "c_name")
    return ag.search(listed, "R#0000000").select("c_custkey", "display")


@register("a4_extent", f"""
SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM {ly.PART_BOXES} t
WHERE p_type = 'SMALL'""")
def a4(spark, sf_dir):
    return ag.extent(ly.part_boxes(spark, sf_dir).where("p_type = 'SMALL'"))


_GROW = "greatest((xmax - xmin) * 0.1, (ymax - ymin) * 0.1, 5.0)"


@register("a5_padded_extents", f"""
SELECT p_partkey, round(xmin - {_GROW}, 6) AS xmin, round(ymin - {_GROW}, 6) AS ymin, round(xmax + {_GROW}, 6) AS xmax,
  round(ymax + {_GROW}, 6) AS ymax FROM {ly.PART_BOXES} t""")
def a5(spark, sf_dir):
    boxes = ag.padded_extents(ly.part_boxes(spark, sf_dir))
    return boxes.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@register("a5_padded_points", f"""
SELECT min(x) - 50 AS xmin, min(y) - 50 AS ymin, max(x) + 50 AS xmax, max(y) + 50 AS ymax FROM {ly.ORDER_POINTS} t
WHERE o_orderstatus = 'P'""")
def a5_points(spark, sf_dir):
    return ag.padded_extent(ly.order_points(spark, sf_dir).where("o_orderstatus = 'P'"))


@register("a6_count", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25")
def a6(spark, sf_dir):
    return ag.count(ly.line_points(spark, sf_dir).where("l_quantity > 25"))


@register("a6_count_distinct", "SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
def a6_distinct(spark, sf_dir):
    return ag.count(ly.line_points(spark, sf_dir), "l_partkey")


@register("a7_display_aggregates", """
SELECT o_orderpriority, round(sum(o_totalprice), 2) AS sum_value, count(o_totalprice) AS count_value,
  round(avg(o_totalprice), 4) AS avg_value, min(o_totalprice) AS min_value, max(o_totalprice) AS max_value
FROM orders GROUP BY 1""")
def a7(spark, sf_dir):
    found = ag.display_aggregates(ly.table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return found.withColumns({"sum_value": F.round("sum_value", 2), "avg_value": F.round("avg_value", 4)})


@register("a7_relation_aggregate", """
SELECT c_custkey, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS last_order FROM customer
LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def a7_relation(spark, sf_dir):
    found = jn.related_aggregates(
        customers(spark, sf_dir), ly.table(spark, sf_dir, "orders"), {"c_custkey": "o_custkey"},
        [F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").alias("last_order")])
    return found.select("c_custkey", "total", "last_order")


@register("a7_array_agg", """
SELECT o_custkey, (rn - 1) // 4 AS chunk, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS order_keys FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1, 2""")
def a7_array(spark, sf_dir):
    found = ag.array_agg(ly.table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderkey",
                         F.floor(col("o_orderkey") / 5000), chunk_rows=4)
    return found.select("o_custkey", "chunk", F.array_join("values", ",").alias("order_keys"))


def _snapped(spark, sf_dir) -> Layer:
    """Part boxes on a grid of 2 units."""
    df = ly.part_boxes(spark, sf_dir).df
    low = {c: F.floor(col(c) / 2) * 2.0 for c in ("xmin", "ymin")}
    high = {c: F.ceil(col(c) / 2) * 2.0 for c in ("xmax", "ymax")}
    return Layer(df.withColumns(low | high), ("p_partkey",), BoxColumns(), ly.PLANE, "snapped")


@register("a8b_dissolve_boxes", f"""
SELECT p_brand, count(*) AS n_cells, count(*) * 4.0::DOUBLE AS area, min(cx) * 2.0::DOUBLE AS xmin,
  min(cy) * 2.0::DOUBLE AS ymin, (max(cx) + 1) * 2.0::DOUBLE AS xmax, (max(cy) + 1) * 2.0::DOUBLE AS ymax FROM (
  SELECT DISTINCT p_brand, cx, cy FROM {ly.PART_BOXES} t,
    unnest(generate_series(CAST(floor(xmin / 2) AS BIGINT), CAST(ceil(xmax / 2) AS BIGINT) - 1)) AS a(cx),
    unnest(generate_series(CAST(floor(ymin / 2) AS BIGINT), CAST(ceil(ymax / 2) AS BIGINT) - 1)) AS b(cy))
GROUP BY 1""")
def a8b(spark, sf_dir):
    return ag.dissolve_boxes(_snapped(spark, sf_dir), ["p_brand"], 2.0)


def _unit_shapes(spark, sf_dir) -> Layer:
    """A square, holed square or L of 18 units per part; one group holds a third of them."""
    df = ly.part_shapes(spark, sf_dir).df.withColumns({
        "geom": ly.zone_shape(col("kind"), col("x0"), col("y0"), F.lit(1.0)),
        "grp": F.when(col("p_size") % 3 == 0, "large").otherwise(col("p_brand"))})
    return Layer(df, ("p_partkey",), ShapeColumn(), ly.PLANE, "unit_shapes")


# unit cells for areas, their sides for the border, their corners for bends and shells less holes, their runs for shells
@register("a8_dissolve", f"""
WITH RECURSIVE shapes AS (SELECT CASE WHEN p_size % 3 = 0 THEN 'large' ELSE p_brand END AS grp, kind,
  CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0 FROM {ly.PART_SHAPES} s),
cells AS (SELECT DISTINCT grp, x0 + i AS cx, y0 + j AS cy FROM shapes, range(1, 19) a(i), range(1, 19) b(j)
  WHERE NOT (kind = 'holed' AND i BETWEEN 6 AND 13 AND j BETWEEN 6 AND 13) AND NOT (kind = 'ell' AND i >= 9 AND j >= 9)),
sides AS (SELECT grp, count(*) AS n FROM cells JOIN (SELECT grp, cx - 1 AS cx, cy FROM cells
  UNION ALL SELECT grp, cx, cy - 1 FROM cells) USING (grp, cx, cy) GROUP BY 1),
corners AS (SELECT grp, sum(CASE WHEN p IN (1, 2, 4, 8) THEN 1 WHEN p IN (6, 9) THEN 2 ELSE 0 END) AS convex,
  sum(CASE WHEN p IN (7, 11, 13, 14) THEN 1 ELSE 0 END) AS concave FROM (
  SELECT grp, cx + a AS x, cy + b AS y, sum(1 << (a + 2 * b)) AS p FROM cells, range(2) d(a), range(2) e(b) GROUP BY 1, 2, 3)
  GROUP BY 1),
runs AS (SELECT row_number() OVER () AS id, grp, cy, min(cx) AS first, max(cx) AS last FROM (
  SELECT *, cx - row_number() OVER (PARTITION BY grp, cy ORDER BY cx) AS island FROM cells) GROUP BY grp, cy, island),
ways AS (SELECT r.id AS a, s.id AS b FROM runs r JOIN runs s ON r.grp = s.grp AND r.cy = s.cy + 1 AND r.first <= s.last
  AND s.first <= r.last),
both_ways AS (SELECT a, b FROM ways UNION ALL SELECT b, a FROM ways),
reach AS (SELECT id, id AS root FROM runs UNION SELECT b, root FROM reach JOIN both_ways ON a = id),
shells AS (SELECT grp, count(DISTINCT root) AS n FROM (SELECT id, min(root) AS root FROM reach GROUP BY 1) JOIN runs USING (id)
  GROUP BY 1)
SELECT grp, CAST(count(*) AS DOUBLE) AS area, CAST(4 * count(*) - 2 * any_value(coalesce(sides.n, 0)) AS DOUBLE) AS perimeter,
  any_value(shells.n) AS n_shells, CAST(any_value(shells.n - (convex - concave) // 4) AS BIGINT) AS n_holes,
  CAST(any_value(convex + concave) AS BIGINT) AS n_corners
FROM cells LEFT JOIN sides USING (grp) JOIN corners USING (grp) JOIN shells USING (grp) GROUP BY 1""")
def a8(spark, sf_dir):
    return ov.dissolve_measures(ov.dissolve(_unit_shapes(spark, sf_dir), ["grp"]), ["grp"])


@register("a9_collect_geometries", """
SELECT n AS s_nationkey, chunk, CAST(count(*) AS INTEGER) AS n_parts, CAST(min(x) AS DOUBLE) AS first_x, 'MULTIPOINT' AS kind FROM (
  SELECT s_nationkey AS n, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // 3 AS chunk,
    first_value((s_suppkey * 613) % 1000) OVER (PARTITION BY s_nationkey, s_suppkey) AS x FROM supplier) GROUP BY 1, 2""")
def a9(spark, sf_dir):
    found = ag.collect_geometries(ly.supplier_points(spark, sf_dir), ["s_nationkey"],
                                  F.floor(col("s_suppkey") / 500), chunk_rows=3)
    xs = F.transform(F.flatten(F.flatten(col("geom")["parts"])), lambda p: p["x"])
    return found.select("s_nationkey", "chunk", F.size(col("geom")["parts"]).alias("n_parts"),
                        F.array_min(xs).alias("first_x"), col("geom")["type"].alias("kind"))


@register("a10_top_counts", """
SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 5""")
def a10(spark, sf_dir):
    return ag.top_counts(ly.table(spark, sf_dir, "orders"), "o_custkey")


# --- profiling -------------------------------------------------------------------------------------


@register("p1_layer_stats", f"""
SELECT count(*) AS n_rows, min(x0 + unit) AS xmin, min(y0 + unit) AS ymin, max(x0 + 19 * unit) AS xmax,
  max(y0 + 19 * unit) AS ymax, 'POLYGON' AS geometry_types,
  round(avg(CASE kind WHEN 'ell' THEN 7 WHEN 'holed' THEN 10 ELSE 5 END), 6) AS mean_vertices,
  round((max(x0 + 19 * unit) - min(x0 + unit)) * (max(y0 + 19 * unit) - min(y0 + unit)), 4) AS extent_area,
  round(greatest(1.0, avg(CASE kind WHEN 'ell' THEN 7 WHEN 'holed' THEN 10 ELSE 5 END) / 10), 6) AS complexity
FROM {ly.PART_SHAPES} t""")
def p1(spark, sf_dir):
    stats = pf.layer_stats(ly.part_shapes(spark, sf_dir))
    return stats.withColumns({"mean_vertices": F.round("mean_vertices", 6), "complexity": F.round("complexity", 6),
                              "extent_area": F.round("extent_area", 4)})


@register("p2_column_stats", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct, 0.0::DOUBLE AS null_frac FROM lineitem""" for c in (
    "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")))
def p2(spark, sf_dir):
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate"]
    return pf.column_stats(ly.table(spark, sf_dir, "lineitem"), columns, exact=True)


@register("p3_selectivity", """
SELECT round(avg(CASE WHEN l_quantity > 40 AND l_discount < 0.03 THEN 1.0 ELSE 0.0 END), 8) AS selectivity FROM lineitem""")
def p3(spark, sf_dir):
    found = pf.selectivity(ly.table(spark, sf_dir, "lineitem"), "l_quantity > 40 AND l_discount < 0.03")
    return found.select(F.round("selectivity", 8).alias("selectivity"))


@register("p3b_spatial_selectivity", f"""
WITH t AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM {ly.ORDER_POINTS} o),
s AS (SELECT min(x0 + 10) AS x0, min(y0 + 10) AS y0, max(x0 + 190) AS x1, max(y0 + 190) AS y1 FROM {ly.ZONES} z
  WHERE n_nationkey IN (6, 7))
SELECT round(greatest(0.001, least(1.0, 0.5 * (least(t.x1, s.x1) - greatest(t.x0, s.x0)) *
  (least(t.y1, s.y1) - greatest(t.y0, s.y0)) / ((t.x1 - t.x0) * (t.y1 - t.y0)))), 8) AS selectivity FROM t, s""")
def p3b(spark, sf_dir):
    found = pf.spatial_selectivity(ly.zones(spark, sf_dir).where("n_nationkey IN (6, 7)"),
                                   ly.order_points(spark, sf_dir), "within")
    return found.select(F.round("selectivity", 8).alias("selectivity"))


@register("p4_key_report", """
SELECT 'doc_id' AS key_column, 3 AS rule, count(*) AS n_rows, count(DISTINCT doc_id) AS n_distinct, 0::BIGINT AS n_null,
  count(*) = count(DISTINCT doc_id) AS is_unique FROM documents""")
def p4(spark, sf_dir):
    return pf.key_report(ly.table(spark, sf_dir, "documents"))


@register("p5_text_columns", " UNION ALL ".join(f"""
SELECT '{name}' AS "column", count(nullif({c}, '')) AS n_values,
  count(TRY_CAST(trim({c}) AS DOUBLE)) / count(nullif({c}, '')) AS numeric_share,
  count(TRY_CAST(trim({c}) AS DOUBLE)) = count(nullif({c}, '')) AS numeric_in_disguise FROM part""" for name, c in (
    ("p_name", "p_name"), ("p_brand", "p_brand"), ("p_type", "p_type"),
    ("brand_no", "replace(p_brand, 'Brand#', '')"))))
def p5(spark, sf_dir):
    df = ly.table(spark, sf_dir, "part")
    return pf.text_columns_report(df.withColumn("brand_no", F.replace("p_brand", F.lit("Brand#"), F.lit(""))))


def _brands(spark, sf_dir):
    return ly.table(spark, sf_dir, "part").withColumn("brand_no", F.replace("p_brand", F.lit("Brand#"), F.lit("")))


@register("f11_filter_type_report", """
WITH c AS (SELECT count(nullif(p_brand, '')) AS n, count(TRY_CAST(trim(p_brand) AS DOUBLE)) AS f,
  count(nullif(replace(p_brand, 'Brand#', ''), '')) AS bn, count(TRY_CAST(trim(replace(p_brand, 'Brand#', '')) AS DOUBLE)) AS bf,
  count(p_size) AS sn FROM part)
SELECT 'brand_no' AS "column", 'BETWEEN' AS operator, 'string' AS column_type, 'try_cast(brand_no AS double)' AS suggestion,
  bn AS n_values, bf / bn AS fitting_share FROM c
UNION ALL SELECT 'brand_no', '<=', 'string', 'try_cast(brand_no AS double)', bn, bf / bn FROM c
UNION ALL SELECT 'p_brand', '>', 'string', 'try_cast(p_brand AS double)', n, f / n FROM c
UNION ALL SELECT 'p_size', 'NOT LIKE', 'int', 'cast(p_size AS string)', sn, 1.0::DOUBLE FROM c""")
def f11(spark, sf_dir):
    """Which comparisons of a filter need a cast, and how many values survive it."""
    expression = ("p_brand > 4 AND (brand_no <= 30 OR brand_no BETWEEN 41 AND 43) AND p_size NOT LIKE '1%' AND p_name = '5' "
                  "AND p_type <> 'p_brand = 3' AND p_retailprice >= 10")
    return pf.filter_type_report(_brands(spark, sf_dir), expression)


@register("p5_display_field", """
SELECT CASE WHEN count(c_name) > 0 THEN 'c_name' ELSE 'c_mktsegment' END AS display_field FROM customer""")
def p5_display(spark, sf_dir):
    return pf.display_field(ly.table(spark, sf_dir, "customer"))


@register("p6_reduction_report", """
WITH c AS (SELECT count(*) AS n0, count(*) FILTER (l_returnflag = 'R') AS n1,
  count(*) FILTER (l_returnflag = 'R' AND l_quantity > 30) AS n2,
  count(*) FILTER (l_returnflag = 'R' AND l_quantity > 30 AND l_discount = 0.05) AS n3 FROM lineitem)
SELECT 1 AS step, 'flag' AS name, n1 AS candidates, round(1 - n1 / n0, 6) AS reduction,
  round((n0 - n1) * 100 / 1048576, 6) AS saved_mb FROM c
UNION ALL SELECT 2, 'quantity', n2, round(1 - n2 / n1, 6), round((n0 - n2) * 100 / 1048576, 6) FROM c
UNION ALL SELECT 3, 'discount', n3, round(1 - n3 / n2, 6), round((n0 - n3) * 100 / 1048576, 6) FROM c""")
def p6(spark, sf_dir):
    steps = [("flag", "l_returnflag = 'R'"), ("quantity", "l_quantity > 30"),
             ("discount", "l_discount = cast(0.05 as double)")]
    report = pf.reduction_report(ly.table(spark, sf_dir, "lineitem"), steps)
    return report.withColumns({"reduction": F.round("reduction", 6), "saved_mb": F.round("saved_mb", 6)})


@register("o2_id_ranges", """
SELECT min(k) AS start, max(k) AS "end" FROM (SELECT k, k - row_number() OVER (ORDER BY k) AS g FROM (
  SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag <> 'N' AND l_quantity > 10)) GROUP BY g""")
def o2(spark, sf_dir):
    ids = ly.table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N' AND l_quantity > 10")
    return wn.id_ranges(ids, "l_orderkey", 1000)


@register("o2_range_rule", """
WITH k AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag <> 'N'),
r AS (SELECT min(k) AS s, max(k) AS e FROM (SELECT k, k - row_number() OVER (ORDER BY k) AS g FROM k) GROUP BY g),
f AS (SELECT count(*) AS n_ranges, CAST(sum(e - s + 1) AS BIGINT) AS n_ids, min(s) AS lowest, max(e) AS highest FROM r)
SELECT *, highest - lowest + 1 - n_ids AS n_gaps,
  CASE WHEN n_ids >= 20 AND n_ids / (highest - lowest + 1) >= 0.5 AND highest - lowest + 1 - n_ids < n_ids / 4
    THEN 'range_with_gaps' WHEN n_ids > 500 AND n_ranges < n_ids / 3 THEN 'ranges' ELSE 'ids' END AS form FROM f""")
def o2_rule(spark, sf_dir):
    return wn.range_rule(ly.table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'"), "l_orderkey", 1000)


# --- filter log --------------------------------------------------------------------------------------


def filter_log(spark, sf_dir) -> DataFrame:
    """Events as history rows: the layer is the user, the filter set is the event type."""
    events = ly.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    day = F.floor(F.unix_timestamp("ts") / 86400)
    ranked = wn.bucketed_rank(events, ["user_id"], ["ts", "event_id"], day, "seq_order")
    return ranked.select(
        col("event_id").alias("id"), "ts", (col("user_id") % 7).alias("project"), col("user_id").alias("layer"),
        "seq_order", col("event_type").alias("subset_string"))


FILTER_LOG = """(SELECT event_id AS id, ts, user_id % 7 AS project, user_id AS layer,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq_order, event_type AS subset_string FROM events)"""


def favourites(spark, sf_dir) -> DataFrame:
    docs = ly.table(spark, sf_dir, "documents")
    day = F.timestamp_seconds(F.lit(1704067200) + col("doc_id") * 60)
    return docs.select(
        col("doc_id").alias("id"), F.concat("source", F.lit("-"), (col("doc_id") % 7).cast("string")).alias("name"),
        col("text").alias("expression"), F.array("lang", "source").alias("tags"),
        (col("n_chars") % 50).alias("use_count"), F.when(col("n_chars") % 3 != 0, day).alias("last_used_at"))


FAVOURITES = """(SELECT doc_id AS id, source || '-' || CAST(doc_id % 7 AS VARCHAR) AS name, text AS expression,
  [lang, source] AS tags, n_chars % 50 AS use_count, CASE WHEN n_chars % 3 <> 0
  THEN make_timestamp(1704067200000000 + doc_id * 60000000) END AS last_used_at FROM documents)"""


@register("l1_last_filter", f"""
SELECT * FROM {FILTER_LOG} l QUALIFY row_number() OVER (PARTITION BY project, layer ORDER BY seq_order DESC) = 1""")
def l1(spark, sf_dir):
    return lg.last_filters(filter_log(spark, sf_dir))


@register("l2_last_filters", f"""
SELECT id, project, layer, seq_order FROM {FILTER_LOG} l
QUALIFY row_number() OVER (PARTITION BY project, layer ORDER BY seq_order DESC) <= 3""")
def l2(spark, sf_dir):
    return lg.last_filters(filter_log(spark, sf_dir), 3).select("id", "project", "layer", "seq_order")


@register("l3_filter_counts", f"SELECT project, layer, count(*) AS n_entries FROM {FILTER_LOG} l GROUP BY ALL")
def l3(spark, sf_dir):
    return lg.filter_counts(filter_log(spark, sf_dir))


@register("l3_previous_filter", f"""
SELECT id, layer, subset_string, lag(subset_string) OVER (PARTITION BY project, layer ORDER BY seq_order)
  AS previous_subset FROM {FILTER_LOG} l""")
def l3_previous(spark, sf_dir):
    return lg.with_previous(filter_log(spark, sf_dir)).select("id", "layer", "subset_string", "previous_subset")


def properties(spark, sf_dir) -> DataFrame:
    """Events as property writes: the key is the event type, the value its rounded amount."""
    events = ly.table(spark, sf_dir, "events")
    return events.select(
        (col("user_id") % 7).alias("project"), col("user_id").alias("layer"), F.lit("usage").alias("meta_type"),
        col("event_type").alias("meta_key"), F.floor("value").cast("string").alias("meta_value"), "event_id")


PROPERTIES = """(SELECT user_id % 7 AS project, user_id AS layer, 'usage' AS meta_type, event_type AS meta_key,
  CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS meta_value FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)"""


@register("l4_latest_properties", f"SELECT * FROM {PROPERTIES} p")
def l4(spark, sf_dir):
    return lg.latest_properties(properties(spark, sf_dir), "event_id")


@register("l4_properties_wide", f"""
SELECT project, layer, max(meta_value) FILTER (meta_key = 'click') AS click,
  max(meta_value) FILTER (meta_key = 'error') AS error, max(meta_value) FILTER (meta_key = 'view') AS view
FROM {PROPERTIES} p GROUP BY ALL""")
def l4_wide(spark, sf_dir):
    latest = lg.latest_properties(properties(spark, sf_dir), "event_id")
    return lg.properties_wide(latest, ["click", "error", "view"])


@register("l5_search_favourites", f"""
SELECT id, name FROM {FAVOURITES} f WHERE contains(lower(name), 'src1') OR contains(lower(expression), 'src1')
  OR contains(lower(tags[1]), 'src1') OR contains(lower(tags[2]), 'src1')""")
def l5(spark, sf_dir):
    return lg.search_favourites(favourites(spark, sf_dir), "SRC1").select("id", "name")


@register("l6_recent", f"""
SELECT id, name, last_used_at FROM {FAVOURITES} f WHERE last_used_at IS NOT NULL ORDER BY last_used_at DESC, id LIMIT 10""")
def l6(spark, sf_dir):
    return lg.recent_favourites(favourites(spark, sf_dir)).select("id", "name", "last_used_at")


@register("l6_most_used", f"SELECT id, name, use_count FROM {FAVOURITES} f ORDER BY use_count DESC, id LIMIT 10")
def l6_used(spark, sf_dir):
    return lg.most_used_favourites(favourites(spark, sf_dir)).select("id", "name", "use_count")


@register("l7_usage_summary", f"""
SELECT count(*) AS total_count, CAST(sum(use_count) AS BIGINT) AS total_uses,
  (SELECT name FROM {FAVOURITES} f ORDER BY use_count DESC, id LIMIT 1) AS most_used, max(use_count) AS most_used_count,
  (SELECT name FROM {FAVOURITES} f WHERE last_used_at IS NOT NULL ORDER BY last_used_at DESC, id LIMIT 1) AS recently_used
FROM {FAVOURITES} g""")
def l7(spark, sf_dir):
    return lg.usage_summary(favourites(spark, sf_dir))


@register("l8_import_favourites", f"""
WITH f AS (SELECT * FROM {FAVOURITES} x), old AS (SELECT id, name FROM f WHERE use_count >= 25)
SELECT id, name FROM old UNION ALL SELECT min(id), name FROM f WHERE use_count < 25
  AND name NOT IN (SELECT name FROM old) GROUP BY name""")
def l8(spark, sf_dir):
    all_rows = favourites(spark, sf_dir)
    old, new = all_rows.where("use_count >= 25"), all_rows.where("use_count < 25")
    return lg.import_favourites(old, new).select("id", "name")


@register("l9_orphans", f"""
SELECT id, layer FROM {FILTER_LOG} l WHERE layer NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def l9(spark, sf_dir):
    log = Layer(filter_log(spark, sf_dir), ("id",), None)
    return jn.orphans(log, customers(spark, sf_dir).df.where("c_acctbal > 0"), {"layer": "c_custkey"}).select(
        "id", "layer")


@register("l9_top_projects", f"""
SELECT project, count(*) AS n FROM {FILTER_LOG} l GROUP BY 1 ORDER BY n DESC, project LIMIT 5""")
def l9_top(spark, sf_dir):
    return ag.top_counts(filter_log(spark, sf_dir), "project")


@register("a7_array_agg_nulls", """
SELECT k, (rn - 1) // 100 AS chunk, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS order_keys FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY o_orderkey) AS rn FROM (
    SELECT nullif(o_custkey % 5, 0) AS k, o_orderkey FROM orders)) GROUP BY 1, 2""")
def a7_array_nulls(spark, sf_dir):
    rows = ly.table(spark, sf_dir, "orders").select(F.nullif(col("o_custkey") % 5, F.lit(0)).alias("k"), "o_orderkey")
    found = ag.array_agg(rows, ["k"], ["o_orderkey"], "o_orderkey", F.floor(col("o_orderkey") / 5000), chunk_rows=100)
    return found.select("k", "chunk", F.array_join("values", ",").alias("order_keys"))


@register("l3_previous_nulls", """
SELECT id, layer, subset_string, lag(subset_string) OVER (PARTITION BY project, layer ORDER BY seq_order) AS previous_subset
FROM (SELECT event_id AS id, user_id % 3 AS project, nullif(user_id % 4, 0) AS layer, event_id AS seq_order,
  event_type AS subset_string FROM events)""")
def l3_previous_nulls(spark, sf_dir):
    log = ly.table(spark, sf_dir, "events").select(
        col("event_id").alias("id"), (col("user_id") % 3).alias("project"),
        F.nullif(col("user_id") % 4, F.lit(0)).alias("layer"), col("event_id").alias("seq_order"),
        col("event_type").alias("subset_string"))
    return lg.with_previous(log).select("id", "layer", "subset_string", "previous_subset")
