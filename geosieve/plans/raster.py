"""Registered queries: raster sampling, zonal statistics, point clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from geosieve.layer import Layer, PointColumns
from geosieve.operators import raster as rs
from geosieve.operators.windows import exact_median
from geosieve.plans import layers as ly
from geosieve.plans.registering import register

col = F.col


def line_raster(spark, sf_dir) -> rs.Raster:
    """Cells of 10 units with the quantity (band 1) and the number (band 2) of the line items in them.

    A cell whose column and row add up to a multiple of 17 is NoData, and so is one without line items.
    """
    df = ly.line_points(spark, sf_dir).df
    cells = df.groupBy(F.floor(col("x") / 10).alias("col"), F.floor(col("y") / 10).alias("row")).agg(
        F.sum("l_quantity").alias("b1"), F.count("*").cast("double").alias("b2"))
    hidden = (col("col") + col("row")) % 17 == 0
    long = cells.select("col", "row", F.explode(F.array(
        F.struct(F.lit(1).alias("band"), col("b1").alias("v")), F.struct(F.lit(2).alias("band"), col("b2").alias("v"))
    )).alias("b"))
    return rs.Raster(long.select(col("b")["band"].alias("band"), "col", "row",
                                 F.when(~hidden, col("b")["v"]).alias("value")), 0.0, 0.0, 10.0)


CELLS = f"""(SELECT CAST(floor(x / 10) AS BIGINT) AS col, CAST(floor(y / 10) AS BIGINT) AS row,
  CASE WHEN (floor(x / 10) + floor(y / 10)) % 17 <> 0 THEN sum(l_quantity) END AS b1,
  CASE WHEN (floor(x / 10) + floor(y / 10)) % 17 <> 0 THEN count(*)::DOUBLE END AS b2
  FROM {ly.LINE_POINTS} p GROUP BY floor(x / 10), floor(y / 10))"""

SAMPLED = f"""(SELECT t.*, c.b1 AS band_1, c.b2 AS band_2 FROM {ly.ORDER_POINTS} t
  LEFT JOIN {CELLS} c ON c.col = floor(t.x / 10) AND c.row = floor(t.y / 10))"""

COVERED = f"""(SELECT s.n_nationkey, c.b1 AS v FROM {CELLS} c JOIN {ly.ZONES} s
  ON c.b1 IS NOT NULL AND {ly.in_zone('(c.col * 10 + 5)', '(c.row * 10 + 5)', 's')})"""


@register("r1_sample_bands", f"SELECT o_orderkey, band_1, band_2 FROM {SAMPLED} s")
def r1(spark, sf_dir):
    sampled = rs.sample(ly.order_points(spark, sf_dir), line_raster(spark, sf_dir), (1, 2))
    return sampled.select("o_orderkey", "band_1", "band_2")


@register("r1_sample_polygons", f"""
SELECT p_partkey, c.b1 AS band_1 FROM {ly.PART_BOXES} t LEFT JOIN {CELLS} c
ON c.col = floor((xmin + xmax) / 20) AND c.row = floor((ymin + ymax) / 20)""")
def r1_polygons(spark, sf_dir):
    sampled = rs.sample(ly.part_boxes(spark, sf_dir), line_raster(spark, sf_dir), (1,), "centroid")
    return sampled.select("p_partkey", "band_1")


@register("r2_mean_under", f"""
SELECT n.n_nationkey, round(avg(v), 6) AS mean FROM nation n LEFT JOIN {COVERED} c ON c.n_nationkey = n.n_nationkey GROUP BY 1""")
def r2(spark, sf_dir):
    found = rs.mean_under(ly.zones(spark, sf_dir), line_raster(spark, sf_dir))
    return found.select("n_nationkey", F.round("mean", 6).alias("mean"))


@register("r3_value_filter", f"SELECT o_orderkey, band_1 FROM {SAMPLED} s WHERE band_1 BETWEEN 100 AND 180")
def r3(spark, sf_dir):
    sampled = rs.sample(ly.order_points(spark, sf_dir), line_raster(spark, sf_dir))
    return rs.value_filter(sampled, "BETWEEN", 100, 180).select("o_orderkey", "band_1")


@register("r4_sampling_stats", f"""
SELECT count(*) AS total, count(band_1) AS sampled, count(*) - count(band_1) AS nodata,
  count(*) FILTER (band_1 >= 150) AS matching, min(band_1) AS min_value, max(band_1) AS max_value,
  round(avg(band_1), 6) AS mean_value, round(stddev_pop(band_1), 6) AS std_value, median(band_1) AS median_value
FROM {SAMPLED} s""")
def r4(spark, sf_dir):
    sampled = rs.sample(ly.order_points(spark, sf_dir), line_raster(spark, sf_dir))
    stats = rs.sampling_stats(sampled, matching="band_1 >= 150")
    return stats.withColumns({"mean_value": F.round("mean_value", 6), "std_value": F.round("std_value", 6)})


ZONAL = f"""SELECT n.n_nationkey, count(v) AS n, sum(v) AS sum, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean,
  round(stddev_pop(v), 6) AS std, median(v) AS median FROM nation n LEFT JOIN {COVERED} c
  ON c.n_nationkey = n.n_nationkey GROUP BY 1"""


def _zonal(spark, sf_dir):
    return rs.zonal_stats(ly.zones(spark, sf_dir), line_raster(spark, sf_dir)).withColumns(
        {"mean": F.round("mean", 6), "std": F.round("std", 6)})


register("r5_zonal_stats", ZONAL)(_zonal)


@register("r6_zonal_filter", f"SELECT n_nationkey, mean, n FROM ({ZONAL}) z WHERE mean >= 153 AND n > 150")
def r6(spark, sf_dir):
    kept = rs.zonal_filter(_zonal(spark, sf_dir), [("mean", ">=", 153), ("n", ">", 150)], "AND")
    return kept.select("n_nationkey", "mean", "n")


@register("r7_histogram", f"""
SELECT n_nationkey, CAST(least(floor((v - 50) / 25), 9) AS INTEGER) + 1 AS bin, count(*) AS n FROM {COVERED} c
WHERE v BETWEEN 50 AND 300 GROUP BY 1, 2""")
def r7(spark, sf_dir):
    return rs.histogram(ly.zones(spark, sf_dir), line_raster(spark, sf_dir), 1, 10, 50, 300)


@register("r8_point_cloud", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {ly.LINE_POINTS} t
WHERE l_linenumber IN (2, 5, 6) AND l_quantity BETWEEN 10 AND 30 AND l_discount > 0.02 AND EXISTS (
  SELECT 1 FROM {ly.ZONES} s WHERE s.n_regionkey = 4 AND {ly.in_zone('t.x', 't.y', 's')})""")
def r8(spark, sf_dir):
    cloud = ly.line_points(spark, sf_dir)
    kept = rs.filter_points(
        Layer(cloud.df, cloud.pk, PointColumns(), cloud.crs), [2, 5, 6], (10, 30), "l_discount > 0.02",
        ly.zones(spark, sf_dir).where("n_regionkey = 4"), "l_linenumber", "l_quantity")
    return kept.select(*cloud.pk)


@register("r4_median_nulls", """
SELECT nullif(o_orderstatus, 'F') AS status, median(o_totalprice) AS middle FROM orders GROUP BY 1""")
def r4_median_nulls(spark, sf_dir):
    rows = ly.table(spark, sf_dir, "orders").select(F.nullif("o_orderstatus", F.lit("F")).alias("status"), "o_totalprice")
    return exact_median(rows, ["status"], "o_totalprice", "middle")


@register("r4_sampling_stats_empty", """
SELECT count(*) AS total, 0 AS sampled, 0 AS nodata, 0 AS matching, NULL::INTEGER AS min_value, NULL::INTEGER AS max_value,
  NULL::DOUBLE AS mean_value, NULL::DOUBLE AS std_value, NULL::DOUBLE AS median_value
FROM orders WHERE o_totalprice < 0""")
def r4_empty(spark, sf_dir):
    """No points to sample: counts are 0, statistics are absent."""
    return rs.sampling_stats(rs.sample(ly.order_points(spark, sf_dir).where("o_totalprice < 0"), line_raster(spark, sf_dir)))
