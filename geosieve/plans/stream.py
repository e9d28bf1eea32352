"""Registered queries: streams over the event table, run to their end and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from geosieve.layer import BoxColumns, Layer, PointColumns
from geosieve.plans import layers as ly
from geosieve.plans.aggregate import FILTER_LOG
from geosieve.plans.registering import register
from geosieve.sizing import checkpoint_dir
from geosieve.streaming import streams as st

col = F.col


def _folder(spark: SparkSession) -> str:
    base = checkpoint_dir(spark)
    if base is None:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return f"{base}/stream-{uuid.uuid4().hex}"


def _events(spark, sf_dir):
    # the file source watches a folder or a pattern
    schema = ly.table(spark, sf_dir, "events").schema
    return st.read_stream(spark, f"{sf_dir}/events*.parquet", schema)


@register("t1_filter_stream", """
SELECT event_id, user_id, value FROM events WHERE event_type IN ('purchase', 'click') AND value > 50""")
def t1(spark, sf_dir):
    out = _folder(spark)
    kept = lambda df: df.where("event_type IN ('purchase', 'click') AND value > 50").select(
        "event_id", "user_id", "value")
    st.export_stream(_events(spark, sf_dir), f"{out}/rows", f"{out}/state", transform=kept).awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@register("t2_geofence", f"""
SELECT event_id, user_id FROM {ly.EVENT_POINTS} t WHERE EXISTS (
  SELECT 1 FROM {ly.ZONES} s WHERE s.n_regionkey IN (0, 3) AND {ly.in_zone('t.x', 't.y', 's')})""")
def t2(spark, sf_dir):
    out = _folder(spark)
    points = ly.event_points(_events(spark, sf_dir))
    fences = ly.zones(spark, sf_dir).where("n_regionkey IN (0, 3)")
    hits = st.geofence(Layer(points.df, points.pk, PointColumns(), points.crs), fences)
    st.export_stream(hits.select("event_id", "user_id"), f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def _event_boxes(df):
    """Boxes of 1 to 300 units around the events."""
    points = ly.event_points(df)
    side = F.when(col("event_id") % 100 == 0, 300.0).otherwise(1.0 + col("event_id") % 7)
    return Layer(points.df.withColumns({"xmin": col("x") - side / 2, "ymin": col("y") - side / 2, "xmax": col("x") + side / 2,
                                        "ymax": col("y") + side / 2}), points.pk, BoxColumns(), points.crs)


@register("t2_geofence_boxes", f"""
SELECT event_id, user_id FROM (SELECT *, CASE WHEN event_id % 100 = 0 THEN 150.0::DOUBLE ELSE (1.0::DOUBLE + event_id % 7) / 2 END AS h
  FROM {ly.EVENT_POINTS} e) t WHERE EXISTS (SELECT 1 FROM {ly.PART_BOXES} s WHERE s.p_size > 45
  AND t.x - t.h <= s.xmax AND t.x + t.h >= s.xmin AND t.y - t.h <= s.ymax AND t.y + t.h >= s.ymin)""")
def t2_boxes(spark, sf_dir):
    """A stream of moving boxes of very different sizes against static ones."""
    out = _folder(spark)
    hits = st.geofence(_event_boxes(_events(spark, sf_dir)), ly.part_boxes(spark, sf_dir).where("p_size > 45"))
    st.export_stream(hits.select("event_id", "user_id"), f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@register("t3_latest_stream", f"""
SELECT id, project, layer, subset_string FROM {FILTER_LOG} l
QUALIFY row_number() OVER (PARTITION BY project, layer ORDER BY ts DESC, id DESC) = 1""")
def t3(spark, sf_dir):
    out = _folder(spark)
    log = _events(spark, sf_dir).select(
        col("event_id").alias("id"), (col("user_id") % 7).alias("project"), col("user_id").alias("layer"),
        F.struct("ts", "event_id").alias("seq_order"), col("event_type").alias("subset_string"))
    st.latest_stream(log, f"{out}/rows", f"{out}/state").awaitTermination()
    return st.read_latest(spark, f"{out}/rows").select("id", "project", "layer", "subset_string")
