"""Filters, windows, skewed joins, raster, log, export and streams on small hand-made tables."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from geosieve import BoxColumns, Layer, PointColumns, ShapeColumn
from geosieve.functions import crs
from geosieve.functions import expressions as ex
from geosieve.functions import geometry as geo
from geosieve.operators import aggregates as ag
from geosieve.operators import filter_log as lg
from geosieve.operators import filters as fl
from geosieve.operators import geometry_jobs as gj
from geosieve.operators import joins as jn
from geosieve.operators import profile as pf
from geosieve.operators import raster as rs
from geosieve.operators import windows as wn
from geosieve.operators.spatial import spatial_filter
from geosieve.sizing import checkpoint_dir, sized_join
from geosieve.sources import readers, writers
from geosieve.streaming import streams


def values(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


@pytest.fixture(scope="module")
def numbers(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("k"), F.when(F.col("id") % 5 != 0, F.col("id")).alias("v"))
    return Layer(df, "id", None)


# --- expressions and filters -------------------------------------------------------------------------


@pytest.mark.parametrize("op, low, high, expected", [
    ("=", 5, None, [5]), ("!=", 5, None, [4, 6]), ("<>", 5, None, [4, 6]), (">", 5, None, [6]), (">=", 5, None, [5, 6]),
    ("<", 5, None, [4]), ("<=", 5, None, [4, 5]), ("BETWEEN", 4, 5, [4, 5]), ("not between", 4, 5, [6])])
def test_comparisons(spark, op, low, high, expected):
    df = spark.createDataFrame([(4,), (5,), (6,), (None,)], "id int")
    assert values(df.where(ex.compare(F.col("id"), op, low, high))) == expected


def test_bad_comparisons(spark):
    for args in (("BETWEEN", 4), ("BETWEEN", 5, 4), ("~", 1)):
        with pytest.raises(ValueError):
            ex.compare(F.col("id"), *args)
    with pytest.raises(ValueError):
        ex.operator_name("XOR")


def test_operator_names():
    names = {"et": "AND", "oder": "OR", " Y ": "AND", "UND NICHT": "AND NOT", "E NÃO": "AND NOT", None: "AND", "": "AND"}
    assert {n: ex.operator_name(n) for n in names} == names


def test_negation_keeps_unknown_out(numbers):
    assert values(numbers.df.where(ex.none_of(["v > 3"]))) == [1, 2, 3]


def test_ids_and_values(spark, numbers):
    assert values(fl.by_ids(numbers, [3, None, 5, 3, 999])) == [3, 5]
    assert values(fl.by_ids(numbers, range(40, 2000))) == list(range(40, 100))
    many = spark.range(95, 200)
    assert values(fl.by_ids(numbers, many)) == list(range(95, 100))
    assert values(fl.by_ids(numbers, [])) == []
    text = Layer(spark.createDataFrame([("a'b", 1), ("", 2), (None, 3)], "id string, n int"), "id", None)
    assert values(fl.by_ids(text, ["a'b"]), "n") == [1]
    assert values(fl.by_values(text, "id", ["", None, "a'b"]), "n") == [1]
    assert values(fl.by_values(text, "id", ["", None]), "n") == []


def test_set_methods(spark, numbers):
    old, new = spark.range(0, 10), spark.range(5, 15)
    expected = {"new": range(5, 15), "add": range(15), "within": range(5, 10), "remove": range(5)}
    for method, rows in expected.items():
        assert values(fl.select_method(numbers, old, new, method)) == list(rows)
    assert values(fl.combine(numbers, None, new)) == list(range(5, 15))


def test_filter_chain_rules(numbers, spark):
    chain = fl.FilterChain(numbers).add(fl.Filter("custom_expression", "id < 50")).add(fl.Filter("bbox_filter", "id > 10"))
    assert [f.kind for f in chain.ordered()] == ["bbox_filter", "custom_expression"]
    chain = chain.add(fl.Filter("custom_expression", "id < 20"), replace_kind=True)
    assert values(chain.apply()) == list(range(11, 20))
    assert values(chain.remove("bbox_filter").apply()) == list(range(20))
    mixed = fl.FilterChain(numbers, "custom").add(fl.Filter("fid_list", spark.range(5))).add(
        fl.Filter("field_condition", "id < 3", "AND NOT"))
    assert values(mixed.apply()) == [3, 4]
    for bad in (lambda: fl.Filter("nothing", "id > 1"), lambda: fl.Filter("fid_list", " "),
                lambda: fl.FilterChain(numbers, "xor")):
        with pytest.raises(ValueError):
            bad()


def test_source_resolution_order(numbers, spark):
    pick = lambda **k: values(fl.resolve_source(numbers, **k).df)
    assert pick(ids=[1], selection=spark.range(5), subset="id = 9") == [1]
    assert pick(selection=spark.range(2), subset="id = 9") == [0, 1]
    assert pick(subset="id = 9", expr="id = 8") == [9]
    assert pick(expr="k") == list(range(100)) and pick(expr="id = 8") == [8]


# --- joins and windows under skew ----------------------------------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_plain_join(spark, how):
    left = spark.range(600).select("id", F.when(F.col("id") % 3 == 0, F.lit(1)).when(
        F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 40).cast("long").alias("k"))
    right = spark.createDataFrame([(1, "a"), (2, "b"), (7, "c"), (None, "d")], "k long, t string")
    plain = left.join(right, "k", how)
    salted = sized_join(left, right, ["k"], how, ["id"], "shuffle", one_in=1, floor=30)
    counted = sized_join(left, right, ["k"], how, ["id"], "sized", max_rows=2, one_in=1, floor=30)
    rows = sorted(map(tuple, plain.select(sorted(plain.columns)).collect()), key=repr)
    for df in (salted, counted):
        assert sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr) == rows


def test_related_rows(spark):
    parent = Layer(spark.range(4), "id", None)
    child = spark.createDataFrame([(0,), (0,), (2,), (None,), (9,)], "pid long").withColumn(
        "cid", F.monotonically_increasing_id())
    counted = jn.related_counts(parent, child, {"id": "pid"})
    assert sorted(map(tuple, counted.select("id", "n").collect())) == [(0, 2), (1, 0), (2, 1), (3, 0)]
    lost = jn.orphans(Layer(child, "cid", None), parent.df, {"pid": "id"})
    assert sorted((r["pid"] for r in lost.collect()), key=str) == [9, None]


def test_id_ranges_over_bucket_borders(spark):
    rng = random.Random(1)
    for ids in (set(range(100)), set(range(5, 37)) | {40, 41} | set(range(95, 131)), {0}, set(rng.sample(range(300), 150)),
                {-3, -2, -1, 0, 1, 9, 10}):
        expected, run = [], None
        for i in sorted(ids):
            if run and run[1] == i - 1:
                run[1] = i
            else:
                run = [i, i]
                expected.append(run)
        df = spark.createDataFrame([(i,) for i in ids], "id long")
        found = sorted([r["start"], r["end"]] for r in wn.id_ranges(df.union(df), "id", 10).collect())
        assert found == expected
    dense = spark.range(10, 60).where("id <> 33")
    rule = wn.range_rule(dense, "id", 10).first()
    assert (rule["form"], rule["n_gaps"], rule["n_ranges"]) == ("range_with_gaps", 1, 2)


def test_bucketed_windows_are_plain_windows(spark):
    df = spark.range(400).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 9).alias("g"),
                                 (F.col("id") * 37 % 211).alias("o"), F.col("id").cast("string").alias("v"))
    df.createOrReplaceTempView("w")
    plain = spark.sql("""SELECT id, row_number() OVER (PARTITION BY g ORDER BY o, id) AS r,
        lag(v) OVER (PARTITION BY g ORDER BY o, id) AS p, lead(v) OVER (PARTITION BY g ORDER BY o, id) AS n FROM w""")
    bucket = F.floor(F.col("o") / 20)
    r = wn.bucketed_rank(df, ["g"], ["o", "id"], bucket, "r").select("id", "r")
    p = wn.bucketed_neighbour(df, ["g"], ["o", "id"], bucket, {"p": "v"}).select("id", "p")
    n = wn.bucketed_neighbour(df, ["g"], ["o", "id"], bucket, {"n": "v"}, 1).select("id", "n")
    mine = r.join(p, "id").join(n, "id")
    assert sorted(map(tuple, mine.select("id", "r", "p", "n").collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("buckets", [1, 3, 1024])
def test_exact_median(spark, buckets):
    rng = random.Random(2)
    rows = [(g, rng.choice([1.0, 1.0, 2.5, rng.uniform(0, 100)])) for g in range(6) for _ in range(rng.randint(1, 40))]
    df = spark.createDataFrame([*rows, (0, None), (77, None)], "g int, v double")
    found = {r["g"]: r["median"] for r in wn.exact_median(df, ["g"], "v", buckets=buckets).collect()}
    import statistics
    assert found == {g: statistics.median(v for k, v in rows if k == g) for g in range(6)}


# --- aggregates and profiles -----------------------------------------------------------------------------


def test_values_extent_and_dissolve(spark):
    df = spark.createDataFrame([(10,), (9,), (None,), (9,)], "n int")
    assert [r["value"] for r in ag.unique_values(df, "n").collect()] == ["10", "9"]
    box = Layer(spark.createDataFrame([(1, 0.0, 0.0, 4.0, 4.0), (2, 2.0, 2.0, 6.0, 4.0), (3, 0.0, 0.0, 4.0, 4.0)],
                                      "id long, xmin double, ymin double, xmax double, ymax double"), "id", BoxColumns())
    assert ag.dissolve_boxes(box.with_df(box.df.withColumn("g", F.lit(1))), ["g"], 2.0).first()["area"] == 20.0
    assert tuple(ag.extent(box).first()) == (0.0, 0.0, 6.0, 4.0)
    assert tuple(ag.padded_extent(box).first()) == (-5.0, -5.0, 11.0, 9.0)
    one = Layer(spark.createDataFrame([(1, 3.0, 4.0)], "id long, x double, y double"), "id", PointColumns())
    assert tuple(ag.padded_extent(one).first()) == (-47.0, -46.0, 53.0, 54.0)


def test_key_and_display_fields(spark):
    df = spark.createDataFrame([("x", 1, None, "p")], "label_id string, parcel_id int, name string, note string")
    assert pf.key_candidates(df)[0] == (3, "parcel_id")
    assert pf.display_field(df).first()[0] == "note"
    assert pf.key_candidates(spark.createDataFrame([(1, "u")], "n int, my_uuid string"))[0] == (2, "my_uuid")
    assert pf.key_candidates(spark.createDataFrame([(1, 2)], "n int, FID int"))[0] == (1, "FID")
    report = {r["column"]: r for r in pf.text_columns_report(
        spark.createDataFrame([("1", "a"), (" 2.5 ", ""), (None, "3")], "a string, b string")).collect()}
    assert report["a"]["numeric_in_disguise"] and not report["b"]["numeric_in_disguise"]


def test_measures_of_special_shapes(spark):
    texts = ["POLYGON ((0 0, 0 9, 9 9, 9 0, 0 0), (3 3, 3 6, 6 6, 6 3, 3 3))", "LINESTRING (0 0, 3 4)", "POINT (2 3)",
             "MULTIPOINT ((0 0), (4 0))", "POLYGON ((1 1, 3 1, 1 1, 1 1))"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, wkt string").withColumn("geom", geo.from_wkt(F.col("wkt")))
    m = {r["id"]: tuple(r)[1:] for r in gj.measures(Layer(df, "id", ShapeColumn())).collect()}
    assert m[0] == (72.0, 0.0, 48.0, 4.5, 4.5) and m[1] == (0.0, 5.0, 0.0, 1.5, 2.0)
    assert m[2] == (0.0, 0.0, 0.0, 2.0, 3.0) and m[3][3:] == (2.0, 0.0) and m[4] == (0.0, 0.0, 4.0, 2.0, 1.0)


def test_hull_simplify_and_repair(spark):
    circle = ", ".join(f"{100 * math.cos(a * math.pi / 180)!r} {100 * math.sin(a * math.pi / 180)!r}" for a in range(360))
    ring = f"POLYGON (({circle}, 100.0 0.0))"
    rows = [(1, ring), (2, "LINESTRING (0 0, 1 0.01, 2 0)"), (3, "POLYGON ((0 0, 4 0, 4 4, 1 4))"), (4, "POINT (1 1)")]
    layer = Layer(spark.createDataFrame(rows, "id long, wkt string").withColumn("geom", geo.from_wkt(F.col("wkt"))), "id",
                  ShapeColumn())
    thin = {r["id"]: r for r in gj.simplify(layer, 1.0).collect()}
    assert thin[1]["vertices_before"] == 361 and 10 < thin[1]["vertices_after"] < 60 and thin[2]["vertices_after"] == 2
    assert thin[4]["vertices_after"] == 1
    fixed = {r["id"]: r["repair_kind"] for r in gj.repair(layer).collect()}
    assert fixed == {1: None, 2: None, 3: "hull", 4: None}
    hull = gj.hulls(layer).df.where("id = 4").first()["hull"]
    assert hull["type"] == "POINT"


def test_crs(spark):
    assert crs.is_geographic("EPSG:4326") and not crs.is_geographic("EPSG:3857")
    zone = spark.range(1).select(crs.utm_epsg(F.lit(2.35), F.lit(48.85)), crs.utm_epsg(F.lit(-70.6), F.lit(-33.4)),
                                 crs.utm_epsg(F.lit(180.0), F.lit(1.0))).first()
    assert tuple(zone) == (32631, 32719, 3857)
    assert geo.wkt_decimals("EPSG:4326") == 8 and geo.wkt_decimals("EPSG:2154") == 3 and geo.wkt_decimals(None) == 3


# --- raster, log -----------------------------------------------------------------------------------------


def test_sampling(spark):
    cells = spark.createDataFrame([(1, 0, 0, 5.0), (1, 1, 0, None), (1, 0, 1, 7.0), (2, 0, 0, 1.0)],
                                  "band int, col long, row long, value double")
    raster = rs.Raster(cells, 0.0, 0.0, 10.0)
    at = spark.createDataFrame([(1, 5.0, 5.0), (2, 15.0, 5.0), (3, 0.0, 10.0), (4, -1.0, 5.0), (5, None, 1.0)],
                               "id long, x double, y double")
    layer = Layer(at, "id", PointColumns())
    sampled = rs.sample(layer, raster, (1, 2))
    assert {r["id"]: (r["band_1"], r["band_2"]) for r in sampled.collect()} == {
        1: (5.0, 1.0), 2: (None, None), 3: (7.0, None), 4: (None, None), 5: (None, None)}
    stats = rs.sampling_stats(sampled, matching="band_1 > 5").first().asDict()
    assert stats == {"total": 5, "sampled": 2, "nodata": 3, "matching": 1, "min_value": 5.0, "max_value": 7.0,
                     "mean_value": 6.0, "std_value": 1.0, "median_value": 6.0}
    none = rs.sampling_stats(sampled.where("id = 4")).first().asDict()
    assert none["total"] == 1 and none["median_value"] is None and none["mean_value"] is None
    for bad in (lambda: raster.band(0), lambda: rs.sample(layer, raster, (0,)), lambda: rs.zonal_stats(layer, raster, 1, ["mode"])):
        with pytest.raises(ValueError):
            bad()
    zone = Layer(spark.createDataFrame([(1, 0.0, 0.0, 20.0, 20.0), (2, 50.0, 50.0, 60.0, 60.0)],
                                       "id long, xmin double, ymin double, xmax double, ymax double"), "id", BoxColumns())
    zonal = {r["id"]: (r["n"], r["mean"], r["median"]) for r in rs.zonal_stats(zone, raster).collect()}
    assert zonal == {1: (2, 6.0, 6.0), 2: (0, None, None)}


def test_log(spark):
    rows = [(i, i % 2, i % 4, i // 4, f"f{i}") for i in range(20)]
    log = spark.createDataFrame(rows, "id long, project long, layer long, seq_order long, subset_string string")
    assert values(lg.last_filters(log)) == [16, 17, 18, 19] and len(lg.last_filters(log, 2).collect()) == 8
    before = {r["id"]: r["previous_subset"] for r in lg.with_previous(log).collect()}
    assert before[3] is None and before[7] == "f3"


# --- export and streams ------------------------------------------------------------------------------------


@pytest.fixture()
def some_points(spark):
    df = spark.createDataFrame([(1, 2.0, 48.5, "a"), (2, None, 1.0, None)], "id long, x double, y double, t string")
    return Layer(df, "id", PointColumns(), "EPSG:4326", "some: points")


def test_export_formats(spark, some_points, tmp_path):
    for fmt in writers.FORMATS:
        assert writers.export(some_points, f"{tmp_path}/{fmt}", fmt) == 2
    features = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/geojson").collect()]
    first = next(f for f in features if f["properties"]["id"] == 1)
    assert first == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [2.0, 48.5]},
                     "properties": {"id": 1, "t": "a"}}
    back = readers.read_layer(spark, "delimitedtext", f"{tmp_path}/csv", wkt="wkt", schema="id long, t string, wkt string")
    point = back.df.where("id = 1").select(geo.start_point(F.col("geom"))["y"]).first()[0]
    assert point == 48.5 and back.df.where("id = 2").first()["geom"] is None
    xy = readers.read_layer(spark, "json", f"{tmp_path}/json", xy=("x", "y"))
    assert xy.df.count() == 2
    renamed = writers.export_frame(some_points, "EPSG:3857", {"t": "title"})
    assert renamed.columns == ["id", "x", "y", "title"] and round(renamed.first()["x"], 2) == 222638.98
    with pytest.raises(ValueError):
        writers.export_frame(some_points, fmt="shp")
    with pytest.raises(ValueError):
        readers.read_table(spark, "shapefile")


def test_export_many_goes_on_after_a_failure(spark, some_points, tmp_path):
    broken = some_points.with_df(some_points.df.withColumn("bad", F.raise_error(F.lit("no"))))
    done = {r["layer"]: r for r in writers.export_many(
        {"a:b": some_points, "broken": broken, "c": some_points.where("id = 1")}, str(tmp_path)).collect()}
    assert done["a:b"]["ok"] and done["a:b"]["path"].endswith("a_b") and done["c"]["rows"] == 1
    assert not done["broken"]["ok"] and done["broken"]["error"]
    writers.export_package({"p": some_points, "q": some_points.where("id = 1")}, f"{tmp_path}/package")
    assert spark.read.parquet(f"{tmp_path}/package").groupBy("layer").count().count() == 2
    assert writers.safe_name('a<b>—c–"d"/e') == "a_b_-c-_d__e"


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.range(200).select(
        "id", (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 10).cast("double").alias("y"),
        F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") % 3).alias("layer"), F.lit(0).alias("project"),
        F.col("id").alias("seq_order"), F.col("id").cast("string").alias("subset_string"))
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    feed = lambda: streams.read_stream(spark, f"{tmp_path}/in", rows.schema, max_files=1)
    fence = Layer(spark.createDataFrame([(1, 2.0, 2.0, 5.0, 5.0), (2, 3.0, 3.0, 5.5, 5.5)],
                                        "fid long, xmin double, ymin double, xmax double, ymax double"), "fid", BoxColumns())
    hits = streams.geofence(Layer(feed(), "id", PointColumns()), fence)
    streams.export_stream(hits, f"{tmp_path}/hits", f"{tmp_path}/c1").awaitTermination()
    expected = values(rows.where("x BETWEEN 2 AND 5.5 AND y BETWEEN 2 AND 5.5 AND (x <= 5 AND y <= 5 OR x >= 3 AND y >= 3)"))
    assert values(spark.read.parquet(f"{tmp_path}/hits")) == expected
    streams.latest_stream(feed(), f"{tmp_path}/latest", f"{tmp_path}/c2").awaitTermination()
    assert values(streams.read_latest(spark, f"{tmp_path}/latest")) == values(lg.last_filters(rows))


def test_checkpoint_folder_is_the_session_s(spark):
    assert checkpoint_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_layer_checks_its_columns(spark):
    with pytest.raises(ValueError):
        Layer(spark.range(1), "nope", None)
    with pytest.raises(ValueError):
        Layer(spark.range(1), "id", PointColumns())


def test_geofence_does_not_depend_on_batches(spark, tmp_path):
    """Files whose times overlap by days, one per batch, fences of two size levels."""
    rows = spark.range(600).select(
        "id", (F.col("id") % 37 * 3).cast("double").alias("x"), (F.col("id") % 41 * 2).cast("double").alias("y"),
        F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(10 * 86400))).alias("ts"))
    rows.repartition(6).write.parquet(f"{tmp_path}/in")
    boxes = [(1, 0.0, 0.0, 60.0, 60.0), (2, 90.0, 70.0, 91.0, 71.0), (3, 30.0, 30.0, 32.0, 33.0)]
    fence = Layer(spark.createDataFrame(boxes, "fid long, xmin double, ymin double, xmax double, ymax double"), "fid",
                  BoxColumns())
    for files in (1, 100):
        feed = streams.read_stream(spark, f"{tmp_path}/in", rows.schema, max_files=files)
        hits = streams.geofence(Layer(feed, "id", PointColumns()), fence)
        streams.export_stream(hits, f"{tmp_path}/hits{files}", f"{tmp_path}/c{files}").awaitTermination()
        expected = rows.where("x <= 60 AND y <= 60 OR x BETWEEN 90 AND 91 AND y BETWEEN 70 AND 71")
        assert values(spark.read.parquet(f"{tmp_path}/hits{files}")) == values(expected)


def test_similar_to_takes_dots_literally(spark):
    rows = spark.createDataFrame([("a.b",), ("axb",), ("a\nb",), ("a^$b",)], "t string")
    hits = lambda p: {r.t for r in rows.where(ex.matches(F.col("t"), "SIMILAR TO", p)).collect()}
    assert hits("a.b") == {"a.b"} and hits("a_b") == {"a.b", "axb", "a\nb"} and hits("a^$b") == {"a^$b"}
    assert hits("a[.x]b") == {"a.b", "axb"} and hits("a\\%b") == set() and hits("a%") == {r.t for r in rows.collect()}


def test_boxes_off_the_grid_are_an_error(spark):
    boxes = spark.createDataFrame([(1, 0.2, 0.2, 0.8, 0.8)], "id long, xmin double, ymin double, xmax double, ymax double")
    with pytest.raises(Exception, match="aligned"):
        ag.dissolve_boxes(Layer(boxes, "id", BoxColumns()), [], 1.0).collect()


def test_vanished_sources_do_not_count(spark):
    ddl = "id long, xmin double, ymin double, xmax double, ymax double"
    point = Layer(spark.createDataFrame([(1, 50.0, 50.0)], "id long, x double, y double"), "id", PointColumns())
    big, small = (1, 0.0, 0.0, 100.0, 100.0), (2, 900.0, 900.0, 902.0, 902.0)
    for rows, any_, all_ in (([big, small], 0, 0), ([small], 0, 1)):
        boxes = Layer(spark.createDataFrame(rows, ddl), "id", BoxColumns())
        assert spatial_filter(point, boxes, "disjoint", radius=-5).count() == any_
        assert spatial_filter(point, boxes, "disjoint", radius=-5, mode="all").count() == all_


def test_rows_without_a_key_stay_apart(spark):
    points = spark.createDataFrame([(None, 50.0, 50.0), (1, 0.0, 1.0), (None, 0.5, 0.5)], "id long, x double, y double")
    box = Layer(spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0)], "id long, xmin double, ymin double, xmax double, ymax double"),
                "id", BoxColumns())
    found = spatial_filter(Layer(points, "id", PointColumns()), box, ("disjoint", "touches"), mode="all")
    assert sorted(r.x for r in found.collect()) == [0.0, 50.0]


def test_median_with_an_outlier_and_a_null_group(spark):
    rows = spark.range(20_001).select(F.when(F.col("id") % 2 == 0, "a").alias("g"), F.col("id").cast("double").alias("v"))
    rows = rows.union(spark.createDataFrame([("a", 1e18)], "g string, v double"))
    got = {r.g: r.m for r in wn.exact_median(rows, ["g"], "v", "m").collect()}
    assert got == {"a": 10001.0, None: 10000.0}


def test_the_scan_is_pruned_by_the_source_extent(spark, tmp_path, capsys):
    spark.range(1000).select("id", F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y")).write.parquet(
        f"{tmp_path}/points")
    points = Layer(spark.read.parquet(f"{tmp_path}/points"), "id", PointColumns())
    box = Layer(spark.createDataFrame([(1, 10.0, 10.0, 20.0, 20.0)], "id long, xmin double, ymin double, xmax double, ymax double"),
                "id", BoxColumns())
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    found = spatial_filter(points, box)
    found.explain("formatted")
    plan = capsys.readouterr().out
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(x," in plan and "LessThanOrEqual(y," in plan
    assert found.count() == 11


def test_reset_to_the_last_saved_filter(spark):
    layer = Layer(spark.range(10), "id", None)
    log = spark.createDataFrame([("a", 1, "id > 7"), ("a", 2, "id > 3"), ("b", 9, "id > 8"), (None, 1, "id = 0"),
                                 ("c", 1, "")], "layer string, seq_order int, subset_string string")
    counts = [lg.reset_filter(layer, log, {"layer": k}).df.count() for k in ("a", "b", None, "c", "d")]
    assert counts == [6, 1, 1, 10, 10]


def test_latest_entries_stay_in_few_folders(spark, tmp_path):
    rows = spark.range(400).select(
        (F.col("id") % 3).alias("layer"), F.lit(0).alias("project"), F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("seq_order"),
        F.col("id").cast("string").alias("subset_string")).dropDuplicates(["layer", "seq_order"])
    rows.repartition(11).write.parquet(f"{tmp_path}/in")
    feed = streams.read_stream(spark, f"{tmp_path}/in", rows.schema, max_files=1)
    streams.latest_stream(feed, f"{tmp_path}/latest", f"{tmp_path}/state", merge_every=2).awaitTermination()
    columns = ["layer", "project", "seq_order", "subset_string"]
    got, expected = (sorted(map(tuple, df.select(*columns).collect())) for df in (
        streams.read_latest(spark, f"{tmp_path}/latest"), lg.last_filters(rows)))
    assert got == expected and len(got) == 3
    assert len(list((tmp_path / "latest").glob("slot=*"))) == 6


@pytest.mark.parametrize("kind", ["boxes", "shapes"])
def test_geofence_of_moving_shapes(spark, tmp_path, kind):
    """Sizes that the plan has not seen, over many levels, each row a batch of its own or all in one."""
    rows = spark.range(120).select("id", (F.col("id") % 40).cast("double").alias("xmin"), F.lit(0.0).alias("ymin")).withColumns(
        {"xmax": F.col("xmin") + F.pow(F.lit(3.0), F.col("id") % 11) / 10, "ymax": F.pow(F.lit(2.0), F.col("id") % 7) / 8})
    boxes = Layer(rows, "id", BoxColumns())
    rows = boxes.as_shapes().df if kind == "shapes" else rows
    geometry = ShapeColumn() if kind == "shapes" else BoxColumns()
    rows.repartition(6).write.parquet(f"{tmp_path}/in")
    fences = spark.createDataFrame([(1, 50.0, 1.0, 51.0, 2.0), (2, 300.0, 0.0, 900.0, 700.0), (3, 7.0, 0.0, 7.01, 0.01)],
                                   "fid long, xmin double, ymin double, xmax double, ymax double")
    feed = streams.read_stream(spark, f"{tmp_path}/in", rows.schema, max_files=2)
    hits = streams.geofence(Layer(feed, "id", geometry), Layer(fences, "fid", BoxColumns()))
    streams.export_stream(hits.select("id"), f"{tmp_path}/hits", f"{tmp_path}/c").awaitTermination()
    want = boxes.df.alias("t").join(fences.alias("f"), F.expr(
        "t.xmin <= f.xmax AND t.xmax >= f.xmin AND t.ymin <= f.ymax AND t.ymax >= f.ymin")).select("id").distinct()
    assert values(spark.read.parquet(f"{tmp_path}/hits")) == values(want) and want.count() > 10
    with pytest.raises(ValueError, match="stream"):
        streams.geofence(Layer(feed, "id", geometry).as_shapes(), Layer(fences, "fid", BoxColumns()), ("within",))


def test_filter_type_report(spark):
    df = spark.createDataFrame([("1", 2, "a"), ("x", 3, "b"), ("", None, None), (None, 4, "c")], "code string, n int, t string")
    report = lambda e: [tuple(r) for r in pf.filter_type_report(df, e).collect()]
    assert report("code > 5 AND n LIKE '1%' AND t = 'code < 3' AND try_cast(code AS double) < 7") == [
        ("code", ">", "string", "try_cast(code AS double)", 2, 0.5), ("n", "LIKE", "int", "cast(n AS string)", 3, 1.0)]
    assert report("`code` NOT BETWEEN 1 AND 2 OR code<>-3.5") == [
        ("code", "<>", "string", "try_cast(code AS double)", 2, 0.5),
        ("code", "NOT BETWEEN", "string", "try_cast(code AS double)", 2, 0.5)]
    assert report("n > 5 AND t LIKE 'x' AND other.code > 3 AND code = '4'") == []
    assert pf.filter_type_report(df.limit(0), "code > 5").first().fitting_share is None
