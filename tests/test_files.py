"""Files of a trip each: they appear on commit, whole, and a failed job leaves none."""

import os

import pytest
from pyspark.sql import functions as F

from veiltrack.functions.geo import LatLon
from veiltrack.operators.fit import CORNERS, edge_areas
from veiltrack.sinks import kml
from veiltrack.sinks.csv import trip_text, write_trip_files
from veiltrack.sinks.files import write_files
from veiltrack.sources.trips import read_trips


def trips(spark, n=40):
    return spark.range(n * 50).select((F.col("id") % n).cast("string").alias("trip_id"), F.floor(F.col("id") / n).alias("idx"), F.concat(F.lit("é,"), F.col("id").cast("string")).alias("raw")).repartition(7)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_trip_files_are_whole(spark, tmp_path, scheme):
    points = trips(spark).unionByName(spark.createDataFrame([(None, 0, "no id"), ("a/b", 0, "x\r"), ("..", 0, "up"), ("a b|c", 1, "2"), ("a b|c", 0, "1")], "trip_id string, idx long, raw string"))
    lost = spark.createDataFrame([("lost",)], "trip_id string").unionByName(points.select("trip_id"))
    rows = write_trip_files(points, f"{scheme}{tmp_path}/out", ".csv", "head", trip_ids=lost).collect()
    want = {r.trip_id: r.file_text for r in trip_text(points, "head", trip_ids=lost).collect()}
    assert want["lost"] == "head\n" and want["a b|c"] == "head\n1\n2\n"
    want[None] = "head\nno id\n"  # which a join by trip doesn't find
    assert {r.trip_id: open(r.path.removeprefix("file://"), encoding="utf-8").read() for r in rows} == want
    assert sorted(os.listdir(tmp_path / "out")) == sorted(os.path.basename(r.path) for r in rows) and "a b|c.csv" in os.listdir(tmp_path / "out")
    assert os.listdir(tmp_path) == ["out"]


def test_a_failed_job_leaves_nothing_and_a_second_run_replaces(spark, tmp_path):
    folder = str(tmp_path / "out")
    points = trips(spark, 6)
    write_trip_files(points, folder, ".csv", "first")
    before = {f: (tmp_path / "out" / f).read_text() for f in os.listdir(folder)}
    fails = points.withColumn("raw", F.when((F.col("trip_id") == "3") & (F.col("idx") == 40), F.raise_error(F.lit("broken"))).otherwise(F.col("raw")))
    with pytest.raises(Exception, match="broken"):
        write_trip_files(fails, folder, ".csv", "second")
    assert {f: (tmp_path / "out" / f).read_text() for f in os.listdir(folder)} == before
    write_trip_files(points.filter("trip_id = '3'"), folder, ".csv", "third")
    after = {f: (tmp_path / "out" / f).read_text() for f in os.listdir(folder)}
    assert set(after) == set(before) and [f for f in after if after[f] != before[f]] == ["3.csv"] and after["3.csv"].startswith("third\n")


def test_empty_and_many_names(spark, tmp_path):
    none = trips(spark).limit(0)
    write_files(none, F.col("trip_id"), F.col("raw"), str(tmp_path / "none"), "", ["idx"])
    assert not os.path.isdir(tmp_path / "none") or os.listdir(tmp_path / "none") == []
    many = spark.range(500).select(F.col("id").cast("string").alias("trip_id"), F.lit(None).cast("string").alias("raw"))
    write_files(many, F.col("trip_id"), F.col("raw"), str(tmp_path / "many"), ".txt", [])
    assert len(os.listdir(tmp_path / "many")) == 500 and (tmp_path / "many" / "7.txt").read_text() == ""


def test_kml_draws_the_areas_of_the_fit(spark, tmp_path):
    edges = [(1, 1, 42.2, -83.8, 2, 42.201, -83.8, 2), (2, 2, 42.201, -83.8, 3, 42.201, -83.799, 0)]
    roads = spark.createDataFrame(edges, "edge_id long, v1_id long, v1_lat double, v1_lon double, v2_id long, v2_lat double, v2_lon double, way_type int").withColumn("width", F.when(F.col("way_type") == 2, 30.0).otherwise(22.0))
    rows = [("t", i, 42.2 + i * 1e-5, -83.8, 10.0, True, e[0], e[7], e[2], e[3], e[5], e[6], False, False) for i, e in enumerate(edges * 3)] + [("t", 6, 42.3, -83.8, 1.0, False, 0, None, 42.3, -83.8, 42.31, -83.8, False, False)]
    marked = spark.createDataFrame(rows, "trip_id string, idx long, lat double, lon double, speed double, edge_explicit boolean, edge_id long, edge_way_type int, v1_lat double, v1_lon double, v2_lat double, v2_lon double, is_critical boolean, is_private boolean")
    found = spark.createDataFrame([("t", 0, 1, ["start_pt"])], "trip_id string, left long, right long, aux array<string>")
    drawn = kml.trip_kml(marked, found, 1.5, 7.0)
    content = drawn.first().content
    for r in edge_areas(roads, 1.5, 7.0).select(*CORNERS).collect():
        assert kml.polygon_mark([LatLon(r[f"c{i}_lat"], r[f"c{i}_lon"]) for i in range(4)], "explicit_boxes") in content
    assert content.count("#explicit_boxes") == 2 and content.count("#implicit_boxes") == 1
    (path,) = kml.write_kml(drawn, str(tmp_path / "kml")).collect()
    assert open(path.path).read() == content and path.path.endswith("/t.di.kml")


def test_trip_files_are_read_once(spark, tmp_path):
    record = ",".join(["a", "b", "c", "5", *"012", "42.2", "-83.9", "1", "2", "3", *["0"] * 7])
    for name, text in {"two": f"head\n{record}\nx\n", "short": f"head\nx\n{record}\n", "header": "head\n", "empty": "", "line": f"\n{record}"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    found = read_trips(spark, str(tmp_path))
    assert found.columns == ["file", "block", "seq", "line", "parts", "lat", "lon", "heading", "speed", "time_us", "outcome", "trip_id"]
    rows = sorted((os.path.basename(r.file), r.seq, r.line, r.outcome, r.trip_id) for r in found.collect())
    assert rows == [("line.csv", 1, record, "ok", "a_b"), ("two.csv", 1, record, "ok", "a_b"), ("two.csv", 2, "x", "field", "a_b")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
