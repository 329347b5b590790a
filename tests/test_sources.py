"""Trip, shape and map files; parameters; the command line."""

import json
import time
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veiltrack.functions import text as txt
from veiltrack.functions.geo import bounds
from veiltrack.plans.cli import main
from veiltrack.plans.config import INTERACTIVE, DIConfig, describe, dump_json, load_json, parse_config, validate
from veiltrack.plans.progress import watched
from veiltrack.sinks.shapes import shape_lines, write_shapes
from veiltrack.sources import osm
from veiltrack.sources.shapes import parse_intervals, read_shapes
from veiltrack.sources.trips import HEADER, number_points, parse_records, read_list, read_mapped_trips, read_trips, split_trips, trip_counters


def test_split_fields(spark):
    cases = {"a,b,": ["a", "b"], "a,,b": ["a", "", "b"], "": [], ",": [""], "a": ["a"], "a,b,,": ["a", "b", ""]}
    rows = spark.createDataFrame([(k,) for k in cases], "line string").select("line", txt.split_fields(F.col("line"), ",").alias("f")).collect()
    assert {r.line: r.f for r in rows} == cases


@pytest.mark.parametrize("text, number", [("12abc", 12.0), ("  -3.5e2x", -350.0), ("12f", 12.0), (".5", 0.5), ("abc", None), ("", None), ("1e999", None), ("+7", 7.0)])
def test_number_prefix(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(txt.number_prefix(F.col("t"))).first()[0] == number


def record(lat="42.0", lon="-83.0", heading="10", speed="5", time="100", uid=("1", "2"), tail=",9"):
    return ",".join([*uid, "t", time, "0", "0", "0", lat, lon, "0", speed, heading, *["0"] * 6]) + tail


OUTCOMES = [(record(), "ok"), (record(tail=""), "field"), (record(tail=",9,"), "ok"), (record(tail=","), "field"), (record(lat="81"), "geo"), (record(lat="-84.1"), "geo"), (record(lon="180"), "geo"), (record("0", "0"), "geo"), (record(heading="360"), "ok"), (record(heading="360.1"), "heading"), (record(heading="-1"), "heading"), (record(lat="x"), "unparsable"), (record(lat="x", lon="999"), "unparsable"), (record(lat="99", lon="x"), "geo"), (record(speed="?"), "unparsable"), (record(time="-5"), "unparsable"), (record(lat="nan"), "unparsable"), ("", "field")]


def test_first_fault_decides(spark):
    rows = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(OUTCOMES)], "seq long, line string")
    got = {r.seq: r.outcome for r in parse_records(rows).collect()}
    assert [got[i] for i in range(len(OUTCOMES))] == [o for _, o in OUTCOMES]


def test_trip_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *(line for line, _ in OUTCOMES)]) + "\n")
    (tmp_path / "b.csv").write_text(HEADER + "\n")
    (tmp_path / "c.csv").write_text(HEADER + "\nonly,three,fields\n" + record() + "\n")
    records = read_trips(spark, str(tmp_path))
    counters = trip_counters(records).collect()
    assert [tuple(r) for r in counters] == [("1_2", len(OUTCOMES), 3, 5, 2)]
    points = number_points(records).orderBy("idx").collect()
    assert [p.idx for p in points] == [0, 1, 2] and points[0].raw == record()
    (tmp_path / "list.txt").write_text("x.csv:aux\n\ny.csv\n")
    assert read_list(spark, str(tmp_path / "list.txt")) == [("x.csv", "aux"), ("y.csv", None)]


def test_mapped_files_hold_several_trips(spark, tmp_path):
    head = "Speed,Latitude,RxDevice,Longitude,FileId,Gentime,Heading"
    rows = [("1", "1"), ("1", "1"), ("2", "1"), ("1", "1"), ("1", "2")]
    lines = [f"3,{42 + i / 100},{a},-83,{b},{i},90" for i, (a, b) in enumerate(rows)]
    (tmp_path / "m.csv").write_text("\n".join([head, *lines, "3,1"]) + "\n")
    records = read_mapped_trips(spark, str(tmp_path / "m.csv"))
    runs = [(r.run, r.uid) for r in records.orderBy("block", "seq").collect()][:5]
    assert runs == [(0, "1_1"), (0, "1_1"), (1, "2_1"), (2, "1_1"), (3, "1_2")]
    points = number_points(records).orderBy("time_us").collect()
    assert [p.idx for p in points] == [0, 1, 0, 0, 0] and points[1].lat == 42.01
    with pytest.raises(Exception, match="no column Nothing"):
        read_mapped_trips(spark, str(tmp_path / "m.csv"), lat="Nothing").collect()


def test_runs_across_blocks(spark):
    uids = "aabbbbbaccd"
    rows = [("f", b, s, u) for s, u in enumerate(uids) for b in [s // 3]]
    got = split_trips(spark.createDataFrame(rows, "file string, block long, seq long, uid string")).orderBy("seq").collect()
    assert [r.run for r in got] == [0, 0, 1, 1, 1, 1, 1, 2, 3, 3, 4]


SHAPES = """type,id,geography,attributes
circle,1,42.25:-83.5:100
circle,2,42.3:-83.55:12.5
circle,7,-12.125:130.5:3000
grid,0_0,42.0:-84.0:42.5:-83.5
grid,0_1,42.0:-83.5:42.5:-83.0
grid,3_12,42.5:-84.0:43.0:-83.5
edge,10,1;42.1;-83.9:2;42.2;-83.8,way_type=secondary:way_id=10
edge,11,2;42.2;-83.8:3;42.2;-83.7,way_type=motorway:way_id=11
edge,12,3;42.2;-83.7:4;42.3;-83.65
edge,13,4;42.3;-83.65:1;42.1;-83.9,way_type=service:way_id=13
"""
FAULTY = """type,id,geography,attributes
circle,1
grid,0_0,42.0:-84.0:42.5:-83.5,a=b,c
edge,10,1;42.1;-83.9:2;42.2;-83.8,way_type=secondary:way_id=10
"""


def test_shape_files(spark, tmp_path):
    (tmp_path / "good").write_text(SHAPES)
    (tmp_path / "bad").write_text(FAULTY)
    good = read_shapes(spark, str(tmp_path / "good"))
    assert (good.circles.count(), good.grids.count(), good.edges.count(), good.bad.count()) == (3, 3, 4, 0)
    bad = read_shapes(spark, str(tmp_path / "bad"))
    assert (bad.circles.count(), bad.grids.count(), bad.edges.count(), bad.bad.count()) == (0, 0, 1, 2)
    write_shapes(str(tmp_path / "out"), good.edges, good.circles, good.grids)
    back = read_shapes(spark, str(tmp_path / "out"))
    for before, after in zip(good[:3], back[:3]):
        assert sorted(tuple(r) for r in before.drop("file", "seq").collect()) == sorted(tuple(r) for r in after.drop("file", "seq").collect())
    assert shape_lines(good.edges).filter("part = 2").first().line.startswith("edge,")


def test_shape_rules(spark, tmp_path):
    lines = ["type,id,geography,attributes", "edge,1,1;42;-83:2;42.1;-83,way_type= Secondary :way_id=7", "edge,2,1;50;50:3;42.2;-83", "edge,3,1;42;-83:1;42;-83", "edge,4,5;91;0:6;42;-83", "line,5,3;0;0:2;0;0,way_type=unheard", "circle,1,42:-83:5", "circle,2,42:-83:-5", "grid,1_2,42:-83:43:-82", "grid,12,42:-83:43:-82", "cloud,1,1", "edge,9,1;2:3;4"]
    (tmp_path / "s").write_text("\n".join(lines))
    found = read_shapes(spark, str(tmp_path / "s"))
    edges = {r.edge_id: r for r in found.edges.collect()}
    assert set(edges) == {1, 2, 5}
    assert (edges[1].way_type, edges[1].width, edges[2].way_type, edges[2].width) == (3, 17.0, 42, 80.0)
    assert (edges[2].v1_lat, edges[5].v1_lat) == (42.0, 42.2)  # where a vertex was first named
    assert found.circles.count() == 1 and found.grids.count() == 1 and found.bad.count() == 5


def test_interval_lines(spark):
    rows = spark.createDataFrame([("critical_interval,0,3;9,stop;ta",), ("critical_interval,1,10;12",), ("privacy_interval,2,12;20,forward:ci",)], "line string")
    assert [(r.id, r.left, r.right, r.aux) for r in parse_intervals(rows, "critical_interval").orderBy("id").collect()] == [(0, 3, 9, ["stop", "ta"]), (1, 10, 12, [])]
    assert [tuple(r) for r in parse_intervals(rows, "privacy_interval").collect()] == [(2, 12, 20, ["forward:ci"])]


OSM = """<?xml version="1.0"?><osm>
<node id="1" lat="42.0" lon="-83.0"/><node id="2" lat="42.1" lon="-83.0"/><node id="3" lat="42.1" lon="-83.0"/><node id="4" lat="42.2" lon="-83.1"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="99"/><nd ref="4"/><tag k="name" v="x"/><tag k="highway" v="primary"/></way>
<way id="11"><nd ref="3"/><nd ref="1"/><tag k="highway" v="path"/><tag k="highway" v="primary"/></way>
<way id="12"><nd ref="4"/><nd ref="1"/></way></osm>"""


def test_street_maps(spark, tmp_path):
    (tmp_path / "m.osm").write_text(OSM)
    nodes, ways = osm.read_nodes(spark, str(tmp_path / "m.osm")), osm.read_ways(spark, str(tmp_path / "m.osm"))
    assert {r.node_id: r.unified_id for r in osm.unify_nodes(nodes).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}
    assert {r.way_id: r.way_type for r in ways.collect()} == {10: "primary", 11: "primary", 12: ""}
    segments = osm.way_segments(ways, nodes)
    assert sorted((r.way_id, r.v1_id, r.v2_id) for r in segments.collect()) == [(10, 1, 2), (11, 2, 1), (12, 4, 1)]
    assert sorted(r.way_id for r in osm.dedup_segments(segments).collect()) == [10, 12]
    box = bounds(42.05, -84.0, 43.0, -82.0)
    assert sorted(r.way_id for r in osm.way_segments(ways, nodes, box).collect()) == [11, 12]
    assert tuple(osm.osm_bounds(nodes).first()) == (42.0, -83.1, 42.2, -83.0)
    lines = [r.line for r in osm.shape_lines(osm.dedup_segments(segments)).orderBy("seq").collect()]
    (tmp_path / "s").write_text("\n".join(["type,id,geography,attributes", *lines]))
    assert sorted(r.way_type for r in read_shapes(spark, str(tmp_path / "s")).edges.collect()) == [2, 42]


def test_numbers_go_on_from_range_to_range(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("pos"), F.lit("x").alias("x")).repartition(9)
    found = osm.numbered(rows, ["pos"])
    assert sorted((r.pos, r.seq) for r in found.collect()) == [(i, i + 1) for i in range(1000)]
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert osm.numbered(rows.limit(0), ["pos"]).count() == 0


def test_shares_rise_while_a_run_goes_on(spark):
    def slow(batches):
        for b in batches:
            time.sleep(0.4)
            yield b

    told = []
    with watched(spark, told.append, 0.1):
        spark.range(0, 24, 1, 24).mapInPandas(slow, "id long").write.format("noop").mode("overwrite").save()
    assert told == sorted(told) and told[-1] == 1.0 and len([x for x in told if 0 < x < 1]) > 3
    failed = []
    with pytest.raises(Exception, match="no"):
        with watched(spark, failed.append, 0.1):
            spark.range(3).select(F.raise_error(F.lit("no"))).collect()
    assert 1.0 not in failed


CONFIG = """quad_sw_lat:42.10
quad_sw_lng:-83.95
plot_kml:1
mf_fit_ext:0.5
mf_scale:1.0
ta_area_width:30.0
ta_heading_delta:90.0
n_heading_groups:24
max_out_degree:9
"""


def test_config_lines():
    now, old = parse_config(CONFIG), parse_config(CONFIG, legacy=True)
    assert old.fit_extension == 1.0 and old.ta_area_width == 90.0
    assert now.fit_scale == 1.0 and now.ta_heading_delta == 90.0 and now.sw_lat == 42.1 and now.heading_groups == 24 and now.plot_kml
    assert parse_config("nothing\nstop_max_time:abc\nplot_kml:1\n") == replace(DIConfig(), plot_kml=True)
    assert parse_config(describe(now)) == now


@pytest.mark.parametrize("wrong", [{"heading-groups": 11}, {"heading-groups": 12.5}, {"fit-ext": "wide"}, {"min-direct-distance": 20000}, {"lat-field": "a,b"}, {"uid-fields": "x" * 129}, {"ta-heading-delta": 361}])
def test_json_config(wrong):
    assert load_json(dump_json(INTERACTIVE)) == INTERACTIVE
    assert load_json('{"min-out-degree": "3", "unknown": 1}').min_out_degree == 3
    with pytest.raises(ValueError):
        load_json(json.dumps(wrong))
    assert validate(DIConfig()) == DIConfig()


def drive(n=240):
    """Records of a trip along a road and back on a second one, with a stop on the way."""
    lines = []
    for i in range(n):
        moving = min(i, 100) + max(0, i - 130)
        lat, lon = 42.2 + 0.00002 * moving, -83.8 + 0.00001 * (i % 2)
        lines.append(record(f"{lat:.6f}", f"{lon:.6f}", "0" if i < 180 else "90", "0.5" if 100 <= i < 130 else "20", str(i * 100_000), ("7", "8")))
    return lines


def test_command_line(spark, tmp_path, capsys):
    config = describe(replace(INTERACTIVE, min_direct=5.0, max_direct=30.0, min_manhattan=5.0, max_manhattan=30.0, sw_lat=42.19, sw_lon=-83.81, ne_lat=42.22, ne_lon=-83.79))
    (tmp_path / "c").write_text(config)
    (tmp_path / "roads").write_text("type,id,geography,attributes\nedge,1,1;42.199;-83.8:2;42.202;-83.8,way_type=secondary:way_id=1\nedge,2,2;42.202;-83.8:3;42.206;-83.8,way_type=residential:way_id=2\n")
    lines = [HEADER, *drive()]
    (tmp_path / "trip.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "list").write_text(f"{tmp_path}/trip.csv:one\n{tmp_path}/missing.csv\n")
    code = main(["-c", str(tmp_path / "c"), "-q", str(tmp_path / "roads"), "-o", str(tmp_path / "out"), "-k", str(tmp_path / "kml"), "-l", "-n", "-v", str(tmp_path / "list")], spark)
    said = capsys.readouterr()
    assert code == 0 and said.out.splitlines()[-1].startswith("240,0,0,0,0,") and "missing.csv" in said.err
    assert "points fit to roads: 240 rows" in said.err and "privacy intervals: " in said.err
    kept = (tmp_path / "out" / "7_8.csv").read_text().splitlines()
    assert kept[0] == HEADER and 0 < len(kept) < len(lines) and set(kept[1:]) <= set(lines)
    kml = (tmp_path / "kml" / "7_8.di.kml").read_text()
    assert kml.startswith("<?xml") and "stop_marker_style" in kml and kml.count("<LineString>") > 2


def test_mapped_command_line(spark, tmp_path):
    (tmp_path / "c.json").write_text(dump_json(replace(INTERACTIVE, plot_kml=False)))
    rows = [f"20,{42.2 + i * 0.0001},{'ab'[i // 60]},-83.8,1,{i * 100000},0" for i in range(120)]
    (tmp_path / "m.csv").write_text("\n".join(["Speed,Latitude,RxDevice,Longitude,FileId,Gentime,Heading", *rows]) + "\n")
    assert main(["-m", "-c", str(tmp_path / "c.json"), "-o", str(tmp_path / "out"), str(tmp_path / "m.csv")], spark) == 0
    assert sorted(p.name.split("|")[-1] for p in (tmp_path / "out").iterdir()) == ["a_1.di.csv", "b_1.di.csv"]
