"""The streaming form against the batch pipeline."""

import shutil
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from veiltrack.operators.fit import count_choices, fit_trips
from veiltrack.operators.roads import build_index, vertices
from veiltrack.plans import demo
from veiltrack.plans.pipeline import run
from veiltrack.queries import SMALL
from veiltrack.streaming import online
from veiltrack.streaming.online import fit_trip, kept_points, stream_kept_points, use_state_store, with_candidates


#: Limits under which something of each trip is kept.
SHORT = replace(SMALL, ta_max_speed=1.0, stop_max_speed=0.1, min_direct=5.0, max_direct=15.0, min_manhattan=5.0, max_manhattan=20.0, min_out_degree=0)


def few(spark, sf_dir, **options):
    return demo.trips(spark, sf_dir, **options).filter(F.col("trip_id").cast("int") < 6)


def keys(rows):
    return sorted((r.trip_id, r.idx, r.raw) for r in rows)


@pytest.mark.parametrize("on_map, random_parts", [(False, 0.0), (True, 0.0), (True, 0.8)])
def test_whole_trips_as_in_the_pipeline(spark, sf_dir, on_map, random_parts):
    points = few(spark, sf_dir, outliers=True)
    edges = demo.roads(spark, sf_dir) if on_map else None
    config = replace(SHORT, rand_direct=random_parts, rand_manhattan=random_parts, rand_out_degree=random_parts, seed=7)
    batch = run(points, edges, config)
    want = keys(batch.kept.collect())
    assert keys(kept_points(points, config, edges).collect()) == want and want


def test_fit_and_choices_as_in_batch(spark, sf_dir):
    points, edges = demo.trips(spark, sf_dir), demo.roads(spark, sf_dir)
    index = build_index(edges, (SMALL.sw_lat, SMALL.sw_lon), (SMALL.ne_lat, SMALL.ne_lon))
    batch = count_choices(fit_trips(points, edges, index, SMALL.fit_scale, SMALL.fit_extension, SMALL.heading_groups, SMALL.min_edge_points), vertices(edges))
    want = {(r.trip_id, r.idx): (r.edge_explicit, r.edge_id, r.out_degree, round(r.v1_lat, 9), round(r.v2_lon, 9)) for r in batch.collect()}
    for trip_id, trip in with_candidates(points, edges, SMALL).toPandas().groupby("trip_id"):
        fitted = fit_trip(trip.sort_values("idx").reset_index(drop=True), SMALL)
        for r in fitted.itertuples():
            assert want[trip_id, r.idx] == (r.edge_explicit, r.edge_id, r.out_degree, round(r.v1_lat, 9), round(r.v2_lon, 9))
    assert any(v[0] for v in want.values()) and any(v[2] for v in want.values())


@pytest.fixture
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    use_state_store(spark)
    yield
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def test_stream_closes_trips_after_restarts(spark, sf_dir, tmp_path, state_store, monkeypatch):
    """A trip comes in many batches, the query is stopped and started between them, and what it keeps is what the batch keeps."""
    points, edges = few(spark, sf_dir), demo.roads(spark, sf_dir)
    config = replace(SHORT, rand_direct=0.5, seed=3)
    want = keys(kept_points(points, config, edges).collect())
    timed = points.withColumn("ts", (F.lit(1_700_000_000) + F.col("time_us") / 1e6).cast("timestamp"))
    later = timed.limit(1).withColumn("trip_id", F.lit("later"))
    parts = [timed.filter(F.expr(f"idx between {a} and {a + 24}")) for a in (0, 25, 50, 75)] + [later.withColumn("ts", F.lit(t).cast("timestamp")) for t in (1_800_000_000, 1_800_000_600)]
    whole, source = tmp_path / "whole", tmp_path / "in"
    for n, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(whole / str(n)))
    source.mkdir()
    out = []
    for starts in ((0, 1), (2, 3), (4, 5)):
        for n in starts:
            for f in (whole / str(n)).glob("*.parquet"):
                shutil.copy(f, source / f"{n}.parquet")
        stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        query = stream_kept_points(stream, config, edges).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    out = spark.read.parquet(str(tmp_path / "out")).filter("trip_id <> 'later'").collect()
    assert keys(out) == want and want


class Handle:
    """State of one trip, which counts what is written and read."""

    def __init__(self):
        self.held, self.value, self.timers, self.written, self.read = [], None, set(), 0, 0

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        own = self

        class Value:
            def exists(self):
                return own.value is not None

            def get(self):
                return own.value

            def update(self, value):
                own.value = value

            def clear(self):
                own.value = None

        return Value()

    def appendList(self, rows):
        self.held += rows
        self.written += len(rows)

    def get(self):
        self.read += len(self.held)
        return iter(self.held)

    def clear(self):
        self.held = []

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_state_is_written_once_a_point(spark, sf_dir):
    """Over many batches: each point is written once and read once, and one timer is left."""
    points = with_candidates(few(spark, sf_dir), None, SMALL).filter("trip_id = '3'").toPandas().sort_values("idx")
    points["ts"] = (points["time_us"] * 1000 + 1_700_000_000_000_000_000).astype("datetime64[ns, UTC]")
    handle, keeper = Handle(), online.TripKeeper(SHORT, 300_000)
    keeper.init(handle)
    for i in range(0, len(points), 3):
        assert list(keeper.handleInputRows(("3",), iter([points.iloc[i : i + 3]]), handle)) == []
        assert handle.read == 0 and len(handle.timers) == 1
    (out,) = keeper.handleExpiredTimer(("3",), handle, None)
    assert handle.written == handle.read == len(points) and not handle.held and handle.value is None
    assert keys(out.itertuples()) == keys(r for r in kept_points(few(spark, sf_dir), SHORT).collect() if r.trip_id == "3")
