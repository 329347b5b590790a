"""The published numbers for the sample trips: every stage of the pipeline at once."""

from dataclasses import replace

import pytest

from veiltrack.operators.clean import correct_errors
from veiltrack.operators.detect import detect_fused, start_end, stops, turnarounds
from veiltrack.operators.fit import count_choices, fit_trips
from veiltrack.operators.intervals import mark_points, merge_intervals, union_intervals
from veiltrack.operators.privacy import PrivacyLimits, deidentify, find_privacy, point_counters, sum_counters
from veiltrack.operators.roads import build_index, vertices
from veiltrack.plans.config import INTERACTIVE
from veiltrack.plans.pipeline import run
from veiltrack.sources.shapes import read_shapes
from veiltrack.sources.trips import number_points, read_trips, trip_counters

SW, NE = (35.946920, -83.938486), (35.955526, -83.926738)


@pytest.fixture(scope="module")
def edges(spark, samples):
    return read_shapes(spark, samples.roads).edges.drop("file", "seq").cache()


@pytest.fixture(scope="module")
def trip(spark, samples):
    return number_points(read_trips(spark, samples.trip)).cache()


@pytest.fixture(scope="module")
def fitted(edges, trip):
    points = fit_trips(trip, edges, build_index(edges, SW, NE), 1.0, 0.5, 36, 10)
    return count_choices(points, vertices(edges)).cache()


def spans(df):
    return sorted((r.left, r.right, ";".join(r.aux)) for r in df.collect())


def marked_by(fitted, *lists):
    return mark_points(fitted, merge_intervals(union_intervals(*lists)))


def test_trip_is_read_whole(trip):
    rows = trip.collect()
    assert len(rows) == 281 and {r.trip_id for r in rows} == {"1_1"}
    assert sorted(r.idx for r in rows) == list(range(281))
    assert max(r.time_us for r in rows) == 28_000_000


def test_explicit_and_inferred_fit(fitted):
    explicit = {r.idx for r in fitted.collect() if r.edge_explicit}
    assert explicit == {*range(34), *range(58, 96), *range(146, 281)}


def test_detectors(fitted):
    assert spans(start_end(fitted)) == [(0, 1, "start_pt"), (280, 281, "end_pt")]
    assert spans(turnarounds(fitted, 20, 30.0, 100.0, 90.0)) == [(33, 58, "ta_fit"), (107, 130, "ta")]
    assert spans(stops(fitted, 1.0, 50.0, 2.5)) == [(0, 10, "stop"), (177, 187, "stop")]
    assert spans(detect_fused(fitted, 20, 30.0, 100.0, 1.0, 50.0, 2.5)) == [(0, 10, "stop"), (107, 130, "ta"), (177, 187, "stop")]


def test_marks_both_ways(fitted):
    all_found = [turnarounds(fitted, 20, 30.0, 100.0, 90.0), stops(fitted, 1.0, 50.0, 2.5), start_end(fitted)]
    critical = {r.idx for r in marked_by(fitted, *all_found).collect() if r.is_critical}
    assert critical == {*range(10), *range(33, 58), *range(107, 130), *range(177, 187), 280}


HEAD = [(1, 33, "forward:ci"), (58, 107, "forward:ci")]


@pytest.mark.parametrize(
    "limits, expected",
    [
        ((10000, 10000, 1, 11000, 11000, 4), [(130, 277, "forward:max_out_degree"), (277, 280, "backward:pi")]),
        ((280, 10000, 10, 300, 11000, 11), [(130, 241, "forward:max_dist"), (241, 280, "backward:pi")]),
        ((10000, 280, 10, 11000, 330, 11), [(130, 216, "forward:max_dist"), (216, 280, "backward:pi")]),
        ((300, 300, 2, 11000, 11000, 10), [(130, 277, "forward:min"), (277, 280, "backward:pi")]),
    ],
)
def test_privacy_intervals(fitted, limits, expected):
    marked = marked_by(fitted, turnarounds(fitted, 20, 30.0, 100.0, 90.0), start_end(fitted))
    found = find_privacy(marked, PrivacyLimits(*limits))
    assert spans(found) == HEAD + expected


def test_removal(fitted):
    marked = marked_by(fitted, start_end(fitted))
    found = find_privacy(marked, PrivacyLimits(10, 10, 0, 11000, 11000, 10))
    both = mark_points(marked, merge_intervals(found), "pi_id", "is_private")
    private = {r.idx for r in both.collect() if r.is_private}
    assert private <= {*range(1, 34), *range(168, 280)}
    assert deidentify(both).count() == 134


def test_counters_of_both_files(spark, samples, edges):
    totals = []
    for name, expected in ((samples.trip, (281, 0, 0, 0, 0, 21, 126)), (samples.faulty_trip, (138, 0, 3, 1, 4, 2, 128))):
        records = read_trips(spark, name)
        points = number_points(records)
        clean = (correct_errors(points) if name == samples.faulty_trip else points).cache()
        fitted = count_choices(fit_trips(clean, edges, build_index(edges, SW, NE), 1.0, 0.5, 36, 10), vertices(edges)).cache()
        critical = [start_end(fitted), stops(fitted, 1.0, 50.0, 2.5)]
        marked = marked_by(fitted, *critical)
        both = mark_points(marked, merge_intervals(find_privacy(marked, PrivacyLimits(10, 10, 0, 11000, 11000, 10))), "pi_id", "is_private")
        counters = point_counters(both.cache(), trip_counters(records), points)
        assert tuple(sum_counters(counters).first()) == expected
        totals.append(counters)
    assert tuple(sum_counters(totals[0].unionByName(totals[1])).first()) == (419, 0, 3, 1, 4, 23, 254)


def test_whole_pipeline(spark, samples, edges):
    records = read_trips(spark, [samples.trip])
    config = replace(INTERACTIVE, min_direct=5.0, max_direct=30.0, min_manhattan=5.0, max_manhattan=30.0)
    result = run(number_points(records), edges, config, trip_counters(records))
    row = result.counters.first()
    assert row.n_points == 281 and row.n_ci + row.n_pi + result.kept.count() == 281
    assert result.kept.count() > 0
