"""Folds over trips: state machines that see a trip's rows in order.

Rows are dealt by trip and sorted within their partition, and a worker streams
through them and pays for a batch of rows, not for each trip.  A fold holds one
trip at a time; a scan holds a piece of a trip, a batch at most, and what its
detectors keep from piece to piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Columns = dict[str, np.ndarray]
#: Bytes of folded trips that a worker holds before it hands them on.
MOST_HELD = 4 << 20


def columns_of(trip: pa.Table, names: list[str]) -> Columns:
    """Columns of a trip as arrays, by name; integers and booleans that may be null become floats and objects."""
    return {name: trip.column(name).to_numpy() for name in names}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Stretches of one trip in sorted batches, whose first column is the trip's id, and whether a trip begins there."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        fresh = last is None or (last != ids[0] and (last.is_valid or ids[0].is_valid))
        changes = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False)
        if ids.null_count:
            changes |= pc.not_equal(pc.is_null(ids[1:]), pc.is_null(ids[:-1])).to_numpy(zero_copy_only=False)
        start = 0
        for end in [*(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]:
            yield fresh, batch.slice(start, end - start)
            fresh, start = True, end
        last = ids[-1]


def _trips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The trips in sorted batches, whole."""
    held: list[pa.RecordBatch] = []
    for fresh, piece in _pieces(batches):
        if fresh and held:
            yield pa.Table.from_batches(held)
            held = []
        held.append(piece)
    if held:
        yield pa.Table.from_batches(held)


def fold_trips(rows: DataFrame, order: list[str | Column], fold: Callable[[pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
    """The tables that fold makes of each trip, whose rows stand in the order of those columns.  The first column of rows is the trip's id."""
    target = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)
    trip_id = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, n, size = [], 0, 0
        for trip in _trips(batches):
            out = fold(trip)
            if out.num_rows:
                made.append(out.cast(target))
                n, size = n + out.num_rows, size + made[-1].nbytes
            if n >= 10_000 or size >= MOST_HELD:
                yield from pa.concat_tables(made).combine_chunks().to_batches()
                made, n, size = [], 0, 0
        if made:
            yield from pa.concat_tables(made).combine_chunks().to_batches()

    return rows.repartition(trip_id).sortWithinPartitions(trip_id, *order).mapInArrow(run, schema)


def scan_intervals(rows: DataFrame, begin: Callable[[], list[tuple[str, Callable[[Columns], list[tuple]]]]]) -> DataFrame:
    """trip_id, left, right, aux of the intervals that detectors give, piece by piece in the order of idx; begin makes (tag, detector) anew for each trip.

    Intervals are (left, right), or (left, right, tag) with a tag of their own.
    A detector's close, if it has one, gives those that are left at the end.
    """
    names = rows.columns[1:]
    schema = f"trip_id {rows.dtypes[0][1]}, left long, right long, aux array<string>"
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detectors, trip, made, n = [], None, [], 0

        def keep(found: list[tuple]) -> None:
            nonlocal n
            if found:
                made.append(pa.table([trip.take(pa.array([0] * len(found), pa.int64())), *(pa.array(x) for x in zip(*found))], names=target.names).cast(target))
                n += len(found)

        tagged = lambda tag, spans: [(left, right, own or [tag]) for left, right, *own in spans]
        closed = lambda: [x for tag, feed in detectors if hasattr(feed, "close") for x in tagged(tag, feed.close())]
        for fresh, piece in _pieces(batches):
            if fresh:
                keep(closed())
                detectors, trip = begin(), pa.concat_arrays([piece.column(0).slice(0, 1)])
            columns = columns_of(pa.Table.from_batches([piece]), names)
            keep([x for tag, feed in detectors for x in tagged(tag, feed(columns))])
            if n >= 10_000:
                yield from pa.concat_tables(made).combine_chunks().to_batches()
                made, n = [], 0
        keep(closed())
        if made:
            yield from pa.concat_tables(made).combine_chunks().to_batches()

    return rows.repartition(rows.columns[0]).sortWithinPartitions(rows.columns[0], "idx").mapInArrow(run, schema)
