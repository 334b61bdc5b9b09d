"""Continuous periods and gaps of overlapping intervals per entity.

Intervals are range-sorted over the whole cluster by (entity, start). Each
partition then gives one summary of its last entity (start of the last island,
greatest end), the summaries are prefix-combined, and a second scan labels
islands with the carried state. Nothing is grouped by entity, so one entity may
hold any share of the rows: it is spread over as many partitions as its rows
need. The range sort is the only shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecue.operators.scan import PART, part_of
from tidecue.session import cut


def _plain(value):
    return value.item() if isinstance(value, np.generic) else value


class _Scan:
    """Running state of one left-to-right scan: entity, island start, greatest end."""

    def __init__(self, entity: int | None = None, start: int = 0, end: int = 0):
        self.entity, self.start, self.end = entity, start, end

    def feed(self, entity: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Consume a sorted batch; give (entity, kind, start, end) of what it closed.

        kind 0 is a period, 1 a gap. The island that is open at the end stays
        in the state.
        """
        n = len(entity)
        if not n:
            return None
        if self.entity is None:
            self.entity, self.start, self.end = _plain(entity[0]), int(start[0]), int(end[0])
        # the state goes in front as a pseudo-row, so one vector pass does it all
        ent = np.concatenate((np.array([self.entity], dtype=entity.dtype), entity))
        sta = np.concatenate(([self.start], start))
        fin = np.concatenate(([self.end], end))
        new_entity = np.flatnonzero(ent[1:] != ent[:-1]) + 1
        reach = np.empty(n + 1, dtype=np.int64)  # greatest end up to and with the row, by entity
        for a, b in zip(np.concatenate(([0], new_entity)), np.concatenate((new_entity, [n + 1]))):
            reach[a:b] = np.maximum.accumulate(fin[a:b])
        opens = np.zeros(n + 1, dtype=bool)
        opens[1:] = (ent[1:] != ent[:-1]) | (sta[1:] > reach[:-1])
        at = np.flatnonzero(opens)
        first = np.concatenate(([0], at))
        close = at - 1  # last row of each closed island
        periods = (ent[close], sta[first[:-1]], reach[close])
        inner = at[ent[at] == ent[at - 1]]
        gaps = (ent[inner], reach[inner - 1], sta[inner])
        self.entity, self.start, self.end = _plain(ent[-1]), int(sta[first[-1]]), int(reach[-1])
        return periods, gaps


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, batches = part_of(batches)
    scan, head = _Scan(), None
    for batch in batches:
        entity, start, end = _columns(batch)
        if len(entity) and head is None:
            head = _plain(entity[0])
        scan.feed(entity, start, end)
    if head is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (part, head, scan.entity, scan.start, scan.end)], names=["part", "head", "tail", "island", "reach"])


def combine_summaries(summaries: list[tuple]) -> dict[int, tuple]:
    """Carry into each partition: (entity, island start, reach) and the next partition's first entity.

    A summary is (partition, first entity, last entity, start of the last
    island, greatest end of the last entity). Empty partitions have none. The
    carried entity is None where the partition begins with another one.
    """
    out: dict[int, tuple] = {}
    ordered = sorted(summaries)
    entity, start, reach = None, 0, 0
    for i, (part, head, tail, island, most) in enumerate(ordered):
        out[part] = (entity if entity == head else None, start, reach, ordered[i + 1][1] if i + 1 < len(ordered) else None)
        if head == tail == entity:  # the partition lies wholly within the carried entity
            start, reach = (start if reach >= island else island), max(reach, most)
        else:
            entity, start, reach = tail, island, most
    return out


def periods_and_gaps(df: DataFrame, entity: str = "track_id", start: str = "start_ms", end: str = "end_ms", partitions: int | None = None) -> DataFrame:
    """Periods and gaps of each entity: columns entity, kind, start, end.

    An interval is a row with entity, both times and end > start; others are
    left out, so empty tables and tables of null times give no rows. Intervals
    that touch belong together. Repeated rows change nothing. A `gap` is the
    stretch between two consecutive periods of an entity. Other columns of df
    are ignored, whatever their names.
    """
    whole = df.schema[entity].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    kind = "long" if whole else "string"
    rows = df.select(F.col(f"`{entity}`").cast(kind).alias("e"), F.col(f"`{start}`").cast("long").alias("s"), F.col(f"`{end}`").cast("long").alias("t")).where("e is not null and t > s")
    # the running number lets rows that are equal in all three be split too
    rows, keys = rows.withColumn("u", F.monotonically_increasing_id()), ["e", "s", "t", "u"]
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    laid = cut(ranged.sortWithinPartitions("e", "s").drop("u").withColumn(PART, F.spark_partition_id()))
    # one small row per partition: its number is set by the cluster, not by the data
    found = laid.mapInArrow(_summaries, f"part long, head {kind}, tail {kind}, island long, reach long").collect()
    carry = combine_summaries([tuple(r) for r in found])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, batches = part_of(batches)
        state = carry.get(part)
        if state is None:
            return
        scan, after = _Scan(*state[:3]), state[3]
        for batch in batches:
            closed = scan.feed(*_columns(batch))
            if closed:
                yield from (_result(x, kind) for x, kind in zip(closed, ("period", "gap")) if len(x[0]))
        if scan.entity is not None and scan.entity != after:
            yield _result(tuple([v] for v in (scan.entity, scan.start, scan.end)), "period")

    out = laid.mapInArrow(label, f"e {kind}, kind string, s long, t long")
    return out.select(F.col("e").alias(entity), "kind", F.col("s").alias(start), F.col("t").alias(end))


def _result(columns: tuple, kind: str) -> pa.RecordBatch:
    e, s, t = columns
    return pa.RecordBatch.from_arrays([pa.array(e), pa.array([kind] * len(e), pa.string()), pa.array(s, pa.int64()), pa.array(t, pa.int64())], names=["e", "kind", "s", "t"])
