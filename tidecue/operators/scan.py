"""Ordered scans of entities that may hold any share of the rows.

Rows are range-sorted by (entity, order) over the cluster and materialised once.
`neighbours` gives each row values of the one before and after it; `ordered_scan`
walks the rows with a state machine. In both, partitions hand their edges on
through one small row each, so nothing is grouped by entity.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecue.session import cut


#: Column of laid rows with the number of their partition.
PART = "_part"


def _laid(df: DataFrame, entity: str, order: list[str], partitions: int | None) -> DataFrame:
    keyed = df.where(F.col(f"`{entity}`").isNotNull()).withColumn("_u", F.monotonically_increasing_id())
    keys = [F.col(f"`{c}`") for c in (entity, *order, "_u")]
    ranged = keyed.repartitionByRange(partitions, *keys) if partitions else keyed.repartitionByRange(*keys)
    return cut(ranged.sortWithinPartitions(*keys).drop("_u").withColumn(PART, F.spark_partition_id()))


def part_of(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, Iterator[pa.RecordBatch]]:
    """The partition number that the last column of laid rows holds, None without rows; and the batches.

    It is kept with the rows, as the tasks of a union are numbered anew.
    """
    for batch in batches:
        if batch.num_rows:
            return batch.column(batch.num_columns - 1)[0].as_py(), chain((batch,), batches)
    return None, iter(())


def neighbours(df: DataFrame, entity: str, order: list[str], columns: list[str], partitions: int | None = None, ahead: int = 1) -> DataFrame:
    """J11: df with prev_<c> and next_<c> of each column: its value in the entity's row before and after, else null.

    With ahead = 2 there is next2_<c> too, of the row after the next. Rows of a
    null entity are left out. Ties in the order keep the order of arrival. An
    empty table gives none.
    """
    laid = _laid(df, entity, order, partitions)
    names = laid.columns[:-1]
    at = [names.index(c) for c in columns]
    who = names.index(entity)
    fields = {f.name: f.dataType.simpleString() for f in laid.schema}
    prefixes = ["prev", "next", "next2"][: 1 + ahead]

    def values(batch: pa.RecordBatch, row: int) -> list:
        return [batch.column(i)[row].as_py() for i in (who, *at)]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, batches = part_of(batches)
        first: list[list] = []
        last = None
        for batch in batches:
            first += [values(batch, i) for i in range(min(batch.num_rows, ahead - len(first)))]
            last = values(batch, batch.num_rows - 1) if batch.num_rows else last
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([pickle.dumps((first, last))])], names=["part", "edge"])

    # one row per partition
    found = {r.part: pickle.loads(bytes(r.edge)) for r in laid.mapInArrow(edges, "part long, edge binary").collect()}
    parts = sorted(found)
    before = {b: found[a][1] for a, b in zip(parts, parts[1:])}
    after = {a: [v for b in parts[k + 1 : k + 1 + ahead] for v in found[b][0]][:ahead] for k, a in enumerate(parts)}
    schema = ", ".join([*[f"`{n}` {fields[n]}" for n in names], *[f"`{p}_{c}` {fields[c]}" for p in prefixes for c in columns]])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, batches = part_of(batches)
        tail, held = before.get(part), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None and batch.num_rows < ahead:  # too few rows to look ahead to
                held = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                continue
            if held is not None:
                yield extend(held, tail, [values(batch, i) for i in range(ahead)])
                tail = values(held, held.num_rows - 1)
            held = batch
        if held is not None:
            yield extend(held, tail, after.get(part, []))

    def extend(batch: pa.RecordBatch, tail: list | None, heads: list[list]) -> pa.RecordBatch:
        n = batch.num_rows
        nothing = [None] * (1 + len(at))
        heads = [*heads, *[nothing] * (ahead - len(heads))]
        out = list(batch.columns[:-1])
        for step in (-1, *range(1, ahead + 1)):
            shifted = []
            for k, i in enumerate((who, *at)):
                column = batch.column(i)
                if step < 0:
                    shifted.append(pa.concat_arrays([pa.array([tail[k] if tail else None], column.type), column.slice(0, n - 1)]))
                else:
                    beyond = [h[k] for h in heads[max(0, step - n) : step]]
                    shifted.append(pa.concat_arrays([column.slice(min(step, n)), pa.array(beyond, column.type)]))
            same = pc.fill_null(pc.equal(shifted[0], batch.column(who)), False)
            out += [pc.if_else(same, c, pa.scalar(None, c.type)) for c in shifted[1:]]
        return pa.RecordBatch.from_arrays(out, names=[*names, *[f"{p}_{c}" for p in prefixes for c in columns]])

    return laid.mapInArrow(join, schema)


def number_rows(df: DataFrame, entity: str, order: list[str], out: str, partitions: int | None = None) -> DataFrame:
    """df with a 1-based bigint row number per entity; rows of a null entity are left out.

    Rows are counted per partition, and an entity that goes on into the next
    partition carries its count over, so no entity is gathered.
    """
    laid = _laid(df.drop(out), entity, order, partitions)
    names, who = laid.columns[:-1], laid.columns.index(entity)
    fields = {f.name: f.dataType.simpleString() for f in laid.schema}

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, batches = part_of(batches)
        first, tail, n = None, None, 0
        for batch in batches:
            for values in _runs_of(batch.column(who)):
                first = values[:1] if first is None else first
                n = n + values[1] if tail is not None and tail == values[0] else values[1]
                tail = values[0]
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([pickle.dumps((first[0], tail, n))])], names=["part", "edge"])

    # one row per partition
    carry: dict[int, tuple] = {}
    entity_now, count = None, 0
    for part, (head, tail, n) in sorted((r.part, pickle.loads(bytes(r.edge))) for r in laid.mapInArrow(summary, "part long, edge binary").collect()):
        carry[part] = (entity_now, count)
        count = count + n if head == tail == entity_now else n
        entity_now = tail

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, batches = part_of(batches)
        now, n = carry.get(part, (None, 0))
        for batch in batches:
            numbers: list[int] = []
            for value, length in _runs_of(batch.column(who)):
                n = n if value == now else 0
                numbers.extend(range(n + 1, n + length + 1))
                now, n = value, n + length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(numbers, pa.int64())], names=[*names, out])

    return laid.mapInArrow(number, ", ".join([*[f"`{c}` {fields[c]}" for c in names], f"`{out}` bigint"]))


def _runs_of(column: pa.Array) -> list[tuple]:
    """(value, length) of the runs of equal values."""
    if not len(column):
        return []
    coded = pc.run_end_encode(column)
    ends = coded.run_ends.to_pylist()
    return list(zip(coded.values.to_pylist(), [b - a for a, b in zip([0, *ends], ends)]))


class Walker:
    """State machine of an ordered scan.

    `feed` takes a row (a tuple of the scanned columns) and gives output rows;
    `finish` gives those of the state left at an entity's end. The state is the
    instance's __dict__ and must be picklable and comparable. `counters` names
    the parts of it that only count on and decide nothing.
    """

    entity = None
    counters: tuple[str, ...] = ()

    def feed(self, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def finish(self) -> list[tuple]:
        return []

    def deciding(self) -> tuple:
        """A hashable value that is equal for equal states of one entity at one row, counters aside."""
        return tuple(v for k, v in sorted(self.__dict__.items()) if k not in self.counters)


#: Rows of a partition's head that are handed on at most; where more would be needed the partition is walked once more.
HEAD_ROWS = 4_096


class _Starts:
    """One partition's walks from each row at which a walk that comes from the partition before may begin anew.

    A walk begins anew at a row if its state after the row is that of a walker
    which has seen no other row. Walks from the partition's first rows are
    kept, up to the row at which the one from its very first row begins anew:
    whatever comes from before is taken to do so by then. Walks that reach
    equal states go on as one.
    """

    def __init__(self, walker: Callable[[], Walker]):
        self.walker = walker
        self.first = self.last = None
        self.single, self.open, self.n = True, True, 0
        self.head: list[tuple] = []
        self.groups: list[tuple[Walker, dict[int, dict[str, int]]]] = []

    def fresh(self, entity, row: tuple) -> Walker:
        out = self.walker()
        out.entity = entity
        out.feed(row)
        return out

    def feed(self, entity, row: tuple) -> None:
        if self.n and entity != self.last:
            self.single, self.open, self.head = False, False, []
            begun = self.fresh(entity, row)
            self.groups = [(begun, {0: dict.fromkeys(begun.counters, 0)})]
            self.last, self.n = entity, self.n + 1
            return
        if not self.n:
            self.first = self.last = entity
        for walk, _ in self.groups:
            walk.feed(row)
        if self.open:
            begun = self.fresh(entity, row)
            self.groups.append((begun, {self.n: dict.fromkeys(begun.counters, 0)}))
            self.head.append(row)
        if len(self.groups) > 1:
            self._merge()
        if self.open and (self.n and 0 in self._of(self.n) or len(self.head) >= HEAD_ROWS):
            self.open = False
        self.n += 1

    def _of(self, start: int) -> dict[int, dict[str, int]]:
        return next(starts for _, starts in self.groups if start in starts)

    def _merge(self) -> None:
        kept: dict[tuple, tuple[Walker, dict]] = {}
        for walk, starts in self.groups:
            other, known = kept.setdefault(walk.deciding(), (walk, starts))
            if other is not walk:
                for start, offsets in starts.items():
                    known[start] = {c: n + getattr(walk, c) - getattr(other, c) for c, n in offsets.items()}
        self.groups = list(kept.values())

    def summary(self) -> tuple:
        """(first entity, last entity, whether they are the only one, rows of the head, whether that is all rows, states, starts)."""
        return self.first, self.last, self.single, self.head, len(self.head) == self.n, [w.__dict__ for w, _ in self.groups], [s for _, s in self.groups]


def _after(summary: tuple, carried: Walker | None, walker: Callable[[], Walker]) -> Walker | None:
    """The state after a partition that is entered with the carried one; None if the summary doesn't tell."""
    first, last, single, head, all_rows, states, starts = summary

    def ended(start: int, counted: dict[str, int]) -> Walker:
        out = walker()
        k = next(i for i, known in enumerate(starts) if start in known)
        out.__dict__.update(states[k])
        for c, n in starts[k][start].items():
            setattr(out, c, getattr(out, c) + n + counted.get(c, 0))
        return out

    if not single:
        return ended(0, {})
    if carried is None or carried.entity != first:
        return ended(0, {})
    now = walker()
    now.__dict__.update(pickle.loads(pickle.dumps(carried.__dict__)))
    for start, row in enumerate(head):
        now.feed(row)
        begun = walker()
        begun.entity = first
        begun.feed(row)
        if now.deciding() == begun.deciding():
            return ended(start, {c: getattr(now, c) - getattr(begun, c) for c in now.counters})
    return now if all_rows else None


def ordered_scan(df: DataFrame, entity: str, order: list[str], columns: list[str], walker: Callable[[], Walker], schema: str, partitions: int | None = None) -> DataFrame:
    """Output rows of a state machine that walks each entity's rows in order.

    Each entity begins with a fresh walker() whose .entity is set. Partitions
    are walked at once from each place at which a walk from the partition
    before may begin anew; from these summaries, one for each partition, the
    state at every edge is combined, and a second walk gives the output. So an
    entity may span any number of partitions. Only a partition whose summary
    doesn't tell is walked once more by itself.
    """
    laid = _laid(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([entity, *order, *columns])]), entity, order, partitions)
    at = [laid.columns.index(c) for c in columns]
    who = laid.columns.index(entity)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            yield list(zip(*(batch.column(i).to_pylist() for i in (who, *at))))

    def walk(batches: Iterator[pa.RecordBatch], state: bytes | None) -> Iterator[tuple[Walker, list[tuple]]]:
        now = None
        if state is not None:
            now = walker()
            now.__dict__.update(pickle.loads(state))
        for rows in rows_of(batches):
            out: list[tuple] = []
            for row in rows:
                if now is None or now.entity != row[0]:
                    if now is not None:
                        out += now.finish()
                    now = walker()
                    now.entity = row[0]
                out += now.feed(row[1:])
            yield now, out

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, batches = part_of(batches)
        found = _Starts(walker)
        for rows in rows_of(batches):
            for row in rows:
                found.feed(row[0], row[1:])
        if found.n:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([pickle.dumps(found.summary())])], names=["part", "state"])

    def again(wanted: int, state: bytes):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, batches = part_of(batches)
            if part != wanted:
                return
            last = None
            for last, _ in walk(batches, state):
                pass
            yield pa.RecordBatch.from_arrays([pa.array([wanted]), pa.array([pickle.dumps(last.__dict__)])], names=["part", "state"])

        return run

    collected = lambda run: {r.part: bytes(r.state) for r in laid.mapInArrow(run, "part long, state binary").collect()}
    # one row per partition
    summaries = collected(summarise)
    carry: dict[int, bytes] = {}
    now: Walker | None = None
    for part in sorted(summaries):
        if now is not None:
            carry[part] = pickle.dumps(now.__dict__)
        after = _after(pickle.loads(summaries[part]), now, walker)
        if after is None:
            after = walker()
            after.__dict__.update(pickle.loads(collected(again(part, carry[part]))[part]))
        now = after
    final = max(summaries, default=None)
    arrow = _arrow_schema(df, schema)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, batches = part_of(batches)
        last = None
        for last, out in walk(batches, carry.get(part)):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
        if part == final and last is not None and (out := last.finish()):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return laid.mapInArrow(emit, schema)


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
