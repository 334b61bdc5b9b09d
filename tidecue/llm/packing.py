"""Filling fixed-capacity containers with items of varying length.

Only the histogram of lengths, which the capacity bounds, reaches the driver.
There, shallow combinations of lengths that fill a container up to a small
window are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded, and the same is done with what is left
until little is; the rest is packed greedily, still by length. The plan so made
says, for each length, which ranks go to which containers; ranks are counted
per partition and offset, so each document finds its container without any
group being gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecue.llm.vocab import DEFAULT_FOLDER, encoder
from tidecue.session import cut, spread

#: Different lengths in a combination, combinations and steps of a fit, and fits at most.
DEPTH, MOST, STEPS, FITS = 4, 40_000, 60, 8
#: Part of a container that a combination may leave empty.
WINDOW = 0.001
#: Share of the items up to a quarter of a container that is kept from the fits, to fill what rounding leaves.
HELD = 0.2
#: Steps of this share of the whole never meet, so that fits in turn try other combinations.
_GOLDEN = (5**0.5 - 1) / 2

Pattern = tuple[tuple[int, int], ...]  # (length, times) of a container


def combinations(counts: np.ndarray, capacity: int, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, times), a row each for shallow combinations that fill a container but for the window; 0 fills up rows.

    From each length present, once, as often as it fills half a container and
    as often as it goes, lengths are added at even shares of the items that
    still fit, again once or more times; each such start is closed by the
    greatest length that fits. turn moves the shares. At most MOST rows, evenly
    drawn from all, that need no more items of a length than there are.
    """
    present = np.flatnonzero(counts)
    present = present[present > 0]
    below = np.zeros(capacity + 1, dtype=np.int64)  # greatest present length up to each number
    below[present] = present
    below = np.maximum.accumulate(below)
    upto = np.cumsum(counts[: capacity + 1]).astype(float)
    window = max(1, int(capacity * WINDOW))
    shares = (6, 4) if len(present) < 700 else (4, 3) if len(present) < 3_000 else (2, 2)
    lengths: list[np.ndarray] = []
    times: list[np.ndarray] = []

    def close(chosen: list[tuple[np.ndarray, np.ndarray]], room: np.ndarray) -> None:
        last = below[room]
        full = room - last <= window
        rows = np.zeros((2, int(full.sum()), DEPTH), dtype=np.int64)
        for k, (length, n) in enumerate(chosen):
            rows[0, :, k], rows[1, :, k] = length[full], n[full]
        rows[0, :, len(chosen)] = last[full]
        rows[1, :, len(chosen)] = last[full] > 0
        lengths.append(rows[0])
        times.append(rows[1])

    def repeats(length: np.ndarray, room: np.ndarray, part: float) -> np.ndarray:
        return np.maximum(1, np.minimum(counts[length], (room * part).astype(np.int64) // np.maximum(length, 1)))

    def extend(chosen: list[tuple[np.ndarray, np.ndarray]], room: np.ndarray, path: int) -> None:
        close(chosen, room)
        if len(chosen) == DEPTH - 1:
            return
        steps = shares[len(chosen) - 1]
        fitting = upto[room]
        for step in range(steps):
            share = ((step + (turn + path) * _GOLDEN % 1) / steps) % 1
            length = np.where(fitting > 0, np.searchsorted(upto, np.minimum(share * fitting, np.maximum(fitting - 1, 0)), side="right"), 0)
            for part in (0.0, 0.5, 1.0) if len(chosen) == 1 else (0.0, 1.0):
                n = repeats(length, room, part)
                fits = (length > 0) & ((n > 1) if part else True)
                if fits.any():
                    extend([*[(a[fits], b[fits]) for a, b in chosen], (length[fits], n[fits])], (room - length * n)[fits], path * 3 + step + 1)

    for part in (0.0, 0.5, 1.0):
        n = repeats(present, np.full(len(present), capacity), part)
        fits = (n > 1) if part else np.ones(len(present), dtype=bool)
        if fits.any():
            extend([(present[fits], n[fits])], capacity - (present * n)[fits], 0)
    found, often = np.vstack([np.zeros((0, DEPTH), np.int64), *lengths]), np.vstack([np.zeros((0, DEPTH), np.int64), *times])
    order = np.argsort(-found, axis=1, kind="stable")
    found, often = np.take_along_axis(found, order, 1), np.take_along_axis(often, order, 1)
    for k in range(DEPTH - 1, 0, -1):  # a length chosen twice counts together
        twice = (found[:, k] == found[:, k - 1]) & (found[:, k] > 0)
        often[twice, k - 1] += often[twice, k]
        found[twice, k] = often[twice, k] = 0
    rows = np.unique(np.hstack([found, often]), axis=0)[::-1]
    rows = rows[((rows[:, DEPTH:] <= counts[rows[:, :DEPTH]]) | (rows[:, :DEPTH] == 0)).all(axis=1)]
    if len(rows) > MOST:
        rows = rows[np.unique((np.arange(MOST) * (len(rows) / MOST) + turn * _GOLDEN).astype(np.int64) % len(rows))]
    return rows[:, :DEPTH], rows[:, DEPTH:]


def fit_repeats(lengths: np.ndarray, times: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 of the combinations that minimise the squared error of their lengths against counts.

    Errors weigh as the root of length over count: long items are the ones
    that must find their partners here. Solved by projected gradients with
    momentum.
    """
    if not len(lengths):
        return np.zeros(0)
    weight = np.sqrt(np.arange(len(counts)) / np.maximum(counts, 1))
    part = times * weight[lengths]
    norm = np.sqrt((part * part).sum(axis=1))
    part = part / norm[:, None]
    flat = lengths.ravel()

    def forward(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, (part * x[:, None]).ravel(), minlength=len(counts))
        out[0] = 0
        return out

    backward = lambda error: (part * error[lengths]).sum(axis=1)
    target = counts * weight
    target[0] = 0
    v, steepest = np.ones(len(lengths)), 1.0
    for _ in range(20):  # power iteration for the step
        v = backward(forward(v))
        steepest = float(np.linalg.norm(v)) or 1.0
        v /= steepest
    x = y = np.zeros(len(lengths))
    momentum = 1.0
    for _ in range(steps):
        moved = np.maximum(0.0, y - backward(forward(y) - target) / steepest)
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y = moved + (momentum - 1) / after * (moved - x)
        x, momentum = moved, after
    return x / norm


def fitted_containers(left: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """(pattern, repeats) from least squares; what they hold is taken from left.

    Repeats are rounded along the rows, so that sums over neighbouring rows,
    which share their greatest length, stay within one of the fitted sums. A
    row is used no more often than its items last.
    """
    plan: list[tuple[Pattern, int]] = []
    whole = int(left.sum())
    for turn in range(FITS):
        before = int(left.sum())
        lengths, times = combinations(left, capacity, turn)
        wanted = np.diff(np.floor(np.cumsum(fit_repeats(lengths, times, left)) + 0.5), prepend=0.0).astype(np.int64)
        for i in np.flatnonzero(wanted).tolist():
            solid = lengths[i] > 0
            length, n = lengths[i][solid], times[i][solid]
            repeats = min(int(wanted[i]), int((left[length] // n).min()))
            if repeats > 0:
                left[length] -= repeats * n
                plan.append((tuple(zip(length.tolist(), n.tolist())), repeats))
        if before - left.sum() <= 0.002 * whole:
            break
    return plan


def plan_containers(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """(pattern, repeats) that together hold exactly counts[length] items of each length."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    held = np.ceil(left * HELD).astype(np.int64)
    held[capacity // 4 + 1 :] = 0
    left -= held
    plan = fitted_containers(left, capacity)
    left += held
    # what rounding left: best fit by length, each pattern as often as it goes
    while True:
        rest = np.flatnonzero(left)
        if not len(rest):
            return plan
        room, pattern = capacity, []
        while room > 0 and len(rest):
            k = int(np.searchsorted(rest, room, side="right")) - 1
            if k < 0:
                break
            length = int(rest[k])
            t = min(int(left[length]), room // length)
            if not pattern:
                t = 1 if length * 2 > capacity else t
            pattern.append((length, t))
            room -= length * t
            rest = rest[:k]
        n = min(int(left[length]) // t for length, t in pattern)
        plan.append((tuple(pattern), n))
        for length, t in pattern:
            left[length] -= n * t


def plan_slots(plan: list[tuple[Pattern, int]]) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """For each length the (first rank, first container, times) of its runs of ranks; and the number of containers."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    filled: dict[int, int] = {}
    container = 0
    for pattern, n in plan:
        for length, t in pattern:
            rank = filled.get(length, 0)
            runs.setdefault(length, []).append((rank, container, t))
            filled[length] = rank + n * t
        container += n
    return {length: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for length, r in runs.items()}, container


def pack_documents(df: DataFrame, budgets: list[tuple[int, str, int]], id_column: str = "doc_id", text_column: str = "text", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """Columns (budget_id, id, part_no, container_id, token_start, tokens).

    budgets are (budget_id, tokenizer, capacity). A document that exceeds the
    capacity alone gives full containers and one remainder, which is packed
    like an item; no other document is split, and each has exactly one row per
    budget. Empty and null texts hold no tokens; they are spread evenly over
    the containers (container 0 if there is none). A container never holds more
    tokens than the capacity. Repeated rows are items of their own, null ids
    stay null, an empty table gives no rows, other columns are ignored.
    """
    kind = df.schema[id_column].dataType.simpleString()
    names = sorted({name for _, name, _ in budgets})
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [encoder(name, folder) for name in names]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([len(enc.encode_ordinary(t)) for t in texts], pa.int64()) for enc in encoders]], names=["id", *[f"n{i}" for i in range(len(names))]])

    measured = spread(rows).mapInArrow(sizes, ", ".join([f"id {kind}", *[f"n{i} long" for i in range(len(names))]]))
    # each row keeps the number of its partition, as tasks of later jobs may be numbered otherwise
    laid = cut(measured.withColumn("pid", F.spark_partition_id()))

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Items with their rank among those of one length in this partition; length -1 is a full container."""
        seen = {b: np.zeros(capacity + 2, dtype=np.int64) for b, _, capacity in budgets}
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(batch.num_columns - 1)[0].as_py()
            for b, name, capacity in budgets:
                n = batch.column(1 + names.index(name)).to_numpy(zero_copy_only=False)
                full = n // capacity
                tail = n - full * capacity
                pieces = full + ((tail > 0) | (n == 0))
                at = np.repeat(np.arange(len(n)), pieces)
                no = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.where(no < full[at], -1, tail[at])
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, int)
                run = np.diff(np.r_[starts, len(ordered)])
                local = np.empty(len(at), dtype=np.int64)
                local[order] = np.arange(len(at)) - np.repeat(starts, run) + np.repeat(seen[b][ordered[starts]], run)
                seen[b][ordered[starts]] += run
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *[pa.array(x) for x in (np.full(len(at), b, np.int32), no.astype(np.int32), length, np.full(len(at), part, np.int32), local)]], names=["id", "budget_id", "part_no", "length", "pid", "local"])

    schema = f"id {kind}, budget_id int, part_no int, length long, pid int, local long"
    ranked = laid.mapInArrow(items, schema)
    counted = cut(ranked.groupBy("budget_id", "length", "pid").agg(F.count(F.lit(1)).alias("n")))
    # one row per length and budget: the capacities bound it
    histogram: dict[int, np.ndarray] = {b: np.zeros(capacity + 1, dtype=np.int64) for b, _, capacity in budgets}
    for b, length, n in counted.where("length >= 0").groupBy("budget_id", "length").agg(F.sum("n")).collect():
        histogram[b][length] = n
    plans = {b: plan_slots(plan_containers(histogram[b], capacity)) for b, _, capacity in budgets}
    before = Window.partitionBy("budget_id", "length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("budget_id", "length", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = ranked.join(offsets, ["budget_id", "length", "pid"]).select("budget_id", "id", "part_no", "length", (F.col("offset") + F.col("local")).alias("rank"))
    capacities = {b: capacity for b, _, capacity in budgets}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            budget, part, length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4))
            container = np.zeros(len(rank), dtype=np.int64)
            size = np.array([capacities[b] for b in budget.tolist()], dtype=np.int64)
            code = budget.astype(np.int64) * (2**32) + (length + 1)
            order = np.argsort(code, kind="stable")
            edges = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]]) if len(order) else np.zeros(0, int)
            for a, z in zip(edges, np.r_[edges[1:], len(order)]):
                at = order[a:z]
                slots, total = plans[int(budget[at[0]])]
                n = int(length[at[0]])
                if n == -1:
                    container[at] = total + rank[at]
                elif n == 0:
                    container[at] = rank[at] % max(1, total)
                else:
                    first, base, times = slots[n]
                    k = np.searchsorted(first, rank[at], side="right") - 1
                    container[at] = base[k] + (rank[at] - first[k]) // times[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(container), pa.array(part.astype(np.int64) * size), pa.array(np.where(length < 0, size, length))], names=["budget_id", "id", "part_no", "container_id", "token_start", "tokens"])

    out = placed.mapInArrow(place, f"budget_id int, id {kind}, part_no int, container_id long, token_start long, tokens long")
    return out.withColumnRenamed("id", id_column)
