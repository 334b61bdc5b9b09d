"""Runs of repeated consecutive utterances, collapsed to one event each.

Events are range-sorted by (entity, start, number) over the cluster and walked
once by a state machine that compares each event with the anchor of the open
run. Each partition gives its finished runs and a summary of its edges: the
runs that touch them, and the different utterances of the first one. From the
summaries runs over several partitions are put together, so a run may span
partitions and an entity may hold any share of the rows. Only where the first
run of a partition would part otherwise under the anchor carried into it is
that partition walked once more.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidecue.operators.scan import part_of
from tidecue.session import cut

#: Hesitation words that a recogniser puts before an utterance.
HESITATIONS = frozenset("uh um er erm hmm hm mm mmm eh ehm em este euh heu hum ahn ah ah ahm ahem ben bah bueno well ну э ээ эм гм えー えーと えっと あの あのー その うーん 嗯 呃 额 那个 음 어 그 저 अं उम हम्म मतलब".split())


class _Fold(dict):
    """Character to its plain form: letters without case and accents, digits, marks of scripts that need them; all else a space."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        kind = unicodedata.category(ch)
        if code in (0x27, 0x2019, 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF) or 0x300 <= code <= 0x36F:
            out = ""
        elif kind[0] in "LNM":
            out = ch
        else:
            out = " "
        self[code] = out
        return out


_FOLD = _Fold()
_MARKUP = re.compile(r"<[^<>]{1,40}>|\{\\[^{}]*\}")
_DIGIT = re.compile(r"\d")
_DOUBLED = re.compile(r"(.)\1")


def utterance_words(text: str) -> tuple[str, ...]:
    """Words of an utterance without case, accents, punctuation, doubled words and leading hesitations."""
    if "<" in text or "{" in text:
        text = _MARKUP.sub(" ", text)
    plain = unicodedata.normalize("NFKD", text.casefold()).translate(_FOLD)
    if not plain.isascii():
        plain = unicodedata.normalize("NFC", plain)
    words: list[str] = []
    for w in plain.split():
        if not words or words[-1] != w:
            words.append(w)
            if len(words) > 3 and words[-2:] == words[-4:-2]:  # a doubled compound
                del words[-2:]
    at = 0
    while at < len(words) - 1 and words[at] in HESITATIONS:
        at += 1
    return tuple(words[at:])


@lru_cache(maxsize=65_536)
def is_slip(a: str, b: str) -> bool:
    """Whether two words differ by one letter left out or doubled, or by two letters swapped."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) < 4 or len(a) - len(b) > 1 or _DIGIT.search(a) or _DIGIT.search(b):
        return False
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :]
    return a[i + 1 :] == b[i:]


def _neighbours(word: str) -> set[str]:
    out = {word}
    for i in range(len(word)):
        out.add(word[:i] + word[i + 1 :])
        out.add(word[:i] + word[i] + word[i:])
        if i + 1 < len(word):
            out.add(word[:i] + word[i + 1] + word[i] + word[i + 2 :])
    return out


@lru_cache(maxsize=65_536)
def is_double_slip(a: str, b: str) -> bool:
    """Whether two words are two slips of one word."""
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 2 or a[0] != b[0]:
        return False
    if abs(len(a) - len(b)) > 1:
        return is_slip(_DOUBLED.sub(r"\1", a), _DOUBLED.sub(r"\1", b))
    return not _neighbours(a).isdisjoint(_neighbours(b))


def same_utterance(a: tuple[str, ...], b: tuple[str, ...], slips: int = 3) -> bool:
    """Whether two word lists are one utterance but for small slips.

    A slip is a misspelt word or a left-out word of at most three letters. The
    number allowed grows with the utterance, up to `slips`. Numbers must be
    equal, and no letter may stand for another, so another name is another
    utterance.
    """
    if a == b:
        return True
    if abs(len(a) - len(b)) > slips or not a or not b:
        return False
    longest = max(len(a), len(b))
    allowed = min(slips, 1 if longest < 4 else 2 if longest < 8 else 3)
    if [w for w in a if _DIGIT.search(w)] != [w for w in b if _DIGIT.search(w)]:
        return False
    # banded alignment of the word lists
    far = allowed + 1
    row = {0: 0}
    for j in range(1, min(len(b), far) + 1):
        row[j] = row[j - 1] + (1 if _skippable(b[j - 1], longest) else far)
    for i in range(1, len(a) + 1):
        after: dict[int, int] = {}
        for j in range(max(0, i - far), min(len(b), i + far) + 1):
            best = far
            if j and j - 1 in row:
                x, y = a[i - 1], b[j - 1]
                best = row[j - 1] + (0 if x == y else 1 if is_slip(x, y) else 2 if is_double_slip(x, y) else far)
            if j in row and _skippable(a[i - 1], longest):
                best = min(best, row[j] + 1)
            if j - 1 in after and _skippable(b[j - 1], longest):
                best = min(best, after[j - 1] + 1)
            if j >= 2 and j - 2 in row and a[i - 1] == b[j - 2] + b[j - 1]:
                best = min(best, row[j - 2] + 1)
            after[j] = min(best, far)
        if min(after.values()) >= far:
            return False
        row = after
    return row.get(len(b), far) <= allowed


def _skippable(word: str, longest: int) -> bool:
    # a sharp s folds to two letters
    return longest >= 4 and len(word) - ("ss" in word) <= 3 and not _DIGIT.search(word)


#: Different utterances of a partition's first run that are handed on at most; where there are more the partition is walked once more.
VARIANTS = 64


class Run:
    """An open run: its anchor, its first and last event, and its greatest known end."""

    __slots__ = ("entity", "words", "bare", "first", "last", "count", "start", "end")

    def __init__(self, entity, words: tuple, bare: str, number, start: float | None, end: float | None):
        self.entity, self.words, self.bare = entity, words, bare
        self.first = self.last = number
        self.count, self.start = 1, start
        self.end = end if end is not None else start

    def takes(self, words: tuple, bare: str, start: float | None, same: Callable, max_gap: float | None) -> bool:
        """Whether an event of the run's entity joins it."""
        if max_gap is not None and start is not None and self.end is not None and start - self.end > max_gap:
            return False
        return same(self.words, words) if words or self.words else bare == self.bare

    def add(self, last, count: int, end: float | None) -> None:
        self.last, self.count = last, self.count + count
        if end is not None:
            self.end = end if self.end is None else max(self.end, end)

    def row(self) -> tuple:
        end = self.end if self.end is not None else self.start
        return (self.entity, self.first, self.last, self.count, self.start, None if self.start is None else max(0.0, end - self.start))


class Edges:
    """What a walk leaves at its edges.

    `entity` is the first row's, `head` the first run if it is of that entity,
    `variants` its different utterances in order, `ends_with` the first event
    of that entity after it, if any; `tail` is the run that is open at the end
    (it may be the head), `last` and `seen` the last row's entity and number,
    `lead` the first row's number.
    """

    __slots__ = ("entity", "lead", "head", "head_start", "variants", "ends_with", "tail", "last", "seen")

    def __init__(self):
        self.entity = self.lead = self.head = self.head_start = self.ends_with = self.tail = self.last = self.seen = None
        self.variants: dict[tuple, None] | None = {}


def walk_events(edges: Edges, events: Iterator[tuple], same: Callable, max_gap: float | None) -> Iterator[tuple]:
    """Feed (entity, number, start, end, text) in order; give the runs that touch neither edge."""
    run: Run | None = edges.tail
    begun, in_head = edges.last is not None, False
    for entity, number, start, end, text in events:
        if not begun:
            edges.entity, edges.lead, begun = entity, number, True
            edges.last, edges.seen = entity, None
            in_head = True
        if entity == edges.last and number is not None and number == edges.seen:
            continue  # delivered again
        if entity != edges.last:
            if run is not None and run is not edges.head:
                yield run.row()
            run, in_head = None, False
        edges.last, edges.seen = entity, number
        if not text or text.isspace():
            continue
        words = utterance_words(text)
        bare = "" if words else text.strip()
        if run is not None and run.takes(words, bare, start, same, max_gap):
            run.add(number, 1, end)
        else:
            if run is not None and run is not edges.head:
                yield run.row()
            run, before = Run(entity, words, bare, number, start, end), run
            if in_head and edges.head is None:
                edges.head, edges.head_start = run, start
            elif before is edges.head and in_head:
                edges.ends_with, in_head = (words, bare, start), False
        if run is edges.head and edges.variants is not None:
            edges.variants[words, bare] = None
            if len(edges.variants) > VARIANTS:
                edges.variants = None
    edges.tail = run


def enter(carried: Run | None, carried_seen: tuple, edges: Edges, same: Callable, max_gap: float | None) -> tuple[list[tuple], Run | None] | None:
    """(finished runs at the edges, open run) after a partition entered with an open run; None if its edges don't tell.

    carried_seen is the (entity, number) of the row before the partition.
    """
    head, goes_on = edges.head, carried is not None and carried.entity == edges.entity
    if carried_seen == (edges.entity, edges.lead) and edges.lead is not None:
        return None  # its first row was delivered before
    done = [carried.row()] if carried is not None and not goes_on else []
    if not goes_on or head is None:
        if head is not None and head is not edges.tail:
            done.append(head.row())
        if goes_on and edges.last == edges.entity:
            return done, carried  # nothing but blank rows
        if goes_on:
            done.append(carried.row())
        return done, edges.tail
    first = (head.words, head.bare)
    if not carried.takes(*first, edges.head_start, same, max_gap):
        done.append(carried.row())
        if head is not edges.tail:
            done.append(head.row())
        return done, edges.tail
    if edges.variants is None and (carried.words, carried.bare) != first:
        return None
    if (carried.words, carried.bare) != first and not all((same(carried.words, w) if w or carried.words else b == carried.bare) for w, b in edges.variants):
        return None
    carried.add(head.last, head.count, head.end)
    if head is edges.tail:
        return done, carried
    if edges.ends_with is not None and carried.takes(*edges.ends_with, same, max_gap):
        return None
    return [*done, carried.row()], edges.tail


def collapse_runs(df: DataFrame, entity: str = "transcript_id", number: str = "seg_no", start: str = "start_s", end: str = "end_s", text: str = "text", max_gap: float | None = None, least: int = 2, partitions: int | None = None) -> DataFrame:
    """Columns (entity, first number, last number, run_count, run start, duration_s) of runs of at least `least` events.

    Events go by start, then number. An event joins the open run if it is the
    same utterance as the run's first event and begins at most max_gap seconds
    after the run's end (any time if None). The duration reaches to the
    greatest known end. Events without text (null or blank) neither break a run
    nor belong to one; null ends count as the start; events of a null entity
    are left out; an event delivered again (equal entity and number at the same
    start) counts once. An empty table gives no rows. Other columns are ignored.
    """
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.select(F.col(f"`{entity}`").alias("e"), F.col(f"`{number}`").alias("n"), F.col(f"`{start}`").cast("double").alias("s"), F.col(f"`{end}`").cast("double").alias("t"), F.col(f"`{text}`").alias("x")).where("e is not null").withColumn("u", F.monotonically_increasing_id())
    keys = ["e", "s", "n", "u"]
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    # the number of the partition is kept with its rows, as tasks of later jobs may be numbered otherwise
    laid = cut(ranged.sortWithinPartitions("e", "s", "n").drop("u").withColumn("part", F.spark_partition_id()))
    run_schema = f"e {kind[entity]}, first {kind[number]}, last {kind[number]}, run_count long, s double, d double"
    arrow = to_arrow_schema(StructType.fromDDL(f"{run_schema}, part int, edges binary"))

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns[:5]))

    def batched(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        while rows := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, batches = part_of(batches)
        edges = Edges()
        yield from batched((*run, part, None) for run in walk_events(edges, events(batches), same_utterance, max_gap) if run[3] >= least)
        if edges.last is not None:
            yield from batched(iter([(*[None] * 6, part, pickle.dumps(edges))]))

    walked = cut(laid.mapInArrow(walk, f"{run_schema}, part int, edges binary"))

    def entered(carry: dict[int, tuple], tail_only: bool):
        """Walk the partitions of carry again, each with its open run and the row before it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, batches = part_of(batches)
            if part not in carry:
                return
            edges = Edges()
            edges.tail, (edges.last, edges.seen) = carry[part]
            found = walk_events(edges, events(batches), same_utterance, max_gap)
            if tail_only:
                for _ in found:
                    pass
                yield from batched(iter([(*[None] * 6, part, pickle.dumps(edges))]))
            else:
                yield from batched((*run, part, None) for run in found if run[3] >= least)

        return laid.mapInArrow(run, f"{run_schema}, part int, edges binary")

    # one row for each partition
    summaries = {r.part: pickle.loads(bytes(r.edges)) for r in walked.where("edges is not null").select("part", "edges").collect()}
    open_run, seen, at_edges, again = None, (None, None), [], {}
    for part in sorted(summaries):
        edges = summaries[part]
        carried = pickle.loads(pickle.dumps(open_run))
        told = enter(carried, seen, edges, same_utterance, max_gap)
        if told is None:
            again[part] = (open_run, seen)
            edges = pickle.loads(bytes(entered({part: again[part]}, True).first().edges))
            told = [], edges.tail
        at_edges += [run for run in told[0] if run[3] >= least]
        open_run, seen = told[1], (edges.last, edges.seen)
    if open_run is not None and open_run.count >= least:
        at_edges.append(open_run.row())
    out = walked.where("edges is null").where(~F.col("part").isin(*again)) if again else walked.where("edges is null")
    names = ["e", "first", "last", "run_count", "s", "d"]
    out = out.select(*names).unionByName(df.sparkSession.createDataFrame(at_edges, run_schema))
    if again:
        out = out.unionByName(entered(again, False).select(*names))
    return out.select(F.col("e").alias(entity), F.col("first").alias(f"first_{number}"), F.col("last").alias(f"last_{number}"), "run_count", F.col("s").alias(start), F.col("d").alias("duration_s"))
