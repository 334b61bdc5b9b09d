import random

import pytest
from pyspark.sql import types as T

from tidecue.operators.intervals import combine_summaries, periods_and_gaps

SCHEMA = "track_id long, start_ms long, end_ms long, kind string, e string"


def brute(rows):
    found = []
    for entity in {r[0] for r in rows if r[0] is not None}:
        spans = sorted((s, t) for e, s, t in rows if e == entity and s is not None and t is not None and t > s)
        merged = []
        for s, t in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([s, t])
        found += [(entity, "period", s, t) for s, t in merged]
        found += [(entity, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(found)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(0, 900)]), None) for _ in range(700)]
    rows = [(e, s, None if s is None or rng.random() < 0.03 else s + rng.randint(-2, 9)) for e, s, _ in rows]
    df = spark.createDataFrame([(*r, "x", "clash") for r in rows + rows[:40]], SCHEMA)
    for parts in (1, 7):
        got = sorted(map(tuple, periods_and_gaps(df, partitions=parts).collect()))
        assert got == brute(rows)


def test_one_entity_over_many_partitions_and_ties(spark):
    rows = [(5, 0, 1000)] + [(5, i, i + 1) for i in range(0, 900, 2)] + [(5, 10, 20)] * 300 + [(5, 1000, 1001), (5, 1003, 1004)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = sorted(map(tuple, periods_and_gaps(df, partitions=9).collect()))
    assert got == [(5, "gap", 1001, 1003), (5, "period", 0, 1001), (5, "period", 1003, 1004)]


def test_empty_and_null_tables(spark):
    assert periods_and_gaps(spark.createDataFrame([], SCHEMA)).count() == 0
    assert periods_and_gaps(spark.createDataFrame([(None, 1, 2, "", ""), (1, None, 2, "", ""), (1, 2, None, "", ""), (1, 3, 3, "", "")], SCHEMA)).count() == 0


def test_text_entities(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("b", 1, 2), ("b", 4, 5)], "who string, start_ms long, end_ms long")
    out = periods_and_gaps(df, entity="who")
    assert out.schema["who"].dataType == T.StringType()
    assert sorted(map(tuple, out.collect())) == [("a", "period", 0, 7), ("b", "gap", 2, 4), ("b", "period", 1, 2), ("b", "period", 4, 5)]


def test_carry_passes_through_partitions_of_one_entity():
    carry = combine_summaries([(0, 1, 2, 10, 500), (1, 2, 2, 100, 200), (3, 2, 2, 600, 700), (4, 3, 3, 1, 2)])
    assert carry == {0: (None, 0, 0, 2), 1: (2, 10, 500, 2), 3: (2, 10, 500, 3), 4: (None, 600, 700, None)}
