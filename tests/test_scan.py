import random

import pytest

from tidecue.operators import folds, neighbors, scan

SCHEMA = "transcript_id long, seg_no int, start_s double, end_s double, text string"


def recording(kind, n=1500):
    rng, t, rows = random.Random(2), 0.0, []
    for i in range(n):
        t += {"even": 1.0, "dense": 0.3}.get(kind) or rng.choice([0.5, 1.0, 2.0, 6.0])
        body = {"even": "x" * 100, "dense": "w" * rng.randint(1, 5)}.get(kind) or rng.choice(["Hello there. ", "word " * rng.randint(1, 30), "end."])
        rows.append((1 if kind != "mixed" else rng.choice([1, 1, 1, 2, 3]), i, t, t + rng.random(), body))
    return rows


@pytest.mark.parametrize("kind", ["even", "dense", "random", "mixed"])
@pytest.mark.parametrize("section_s", [None, 60.0])
def test_any_number_of_partitions_gives_one_result_in_one_walk(spark, monkeypatch, kind, section_s):
    df = spark.createDataFrame(recording(kind), SCHEMA)
    told = []
    after = scan._after
    monkeypatch.setattr(scan, "_after", lambda *a: told.append(after(*a)) or told[-1])
    whole = scan.ordered_scan

    def paragraphs(parts):
        monkeypatch.setattr(folds, "ordered_scan", lambda *a: whole(*a, partitions=parts))
        return sorted(map(tuple, folds.build_paragraphs(df, section_s=section_s).collect()))

    one = paragraphs(1)
    told.clear()
    assert paragraphs(32) == one
    # no partition had to be walked a second time to know its state
    assert len(told) >= 25 and None not in told


def test_prefixes_over_partitions(spark, monkeypatch):
    rng = random.Random(3)
    said = ["Hola amigo", "Hola amigo que tal", "Hola", "que", "Hola amigo que tal. Bien", "A"]
    df = spark.createDataFrame([(1, n, rng.choice(said)) for n in range(400)], "track_id long, cue_no int, text string")
    whole, results = scan.ordered_scan, []
    for parts in (1, 32, 150):
        monkeypatch.setattr(neighbors, "ordered_scan", lambda *a, parts=parts: whole(*a, partitions=parts))
        results.append(sorted(map(tuple, neighbors.redistribute_prefixes(df).collect())))
    assert results[0] == results[1] == results[2] and any(r[3] for r in results[0])


def test_results_survive_a_union(spark):
    """Tasks of a union are numbered anew; partitions keep their own numbers."""
    df = spark.createDataFrame([(1, i) for i in range(100)], "e long, n int")
    numbered = scan.number_rows(df, "e", ["n"], "k", partitions=7)
    both = numbered.unionByName(numbered)
    assert sorted(r.k for r in both.collect()) == sorted([*range(1, 101)] * 2)
    beside = scan.neighbours(df, "e", ["n"], ["n"], partitions=7)
    assert all(r.next_n == r.n + 1 for r in beside.unionByName(beside).collect() if r.n < 99)
