import random

import pytest

from tidecue.llm.runs import collapse_runs, same_utterance, utterance_words

SCHEMA = "transcript_id long, seg_no int, start_s double, end_s double, text string, first_seg_no int"


def brute(rows):
    found = []
    for t in {r[0] for r in rows if r[0] is not None}:
        own = sorted({r for r in rows if r[0] == t}, key=lambda r: (r[2], r[1]))
        own = [r for r in own if r[4] and r[4].strip()]
        i = 0
        while i < len(own):
            j = i
            while j + 1 < len(own) and same_utterance(utterance_words(own[i][4]), utterance_words(own[j + 1][4])):
                j += 1
            if j > i:
                found.append((t, own[i][1], own[j][1], j - i + 1))
            i = j + 1
    return sorted(found)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_over_partitions(spark, seed):
    rng = random.Random(seed)
    said = ["The night crew renamed episode 4.", "Uh, the night crew renamed episode 4", "the night night crew renamed episode 4!", "Step 5: open the valve.", "Yes.", None, "  "]
    rows, clock = [], {1: 0.0, 2: 0.0, 3: 0.0}
    for n in range(600):
        t = rng.choice([1, 1, 1, 1, 2, 3])
        clock[t] += rng.choice([0.5, 1.0])
        rows.append((t, n, clock[t], clock[t] + 0.4, rng.choice(said + said[:1] * 8)))
    df = spark.createDataFrame([(*r, 0) for r in rows + rows[:50]], SCHEMA)
    for parts in (1, 13):
        got = sorted((r.transcript_id, r.first_seg_no, r.last_seg_no, r.run_count) for r in collapse_runs(df, partitions=parts).collect())
        assert got == brute(rows)


def test_anchors_that_differ_at_edges(spark):
    """Slips in chains: which event is the anchor decides where runs part."""
    rng = random.Random(9)
    said = ["the crew walked along the river", "the crw walked along the river", "the crw wlked along the river", "the crw wlked alng the river", "te crw wlked alng the river", "and then the lamp went out"]
    rows = [(1, n, float(n // 2), n + 0.5, rng.choice(said) if rng.random() < 0.98 else said[-1]) for n in range(400)]
    df = spark.createDataFrame([(*r, 0) for r in rows + rows[::7]], SCHEMA)
    want = brute(rows)
    for parts in (3, 32):
        assert sorted((r.transcript_id, r.first_seg_no, r.last_seg_no, r.run_count) for r in collapse_runs(df, partitions=parts).collect()) == want


def test_gaps_over_partitions(spark):
    rng = random.Random(4)
    rows, clock = [], 0.0
    for n in range(300):
        clock += rng.choice([0.5, 1.0, 4.0])
        rows.append((1, n, clock, clock + rng.choice([0.2, 3.0]), "Again.", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(tuple, collapse_runs(df, max_gap=1.0, least=1, partitions=1).collect()))
    assert len(one) > 20 and sorted(map(tuple, collapse_runs(df, max_gap=1.0, least=1, partitions=40).collect())) == one


def test_one_walk_for_a_run_over_many_partitions(spark, monkeypatch):
    from tidecue.llm import runs

    df = spark.createDataFrame([(7, i, float(i), i + 1.0, "Again.", 0) for i in range(400)], SCHEMA)
    entered = []
    enter = runs.enter
    monkeypatch.setattr(runs, "enter", lambda *a: entered.append(enter(*a)) or entered[-1])
    got = collapse_runs(df, partitions=32).collect()
    assert [r.run_count for r in got] == [400] and len(entered) >= 30 and None not in entered


def test_entities_of_other_types(spark):
    from datetime import date
    from decimal import Decimal

    rows = [(date(2026, 1, 1 + i // 4), Decimal(i), float(i), i + 1.0, "Again.") for i in range(8)]
    df = spark.createDataFrame(rows, "transcript_id date, seg_no decimal(10,2), start_s double, end_s double, text string")
    assert sorted(r.run_count for r in collapse_runs(df, partitions=3).collect()) == [4, 4]


def test_one_run_over_all_partitions_with_duration(spark):
    df = spark.createDataFrame([(7, i, float(i), None if i % 3 else i + 2.0, "Again.", 0) for i in range(300)], SCHEMA)
    got = collapse_runs(df, partitions=8).collect()
    assert [(r.first_seg_no, r.last_seg_no, r.run_count, r.start_s, r.duration_s) for r in got] == [(0, 299, 300, 0.0, 299.0)]
    assert collapse_runs(df, max_gap=-0.5, partitions=8).count() < 300


def test_empty_and_null(spark):
    assert collapse_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collapse_runs(spark.createDataFrame([(None, 1, 0.0, 1.0, "a", 0), (1, 1, 0.0, 1.0, None, 0), (1, 2, 1.0, 2.0, " ", 0)], SCHEMA)).count() == 0


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("El técnico de sonido revisó.", "el tecnico de sonido revisó", True),
        ("Do you still believe Lodar?", "Do still beleive Lodar?", True),
        ("In realtà, Dornedek ha chesto più tempo.", "In realtà, Dornedek ha chiestto più tempo.", True),
        ("Take 41 lasts long", "Take 42 lasts long", False),
        ("Gracias, Pelsoria.", "Gracias, Qlsoria.", False),
        ("第3步：打开白青川的阀门。", "第4步：打开白青川的阀门。", False),
        ("好的。", "好的！", True),
        ("[music]", "[music]", True),
    ],
)
def test_utterances(a, b, same):
    assert same_utterance(utterance_words(a), utterance_words(b)) is same
