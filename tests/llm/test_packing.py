import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidecue.llm.packing import fit_repeats, fitted_containers, pack_documents, plan_containers, plan_slots
from tidecue.llm.vocab import encoder


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_everything_and_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 64, 200, 512])
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for _ in range(rng.choice([1, 30, 4000])):
        counts[min(capacity, max(1, int(rng.lognormvariate(3, 1))))] += 1
    plan = plan_containers(counts, capacity)
    used = Counter()
    for pattern, n in plan:
        assert n > 0 and sum(a * t for a, t in pattern) <= capacity
        for a, t in pattern:
            used[a] += t * n
    assert all(used[i] == counts[i] for i in range(1, capacity + 1))
    total = plan_slots(plan)[1]
    lower = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    assert total <= max(lower + 1, int(lower * 1.25) + 1) or capacity <= 8


def test_documents(spark):
    rng = random.Random(1)
    enc = encoder("byte_bpe_50k")
    texts = [" ".join(rng.choice(["the", "river", "song", "lamp"]) for _ in range(rng.randint(0, 90))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, "word " * 700), (5, texts[5]), (None, "alone")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, tokens int")
    out = pack_documents(df, [(1, "byte_bpe_50k", 128), (2, "byte_bpe_50k", 300)]).collect()
    for budget, capacity in ((1, 128), (2, 300)):
        fill, held = defaultdict(int), defaultdict(int)
        for r in out:
            if r.budget_id == budget:
                fill[r.container_id] += r.tokens
                held[r.doc_id] += r.tokens
        assert max(fill.values()) <= capacity
        for i, t in rows:
            n = len(enc.encode_ordinary(t or ""))
            assert held[i] == n * (2 if i == 5 else 1)
        whole = [r for r in out if r.budget_id == budget and r.doc_id is not None and r.doc_id < 400]
        assert len(whole) == 401 and all(r.part_no == 0 for r in whole)
        assert len(fill) <= 1.03 * sum(fill.values()) / capacity + 2


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), [(1, "byte_bpe_50k", 64)]).count() == 0


def lengths_like_documents(n, capacity, seed=1):
    rng = np.random.default_rng(seed)
    return np.bincount(np.maximum(1, (rng.lognormal(5, 1.2, n) % capacity).astype(np.int64)), minlength=capacity + 1)


@pytest.mark.parametrize(("n", "capacity"), [(10_000, 512), (10_000, 2048), (100_000, 1024)])
def test_least_squares_place_most_items(n, capacity):
    counts = lengths_like_documents(n, capacity)
    left = counts.copy()
    plan = fitted_containers(left, capacity)
    assert (left >= 0).all() and left.sum() <= 0.1 * n
    used = sum(k for _, k in plan)
    assert sum(a * t * k for p, k in plan for a, t in p) >= 0.999 * used * capacity
    total = plan_slots(plan_containers(counts, capacity))[1]
    assert (counts * np.arange(capacity + 1)).sum() >= 0.998 * total * capacity


def test_fit_solves_a_small_problem():
    """Two combinations of three lengths, checked against a grid of all repeat counts."""
    counts = np.array([0, 0, 0, 40, 25, 90])
    lengths, times = np.array([[5, 3, 0, 0], [5, 4, 0, 0]]), np.array([[1, 1, 0, 0], [2, 1, 0, 0]])
    x = fit_repeats(lengths, times, counts, steps=2000)
    weight = np.sqrt(np.arange(6) / np.maximum(counts, 1))

    def error(a, b):
        made = np.zeros(6)
        np.add.at(made, [5, 3, 5, 4], [a, a, 2 * b, b])
        return (((made - counts) * weight)[1:] ** 2).sum()

    best = min(error(a, b) for a in range(60) for b in range(60))
    assert error(*x) <= best + 1e-6


def test_planning_time():
    import time

    began = time.time()
    plan_containers(lengths_like_documents(100_000, 8192), 8192)
    assert time.time() - began < 15  # about two seconds on a quiet machine
