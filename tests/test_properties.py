from hypothesis import given, settings
from hypothesis import strategies as st

from tidecue.functions.text import spanish_text
from tidecue.operators.intervals import combine_summaries
from tidecue.operators.neighbors import share_out


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_spanish_repair_settles(text):
    once = spanish_text(text)
    assert once == once.strip() and "  " not in once and "¿¿" not in once


@given(st.text(alphabet="ab .,!A", max_size=20), st.text(alphabet="ab .,!A", max_size=20))
@settings(max_examples=300, deadline=None)
def test_redistribution_loses_no_letters(left, right):
    given = share_out(left, right)
    letters = lambda s: [ch for ch in s.lower() if ch.isalpha()]
    if given is not None:
        assert given[1] and letters(given[0] + given[1])[: len(letters(left))] == letters(left)


def merged(spans):
    out = []
    for s, t in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], t)
        else:
            out.append([s, t])
    return out


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20)), min_size=1, max_size=40), st.lists(st.integers(0, 40), max_size=5))
@settings(max_examples=300, deadline=None)
def test_carry_equals_one_scan(spans, cuts):
    rows = sorted((s, s + d) for s, d in spans)
    edges = [0, *sorted(min(c, len(rows)) for c in cuts), len(rows)]
    summaries = []
    for part, (a, b) in enumerate(zip(edges, edges[1:])):
        if a < b:
            last = merged(rows[a:b])[-1]
            summaries.append((part, 1, 1, last[0], max(t for _, t in rows[a:b])))
    carry = combine_summaries(summaries)
    for part, (a, b) in enumerate(zip(edges, edges[1:])):
        if a < b and a > 0:
            island = merged(rows[:a])[-1]
            assert carry[part][:3] == (1, *island)
