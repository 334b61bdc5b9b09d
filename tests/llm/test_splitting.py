import random

import pytest

from tidecue.llm.splitting import split_documents, split_text
from tidecue.llm.vocab import encoder

ENC = encoder("byte_bpe_50k")


def prose(rng, n):
    out = []
    for _ in range(n):
        out.append(" ".join(rng.choice("the night crew moved song another track by river after rehearsal".split()) for _ in range(rng.randint(4, 16))).capitalize() + rng.choice([". ", "! ", "?\n\n"]))
    return "".join(out).strip()


@pytest.mark.parametrize("text", [prose(random.Random(1), 200), "日本語の文です。" * 300, "x" * 9000, "é" * 4000, "😀" * 900, "a b " * 2000])
def test_pieces_cover_fit_and_overlap(text):
    limit, overlap = 128, 16
    pieces = split_text(text, limit, overlap, ENC)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for start, end, tokens, _ in pieces:
        assert start < end and tokens == len(ENC.encode_ordinary(text[start:end])) <= limit
    for before, after in zip(pieces, pieces[1:]):
        assert before[0] < after[0] <= before[1] < after[1]
        assert overlap <= after[3] <= overlap + 3


def test_sizes_are_those_of_the_piece_alone():
    rng = random.Random(4)
    parts = ["a", " ", "  ", "'", "'s", "re", "日", "。", "!", "1", "\n\n", "\t", "😀", " the", ". "]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 300)))
        limit = rng.randint(12, 40)
        pieces = split_text(text, limit, rng.randint(0, limit - 8), ENC)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        assert all(k == len(ENC.encode_ordinary(text[a:b])) <= limit for a, b, k, _ in pieces)
        assert all(u[0] <= v[0] <= u[1] < v[1] for u, v in zip(pieces, pieces[1:]))


@pytest.mark.parametrize(("limit", "overlap"), [(3, 0), (8, 2), (10, 12), (16, -1)])
def test_budgets_without_room(limit, overlap):
    with pytest.raises(ValueError):
        split_text("text", limit, overlap, ENC)


def test_cuts_are_natural_and_local():
    text = prose(random.Random(2), 400)
    pieces = split_text(text, 128, 16, ENC)
    ends = [text[p[1] - 1] for p in pieces[:-1]]
    assert sum(e in ".!?" for e in ends) >= 0.9 * len(ends)
    edited = split_text(text[:3000] + "An edit stands here. " + text[3000:], 128, 16, ENC)
    shift = len("An edit stands here. ")
    same = {p[1] for p in pieces} & ({p[1] for p in edited} | {p[1] - shift for p in edited})
    assert len(same) >= len(pieces) - 8


def test_documents(spark):
    rows = [(1, prose(random.Random(3), 90)), (2, "short"), (3, ""), (4, None), (None, "y" * 3000), (1, prose(random.Random(3), 90))]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, tokens int")
    cut = split_documents(df, [(4, "byte_bpe_50k", 64, 8)])
    got = cut.collect()
    assert {r.doc_id for r in got} == {1, None} and all(r.tokens <= 64 for r in got)
    assert all(r.text == dict(rows)[r.doc_id][r.char_start : r.char_end] for r in got)
    kept = split_documents(df, [(4, "byte_bpe_50k", 64, 8)], keep_whole=True)
    assert {r.doc_id for r in kept.collect()} == {1, 2, None}
    assert split_documents(spark.createDataFrame([], "doc_id long, text string"), [(4, "byte_bpe_50k", 64, 8)]).count() == 0
