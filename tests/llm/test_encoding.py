import random

import pytest

from tidecue.llm import encoding
from tidecue.llm.encoding import encode_documents, encode_text, halve
from tidecue.llm.vocab import encoder, keeps_ids

PARTS = ["a", "b", " ", "  ", "'", "s", "ll", "'s", "é", "日", "本", "!", "..", "1", "\n", "\t", "　", "x" * 9, " the", "😀", "́", "re", "'ve", "l", "d"]
ALPHABETS = [PARTS, PARTS[:2], ["日", "本"], ["!", "'"], [" "], ["'", "r", "e", "l"], ["\n", " ", "a"], list("の日本語がは"), list("abcde")]


def random_text(rng, most):
    alphabet = rng.choice(ALPHABETS)
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, most)))


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_tree_equals_whole(name):
    enc, rng = encoder(name), random.Random(5)
    for _ in range(1500):
        text = random_text(rng, 400)
        assert encode_text(text, enc, rng.randint(1, 60)).tolist() == enc.encode_ordinary(text)


@pytest.mark.parametrize("unit", ["日本語の文字", "x", "abcdefghij", "'", " ", "\n", "!?", "é", "9"])
def test_unbroken_text_goes_through_windows(unit, monkeypatch):
    enc, rng = encoder("byte_bpe_50k"), random.Random(3)
    text = "".join(rng.choice(unit) for _ in range(30_000))
    joins = []
    join = encoding.join_ids
    monkeypatch.setattr(encoding, "join_ids", lambda *a: joins.append(1) or join(*a))
    assert encode_text(text, enc).tolist() == enc.encode_ordinary(text)
    assert len(joins) == 15


def test_halves():
    assert halve("", 4) == [""] and halve("abcd", 4) == ["abcd"]
    assert halve("abcdefghi", 4) == ["ab", "cd", "ef", "ghi"]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_stretches_keep_their_ids(name):
    enc, rng, told = encoder(name), random.Random(8), 0
    for _ in range(3000):
        text = random_text(rng, 60)
        ids = enc.encode_ordinary(text)
        if len(ids) < 2:
            continue
        i, j = sorted(rng.sample(range(len(ids) + 1), 2))
        try:
            a, b = (len(enc.decode_bytes(ids[:k]).decode("utf-8")) for k in (i, j))
        except UnicodeDecodeError:
            continue
        if keeps_ids(text, a, b):
            told += 1
            assert enc.encode_ordinary(text[a:b]) == ids[i:j]
    assert told > 800


def test_documents_of_all_kinds(spark):
    enc = encoder("byte_bpe_50k")
    texts = {1: "Hello there", 2: "", 3: None, 4: "word " * 3000, 5: "日本語" * 4000, 6: "<|endoftext|> <s>", 7: "a" * 20_000, 8: "   "}
    df = spark.createDataFrame([(i, t, "x", [0]) for i, t in texts.items()] + [(1, "Hello there", "y", [1]), (None, "null id", "z", [2])], "doc_id long, text string, id string, ids array<int>")
    got = encode_documents(df, piece_chars=300, spread_chars=13_000).collect()
    assert len(got) == len(texts) + 2
    for row in got:
        want = "null id" if row.doc_id is None else texts[row.doc_id]
        assert row.ids == enc.encode_ordinary(want or "")


def test_empty_table(spark):
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
