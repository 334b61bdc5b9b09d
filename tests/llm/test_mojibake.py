import pytest

from tidecue.llm.mojibake import find_garbled, garbled_forms, mend_text, read_as, restore, restore_texts

CLEAN = ["El técnico de sonido revisó los subtítulos.", "Кроме того, редактор забыл ключи от студии.", "編集者は休憩中に録音を最後まで聞きました。", "그 뒤에 편집자는 안쪽 방에서 잊어버렸습니다.", "They missed the 9 o'clock ferry — again.", "संपादक ने नदी के किनारे कहा।", "录音师在河边改了标题。", "S�"[:1] + "í, sí. SÌ. sì, sì, sì."]
GARBLED = {
    1: "El técnico de sonido revisó los subtítulos.".encode().decode("cp1252"),
    2: "Кроме того, редактор забыл ключи от студии.".encode("koi8-r").decode("cp1251"),
    3: "編集者は休憩中に録音を最後まで聞きました。".encode("euc_jp").decode("latin-1"),
    4: "El t�cnico de sonido revis� los subt�tulos.",
    5: "They missed the 9 oâ€™clock ferry again.",
    6: "El t?cnico de sonido revis? los subt?tulos.",
    7: "编集者".encode().decode("latin-1"),
}


@pytest.fixture(scope="module")
def table(spark):
    rows = [("cues", 100 + 20 * k + i, t, "x") for k, t in enumerate(CLEAN) for i in range(12)]
    rows += [("segments", i, t, "x") for i, t in GARBLED.items() if i != 7]
    rows += [("segments", 1, GARBLED[1], "y"), ("segments", 50, None, ""), ("segments", 51, "", ""), ("segments", 52, "plain " * 20_000, "")]
    return spark.createDataFrame(rows, "tab string, row_id long, text string, chain string")


def test_finds_garbled_records_alone(table):
    found = {(r.tab, r.row_id) for r in find_garbled(table).collect()}
    assert found == {("segments", i) for i in range(1, 7)}


def test_hot_tokens_are_spread_without_loss(table, monkeypatch):
    from tidecue.llm import mojibake

    want = sorted(map(tuple, find_garbled(table).collect()))
    mended = sorted(map(tuple, restore_texts(table).collect()))
    monkeypatch.setattr(mojibake, "HOT", 1)
    assert sorted(map(tuple, find_garbled(table).collect())) == want
    assert sorted(map(tuple, restore_texts(table).collect())) == mended


def test_null_ids(spark):
    bad = "La estación cerró.".encode().decode("cp1252")
    df = spark.createDataFrame([("cues", 1, "La estación cerró."), ("cues", None, bad), ("cues", None, bad)], "tab string, row_id long, text string")
    assert [tuple(r)[:2] for r in find_garbled(df).collect()] == [("cues", None)]
    assert [tuple(r) for r in restore_texts(df).collect()] == [("cues", None, "La estación cerró.", True)]


def test_word_seen_once(spark):
    df = spark.createDataFrame([("cues", 1, "La estación cerró."), ("cues", 2, "Vamos a la " + "estación".encode().decode("cp1252"))], "tab string, row_id long, text string")
    assert [r.row_id for r in find_garbled(df).collect()] == [2]


@pytest.mark.parametrize(("text", "chain"), [(CLEAN[1], ("cp1251", "koi8-r")), (CLEAN[1], ("cp1251", "cp1252")), (CLEAN[0], ("cp1252", "cp437")), (CLEAN[6], ("gb18030", "cp1252"))])
def test_hot_source_read_wrongly(spark, text, chain):
    bad = read_as(text.encode(chain[0]), chain[1])
    df = spark.createDataFrame([("cues", i, text if i < 3 else bad) for i in range(30)], "tab string, row_id long, text string")
    assert {r.row_id for r in find_garbled(df).collect()} == set(range(3, 30))


def test_restores_originals(table):
    got = {r.row_id: (r.original_text, r.restored) for r in restore_texts(table).collect()}
    assert got[1] == (CLEAN[0], True) and got[2] == (CLEAN[1], True) and got[3] == (CLEAN[2], True)
    assert got[4] == (CLEAN[0], True) and got[6] == (CLEAN[0], True)


def test_lost_characters_give_the_verified_original():
    assert restore("sÃ", "utf-8>cp1252>lost") is None
    assert mend_text("Claro que sÃ.", [("sÃ", "sí", "utf-8>cp1252>lost")]) == ("Claro que sí.", True)


def test_empty(spark):
    empty = spark.createDataFrame([], "tab string, row_id long, text string")
    assert find_garbled(empty).count() == 0 and restore_texts(empty).count() == 0


@pytest.mark.parametrize(("word", "script"), [("estación", "latin"), ("Потом", "cyrillic"), ("編集", "japanese"), ("자막을", "hangul")])
def test_chains_invert(word, script):
    forms = garbled_forms(word, script)
    back = [restore(f, c) for f, c in forms.items() if not c.endswith("lost")]
    assert len(forms) > 8 and {b.lower() for b in back if b} == {word.lower()}


def test_single_letters_follow_the_other_words():
    garbled = read_as("personne à la gare a trouvé l'écho".encode("cp850"), "cp1252")
    hits = [(t, o, "cp850>cp1252") for t, o in ((read_as("trouvé".encode("cp850"), "cp1252"), "trouvé"),)]
    assert mend_text(garbled, hits)[0].startswith("personne à la gare a trouvé")
    # beside a clean word a single sign stays what it is
    mixed = garbled.split(" l'")[0] + " après"
    assert "…" in mend_text(mixed, hits)[0] and mend_text(mixed, hits)[0].endswith("trouvé après")
