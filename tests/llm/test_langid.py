import random

import pytest

from tidecue.llm.langid import LanguageModel, document_languages, fit_dictionaries, judge_document, judge_documents, label_code, plain, transcript_languages

ALIASES = {"es": "es", "english": "en", "en": "en", "zh": "zh-cmn", "zh-wuu": "wuu", "ru": "ru", "fr": "fr", "ja": "ja"}
SAID = {
    "en": ["The night crew renamed the episode before rehearsal.", "Nobody in the booth forgot the keys to the studio.", "A visitor painted the stage door green while it rained.", "How long is the final scene of the whole recording?"],
    "es": ["El equipo de guion cambió el título del capítulo.", "Nadie en la estación olvidó las llaves del estudio.", "La señora del molino cosió el telón rojo mientras llovía.", "Cuánto dura la última escena de la grabación completa."],
    "fr": ["L'équipe du scénario a changé le titre de l'épisode.", "Personne à la gare a oublié les clés du studio.", "La monteuse a demandé plus de temps sous la pluie.", "Combien de temps dure la dernière scène du film."],
    "ru": ["Капитан поменял название серии после репетиции.", "Никто на вокзале забыл ключи от студии.", "Редактор попросил ещё немного времени у реки."],
    "ja": ["編集者は休憩中に録音を最後まで聞きました。", "船長は奥の部屋で題名を変えました。", "翻訳係は何も言わずに鍵を忘れました。"],
}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    samples = {code: [" ".join(rng.choices(said, k=5)) for _ in range(40)] for code, said in SAID.items()}
    samples["en"] += [" ".join(SAID["es"])] * 4  # wrong labels
    samples["zh-cmn"] = []
    return LanguageModel(fit_dictionaries(samples))


def test_wrong_labels_leave_the_dictionaries(model):
    assert "cambió" not in model.dictionaries["en"].decode()


@pytest.mark.parametrize("code", SAID)
def test_sentences(model, code):
    for s in SAID[code]:
        assert judge_document(model, s, None)[0][1] == code


def test_cases(model):
    text = " ".join(SAID["es"]) + "\n\n" + SAID["en"][0] + "\n \n" + SAID["es"][0]
    assert [(n, c, k) for n, c, _, k in judge_document(model, text, "es")] == [(0, "es", False), (2, "en", True)]
    assert judge_document(model, text, "en")[0][3] and judge_document(model, text, None)[0][3]
    assert judge_document(model, "Error 404: the page could not be found.", None) == []
    assert judge_document(model, "12 34 !", None) == []


def test_labels():
    assert label_code(" EN ", ALIASES) == "en" and label_code("en-GB", ALIASES) == "en" and label_code("zh-wuu", ALIASES) == "wuu" and label_code("zh-TW", ALIASES) == "zh-cmn"
    assert label_code("xx", ALIASES) is None and label_code(None, ALIASES) is None and label_code("  ", ALIASES) is None


def test_tables(spark, model):
    docs = spark.createDataFrame([(1, "es", " ".join(SAID["es"]), 0), (2, "fr", " ".join(SAID["en"]), 0), (None, None, " ".join(SAID["ru"]), 0), (4, "es", None, 0), (5, "es", "  ", 0)], "doc_id long, lang string, text string, code int")
    got = sorted(((r.doc_id or 0), r.para_no, r.code, r.case) for r in document_languages(docs, model, ALIASES).collect())
    assert got == [(0, 0, "ru", True), (1, 0, "es", False), (2, 0, "en", True)]
    segs = spark.createDataFrame([(i, 1, t) for i, t in enumerate(SAID["fr"] * 3)] + [(90, 1, SAID["es"][0]), (90, 1, SAID["es"][0]), (91, 1, "null"), (92, 2, SAID["ja"][0]), (93, None, "x"), (94, 3, None)], "segment_id long, transcript_id long, text string")
    heads = spark.createDataFrame([(1, "FR"), (1, "FR"), (2, "en"), (3, None)], "transcript_id long, detected_language string")
    whole, foreign = transcript_languages(segs, heads, model, ALIASES)
    assert sorted((r.id, r.code, r.case) for r in whole.collect()) == [(1, "fr", False), (2, "ja", True)]
    assert [(r.id, r.code) for r in foreign.collect()] == [(90, "es")]
    assert document_languages(docs.limit(0), model, ALIASES).count() == 0


def test_labels_of_one_language_get_one_dictionary():
    rng = random.Random(2)
    samples = {code: [" ".join(rng.choices(said, k=5)) for _ in range(40)] for code, said in SAID.items()}
    samples["wuu"] = [" ".join(rng.choices(SAID["ja"], k=5)) for _ in range(12)]
    assert set(fit_dictionaries(samples)) == set(SAID)


def test_narrow_margins_reject_missing_labels(model):
    """A text that reads alike in two languages names none, with or without a label."""
    text = SAID["en"][0] + " " + SAID["es"][0]
    sizes = model.sizes(plain(text))
    if model.best(sizes)[2] < 8:
        assert judge_document(model, text, None)[0][1] is None
    for label in (None, "wuu", "en"):
        assert judge_document(model, "ok", label)[0][1:] == (None, judge_document(model, "ok", label)[0][2], False)


def test_labels_without_a_dictionary_count_as_missing(model):
    for text in (" ".join(SAID["ja"]), " ".join(SAID["fr"])):
        assert judge_document(model, text, "wuu") == judge_document(model, text, None) and judge_document(model, text, None)[0][3]


def test_dictionaries_that_share_nothing_give_one_size(model):
    """Skipped dictionaries give the size that they would have given."""
    rng = random.Random(5)
    texts = [s for said in SAID.values() for s in said] + ["“Oui”, dit-il — …", "नदी के किनारे", "그 뒤에", "a, б. в", "…", "😀 hm", "no…"]
    for _ in range(300):
        text = plain(" ".join(rng.choices(texts, k=rng.randint(1, 4))))
        sizes = model.sizes(text)
        if sizes is not None:
            assert sizes == [len(compress(text.encode())) for compress in model._compress]
    assert len(model.sharing("plain letters".encode())) < len(model.codes)


def test_texts_measured_together(model):
    """Batches give what single texts give; equal texts are compressed once."""
    texts = [s for said in SAID.values() for s in said] + ["12 34", "", SAID["en"][0], "“Oui”, dit-il — …"]
    together, once = LanguageModel(model.dictionaries), []
    together.sizes("x")
    together._compress = [lambda raw, c=c: once.append(raw) or c(raw) for c in together._compress]
    assert together.all_sizes(texts) == [model.sizes(t) for t in texts]
    assert once.count(SAID["en"][0].encode()) <= len(model.codes)
    whole = ["\n\n".join(texts[i:]) for i in range(0, len(texts), 3)] + [" \n", "null"]
    assert judge_documents(model, whole, [None] * len(whole)) == [judge_document(model, t, None) for t in whole]
    assert together.all_sizes([]) == [] and together.all_sizes(["1", "2"]) == [None, None]
    assert judge_documents(LanguageModel({}), ["text", ""], [None, "en"]) == [[], []]


def test_dictionaries_in_other_letters_are_asked_for_shared_bytes():
    """A first byte in common isn't enough where a dictionary holds no ASCII, as with garbled text in it."""
    rng = random.Random(6)
    garbled = "編集者は".encode().decode("latin-1")
    dictionaries = {"en": " ".join(SAID["en"] + SAID["fr"]).encode(), "ja": (" ".join(SAID["ja"]) + f" {garbled} à  é — ").encode()}
    model = LanguageModel(dictionaries)
    assert model.sharing("le café fermé".encode()) == (0,)
    for text in ("il va à pied", "deux  é", garbled + " is what it said", "and " + SAID["ja"][0]):
        assert 1 in model.sharing(text.encode())
    signs = ["a", "b", "the", " ", "  ", "é", "à", "—", "…", "ã", "\u0081", "編", "集", "者は", "б", "x" * 9]
    for _ in range(3000):
        raw = "".join(rng.choices(signs, k=rng.randint(1, 12))).encode()
        fours = {raw[i : i + 4] for i in range(len(raw) - 3)}
        for i, content in enumerate(dictionaries.values()):
            assert i in model.sharing(raw) or not any(four in content for four in fours)
