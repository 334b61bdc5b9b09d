import pytest

from tidecue.llm.residue import find_residue, residue_kind

ONLY = [
    "undefined", "[object Object]", "N/A", "Error 404: the page you asked for could not be located on subs3.example.", "HTTP/1.1 503 Service Unavailable", "404 Página no disponible",
    "Your session ran out. Sign in again to read the captions.", "字幕を読み込めませんでした。0分後にもう一度お試しください。", "Включите JavaScript, чтобы увидеть субтитры.", "请启用JavaScript以查看字幕。",
    "Accès refusé à cette piste (réf. c5a6)\n\nErreur 502 : la page demandée est introuvable sur a.example.", '{"status": 500, "message": "anything"}', "<html><head><title>Access denied</title></head><body><h1>Access denied</h1></body></html>",
    "Lorem minim ipsum dolor magna aliqua.", "asdf asdf asdf", "TBD TBD TBD", "ダミーテキスト", "Texto de ejemplo para la maqueta", "자막을 보려면 자바스크립트를 켜 주세요.",
]
PART = [
    "Gracias, {{ guest | title }}.", "A visitor from ${host} left.", "<%= city %> moved on.", "#{name}的摄像机在哪里？", "Sr. %s falou.", "Don %CITY% midió.", "J. R. @@capitulo@@ signed.", "From [[host]] with care.", "Obrigado, :guest:.",
    "Vive en la av. __GUEST__, núm. 0.", "sagte {0} leise.", "The man from <SPEAKER> spoke.", "Según [NOMBRE HERE], ya.", "Say [INSERT CITY] now.", "Don NaN explicó.", "According to undefined, yes.", "Según <tu capitulo aquí>, sí.", "録音は__SPEAKER__の話です。", "NaNさん、そのボタン",
]
CLEAN = [
    None, "", "   ", "[music]", "<i>Hola</i>", "{\\an8}Hola", "The model printed <|endoftext|> after line 47.", "<s> Hola [MASK] </s> <unk>", "We got error 502 twice, so Nudek phoned the station.", "JavaScript was the topic of lecture 3.",
    "The teacher drew two curly braces { } on the board.", "El servidor estuvo caído 5 minutos.", "Call me at 10:30: or 11.", "Use `{{ name }}` in the template.", "```\nprint('%s' % x)\n```\nThat is all.", "One hundred % sure.", "None of them came.",
    "In this tutorial the template variable \"{{ name }}\" is the placeholder.", "00:00:01,000 --> 00:00:02,000", "Version 2.9.1 of the script fixes p. 20.",
]


@pytest.mark.parametrize("text", ONLY)
def test_only(text):
    assert residue_kind(text) == "only"


@pytest.mark.parametrize("text", [
    "Do you still believe &&nombre&& will come back?", "Pela terceira vez, Eng. $guest$ pediu mais tempo.", "By the river, <TITLE> measured the echo.", "He met ##host## and %%city%% there.", "Ask ^^name^^.",
    "The guest was ${" + "very_" * 40 + "long_name}.", "{{ " + "a.b." * 50 + "c }} spoke.",
])
def test_more_delimiters_and_long_names(text):
    assert residue_kind(text) == "part"


@pytest.mark.parametrize("text", ["-- empty --", "(no text)", "sin contenido", "n/d", "[ohne Text]", "<blank>", "без текста", "(空)"])
def test_notes_that_there_is_no_text(text):
    assert residue_kind(text) == "only"


@pytest.mark.parametrize("text", [
    "It costs $5 or $6 today.", "Tom && Ann came, && so did Bob.", "<TITLE>The river</TITLE> was shown.", "Leer", "The room was empty.", "No text arrived that night, he said.", "They spoke of $ and & signs.",
    "for (const x of rows) {\n  print(`${x}`);\n  return x;\n}\nconst y = () => ${x};\nlet z = ${y};", "We turned it on. The script still needs work.",
])
def test_speech_code_and_markup_that_look_alike(text):
    assert residue_kind(text) is None


def test_a_placeholder_in_speech_beside_code_counts():
    """Density is that of the paragraph: code elsewhere in a document excuses nothing."""
    code = "let x = ${a};\nreturn () => print(x);\nconst y = ${b};"
    assert residue_kind(code) is None
    assert residue_kind(code + "\n\nThen ${guest} left the old station and walked along the river until it was late and nobody came.") == "part"


@pytest.mark.parametrize("text", PART)
def test_part(text):
    assert residue_kind(text) == "part"


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert residue_kind(text) is None


@pytest.mark.parametrize("text", [
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.", "bla " * 40, "test " * 13, "todo " * 2_000, "texto " * 20, "foo " * 16,
    "sunt in culpa qui officia deserunt mollit anim id est, " * 300,
])
def test_filler_of_any_length(text):
    assert residue_kind(text) == "only"


@pytest.mark.parametrize("text", ["bla " * 40 + "but no", "sunt in culpa qui " * 200 + "and then they spoke of " * 200, "We spoke of it in the end. " * 300 + "culpa qui officia deserunt " * 100])
def test_long_speech_is_no_filler(text):
    assert residue_kind(text) is None


def test_page_after_a_long_prolog():
    page = "<!DOCTYPE html>\n<!-- " + "served by <cache> 7, " * 30 + "-->\n<html><head><title>Access denied</title></head><body><h1>Access denied</h1></body></html>"
    assert page.index("<html") > 200 and residue_kind(page) == "only"


def test_table(spark):
    rows = [(i, t, "x") for i, t in enumerate([*ONLY, *CLEAN, "word " * 50_000 + "${tail}"])] + [(None, "null", "x"), (0, "undefined", "x")]
    df = spark.createDataFrame(rows, "segment_id long, text string, kind string")
    found = find_residue(df, "segment_id").collect()
    assert len(found) == len(ONLY) + 3
    assert sorted(r.row_id for r in found if r.row_id is not None and r.row_id < len(ONLY)) == sorted([0, *range(len(ONLY))])
    assert find_residue(spark.createDataFrame([], "segment_id long, text string"), "segment_id").count() == 0
