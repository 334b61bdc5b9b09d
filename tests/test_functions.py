import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from tidecue.functions import languages, predicates, rules, text, timecode


def values(spark, items, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_timestamps(spark):
    assert values(spark, ["00:00:01,250", "01:02.500", "1:02:03.4", "x", None, "1:2:3:4"], timecode.parse_timestamp) == [1250, 62500, 3723400, None, None, None]
    assert values(spark, ["00:00:01,250", "00:00:01.250", "0:00:01,250"], timecode.parse_srt_timestamp) == [1250, None, None]
    assert values(spark, ["0:00:01.25", "1:00:00.5", "0:00:00"], timecode.ass_time_to_ms) == [1250, 3600500, 0]
    assert values(spark, [1250, 1255, 1265, 59999, 3599999, 36000000], timecode.ms_to_ass_time, "long") == ["0:00:01.25", "0:00:01.26", "0:00:01.26", "0:01:00.00", "1:00:00.00", "10:00:00.00"]
    assert values(spark, [3500, 360000123], timecode.ms_to_srt_time, "long") == ["00:00:03,500", "100:00:00,123"]
    assert values(spark, [-1.0, 0.0005, 0.0015, 61.2], timecode.seconds_to_srt_time, "double") == ["00:00:00,000", "00:00:00,000", "00:00:00,002", "00:01:01,200"]
    assert values(spark, [0.5, 1.5, 3661.0], timecode.format_time, "double") == ["00:00:00", "00:00:02", "01:01:01"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("Se que tu y yo estaremos aqui mas dias con el corazon y la pasi?n", "Sé que tú y yo estaremos aquí más días con el corazón y la pasión"),
        ("Ese evento termin?, ?verdad?", "Ese evento terminó, ¿verdad?"),
        ("?Es... escrita de su mano! Demasi?ado sublime... Demasíado. Ry?mon regres? a Fukui. ocasíón", "¡Es... escrita de su mano! Demasiado sublime... Demasiado. Ryumon regresó a Fukui. ocasión"),
    ],
)
def test_spanish(given, wanted):
    assert text.spanish_text(given) == wanted


def test_markup_and_ass(spark):
    assert values(spark, ["Hello <i>there</i>\nSecond line", "<v Speaker>Ready<br>Go", " a  &amp; b \n c ", "{x}<c.red>y</c>"], text.strip_markup) == ["Hello there\nSecond line", "Ready\nGo", "a & b\nc", "{x}y"]
    assert values(spark, [r"{\an8}Hola\Nmundo\hya", r"{\pos(1,2)}", r"a\fad(1,2)b"], text.strip_ass_text) == ["Hola\nmundo ya", "", "ab"]
    assert values(spark, [r"{\a}{\b}x{c}", "x", "{open"], text.leading_tags) == [r"{\a}{\b}", "", ""]
    assert values(spark, [r"{\pos(12.5,3)}", "x", r"{\pos(a,3)}"], text.position_x) == [12.5, 0.0, 0.0]
    assert values(spark, ["a{b}\\c\nd"], text.escape_ass_text) == ["a(b)\\\\c\\Nd"]


def model_words(t):
    out = []
    for w in t.split():
        key = re.sub(r"\W+", "", w).casefold()
        if len(t.split()) >= 2 and key and out and key == re.sub(r"\W+", "", out[-1]).casefold():
            continue
        out.append(w)
    return " ".join(out) if len(t.split()) >= 2 else t


def model_phrases(t):
    parts = re.split(r"([,.;:!?。！？])", " ".join(t.split()))
    out, last = [], ""
    for i in range(0, len(parts), 2):
        phrase = parts[i].strip()
        key = re.sub(r"\W+", "", phrase).casefold()
        if key and key == last:
            continue
        if phrase:
            out.append(phrase + (parts[i + 1] if i + 1 < len(parts) else ""))
            last = key
    return " ".join(out)


def test_repetitions_against_models(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["sí", "Sí", "no", " ", " ", ", ", ". ", "...", "-", "?", "a"]) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    assert values(spark, texts, text.drop_repeated_words) == [model_words(t) for t in texts]
    assert values(spark, texts, text.collapse_phrases) == [model_phrases(t) for t in texts]
    assert values(spark, ["Hola... adiós", "3.14", "Sí, sí."], text.collapse_phrases) == ["Hola. adiós", "3. 14", "Sí,"]


def test_repair(spark):
    assert values(spark, ["la ciudad estÃ¡ en caos Â¿en quÃ© zona?", "ÂaÂ", "﻿x​�"], text.repair_encoding) == ["la ciudad está en caos ¿en qué zona?", "a", "x"]
    assert values(spark, ["?Es esto una prueba?", "?Siempre", "ok ?Ana?"], lambda c: text.repair_encoding(c, F.lit(True))) == ["¿Es esto una prueba?", "¿Síempre", "ok ¿Ana?"]
    assert values(spark, ["pues perdí permiso", "Señor Lugar"], text.repair_phrases) == ["pues pedí permiso", "Señor del lugar"]


def test_suffixes_and_overlaps(spark):
    df = spark.createDataFrame([("Primera frase. Concentrar todas las fuerzas", "Concentrar todas las fuerzas"), ("dijo: una frase bastante larga", "una frase bastante larga"), ("igual igual igual igual", "igual igual igual igual"), ("a b", "b")], "l string, r string")
    assert [r.x for r in df.select(text.trim_repeated_suffix(F.col("l"), F.col("r")).alias("x")).collect()] == ["Primera frase.", "dijo.", None, None]
    arrays = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"]), (["a", "a"], ["a", "a"]), (["x"], ["y"])], "l array<string>, r array<string>")
    assert [r.x for r in arrays.select(text.overlap_size(F.col("l"), F.col("r")).alias("x")).collect()] == [1, 0, 2, 0]
    heads = spark.createDataFrame([("Uno dos. Tres",), ("sin corte",), ("Fin. ",)], "t string")
    assert [tuple(r.x) for r in heads.select(text.split_final_sentence(F.col("t")).alias("x")).collect()] == [("Uno dos.", "Tres"), ("sin corte", ""), ("Fin.", "")]


def test_terms(spark):
    terms = text.glossary_terms([("金沢", "Kanazawa!")])
    assert values(spark, ["長尾武兎惇 ordenó avanzar hacia 金沢 y 大和.", "長尾武兎惇".encode().decode("cp1252", "ignore")], lambda c: text.apply_terms(c, terms)) == ["Nagao Buton ordenó avanzar hacia Kanazawa! y Yamato.", "Nagao Buton"]


def test_predicates(spark):
    assert values(spark, ["m 0 0 l 10 0 10 10 0 10", "m 0 0 hello 1 2 3 4 5 6 7", ""], predicates.looks_like_vector_path) == [True, False, False]
    assert values(spark, ["ffffffff", "f f f f f f f f", "fffffff", "abababab"], predicates.looks_like_placeholder) == [True, True, False, False]
    assert values(spark, ["[music]", "Subtitulos realizados por la comunidad", "Gracias por ver.", "...", "", "La casa", "(Risas)"], predicates.is_noise) == [True, True, True, True, True, False, True]
    assert values(spark, ["Eh...", "o sea", "este libro", "¿Um?"], lambda c: predicates.is_filler_only(c, F.lit("es-MX"))) == [True, True, False, True]
    assert predicates.decoding_options("maximum") == {"beam_size": 10, "patience": 2.0}
    with pytest.raises(ValueError):
        predicates.decoding_options(beam_size=0)
    with pytest.raises(ValueError):
        predicates.check_segmentation(0.5, 2, 30)


def test_folder_names(spark):
    assert values(spark, ["inputs/video. .mkv", r"C:\a\b.c.mkv"], text.output_folder_name) == ["video", "b.c"]
    with pytest.raises(Exception, match="no folder name"):
        values(spark, ["x/_legacy.mkv"], text.output_folder_name)


def test_languages(spark):
    aliases = spark.createDataFrame([("es", "es"), ("zh", "zh-cmn"), ("zh-wuu", "wuu"), ("ja", "ja")], "alias string, code string")
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(["ja-JP", " ZH ", "zh-wuu", "latin", None, "", "es"])], "i int, label string, code string")
    got = languages.with_profile(df, "label", aliases).orderBy("i").collect()
    assert [r.profile_code for r in got] == ["ja", "zh-cmn", "wuu", None, None, None, "es"] and {r.code for r in got} == {"clash"}
    named = languages.with_container_language(df, "label").orderBy("i").collect()
    assert (named[6].mkv_language, named[6].language_display, named[4].mkv_language, named[3].language_display) == ("spa", "Español", "und", "latin")
    assert [r.recogniser_code for r in languages.with_recogniser_language(df.withColumn("label", F.lit("spa")), "label").limit(1).collect()] == ["es"]


def test_rules_are_plain():
    assert len(rules.SPANISH_SPELLINGS) == 165
    assert datetime.date.today()
