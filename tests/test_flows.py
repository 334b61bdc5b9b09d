import pytest
from pyspark.sql import functions as F

from tidecue.functions import predicates
from tidecue.operators import translate
from tidecue.plans import commands, pipelines
from tidecue.sources import discovery

SEGMENTS = "transcript_id long, seg_no int, start_s double, end_s double, text string"
HEADS = "transcript_id long, title string, source_video string, backend string, language string, audio_stream_index int"


def test_transcript_from_segments_to_report(spark):
    rows = [(1, 1, 0.0, 3.0, "Hola hola equipo."), (1, 2, 4.0, 7.0, "Este metodo mejora la trazabilidad del proceso."), (1, 3, 190.0, 195.0, "Gracias por ver."), (1, 4, 196.0, 201.0, "La decision de diseno prioriza resultados reproducibles."), (2, 1, 0.0, 1.0, "[music]")]
    heads = spark.createDataFrame([(1, "Reunión", "v.mkv", "whisperx", "es", 1), (2, "Nada", "w.mkv", "whisperx", "", None)], HEADS)
    paragraphs, documents, report = pipelines.transcribe(spark.createDataFrame(rows, SEGMENTS), heads, "2026-01-01")
    got = sorted((r.para_no, r.start_s, r.end_s, r.low, r.warnings) for r in paragraphs.collect())
    assert got == [(1, 0.0, 7.0, False, []), (2, 196.0, 201.0, False, [])]
    content = {r.transcript_id: r.content for r in documents.collect()}
    assert "## 00:00:00 - 00:00:07\n\nHola equipo." in content[1] and "## 00:03:16 - 00:03:21" in content[1] and content[2].endswith("# Nada\n")
    found = {r.transcript_id: r for r in report.collect()}
    assert (found[1].language, found[1].n_input, found[1].n_clean, found[1].n_removed, found[1].n_paragraphs, found[1].n_warnings) == ("es", 4, 3, 1, 2, 0)
    assert (found[2].language, found[2].n_clean, found[2].n_paragraphs) == ("und", 0, 0)


def test_language_is_settled_before_cleaning(spark):
    rows = [(1, i, float(i), i + 0.5, t) for i, t in enumerate(["Estoy en la sesión, profe.", "La grabación es por la mañana.", "¿Qué está pasando aquí?"])]
    heads = spark.createDataFrame([(1, "t", "v", "b", "en", 0)], HEADS)
    assert pipelines.transcribe(spark.createDataFrame(rows, SEGMENTS), heads, "x")[2].first().language == "es"


def test_transcripts_are_aligned_once(spark, monkeypatch):
    seen, plain = spark.sparkContext.accumulator(0), pipelines.folds.align_paragraphs
    note = F.udf(lambda t: seen.add(1) or t, "string").asNondeterministic()
    monkeypatch.setattr(pipelines.folds, "align_paragraphs", lambda *a: plain(*a).withColumn("text", note("text")))
    rows = [(t, i, 10.0 * i, 10.0 * i + 1, f"Recording {t} says word{i}.") for t in range(4) for i in range(5)]
    heads = spark.createDataFrame([(t, "t", "v", "b", "en", 0) for t in range(4)], HEADS)
    documents = pipelines.transcribe(spark.createDataFrame(rows, SEGMENTS), heads, "x")[1]
    assert len(documents.collect()) == 4 and seen.value == 20


def test_translated_file(spark):
    lines = spark.createDataFrame([(1, 1, True, "0", "0:00:01.00", "0:00:02.00", "Default", "", "0", "0", "0", "", r"{\i1}Hello"), (1, 2, True, "0", "0:00:03.00", "0:00:04.00", "SongEnglish", "", "0", "0", "0", "fx", r"{\pos(1,2)}L"), (1, 3, True, "0", "0:00:05.00", "0:00:06.00", "Default", "", "0", "0", "0", "", "stays")], "track_id long, line_no int, in_events boolean, layer string, start string, end string, style string, name string, ml string, mr string, mv string, effect string, raw string")
    maps = spark.createDataFrame([(1, 1, {"1": "Hola Yamato", "Op|9:00:00.00|9:00:01.00": "b", "Op|10:00:00.00|10:00:01.00": "a Yamato"})], "track_id long, file_no int, entries map<string,string>")
    out, report = translate.translated_files(lines, maps, terms=[("Yamato", "大和")], blank_song_letters=True)
    got = sorted((r.line_no, r.outcome, r.raw, r.layer, r.mv) for r in out.collect())
    assert got == [(1, "translated", r"{\i1}Hola 大和", "0", "0"), (2, "blanked", r"{\pos(1,2)}", "0", "0"), (3, "kept", "stays", "0", "0"), (4, "appended", "a 大和", "99", "30"), (5, "appended", "b", "99", "30")]
    assert tuple(report.first())[1:] == (1, 1, 2)
    kept, _ = translate.translated_files(lines, maps.where("false"))
    assert {r.outcome for r in kept.collect()} == {"kept"}


def test_export(spark):
    cues = spark.createDataFrame([(1, 1000, 2000, "a"), (1, 3000, 4000, "b"), (2, 0, 500, "c")], "track_id long, start_ms long, end_ms long, text string")
    packets = spark.createDataFrame([(1, 1001), (1, 3002), (2, 5)], "track_id long, start_ms long")
    files, checks = pipelines.export_synchronized(packets, cues)
    assert {r.track_id: (r.delta, r.passed) for r in checks.collect()} == {1: (2, True), 2: (5, False)}
    assert all("192,192,48" in r.content for r in files.collect())


def test_recogniser_choice_and_options(spark):
    assert commands.choose_recogniser("auto", lambda n: n == "whisper") == "whisper"
    with pytest.raises(RuntimeError):
        commands.choose_recogniser("whisperx", lambda n: n == "whisper")
    assert predicates.decoding_options() == {"beam_size": 5, "patience": 1.0} and predicates.decoding_options("maximum", patience=3)["patience"] == 3.0
    for bad in ({"beam_size": 0}, {"patience": 0.0}, {"quality": "none"}):
        with pytest.raises(ValueError):
            predicates.decoding_options(**bad)
    with pytest.raises(ValueError):
        predicates.check_segmentation(0.5, 1.2, 30)
    payload = commands.recogniser_payload("auto", lambda n: True, F.lit("a.wav"), F.lit("out"), F.lit(""))
    got = spark.range(1).select(payload.alias("p")).first().p
    assert got.recogniser == "whisperx" and "--beam_size" in got.command and "--language" not in got.command and got.settings["language"] == "auto"


def test_input_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.mkv", "a.mkv", "a.mp4", "sub/c.mkv"):
        (tmp_path / name).write_bytes(b"x")
    found = discovery.list_inputs(spark, str(tmp_path))
    assert [r.name for r in found.collect()] == ["a.mkv", "a.mp4", "b.mkv"]
    assert [tuple(r) for r in discovery.duplicate_stems(found).collect()] == [("a", 2)]
