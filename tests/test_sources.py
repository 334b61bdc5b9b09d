import json

import pytest
from pyspark.sql import functions as F

from tidecue.plans import commands, pipelines
from tidecue.sources import ass, discovery, recogniser, sinks, subtitles
from tidecue.streaming import cues as streaming

SRT = "1\n00:00:01,250 --> 00:00:03,500\nHello <i>there</i>\nSecond line\n\nbroken block\n\n00:00:05,000 --> 00:00:04,000\nreversed\n\n3\r\n00:00:06,000 --> 00:00:07,000 X1:0\r\n&lt;ok&gt;\r\n"
VTT = "WEBVTT\n\nNOTE a comment\n\nid\n00:01.000 --> 00:02.000 align:start\n<v Speaker>Ready<br>Go\n\n00:03.000 --> 00:04.000\nlost\nNOTE inside\n"


def files(spark, *contents):
    return spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(contents)], "track_id long, path string, content string")


def test_subtitle_parsers(spark):
    df = files(spark, ("a.srt", SRT), ("b.vtt", VTT), ("c", "﻿" + VTT.replace("﻿", "")), ("d.srt", ""))
    got = sorted((r.track_id, r.start_ms, r.end_ms, r.text, r.identifier) for r in subtitles.parse_subtitles(df, ["track_id"]).collect())
    assert got == [(0, 1250, 3500, "Hello there\nSecond line", "1"), (0, 6000, 7000, "<ok>", "3"), (1, 1000, 2000, "Ready\nGo", "id"), (2, 1000, 2000, "Ready\nGo", "id")]
    starts = subtitles.start_times(files(spark, ("a", SRT)), ["track_id"]).collect()
    assert [r.start_ms for r in starts] == [1250, 5000, 6000]
    with pytest.raises(Exception, match="no cue times"):
        subtitles.start_times(files(spark, ("a", "none")), ["track_id"]).collect()
    with pytest.raises(Exception, match="malformed time"):
        subtitles.parse_strict_srt(files(spark, ("a", "1\n00:00:01.000 --> 00:00:02,000\nx")), ["track_id"]).collect()


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "x.srt").write_text("﻿" + SRT, encoding="utf-8")
    (tmp_path / "y.vtt").write_text(VTT, encoding="utf-8")
    read = subtitles.read_files(spark, str(tmp_path))
    assert subtitles.parse_subtitles(read, ["track_id"]).count() == 3
    assert [r.stem for r in discovery.list_inputs(spark, str(tmp_path)).collect()] == ["x", "y"]
    stems = spark.createDataFrame([("a",), ("a",), ("b",)], "stem string")
    assert [tuple(r) for r in discovery.duplicate_stems(stems).collect()] == [("a", 2)]


ASS = "[Script Info]\nDialogue: 0,0:00:00.00,0:00:01.00,Default,,0,0,0,,before\n[Events]\nFormat: x\nDialogue: 0,0:00:01.00,0:00:02.50,Default,,0,0,0,,Hola, {\\i1}mundo\nDialogue: 0,bad\nDialogue: 0,0:00:02.00,0:00:03.00,Romaji,,0,0,0,,kana\nDialogue: 0,0:00:03.00,0:00:04.00,Default,,0,0,0,,ffffffffff"


def test_ass(spark):
    lines = ass.read_lines(files(spark, ("a.ass", ASS)), ["track_id"])
    got = {r.line_no: (r.in_events, r.raw) for r in lines.collect()}
    assert got[2] == (False, "before") and got[5] == (True, "Hola, {\\i1}mundo") and got[6] == (True, None) and len(got) == 8
    events = lines.where("in_events")
    assert [(r.start_ms, r.end_ms, r.text) for r in pipelines.tv_safe_cues(events, "track_id").collect()] == [(1000, 2500, "Hola, mundo")]
    assert ass.dialogue_line(lines.where("line_no = 5")).first().line == ASS.split("\n")[4]


def test_normalize_files(spark):
    text = ["Se que tu y yo", "El corazon canta fuerte otra vez", "El corazon canta fuerte otra vez", "fin?n"]
    body = "[Events]\n" + "\n".join(f"Dialogue: 0,0:00:0{i}.00,0:00:0{i + 1}.00,Default,,0,0,0,,{{\\b}}{t}" for i, t in enumerate(text))
    lines, cues, report = pipelines.normalize_files(ass.read_lines(files(spark, ("a", body)), ["track_id"]), "track_id")
    got = sorted((r.start_ms, r.end_ms, r.text) for r in cues.collect())
    assert got == [(0, 1000, "Sé que tú y yo"), (1000, 3000, "El corazón canta fuerte otra vez"), (3000, 4000, "fin?n")]
    assert tuple(report.select("visible", "skipped", "changed", "suspicious").first()) == (4, 0, 3, 2)
    assert lines.where("raw is not null").count() == 3


def test_recogniser(spark):
    doc = {"language": "en", "segments": [{"start": 0, "end": 3, "text": " Hola  hola equipo. "}, {"text": ""}, {"start": 4.0, "end": 4.0, "text": "x"}, {"text": "no times"}]}
    df = spark.createDataFrame([(1, "json", json.dumps(doc)), (1, "txt", "ignored"), (2, "json", '{"segments": []}'), (2, "srt", SRT), (3, "txt", " whole  text ")], "k long, kind string, content string")
    rows = recogniser.json_segments(df.where("kind = 'json'"), ["k"]).where("k = 1").orderBy("seg_no").collect()
    assert [(r.start_s, r.end_s, r.text, r.language) for r in rows] == [(0.0, 3.0, "Hola hola equipo.", "en"), (4.0, 4.01, "x", "en"), (0.0, 0.01, "no times", "en")]
    loaded = recogniser.load_segments(df, ["k"]).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in loaded} == {1: 3, 2: 2, 3: 1}
    lang = spark.createDataFrame([('{"language": " es "}',), ("bad",), (None,)], "c string")
    assert [r.x for r in lang.select(recogniser.detected_language(F.col("c")).alias("x")).collect()] == ["es", "", ""]
    listed = spark.createDataFrame([(1, "d/b.json"), (1, "d/a.json"), (2, "d/stem.json"), (2, "d/a.json"), (3, "d/x.txt")], "k long, path string")
    assert sorted(map(tuple, recogniser.backend_output(listed, ["k"], "stem", ".json").collect())) == [(1, "d/a.json"), (2, "d/stem.json")]
    arg = spark.createDataFrame([('["a"]',), ("WyJiIl0=",)], "c string").select(recogniser.json_argument(F.col("c"), "array<string>").alias("x"))
    assert [r.x for r in arg.collect()] == [["a"], ["b"]]


def test_transcript_pipeline(spark):
    seg = spark.createDataFrame([(1, 1, 0.0, 3.0, "Hola hola equipo."), (1, 2, 4.0, 7.0, "Este metodo mejora la trazabilidad del proceso."), (1, 3, 190.0, 195.0, "Gracias por ver."), (1, 4, 196.0, 201.0, "La decision de diseno prioriza resultados.")], "transcript_id long, seg_no int, start_s double, end_s double, text string")
    heads = spark.createDataFrame([(1, "es")], "transcript_id long, language string")
    paragraphs = pipelines.transcript_paragraphs(seg, heads)
    front = spark.createDataFrame([(1, "It's", "v.mkv", "whisper", "", None, "clean")], "transcript_id long, title string, source_video string, backend string, language string, audio_stream_index int, postprocess_mode string")
    content = pipelines.markdown_documents(paragraphs, front, "transcript_id", "T").first().content
    assert "title: 'It''s'" in content and "language: 'und'" in content
    assert "## 00:00:00 - 00:00:07\n\nHola equipo. Este" in content and "## 00:03:16 - 00:03:21" in content
    verbatim = pipelines.clean_segments(seg.withColumn("language", F.lit("es")).unionByName(seg.withColumn("language", F.lit("es"))), verbatim=True)
    assert verbatim.count() == 8


def test_sinks(spark):
    cues = spark.createDataFrame([(1, 2000, 3000, "b"), (1, 0, 1500, "a\nc"), (1, 0, 1500, "a\nc")], "track_id long, start_ms long, end_ms long, text string")
    assert sinks.srt_files(cues.dropDuplicates(), "track_id").first().content == "1\n00:00:00,000 --> 00:00:01,500\na\nc\n\n2\n00:00:02,000 --> 00:00:03,000\nb\n"
    assert sinks.tv_srt_files(cues, "track_id").first().content == "﻿1\n00:00:00,000 --> 00:00:01,500\na\nc\n\n2\n00:00:02,000 --> 00:00:03,000\nb\n"
    made = sinks.ass_files(cues, "track_id").first()
    assert made.n_cues == 2 and made.content.endswith("Dialogue: 0,0:00:00.00,0:00:01.50,Default,,0,0,0,,a\\Nc\nDialogue: 0,0:00:02.00,0:00:03.00,Default,,0,0,0,,b\n")
    assert json.loads(sinks.report_lines(cues.limit(1), "track_id").first().report).keys() == {"start_ms", "end_ms", "text"}


def test_commands(spark):
    row = spark.range(1).select(
        commands.native_mux_command(F.lit("v"), F.lit("s"), F.lit("o"), F.lit("spa"), F.lit("T"), F.array(F.lit(2), F.lit(4))).alias("native"),
        commands.copy_mux_command(F.lit("v"), F.lit("s"), F.lit("o"), F.lit("spa"), F.lit("T"), F.lit(1)).alias("copy"),
        commands.recogniser_command("whisper", F.lit("a.wav"), F.lit("out"), F.lit("es")).alias("run"),
        discovery.workspace(F.lit("in/My. .mkv")).alias("w"),
    ).first()
    assert row.native[:7] == ["mkvmerge", "--output", "o", "--default-track-flag", "2:no", "--default-track-flag", "4:no"] and row.native[-1] == "s"
    assert row.copy[-1] == "o" and "-disposition:s:0" in row.copy and "-metadata:s:s:1" in row.copy
    assert row.run[:2] == ["whisper", "a.wav"] and row.run[-2:] == ["--language", "es"]
    assert row.w.output_name == "My" and row.w.source_ass.endswith("subtitles/source/My. .source.ass")
    assert commands.choose_recogniser("auto", lambda n: n == "whisper") == "whisper"
    with pytest.raises(RuntimeError):
        commands.choose_recogniser("whisperx", lambda n: False)


def test_translation_map_listing(spark):
    df = spark.createDataFrame([(1, "a/translations_b.json"), (1, "a/translations_a.json"), (2, "a/translations_all.json"), (2, "a/translations_a.json"), (3, "a/x.json")], "k long, path string")
    got = sorted((r.k, r.file_no, r.path) for r in discovery.translation_maps(df, ["k"]).collect())
    assert got == [(1, 0, "a/translations_a.json"), (1, 1, "a/translations_b.json"), (2, 0, "a/translations_all.json")]


def test_streams(spark, tmp_path):
    rows = [(1, "w", 0, 1000, "Ã¡ <i>x</i>", "2026-01-01 10:00:00"), (1, "w", 0, 1000, "Ã¡ <i>x</i>", "2026-01-01 11:00:00"), (2, "w", 5, 1, "b", "2026-01-02 10:00:00"), (3, "w", 0, 9, "late", "2026-01-20 10:00:00")]
    df = spark.createDataFrame(rows, "cue_id long, workspace string, start_ms long, end_ms long, text string, t string").withColumn("ingested_at", F.col("t").cast("timestamp")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    stream = streaming.read_cues(spark, str(tmp_path / "in"), df.schema)
    cleaned = streaming.drain(streaming.clean(streaming.once(stream)), str(tmp_path / "c1"))
    assert sorted((r.cue_id, r.text) for r in cleaned.collect()) == [(1, "á x"), (2, "b"), (3, "late")]
    # the last day is still open
    counted = streaming.drain(streaming.arrivals(stream), str(tmp_path / "c2"))
    assert sorted((r.n_cues, r.shown_ms) for r in counted.collect()) == [(1, 0), (2, 2000)]
