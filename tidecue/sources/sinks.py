"""Cues, segments and paragraphs to file contents (SNK1-SNK8, SNK10, SNK13).

Each builder gives one row per file: (key, content). The lines of one file are
its natural bound: a file is a single value by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecue.functions import text, timecode

# Fixed value: the file header that players expect.
ASS_HEADER = """[Script Info]
Title: {title}
ScriptType: v4.00+
WrapStyle: 0
ScaledBorderAndShadow: yes
YCbCr Matrix: TV.709
PlayResX: {width}
PlayResY: {height}

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Default,{font},{size},&H00FFFFFF,&H000000FF,&H00000000,&H99000000,0,0,0,0,100,100,0,0,1,2,0,2,{margin_l},{margin_r},{margin_v},1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""


def _ordered(df: DataFrame, key: str, order: list[Column], body: Column) -> DataFrame:
    """(key, lines): body of each row, ordered."""
    packed = F.sort_array(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], body.alias("body"))))
    return df.groupBy(key).agg(F.transform(packed, lambda x: x["body"]).alias("lines"))


def distinct_cues(cues: DataFrame, key: str) -> DataFrame:
    """SE1: one row per (key, start, end, text)."""
    return cues.select(key, "start_ms", "end_ms", "text").dropDuplicates()


def ass_files(cues: DataFrame, key: str, title: str = "Converted text subtitles", width: int = 1920, height: int = 1080, font: str = "Arial", size: int = 54, margins: tuple[int, int, int] = (80, 80, 48)) -> DataFrame:
    """SNK1, SNK13, SO1: ASS contents and the number of cues, ordered by start, end and text without repeats."""
    line = F.concat(F.lit("Dialogue: 0,"), timecode.ms_to_ass_time(F.col("start_ms")), F.lit(","), timecode.ms_to_ass_time(F.col("end_ms")), F.lit(",Default,,0,0,0,,"), text.escape_ass_text(F.col("text")))
    head = ASS_HEADER.format(title=title, width=width, height=height, font=font, size=size, margin_l=margins[0], margin_r=margins[1], margin_v=margins[2])
    files = _ordered(distinct_cues(cues, key), key, [F.col("start_ms"), F.col("end_ms"), F.col("text")], line)
    return files.select(key, F.size("lines").alias("n_cues"), F.concat(F.lit(head), F.array_join("lines", "\n"), F.lit("\n")).alias("content"))


def _numbered(lines: Column) -> Column:
    return F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x))


def srt_files(cues: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """SNK2, SNK3: numbered blocks parted by a blank line, with a final line end."""
    block = F.concat(timecode.ms_to_srt_time(F.col("start_ms")), F.lit(" --> "), timecode.ms_to_srt_time(F.col("end_ms")), F.lit("\n"), F.col("text"))
    files = _ordered(cues, key, [F.col(c) for c in order or ["start_ms", "end_ms", "text"]], block)
    return files.select(key, F.concat(F.array_join(_numbered(F.col("lines")), "\n\n"), F.lit("\n")).alias("content"))


def tv_srt_files(cues: DataFrame, key: str) -> DataFrame:
    """SNK4: as the television form has it: byte order mark, cues without repeats, no final line end."""
    block = F.concat(timecode.ms_to_srt_time(F.col("start_ms")), F.lit(" --> "), timecode.ms_to_srt_time(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n"))
    files = _ordered(distinct_cues(cues, key), key, [F.col("start_ms"), F.col("end_ms"), F.col("text")], block)
    return files.select(key, F.concat(F.lit("﻿"), F.array_join(_numbered(F.col("lines")), "\n")).alias("content"))


def vtt_files(cues: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """SNK5: WebVTT without identifiers."""
    block = F.concat(timecode.ms_to_srt_time(F.col("start_ms"), "."), F.lit(" --> "), timecode.ms_to_srt_time(F.col("end_ms"), "."), F.lit("\n"), F.col("text"))
    files = _ordered(cues, key, [F.col(c) for c in order or ["start_ms", "end_ms", "text"]], block)
    return files.select(key, F.concat(F.lit("WEBVTT\n\n"), F.array_join("lines", "\n\n"), F.lit("\n")).alias("content"))


def txt_files(segments: DataFrame, key: str, order: list[str]) -> DataFrame:
    """SNK6: one segment per line."""
    return _ordered(segments, key, [F.col(c) for c in order], F.col("text")).select(key, F.concat(F.array_join("lines", "\n"), F.lit("\n")).alias("content"))


def seconds_as_cues(segments: DataFrame, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Segments in seconds as cues in ms, half to even, never below 0."""
    return segments.withColumn("start_ms", timecode.seconds_to_ms(F.col(start))).withColumn("end_ms", timecode.seconds_to_ms(F.col(end)))


def markdown_files(paragraphs: DataFrame, headers: DataFrame, key: str, generated_at: str) -> DataFrame:
    """SNK7: Markdown with front matter, title and a time heading per paragraph.

    headers has (key, title, source_video, backend, language, audio_stream_index,
    postprocess_mode). generated_at is given, so a run can be repeated.
    """
    part = F.concat(F.lit("## "), timecode.format_time(F.col("start_s")), F.lit(" - "), timecode.format_time(F.col("end_s")), F.lit("\n\n"), F.col("text"))
    bodies = _ordered(paragraphs, key, [F.col("para_no")], part)
    q = lambda c: text.quote_single(F.coalesce(F.col(c).cast("string"), F.lit("")))
    front = F.concat(
        F.lit("---\ntitle: "), q("title"), F.lit("\nsource_video: "), q("source_video"), F.lit("\nbackend: "), q("backend"),
        F.lit("\nlanguage: "), text.quote_single(F.coalesce(F.nullif("language", F.lit("")), F.lit("und"))), F.lit("\naudio_stream_index: "), F.coalesce(F.col("audio_stream_index").cast("string"), F.lit("")),
        F.lit("\npostprocess_mode: "), q("postprocess_mode"), F.lit("\ngenerated_at: "), text.quote_single(F.lit(generated_at)), F.lit("\n---\n\n# "), F.coalesce(F.col("title"), F.lit("")), F.lit("\n"),
    )
    joined = headers.join(bodies, key, "left")
    return joined.select(key, F.concat(front, F.coalesce(F.concat(F.lit("\n"), F.array_join("lines", "\n\n"), F.lit("\n")), F.lit(""))).alias("content"))


def report_lines(df: DataFrame, key: str) -> DataFrame:
    """SNK10: (key, report): each row as a JSON document, null fields kept."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"}).alias("report"))


def write_contents(files: DataFrame, path: str, key: str, public: bool = True) -> None:
    """SNK8, SNK11: contents written under path/public or path/debug, partitioned by a bucket of the key.

    Spark's committer makes the new files visible at once; a path that is being
    read must not be overwritten in the same job.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(64))
    files.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{'public' if public else 'debug'}")
