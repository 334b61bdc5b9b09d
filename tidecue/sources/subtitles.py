"""Subtitle files to cues: SRT and WebVTT (SRC1-SRC6, SRC19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecue.functions import text, timecode

SP = text.SP
TIMING = rf"^((?:\d{{1,2}}:)?\d{{1,2}}:\d{{2}}[.,]\d{{3}}){SP}+-->{SP}+((?:\d{{1,2}}:)?\d{{1,2}}:\d{{2}}[.,]\d{{3}})(?:{SP}+.*)?$"


def read_files(spark: SparkSession, path: str, track: str = "track_id") -> DataFrame:
    """(track, path, content): one row per text file, its path as the track, without byte order mark."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("content"))
    return raw.select(F.col("path").alias(track), "path", "content")


def format_of(path: Column, content: Column, explicit: str = "auto") -> Column:
    """SRC1: the explicit format, else by suffix, else vtt if WEBVTT leads the first 512 characters, else srt."""
    if explicit != "auto":
        return F.lit(explicit.lower())
    p = F.lower(path)
    sniffed = text.strip(F.substring(content, 1, 512)).startswith("WEBVTT")
    return F.when(p.endswith(".srt"), F.lit("srt")).when(p.rlike(r"\.(vtt|webvtt)$"), F.lit("vtt")).when(sniffed, F.lit("vtt")).otherwise(F.lit("srt"))


def _newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n|\r", "\n")


def _cues(blocks: DataFrame, keys: list[str], entities: bool = True) -> DataFrame:
    """Blocks (keys, block_no, lines array) to cues; a block without timing on its first or second line gives none."""
    lines = F.col("lines")
    first = F.get(lines, F.lit(0))
    named = ~F.contains(first, F.lit("-->")) & (F.size(lines) > 1)
    at = F.when(named, 1).otherwise(0)
    timing = text.strip(F.get(lines, at))
    body = F.array_join(F.slice(lines, at + 2, F.greatest(F.size(lines) - at - 1, F.lit(0))), "\n")
    parsed = blocks.select(*keys, "block_no", timing.alias("_t"), F.when(named, text.strip(first)).otherwise(F.lit("")).alias("identifier"), text.strip_markup(body, entities).alias("text")).where(F.col("_t").rlike(TIMING) & (F.col("text") != ""))
    return parsed.select(
        *keys, "block_no", timecode.parse_timestamp(F.regexp_extract("_t", TIMING, 1)).alias("start_ms"), timecode.parse_timestamp(F.regexp_extract("_t", TIMING, 2)).alias("end_ms"), "text", "identifier"
    )


def parse_srt(df: DataFrame, keys: list[str], content: str = "content", entities: bool = True) -> DataFrame:
    """SRC2: (keys, block_no, start_ms, end_ms, text, identifier) of SRT texts; blocks are parted by blank lines."""
    blocks = F.split(text.strip(_newlines(F.col(content))), f"\n{SP}*\n")
    rows = df.select(*keys, F.posexplode(blocks).alias("block_no", "_b"))
    return _cues(rows.select(*keys, "block_no", F.filter(F.split("_b", "\n"), lambda x: text.strip(x) != "").alias("lines")).where("size(lines) > 0"), keys, entities)


def parse_vtt(df: DataFrame, keys: list[str], content: str = "content", entities: bool = True) -> DataFrame:
    """SRC3, SRC4: the same of WebVTT texts; a block with a NOTE, STYLE or REGION line gives no cue of what came before it."""
    t = F.regexp_replace(_newlines(F.col(content)), "^﻿?WEBVTT[^\n]*\n?", "")
    blocks = F.split(t, f"\n{SP}*\n|^{SP}*\n")
    rows = df.select(*keys, F.posexplode(blocks).alias("block_no", "_b"))
    lines = rows.select(*keys, "block_no", F.filter(F.split("_b", "\n"), lambda x: text.strip(x) != "").alias("lines")).where("size(lines) > 0")
    # such a line resets the block, and what follows begins with it, so nothing of the block remains
    return _cues(lines.where(~F.exists("lines", lambda x: text.strip(x).rlike("^(NOTE|STYLE|REGION)"))), keys, entities)


def parse_subtitles(df: DataFrame, keys: list[str], path: str = "path", content: str = "content", explicit: str = "auto", entities: bool = True) -> DataFrame:
    """SRC5: cues of SRT and WebVTT texts by their detected format, with a positive duration."""
    bare = df.withColumn(content, F.regexp_replace(F.col(content), "^\ufeff", ""))
    marked = bare.withColumn("_format", format_of(F.col(path), F.col(content), explicit))
    both = parse_srt(marked.where("_format = 'srt'"), keys, content, entities).unionByName(parse_vtt(marked.where("_format = 'vtt'"), keys, content, entities))
    return both.where("end_ms > start_ms")


def parse_strict_srt(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """SRC6: SRT blocks of three lines or more with timing on the second; times with a comma only; text as it stands.

    A malformed time is an error, as the file can't be trusted.
    """
    blocks = F.split(text.strip(_newlines(F.col(content))), f"\n{SP}*\n")
    rows = df.select(*keys, F.posexplode(blocks).alias("block_no", "_b")).select(*keys, "block_no", F.filter(F.split("_b", "\n"), lambda x: text.strip(x) != "").alias("lines"))
    timed = rows.where((F.size("lines") >= 3) & F.contains(F.get("lines", F.lit(1)), F.lit("-->")))
    time = lambda i: timecode.parse_srt_timestamp(text.strip(F.get(F.split(F.get("lines", F.lit(1)), "-->"), F.lit(i))))
    checked = lambda c: F.coalesce(c, F.raise_error(F.concat(F.lit("malformed time: "), F.get("lines", F.lit(1)))).cast("bigint"))
    return timed.select(*keys, "block_no", checked(time(0)).alias("start_ms"), checked(time(1)).alias("end_ms"), F.array_join(F.slice("lines", 3, F.greatest(F.size("lines") - 2, F.lit(0))), "\n").alias("text"))


def start_times(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """SRC19: (keys, cue_no, start_ms) of every timing in an SRT text; an error if there is none."""
    found = F.regexp_extract_all(F.col(content), F.lit(r"(\d{1,3}:\d{2}:\d{2}[,.]\d{3})\s*-->"), 1)
    held = F.when(F.size(found) > 0, found).otherwise(F.raise_error(F.lit("no cue times found")).cast("array<string>"))
    return df.select(*keys, F.posexplode(held).alias("_n", "_t")).select(*keys, (F.col("_n") + 1).alias("cue_no"), timecode.parse_timestamp(F.col("_t")).alias("start_ms"))
