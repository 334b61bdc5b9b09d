"""Recogniser output: JSON, subtitles or plain text to segments (SRC9-SRC15, SRC23)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecue.functions import text
from tidecue.sources.subtitles import parse_srt, parse_vtt

WORD = "struct<word:string,start:double,end:double>"
DOCUMENT_DDL = f"language string, segments array<struct<start:double,end:double,text:string,words:array<{WORD}>>>"


def json_segments(df: DataFrame, keys: list[str], content: str = "content", strict: bool = True) -> DataFrame:
    """SRC9: (keys, seg_no, language, start_s, end_s, text, words): segments with a text.

    start defaults to 0, end to start, and an end that isn't after the start
    becomes start + 0.01. With strict a text that isn't JSON is an error.
    """
    parsed = F.from_json(F.col(content), DOCUMENT_DDL, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    rows = df.select(*keys, parsed.alias("_d")).select(*keys, text.strip(F.coalesce("_d.language", F.lit(""))).alias("language"), F.posexplode("_d.segments").alias("_i", "_s"))
    start = F.coalesce("_s.start", F.lit(0.0))
    end = F.coalesce("_s.end", start)
    named = rows.select(*keys, (F.col("_i") + 1).alias("seg_no"), "language", start.alias("start_s"), F.when(end <= start, start + 0.01).otherwise(end).alias("end_s"), text.squeeze(F.col("_s.text")).alias("text"), F.col("_s.words").alias("words"))
    return named.where("text <> ''")


def subtitle_segments(df: DataFrame, keys: list[str], kind: str, content: str = "content") -> DataFrame:
    """SRC10: cues as segments in seconds."""
    cues = (parse_srt if kind == "srt" else parse_vtt)(df, keys, content).where("end_ms > start_ms")
    return cues.select(*keys, (F.col("block_no") + 1).alias("seg_no"), F.lit("").alias("language"), (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"), "text")


def text_segments(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """SRC11: a whole text as one segment at 0."""
    return df.select(*keys, F.lit(1).alias("seg_no"), F.lit("").alias("language"), F.lit(0.0).alias("start_s"), F.lit(0.0).alias("end_s"), text.squeeze(F.col(content)).alias("text")).where("text <> ''")


def load_segments(files: DataFrame, keys: list[str], requested: str = "") -> DataFrame:
    """SRC12: segments of each recording from its first source that has any: JSON, SRT, WebVTT, text.

    files has (keys, kind, content) with kind json, srt, vtt or txt. The least
    priority per recording is an aggregate with map-side combine, joined back.
    """
    # the test is repeated inside, as filters may run in any order and JSON errors must not come from other files
    of = lambda kind: files.where(F.col("kind") == kind).withColumn("content", F.when(F.col("kind") == kind, F.col("content")))
    parts = [json_segments(of("json"), keys).drop("words"), subtitle_segments(of("srt"), keys, "srt"), subtitle_segments(of("vtt"), keys, "vtt"), text_segments(of("txt"), keys)]
    ranked = reduce(lambda a, b: a.unionByName(b), [p.withColumn("priority", F.lit(i)) for i, p in enumerate(parts)])
    best = ranked.groupBy(*keys).agg(F.min("priority").alias("priority"))
    out = ranked.join(best, [*keys, "priority"])
    return out.withColumn("language", F.when(F.lit(requested) != "", F.lit(requested)).otherwise(F.col("language"))).drop("priority")


def detected_language(content: Column, requested: str = "") -> Column:
    """SRC15: the requested language, else that of the JSON, else empty, also for bad JSON."""
    found = text.strip(F.coalesce(F.get_json_object(content, "$.language"), F.lit("")))
    return F.coalesce(F.nullif(F.lit(requested), F.lit("")), found, F.lit(""))


def backend_output(files: DataFrame, keys: list[str], stem: str, suffix: str, path: str = "path") -> DataFrame:
    """SRC14: (keys, path): of each recording's files `stem`+suffix, else the bare suffix, else the first by name with the suffix."""
    name = F.substring_index(path, "/", -1)
    rank = F.when(name == F.concat(F.lit(stem), F.lit(suffix)), 0).when(name == F.lit(suffix), 1).when(F.endswith(name, F.lit(suffix)), 2)
    return files.withColumn("_r", rank).where("_r is not null").groupBy(*keys).agg(F.min_by(path, F.struct("_r", path)).alias(path))


def json_argument(c: Column, ddl: str) -> Column:
    """SRC23: JSON text, or its base64 form, to a typed value."""
    direct = F.from_json(c, ddl, {"mode": "PERMISSIVE"})
    looks = text.strip(c).rlike(r"^[\[{]")
    return F.when(looks, direct).otherwise(F.from_json(F.try_to_binary(c, F.lit("base64")).cast("string"), ddl))
