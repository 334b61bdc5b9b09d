"""ASS lines and dialogues (SRC7, SRC8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecue.functions import predicates, text, timecode

FIELDS = ("layer", "start", "end", "style", "name", "ml", "mr", "mv", "effect", "raw")


def with_dialogue(df: DataFrame, line: str = "line") -> DataFrame:
    """SRC7: df with the ten dialogue fields, all null where the line isn't a dialogue."""
    parts = F.split(F.substr(F.col(line), F.lit(11)), ",", 10)
    good = F.startswith(line, F.lit("Dialogue: ")) & (F.size(parts) == 10)
    return df.withColumn("_f", F.when(good, parts)).select(*df.columns, *[F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(FIELDS)])


def read_lines(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """SRC8: (keys, line_no, line, in_events, fields) of ASS texts; lines count from 1.

    A line is in the events section if a `[Events]` line stands before it in
    its file; the first such line is found within the file's row, so no window
    is needed.
    """
    lines = df.select(*keys, F.split(F.regexp_replace(F.col(content), "\r\n|\r", "\n"), "\n").alias("_l"))
    # found before the lines are unfolded, else it would be sought for each of them
    begun = lines.withColumn("_b", F.array_position(F.transform("_l", text.strip), "[Events]"))
    rows = begun.select(*keys, "_b", F.posexplode("_l").alias("_i", "line"))
    placed = rows.select(*keys, (F.col("_i") + 1).alias("line_no"), "line", ((F.col("_b") > 0) & (F.col("_i") + 1 > F.col("_b"))).alias("in_events"))
    return with_dialogue(placed)


def dialogue_line(df: DataFrame) -> DataFrame:
    """df with `line` written from its dialogue fields."""
    return df.withColumn("line", F.concat(F.lit("Dialogue: "), F.concat_ws(",", *[F.coalesce(F.col(n), F.lit("")) for n in FIELDS])))


def visible_events(lines: DataFrame) -> DataFrame:
    """Dialogues with `text`, `start_ms`, `end_ms` and `skippable`."""
    shown = lines.where("raw is not null").withColumn("text", text.strip_ass_text(F.col("raw")))
    return shown.withColumn("skippable", predicates.is_skippable(F.col("style"), F.col("effect"), F.col("raw"), F.col("text"))).withColumn("start_ms", timecode.ass_time_to_ms(F.col("start"))).withColumn("end_ms", timecode.ass_time_to_ms(F.col("end")))
