"""Translation maps and glossaries over ASS lines (PL5, SRC16-SRC18, J1, J9, J12, SE3, SE4, AG9, SNK12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecue.functions import predicates, text
from tidecue.operators.scan import number_rows

SONG_LAYER, SONG_MARGIN = 99, 30


def merge_maps(maps: DataFrame, group: str = "track_id") -> DataFrame:
    """SE4, SRC16: (group, key, value): of maps with (group, file_no, entries map<string,string>) the last file's value of each key.

    Null and blank values are skipped, so an earlier value stays.
    """
    flat = maps.select(group, "file_no", F.explode("entries").alias("key", "value")).withColumn("value", text.strip(F.col("value"))).where("value is not null and value <> ''")
    return flat.groupBy(group, "key").agg(F.max_by("value", "file_no").alias("value"))


def event_entries(merged: DataFrame, group: str = "track_id") -> DataFrame:
    """Entries whose key is a line number: (group, line_no, translation)."""
    return merged.where(F.col("key").rlike("^[0-9]+$")).select(group, F.col("key").cast("int").alias("line_no"), F.col("value").alias("translation"))


def song_entries(merged: DataFrame, group: str = "track_id") -> DataFrame:
    """Entries whose key is style|start|end: (group, style, start, end, translation)."""
    parts = F.split("key", r"\|", 3)
    return merged.where(F.contains("key", F.lit("|")) & ~F.col("key").rlike("^[0-9]+$")).select(group, parts[0].alias("style"), parts[1].alias("start"), F.get(parts, F.lit(2)).alias("end"), F.col("value").alias("translation"))


def apply_translations(lines: DataFrame, events: DataFrame, group: str = "track_id", blank_song_letters: bool = False, terms: list[tuple[str, str]] | None = None) -> DataFrame:
    """J1: ASS lines (group, line_no, in_events, style, effect, raw) with their translations, tags kept.

    Lines without one stay; letter-by-letter English songs are blanked on
    request. `outcome` tells translated, blanked and kept lines apart.
    """
    wanted = events.withColumn("translation", text.apply_terms(F.col("translation"), terms or []))
    joined = lines.join(wanted, [group, "line_no"], "left")
    translated = F.col("in_events") & F.col("translation").isNotNull()
    blank = F.lit(blank_song_letters) & F.col("in_events") & predicates.is_song_style(F.col("style")) & F.col("effect").isin("fx", "karaoke")
    raw = F.when(translated, text.replace_keeping_tags(F.col("raw"), F.col("translation"))).when(blank, text.leading_tags(F.col("raw"))).otherwise(F.col("raw"))
    outcome = F.when(translated, F.lit("translated")).when(blank, F.lit("blanked")).otherwise(F.lit("kept"))
    return joined.withColumn("outcome", outcome).withColumn("raw", raw).drop("translation")


def song_lines(songs: DataFrame, group: str = "track_id") -> DataFrame:
    """SE3, SO2: a dialogue for every song entry on the top layer, in order of the start's text."""
    return songs.select(group, F.lit(SONG_LAYER).cast("string").alias("layer"), "start", "end", "style", F.lit("").alias("name"), F.lit("0").alias("ml"), F.lit("0").alias("mr"), F.lit(str(SONG_MARGIN)).alias("mv"), F.lit("").alias("effect"), F.col("translation").alias("raw"))


def translated_files(lines: DataFrame, maps: DataFrame, group: str = "track_id", terms: list[tuple[str, str]] | None = None, blank_song_letters: bool = False) -> tuple[DataFrame, DataFrame]:
    """PL5 whole: (lines, report) of ASS files with their translation maps applied.

    Maps are merged, terms put into their values, line entries replace texts
    behind their tags, letter-by-letter songs are blanked on request, and every
    song entry is appended as a line of its own after the file's last one, in
    order of the start's text, then the key. The report counts per file what
    was translated, blanked and appended.
    """
    merged = merge_maps(maps, group)
    done = apply_translations(lines, event_entries(merged, group), group, blank_song_letters, terms)
    songs = song_entries(merged, group).withColumn("translation", text.apply_terms(F.col("translation"), terms or []))
    last = lines.groupBy(group).agg(F.max("line_no").alias("_last"))
    # songs of a file are numbered by a range sort: one file may hold any share of them
    numbered = number_rows(song_lines(songs, group), group, ["start", "style", "end"], "_n").join(last, group)
    appended = numbered.withColumn("line_no", (F.col("_last") + F.col("_n")).cast("int")).withColumn("in_events", F.lit(True)).withColumn("outcome", F.lit("appended"))
    columns = [group, "line_no", "in_events", "layer", "start", "end", "style", "name", "ml", "mr", "mv", "effect", "raw", "outcome"]
    out = done.select(*columns).unionByName(appended.select(*columns))
    tally = lambda outcome: F.count_if(F.col("outcome") == outcome).alias(outcome)
    return out, out.groupBy(group).agg(*map(tally, ("translated", "blanked", "appended")))


def song_groups(lines: DataFrame, group: str = "track_id") -> DataFrame:
    """AG9: (group, key, text): letters of English song effects joined by their place from left to right.

    Letters of equal place keep their line order. One group is one sung line.
    """
    letters = lines.where((F.col("layer") == "2") & (F.col("effect") == "fx") & predicates.is_song_style(F.col("style")))
    shown = F.regexp_replace("raw", r"\{[^{}]*\}", "")
    one = letters.select(group, F.concat_ws("|", "style", "start", "end").alias("key"), F.struct(text.position_x(F.col("raw")).alias("x"), F.col("line_no"), F.when(shown == "", F.lit(" ")).otherwise(shown).alias("ch")).alias("l"))
    joined = one.groupBy(group, "key").agg(text.squeeze(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda l: l["ch"]), "")).alias("text"))  # noqa: E741
    return joined.where("text <> ''")


def sanitize_maps(merged: DataFrame, group: str = "track_id") -> tuple[DataFrame, DataFrame]:
    """SNK12, AG10, LI2: repaired entries, and per group their counts with the first 25 changes and the suspicious ones."""
    done = merged.withColumn("repaired", text.normalize_spanish(F.col("value"))).withColumn("changed", F.col("repaired") != F.col("value")).withColumn("suspicious", F.size(text.suspicious_questions(F.col("repaired"))) > 0)
    sample = lambda c: F.slice(F.sort_array(F.collect_list(F.when(F.col(c), F.struct("key", F.col("value").alias("before"), F.col("repaired").alias("after"))))), 1, 25)
    report = done.groupBy(group).agg(F.count(F.lit(1)).alias("entries"), F.count_if("changed").alias("changed"), F.count_if("suspicious").alias("suspicious"), sample("changed").alias("samples"))
    return done.select(group, "key", F.col("repaired").alias("value")), report
