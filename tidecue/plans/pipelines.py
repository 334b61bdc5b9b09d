"""Composite pipelines over many recordings at once (PL1-PL9, PL12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecue.functions import predicates, rules, text, timecode
from tidecue.functions.languages import with_container_language, with_profile
from tidecue.operators import folds, neighbors, tracks
from tidecue.session import cut
from tidecue.sources import ass, sinks


def is_spanish(label: Column) -> Column:
    return F.lower(F.coalesce(label, F.lit(""))).startswith("es")


def with_clean_text(df: DataFrame, column: str = "text", language: str = "language", verbatim: bool = False) -> DataFrame:
    """SC17: df with its text repaired, without noise, fillers and repetitions; empty where nothing is left. verbatim only repairs encoding.

    Each step is a column of its own, so no step's expression is copied into the next.
    """
    body, lang = F.col(column), F.col(language)
    if verbatim:
        return df.withColumn(column, text.squeeze(text.repair_encoding(body)))
    steps = df.withColumn("_fixed", text.repair_encoding(body, is_spanish(lang)))
    steps = steps.withColumn("_fixed", text.squeeze(F.when(is_spanish(lang), text.repair_phrases(F.col("_fixed"))).otherwise(F.col("_fixed"))))
    steps = steps.withColumn("_gone", predicates.is_noise(F.col("_fixed")) | predicates.is_filler_only(F.col("_fixed"), lang))
    steps = steps.withColumn("_worded", F.when(F.col("_gone"), F.lit("")).otherwise(text.drop_repeated_words(F.col("_fixed"))))
    return steps.withColumn(column, text.collapse_phrases(F.col("_worded"))).drop("_fixed", "_gone", "_worded")


def clean_segments(segments: DataFrame, entity: str = "transcript_id", order: list[str] | None = None, language: str = "language", verbatim: bool = False) -> DataFrame:
    """SC17, WN1: segments with their cleaned text, without empty ones and (unless verbatim) repeats of the one before."""
    cleaned = with_clean_text(segments.where(F.col("text").isNotNull()), "text", language, verbatim)
    # the row id keeps the optimiser from copying the whole chain below this filter
    cleaned = cleaned.withColumn("_row", F.monotonically_increasing_id()).where("text <> '' and _row >= 0").drop("_row")
    if verbatim:
        return cleaned
    # the range sort below reads its input twice, to sample and to shuffle
    cleaned = cut(cleaned)
    return neighbors.drop_repeats(cleaned, entity, order or ["start_s", "seg_no"])


def clean_report(segments: DataFrame, cleaned: DataFrame, entity: str = "transcript_id") -> DataFrame:
    """AG6: (entity, n_input, n_clean, n_removed)."""
    a = segments.groupBy(entity).agg(F.count(F.lit(1)).alias("n_input"))
    b = cleaned.groupBy(entity).agg(F.count(F.lit(1)).alias("n_clean"))
    both = a.join(b, entity, "left").na.fill(0, ["n_clean"])
    return both.withColumn("n_removed", F.col("n_input") - F.col("n_clean"))


def infer_spanish(segments: DataFrame, entity: str = "transcript_id", order: list[str] | None = None, first: int = 20, least: int = 4) -> DataFrame:
    """AG11, LI1: (entity, signs, is_spanish): how many signs of Spanish the first 20 segments hold."""
    # Spark keeps the first rows of each entity within every partition before it shuffles
    place = Window.partitionBy(entity).orderBy(*(order or ["start_s", "seg_no"]))
    ranked = segments.where(F.col(entity).isNotNull()).withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= first)
    fixed = text.repair_encoding(F.col("text"), F.lit(True))
    joined = ranked.groupBy(entity).agg(F.lower(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", fixed.alias("t")))), lambda x: x["t"]), " ")).alias("_t"))
    signs = sum((F.contains("_t", F.lit(s)).cast("int") for s in rules.SPANISH_SIGNS), F.lit(0))
    return joined.select(entity, signs.alias("signs"), (signs >= least).alias("is_spanish"))


def settled_language(label: Column, spanish: Column) -> Column:
    """The label, or es where the label is blank, English or unknown and the text looks Spanish."""
    unsure = F.lower(F.coalesce(label, F.lit(""))).isin("", *rules.UNSURE_LABELS)
    return F.when(unsure & F.coalesce(spanish, F.lit(False)), F.lit("es")).otherwise(label)


def transcript_paragraphs(segments: DataFrame, headers: DataFrame, entity: str = "transcript_id", most: int = folds.PARAGRAPH_CHARS, verbatim: bool = False) -> DataFrame:
    """PL7 up to FO4: cleaned segments of settled language joined to paragraphs.

    headers has (entity, language).
    """
    guessed = infer_spanish(segments.where("text is not null"), entity)
    settled = headers.join(guessed, entity, "left").select(entity, settled_language(F.col("language"), F.col("is_spanish")).alias("language"))
    labelled = segments.join(settled, entity, "left")
    cleaned = clean_segments(labelled, entity, verbatim=verbatim)
    timed = cleaned.where("start_s is not null").withColumn("end_s", F.coalesce("end_s", "start_s"))
    return folds.build_paragraphs(timed, entity, most=most)


def transcribe(segments: DataFrame, headers: DataFrame, generated_at: str, entity: str = "transcript_id", most: int = folds.PARAGRAPH_CHARS, verbatim: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """PL7 whole: (aligned paragraphs, Markdown documents, reports) of recordings.

    headers has (entity, title, source_video, backend, language,
    audio_stream_index). Language, cleaning, paragraphs, alignment, checks,
    Markdown and report follow one another as in the original. A paragraph
    without Latin letters or digits can't be aligned and is left out, as there.
    A report has the settled language, the counts of segments before and after
    cleaning, of paragraphs, and both kinds of warnings.
    """
    guessed = infer_spanish(segments.where("text is not null"), entity)
    settled = headers.join(guessed.select(entity, "is_spanish"), entity, "left").withColumn("language", settled_language(F.col("language"), F.col("is_spanish"))).drop("is_spanish")
    languages = settled.select(entity, "language")
    labelled = segments.join(languages, entity, "left")
    # paragraphs, alignment and report read the cleaned segments
    cleaned = cut(clean_segments(labelled, entity, verbatim=verbatim))
    timed = cleaned.where("start_s is not null").withColumn("end_s", F.coalesce("end_s", "start_s"))
    built = folds.build_paragraphs(timed, entity, most=most).select(entity, "para_no", "text")
    keyed = lambda df: with_clean_text(df.withColumn("key", F.col("text")), "key", "language", verbatim).withColumn("key", text.alignment_key(F.col("key")))
    # the range sort of the warnings reads its input twice, to sample and to shuffle
    aligned = cut(folds.align_paragraphs(keyed(built.join(languages, entity, "left")), keyed(timed), entity))
    checked = cut(neighbors.paragraph_warnings(aligned, entity, "para_no", "start_s", "end_s"))
    documents = sinks.markdown_files(checked, settled.withColumn("postprocess_mode", F.lit("verbatim" if verbatim else "clean")), entity, generated_at)
    counts = checked.groupBy(entity).agg(F.count(F.lit(1)).alias("n_paragraphs"), F.count_if("low").alias("n_low"), F.sum(F.size("warnings")).alias("n_warnings"))
    report = clean_report(segments, cleaned, entity).join(languages, entity, "left").join(counts, entity, "left").na.fill(0, ["n_paragraphs", "n_low", "n_warnings"])
    return checked, documents, report.withColumn("language", F.coalesce(F.nullif("language", F.lit("")), F.lit("und")))


def markdown_documents(paragraphs: DataFrame, headers: DataFrame, entity: str, generated_at: str) -> DataFrame:
    """PL7, SNK7: a Markdown document per recording."""
    return sinks.markdown_files(paragraphs, headers, entity, generated_at)


def tv_safe_cues(lines: DataFrame, key: str, spanish: bool = False) -> DataFrame:
    """PL1, PL2: distinct visible cues of ASS lines with a positive duration; with spanish their text is normalised first."""
    shown = lines.where("raw is not null").withColumn("text", text.strip_ass_text(F.col("raw")))
    if spanish:
        shown = shown.withColumn("text", text.normalize_spanish(F.col("text")))
    kept = shown.where(~predicates.is_skippable(F.col("style"), F.col("effect"), F.col("raw"), F.col("text")))
    timed = kept.withColumn("start_ms", timecode.ass_time_to_ms(F.col("start"))).withColumn("end_ms", timecode.ass_time_to_ms(F.col("end")))
    return sinks.distinct_cues(timed.where(predicates.has_positive_duration(F.col("start_ms"), F.col("end_ms"))), key)


def normalize_ass(lines: DataFrame) -> DataFrame:
    """PL3: ASS lines with normalised Spanish; `skipped` and `changed` tell what happened to each dialogue."""
    shown = text.strip_ass_text(F.col("raw"))
    skip = predicates.is_skippable(F.col("style"), F.col("effect"), F.col("raw"), shown)
    done = lines.withColumn("skipped", F.col("raw").isNotNull() & skip).withColumn("_n", text.normalize_ass_raw(F.coalesce("raw", F.lit(""))))
    change = F.col("raw").isNotNull() & ~F.col("skipped") & F.col("_n.changed")
    return done.withColumn("changed", change).withColumn("raw", F.when(change, F.col("_n.raw")).otherwise(F.col("raw"))).drop("_n")


def event_counts(lines: DataFrame, key: str) -> DataFrame:
    """AG5: (key, visible, skipped, changed) of normalised lines."""
    shown = lines.where("raw is not null")
    return shown.groupBy(key).agg(F.count_if(~F.col("skipped")).alias("visible"), F.count_if("skipped").alias("skipped"), F.count_if("changed").alias("changed"))


def normalize_files(lines: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """PL4: (lines, cues, report) of ASS files in Spanish.

    Order matters: spelling, then shared prefixes, then doubled cues, then
    repeated tails, then cues for television. The report counts events and the
    suspicious question marks of every dialogue and cue.
    """
    # both are read by several of the steps below
    spelt = cut(normalize_ass(lines))
    shown = spelt.where("raw is not null").withColumn("text", text.strip_ass_text(F.col("raw")))
    shown = shown.where(~predicates.is_skippable(F.col("style"), F.col("effect"), F.col("raw"), F.col("text")))
    moved = neighbors.redistribute_prefixes(shown.select(key, "line_no", "text"), key, "line_no").where("redistributed").select(key, "line_no", F.col("text").alias("_moved"))
    shown = shown.join(moved, [key, "line_no"], "left").withColumn("raw", F.when(F.col("_moved").isNotNull(), text.replace_keeping_tags(F.col("raw"), F.col("_moved"))).otherwise(F.col("raw"))).withColumn("text", F.coalesce("_moved", "text")).drop("_moved")
    timed = cut(shown.withColumn("start_ms", timecode.ass_time_to_ms(F.col("start"))).withColumn("end_ms", timecode.ass_time_to_ms(F.col("end"))))
    kept = neighbors.remove_adjacent_duplicates(timed.select(key, "line_no", "start_ms", "end_ms", "text"), key, ["line_no"])
    trimmed = neighbors.trim_repeated_fragments(kept, key, ["line_no"])
    fates = trimmed.select(key, "line_no", F.col("end_ms").alias("_end"), F.when(F.col("trimmed"), F.col("text")).alias("_cut"))
    visible = timed.join(fates, [key, "line_no"]).withColumn("end", F.when(F.col("_end") > F.col("end_ms"), timecode.ms_to_ass_time(F.col("_end"))).otherwise(F.col("end"))).withColumn("raw", F.when(F.col("_cut").isNotNull(), text.replace_keeping_tags(F.col("raw"), F.col("_cut"))).otherwise(F.col("raw")))
    rest = spelt.join(timed.select(key, "line_no"), [key, "line_no"], "left_anti")
    columns = [c for c in spelt.columns]
    final = rest.select(*columns).unionByName(visible.select(*columns))
    final = ass.dialogue_line(final).withColumn("line", F.when(F.col("raw").isNotNull(), F.col("line"))) if "line" not in columns else final
    cues = tv_safe_cues(final, key, spanish=True)
    suspects = final.where("raw is not null").select(key, F.size(text.suspicious_questions(F.col("raw"))).alias("n")).unionByName(cues.select(key, F.size(text.suspicious_questions(F.col("text"))).alias("n")))
    report = event_counts(spelt, key).join(suspects.groupBy(key).agg(F.sum("n").alias("suspicious")), key, "left")
    return final, cues, report


def subtitle_inventory(candidates: DataFrame, aliases: DataFrame, preferences: DataFrame, group: str = "workspace") -> DataFrame:
    """PL8: track candidates with profile code, flags, audio rank and score.

    candidates has (group, stream_index, track_id, codec_name, codec_id, title,
    language_raw, forced, is_default, event_count).
    """
    coded = with_profile(candidates, "language_raw", aliases, "source_language")
    flagged = (
        coded.withColumn("supported", F.col("source_language").isNotNull())
        .withColumn("textual", predicates.is_text_codec(F.col("codec_name"), F.col("codec_id")))
        .withColumn("forced_like", predicates.is_forced_track(F.col("title"), F.col("forced")))
        .withColumn("cc_like", predicates.is_caption_track(F.col("title")))
    )
    ranked = tracks.with_audio_rank(flagged, preferences, group)
    return ranked.withColumn("score", tracks.score_struct(F.col("supported"), F.col("textual"), F.col("forced_like"), F.col("cc_like"), F.col("event_count"), F.col("audio_rank"), F.coalesce("is_default", F.lit(False))))


def select_tracks(inventory: DataFrame, group: str = "workspace") -> DataFrame:
    """PL8, TK1: the chosen track of each group."""
    return tracks.best_track(inventory, group)


def audio_subtitles(cues: DataFrame, timed: DataFrame, headers: DataFrame, key: str = "track_id") -> tuple[DataFrame, DataFrame]:
    """PL6: (SRT contents, report) of readable cues: from timed words where there are any, else reflowed.

    An entity without any cue is missing from the contents; its report has
    n_cues 0.
    """
    flowed = folds.reflow_cues(cues, [key, "cue_no"]).select(key, "start_ms", "end_ms", "text")
    readable = folds.readable_cues(timed.select(key, "start_ms", "end_ms", "text"), flowed, key)
    counts = readable.groupBy(key).agg(F.count(F.lit(1)).alias("n_cues"))
    report = with_container_language(headers, "language").join(counts, key, "left").na.fill(0, ["n_cues"])
    return sinks.srt_files(readable, key), report


def check_timeline(source: DataFrame, embedded: DataFrame, group: str = "track_id") -> DataFrame:
    """PL9, J7: shift and greatest distance of starts paired by place; counts must be equal.

    source and embedded have (group, start_ms).
    """
    a = source.select(group, F.col("start_ms").alias("source_ms"))
    b = embedded.select(group, F.col("start_ms").alias("embedded_ms"))
    pairs = tracks.zip_by_ordinal(a, b, group, ["source_ms"], ["embedded_ms"], "full")
    equal = pairs.groupBy(group).agg((F.count_if(F.col("source_ms").isNull() | F.col("embedded_ms").isNull()) == 0).alias("same_count"))
    return tracks.timeline_shift(pairs, group).join(tracks.largest_delta(pairs, group), group).join(equal, group)


def export_synchronized(embedded: DataFrame, extracted: DataFrame, group: str = "track_id", title: str = "Converted text subtitles") -> tuple[DataFrame, DataFrame]:
    """PL9's export: (ASS contents, checks) of subtitles extracted from a container.

    embedded has (group, start_ms) of the track's packets, extracted the cues
    (group, start_ms, end_ms, text). The check says whether both have the same
    number, the greatest distance of starts, and whether every cue became a
    dialogue. The margins are those of the export.
    """
    files = sinks.ass_files(extracted, group, title, margins=(192, 192, 48))
    timing = check_timeline(embedded, extracted.select(group, "start_ms"), group)
    checks = timing.join(files.select(group, "n_cues").withColumnRenamed("n_cues", "n_dialogues"), group, "left")
    passed = F.col("same_count") & F.col("within") & (F.col("n_dialogues") == F.col("n_cues"))
    return files, checks.select(group, "n_cues", "n_dialogues", "delta", F.coalesce(passed, F.lit(False)).alias("passed"))


def check_final_tracks(streams: DataFrame, group: str, language: str = "spa", title: str = "Español") -> DataFrame:
    """PL12: (group, first_language, first_title, one_default, first_default): whether the first subtitle is as it should be."""
    first = streams.groupBy(group).agg(F.min_by(F.struct("language", "title", "is_default"), "stream_index").alias("f"), F.count_if("is_default").alias("n"))
    return first.select(group, F.coalesce(F.col("f.language") == language, F.lit(False)).alias("first_language"), F.coalesce(F.col("f.title") == title, F.lit(False)).alias("first_title"), (F.col("n") == 1).alias("one_default"), F.coalesce("f.is_default", F.lit(False)).alias("first_default"))
