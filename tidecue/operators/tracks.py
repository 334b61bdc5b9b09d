"""Track selection, stream counts and timeline checks (TK, J5-J8, AG1-AG8, AG12, AG14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecue.operators.scan import number_rows


def score_struct(supported: Column, textual: Column, forced: Column, cc: Column, events: Column, audio_rank: Column, default: Column) -> Column:
    """The seven-part score of a subtitle track; structs compare field by field."""
    i = lambda c: c.cast("int")
    return F.struct(
        i(F.when(supported, 0).otherwise(-100_000)).alias("s_supported"),
        i(F.when(textual, 0).otherwise(-100_000)).alias("s_textual"),
        i(F.when(forced, 0).otherwise(10_000)).alias("s_not_forced"),
        i(F.when(cc, 0).otherwise(1_000)).alias("s_not_cc"),
        i(events).alias("s_events"),
        i(F.when(audio_rank == 99, 0).otherwise(500 - audio_rank)).alias("s_audio"),
        i(F.when(default, 100).otherwise(0)).alias("s_default"),
    )


def with_audio_rank(tracks: DataFrame, preferences: DataFrame, group: str = "workspace", language: str = "source_language") -> DataFrame:
    """J5: tracks with `audio_rank`, the place of their language in the group's audio preferences, else 99."""
    ranks = preferences.select(F.col(group), F.col("code").alias(language), F.col("rank").cast("int").alias("_rank"))
    return tracks.join(ranks, [group, language], "left").withColumn("audio_rank", F.coalesce("_rank", F.lit(99))).drop("_rank")


def audio_preferences(audio: DataFrame, group: str = "workspace") -> DataFrame:
    """AG14: (group, code, rank): languages of a group's default audio tracks, or of all if none is default, in order.

    audio has (group, ordinal, code, is_default); rows without a code count for
    the choice of tracks but give no language.
    """
    any_default = audio.groupBy(group).agg(F.max(F.coalesce("is_default", F.lit(False))).alias("_any"))
    chosen = audio.join(any_default, group).where(~F.col("_any") | F.coalesce("is_default", F.lit(False))).where(F.coalesce("code", F.lit("")) != "")
    first = chosen.groupBy(group, "code").agg(F.min("ordinal").alias("_first"))
    return number_rows(first, group, ["_first", "code"], "_n").select(group, "code", (F.col("_n") - 1).cast("int").alias("rank"))


def best_track(tracks: DataFrame, group: str = "workspace") -> DataFrame:
    """TK1: the best supported text track of each group.

    Defaults come before others, then tracks that aren't forced, then such not
    for the hard of hearing, then the score; of equals the first by stream
    index, then id. An aggregate with map-side combine, so groups aren't sorted.
    """
    rank = F.struct("is_default", ~F.col("forced_like"), ~F.col("cc_like"), "score", -F.col("stream_index"), -F.col("track_id"))
    return tracks.where("supported and textual").groupBy(group).agg(F.max_by(F.struct(*[c for c in tracks.columns if c != group]), rank).alias("_t")).select(group, "_t.*")


def find_stream(streams: DataFrame, group: str, index: int | None = None) -> DataFrame:
    """TK2: the stream of that index in each group, or each group's first."""
    if index is not None:
        return streams.where(F.col("stream_index") == index)
    return streams.groupBy(group).agg(F.min_by(F.struct(*[c for c in streams.columns if c != group]), "stream_index").alias("_s")).select(group, "_s.*")


def choose_audio(streams: DataFrame, group: str, requested: int | None = None) -> DataFrame:
    """TK3: the requested audio stream, else the first default one, else the first."""
    rank = F.struct((F.col("stream_index") == requested).cast("int") if requested is not None else F.lit(0), F.coalesce("is_default", F.lit(False)).cast("int"), -F.col("stream_index"))
    return streams.groupBy(group).agg(F.max_by("stream_index", rank).alias("stream_index"))


def zip_by_ordinal(left: DataFrame, right: DataFrame, group: str, order_left: list[str], order_right: list[str], how: str = "left") -> DataFrame:
    """J6, J7: rows of two tables paired by their place within each group."""
    a = number_rows(left, group, order_left, "ordinal")
    b = number_rows(right, group, order_right, "ordinal")
    return a.join(b, [group, "ordinal"], how)


def stream_counts(streams: DataFrame, group: str, kind: str = "codec_type") -> DataFrame:
    """AG1: streams of each kind in each group."""
    return streams.groupBy(group, kind).agg(F.count(F.lit(1)).alias("n_streams"))


def check_stream_counts(source: DataFrame, output: DataFrame, group: str, kind: str = "codec_type", added: str = "subtitle") -> DataFrame:
    """AG2: (group, kind, n_source, n_output, kept): whether the output has the source's streams and one more of `added`."""
    a = stream_counts(source, group, kind).withColumnRenamed("n_streams", "n_source")
    b = stream_counts(output, group, kind).withColumnRenamed("n_streams", "n_output")
    both = a.join(b, [group, kind], "full").na.fill(0, ["n_source", "n_output"])
    return both.withColumn("kept", F.col("n_source") + F.when(F.col(kind) == added, 1).otherwise(0) == F.col("n_output"))


def timeline_shift(pairs: DataFrame, group: str, a: str = "source_ms", b: str = "embedded_ms", tolerance_ms: int = 5) -> DataFrame:
    """AG3: (group, n_cues, median_shift, spread, steady): how paired starts are shifted, and whether by the same."""
    shift = F.col(b) - F.col(a)
    return pairs.groupBy(group).agg(F.count(shift).alias("n_cues"), F.median(shift).alias("median_shift"), (F.max(shift) - F.min(shift)).alias("spread"), (F.max(shift) - F.min(shift) <= tolerance_ms).alias("steady"))


def largest_delta(pairs: DataFrame, group: str, a: str = "source_ms", b: str = "embedded_ms", tolerance_ms: int = 2) -> DataFrame:
    """AG4: (group, delta, within): the greatest distance of paired starts."""
    delta = F.max(F.abs(F.col(a) - F.col(b)))
    return pairs.groupBy(group).agg(delta.alias("delta"), (delta <= tolerance_ms).alias("within"))


def cue_counts(cues: DataFrame, group: str, column: str = "text") -> DataFrame:
    """AG7: the multiset of (start, end, text) of each group."""
    return cues.groupBy(group, "start_ms", "end_ms", column).agg(F.count(F.lit(1)).alias("n"))


def changed_cues(before: DataFrame, after: DataFrame, group: str, column: str = "text") -> DataFrame:
    """AG8, SE2: (group, changed): how many cues of `after` aren't in `before`, with multiplicity."""
    a = cue_counts(before, group, column).withColumnRenamed("n", "n_before")
    b = cue_counts(after, group, column)
    keys = [group, "start_ms", "end_ms", column]
    marked = b.join(a, [b[k].eqNullSafe(a[k]) for k in keys], "left").select(*[b[k] for k in keys], "n", F.coalesce("n_before", F.lit(0)).alias("n_before"))
    return marked.groupBy(group).agg(F.sum(F.greatest(F.col("n") - F.col("n_before"), F.lit(0))).alias("changed"))


def majority_language(samples: DataFrame, group: str) -> DataFrame:
    """AG12: (group, language, votes, probability): the language with most samples and their mean probability.

    Of equals the one with the greater mean, then the first by name.
    """
    votes = samples.groupBy(group, "language").agg(F.count(F.lit(1)).alias("votes"), F.avg("probability").alias("probability"))
    # the last key turns names about, as the greatest struct wins
    return votes.groupBy(group).agg(F.min_by(F.struct("language", "votes", "probability"), F.struct(-F.col("votes"), -F.col("probability"), F.col("language"))).alias("_v")).select(group, "_v.*")


def probe_offsets(duration: Column) -> Column:
    """SE6: places to probe a recording: its start if short, else an early, a middle and a late one.

    Only 20 s -> [0] and 100 s -> [3.5, 35, 63] are known of the original; the
    shares 3.5, 35 and 63 % and the border at 30 s are this library's.
    """
    return F.when(duration < 30, F.array(F.lit(0.0))).otherwise(F.array(*[F.round(duration * share, 3) for share in (0.035, 0.35, 0.63)]))


def remux_strategy(formats: Column) -> Column:
    """SE5: whether a container is written natively."""
    names = F.transform(F.split(F.lower(F.coalesce(formats, F.lit(""))), ","), F.trim)
    return F.when(F.arrays_overlap(names, F.array(F.lit("matroska"), F.lit("webm"))), F.lit("mkvmerge-native")).otherwise(F.lit("ffmpeg-shared-timeline"))


def result_tally(results: DataFrame, status: str) -> DataFrame:
    """AG15: (status, n): how many results of a batch ended so."""
    return results.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
