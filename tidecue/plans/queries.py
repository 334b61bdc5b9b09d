"""Registered queries of the core and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecue.functions import languages, predicates, rules, text, timecode
from tidecue.operators import folds, neighbors, tracks, translate
from tidecue.operators.intervals import periods_and_gaps
from tidecue.plans import commands, pipelines
from tidecue.plans import sql as S
from tidecue.session import scratch_folder, table
from tidecue.sources import ass, discovery, recogniser, sinks, subtitles
from tidecue.streaming import cues as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its oracle where SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "p1_found",
    """
with i as (select distinct track_id, start_ms, end_ms from cues where track_id is not null and end_ms > start_ms),
m as (select *, max(end_ms) over (partition by track_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as reach from i),
g as (select *, sum(case when reach is null or start_ms > reach then 1 else 0 end) over (partition by track_id order by start_ms, end_ms rows unbounded preceding) as island from m),
p as (select track_id, island, min(start_ms) as start_ms, max(end_ms) as end_ms from g group by 1, 2)
select track_id, 'period' as kind, start_ms, end_ms from p
union all
select track_id, 'gap' as kind, end_ms as start_ms, n as end_ms
from (select track_id, end_ms, lead(start_ms) over (partition by track_id order by start_ms) as n from p) where n is not null
""",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_and_gaps(table(spark, sf_dir, "cues"), "track_id", "start_ms", "end_ms")


# ---------------------------------------------------------------- cues and segments, each delivery once


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cues").drop("ingested_at").distinct()


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "segments").drop("ingested_at").distinct()


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "transcripts").select("transcript_id", "workspace", "backend", "audio_stream_index", "detected_language").distinct()


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with their transcript's label as `language`."""
    labels = headers(spark, sf_dir).select("transcript_id", F.col("detected_language").alias("language"))
    return segments(spark, sf_dir).join(labels, "transcript_id", "left")


def shown_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues with visible text and both times."""
    c = cues(spark, sf_dir).where("start_ms is not null and end_ms is not null and text is not null")
    return c.withColumn("text", text.strip_ass_text(F.col("text"))).where("text <> ''")


SHOWN = f"(select * from (select cue_id, track_id, cue_no, start_ms, end_ms, {S.strip_ass('text')} as text from {S.CUES} where start_ms is not null and end_ms is not null and text is not null) where text <> '')"


# ---------------------------------------------------------------- time


@query(
    "time_format",
    f"select cue_id, {S.ass_time('start_ms')} as ass, {S.srt_time('start_ms')} as srt, {S.srt_time('start_ms', '.')} as vtt, {S.clock('start_ms / 1000.0')} as clock from {S.CUES} where start_ms >= 0",
)
def time_format(spark, sf_dir):
    c, ms = cues(spark, sf_dir).where("start_ms >= 0"), F.col("start_ms")
    return c.select("cue_id", timecode.ms_to_ass_time(ms).alias("ass"), timecode.ms_to_srt_time(ms).alias("srt"), timecode.seconds_to_vtt_time(ms / 1000).alias("vtt"), timecode.format_time(ms / 1000).alias("clock"))


@query(
    "time_parse",
    f"select cue_id, start_ms as from_srt, start_ms as from_strict, start_ms % 3600000 as from_short, (start_ms // 1000) * 1000 + cast(round_even((start_ms % 1000) / 10.0, 0) as bigint) * 10 as from_ass from {S.CUES} where start_ms >= 0",
)
def time_parse(spark, sf_dir):
    c, ms = cues(spark, sf_dir).where("start_ms >= 0"), F.col("start_ms")
    srt = timecode.ms_to_srt_time(ms)
    return c.select(
        "cue_id", timecode.parse_timestamp(srt).alias("from_srt"), timecode.parse_srt_timestamp(F.when(F.length(srt) == 12, srt)).alias("from_strict"), timecode.parse_timestamp(F.replace(F.substring(srt, 4, 9), F.lit(","), F.lit("."))).alias("from_short"), timecode.ass_time_to_ms(timecode.ms_to_ass_time(ms)).alias("from_ass")
    )


# ---------------------------------------------------------------- text


@query("normalize_space", f"select cue_id, {S.squeeze('text')} as squeezed, {S.key('text')} as text_key, len({S.words('text')}) as n_words from {S.CUES}")
def normalize_space(spark, sf_dir):
    t = F.col("text")
    return cues(spark, sf_dir).select("cue_id", text.squeeze(t).alias("squeezed"), text.comparable_key(t).alias("text_key"), F.size(text.words(t)).cast("long").alias("n_words"))


@query("strip_markup", f"select cue_id, {S.markup('text')} as plain from {S.CUES} where text is not null")
def strip_markup(spark, sf_dir):
    return cues(spark, sf_dir).where("text is not null").select("cue_id", text.strip_markup(F.col("text"), entities=False).alias("plain"))


ENTITIES = [("&", "&amp;"), ('"', "&quot;"), ("'", "&#39;"), ("é", "&eacute;"), ("ñ", "&#xF1;"), ("¿", "&iquest;")]


@query("unescape_entities", f"select cue_id, {S.markup('text')} as plain from {S.CUES} where text is not null")
def unescape_entities(spark, sf_dir):
    """The cues with some characters written as entities; reading them gives the cues without markup."""
    written = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), ENTITIES, F.col("text"))
    return cues(spark, sf_dir).where("text is not null").select("cue_id", text.strip_markup(written).alias("plain"))


@query(
    "ass_text",
    f"""select cue_id, {S.strip_ass('text')} as shown, regexp_extract(text, '^((\\{{[^}}]*\\}})*)', 1) as tags,
coalesce(try_cast(regexp_extract(text, '\\\\pos\\(([-0-9.]+),', 1) as double), 0.0) as x, regexp_matches(text, '\\\\p[1-9]') as drawing,
{S.replaces(S.replaces('text', [(chr(92), chr(92) * 2)]).join(['translate(', ", '{{}}', '()')"]).replace('{{}}', '{}'), [(chr(10), chr(92) + 'N')])} as escaped
from {S.CUES} where text is not null""",
)
def ass_text(spark, sf_dir):
    t = F.col("text")
    return cues(spark, sf_dir).where("text is not null").select(
        "cue_id", text.strip_ass_text(t).alias("shown"), text.leading_tags(t).alias("tags"), text.position_x(t).alias("x"), predicates.has_drawing_mode(t).alias("drawing"), text.escape_ass_text(t).alias("escaped")
    )


@query("repair_mojibake", f"select segment_id, {S.repair('text', S.spanish('language'))} as fixed from {S.LABELLED} where text is not null")
def repair_mojibake(spark, sf_dir):
    return labelled(spark, sf_dir).where("text is not null").select("segment_id", text.repair_encoding(F.col("text"), pipelines.is_spanish(F.col("language"))).alias("fixed"))


@query("remove_repeated_words", f"select segment_id, {S.once_words('text')} as fixed from {S.SEGMENTS} where text is not null")
def remove_repeated_words(spark, sf_dir):
    return segments(spark, sf_dir).where("text is not null").select("segment_id", text.drop_repeated_words(F.col("text")).alias("fixed"))


@query("collapse_phrases", f"select segment_id, {S.phrases('text')} as fixed from {S.SEGMENTS} where text is not null")
def collapse_phrases(spark, sf_dir):
    return segments(spark, sf_dir).where("text is not null").select("segment_id", text.collapse_phrases(F.col("text")).alias("fixed"))


_ES = S.spanish("language")
TERMS = [("público", "audience"), ("editora", "editor"), ("la editora", "the editor"), ("niño", "boy"), ("the editor", "EDITOR")]


@query("glossary", f"select segment_id, {S.replaces('text', sorted(TERMS, key=lambda t: -len(t[0])))} as translated from {S.SEGMENTS} where text is not null")
def glossary(spark, sf_dir):
    return segments(spark, sf_dir).where("text is not null").select("segment_id", text.apply_terms(F.col("text"), TERMS).alias("translated"))


@query("glossary_defaults", f"select doc_id, {S.replaces('text', sorted(text.glossary_terms(), key=lambda t: -len(t[0])))} as translated from documents where text is not null")
def glossary_defaults(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.apply_terms(F.col("text"), text.glossary_terms()).alias("translated"))


@query("spanish_normalize", f"with {S.spanish_steps(f'(select segment_id, text from {S.LABELLED} where text is not null and {_ES})', 'text')} select segment_id, spanish as fixed from s4")
def spanish_normalize(spark, sf_dir):
    return labelled(spark, sf_dir).where(pipelines.is_spanish(F.col("language")) & F.col("text").isNotNull()).select("segment_id", text.normalize_spanish(F.col("text")).alias("fixed"))


@query("suspicious_questions", S.suspects(f"{S.SEGMENTS}", "segment_id", "text"))
def suspicious_questions(spark, sf_dir):
    found = segments(spark, sf_dir).where("text is not null").select("segment_id", F.explode(text.suspicious_questions(F.col("text"))).alias("f"))
    return found.select("segment_id", "f.offset", "f.context")


# ---------------------------------------------------------------- predicates


@query("noise_filter", f"select segment_id, {S.noise('text')} as noise, {S.filler('text', 'language')} as filler from {S.LABELLED} where text is not null")
def noise_filter(spark, sf_dir):
    return labelled(spark, sf_dir).where("text is not null").select("segment_id", predicates.is_noise(F.col("text")).alias("noise"), predicates.is_filler_only(F.col("text"), F.col("language")).alias("filler"))


@query(
    "track_flags",
    f"""select track_id, lower(codec_name) in {S.listed(rules.TEXT_CODECS + rules.TEXT_CODEC_IDS)} as textual, (contains(lower(coalesce(title, '')), 'forced') or contains(lower(coalesce(title, '')), 'forzado')) as forced,
(contains(lower(coalesce(title, '')), 'cc') or contains(lower(coalesce(title, '')), 'closed caption') or contains(lower(coalesce(title, '')), 'sdh')) as captions from {S.TRACKS}""",
)
def track_flags(spark, sf_dir):
    t = subtitle_tracks(spark, sf_dir)
    return t.select("track_id", predicates.is_text_codec(F.col("codec_name")).alias("textual"), predicates.is_forced_track(F.col("title"), F.lit(False)).alias("forced"), predicates.is_caption_track(F.col("title")).alias("captions"))


@query(
    "ass_tv_safe",
    f"""with e as (select track_id, {S.ass_time('start_ms')} as s, {S.ass_time('end_ms')} as t, {S.strip_ass('text')} as text, text as raw from {S.CUES} where start_ms >= 0 and end_ms >= 0 and text is not null),
f as (select *, lower(replace(text, chr(10), ' ')) as low, lower({S.sub('text', rules.SPACE + '+')}) as tight from e),
p as (select track_id, text, list_transform(string_split(s, ':'), lambda x: cast(x as double)) as a, list_transform(string_split(t, ':'), lambda x: cast(x as double)) as b from f
where text <> '' and not regexp_matches(raw, '\\\\p[1-9]') and not (length(tight) >= 8 and replace(tight, left(tight, 1), '') = '')
and not (regexp_matches(trim(low), '^[mlbns]\\s+-?\\d') and len(regexp_extract_all(low, '\\b[mlbns]\\b')) >= 2 and len(regexp_extract_all(low, '-?\\d+(?:\\.\\d+)?')) >= 8 and not regexp_matches({S.sub('low', chr(92) + 'b[mlbns]' + chr(92) + 'b')}, '[a-zA-Z]'))),
m as (select track_id, cast(round((a[1] * 3600 + a[2] * 60 + a[3]) * 1000) as bigint) as start_ms, cast(round((b[1] * 3600 + b[2] * 60 + b[3]) * 1000) as bigint) as end_ms, text from p)
select distinct track_id, start_ms, end_ms, text from m where end_ms > start_ms""",
)
def ass_tv_safe(spark, sf_dir):
    return pipelines.tv_safe_cues(ass_lines(spark, sf_dir), "track_id")


def ass_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cues as ASS dialogues: (track_id, line_no, in_events, fields)."""
    c = cues(spark, sf_dir).where("start_ms >= 0 and end_ms >= 0 and text is not null")
    lit = lambda name, value: F.lit(value).alias(name)
    return c.select(
        "track_id", F.col("cue_no").alias("line_no"), lit("in_events", True), lit("layer", "0"), timecode.ms_to_ass_time(F.col("start_ms")).alias("start"), timecode.ms_to_ass_time(F.col("end_ms")).alias("end"),
        lit("style", "Default"), lit("name", ""), lit("ml", "0"), lit("mr", "0"), lit("mv", "0"), lit("effect", ""), F.col("text").alias("raw"),
    )


# ---------------------------------------------------------------- neighbours


@query(
    "clean_segments",
    f"""with {S.cleaned(S.LABELLED)},
d as (select *, {S.bare('cleaned')} as k, lag({S.bare('cleaned')}) over (partition by transcript_id order by start_s, seg_no) as before from c4 where cleaned <> '' and transcript_id is not null)
select segment_id, transcript_id, cleaned as text from d where k = '' or before is null or k <> before""",
)
def clean_segments(spark, sf_dir):
    return pipelines.clean_segments(labelled(spark, sf_dir)).select("segment_id", "transcript_id", "text")


@query(
    "clean_report",
    f"""with {S.cleaned(S.LABELLED)},
d as (select *, {S.bare('cleaned')} as k, lag({S.bare('cleaned')}) over (partition by transcript_id order by start_s, seg_no) as before from c4 where cleaned <> '' and transcript_id is not null),
k as (select transcript_id, count(*) as n_clean from d where k = '' or before is null or k <> before group by 1),
a as (select transcript_id, count(*) as n_input from {S.SEGMENTS} group by 1)
select transcript_id, n_input, coalesce(n_clean, 0) as n_clean, n_input - coalesce(n_clean, 0) as n_removed from a left join k using (transcript_id)""",
)
def clean_report(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return pipelines.clean_report(rows, pipelines.clean_segments(rows))


WHY = f"""w as (select *, {S.key('text')} as k, lag({S.key('text')}) over t as kp, lead({S.key('text')}) over t as kn, end_ms - start_ms as dur from {SHOWN} window t as (partition by track_id order by cue_no)),
x as (select *, string_split(k, ' ') as ws, string_split(kp, ' ') as wp, string_split(kn, ' ') as wn from w),
y as (select *, case when kp is null or kn is null or k = '' then null when k = kp then 'duplicates_previous' when not (dur <= 1800 and len(ws) >= 7) then null when k = kn then 'duplicates_next'
when {S.overlap('wp', 'ws')} >= 2 and {S.overlap('ws', 'wn')} >= 3 and {S.overlap('wp', 'ws')} + {S.overlap('ws', 'wn')} >= len(ws) - 1 then 'bridge_from_previous_and_next' end as why from x)"""


@query(
    "adjacent_duplicates",
    f"""with {WHY}, z as (select *, lead(case when why is not null then end_ms end) over (partition by track_id order by cue_no) as gone from y)
select cue_id, track_id, start_ms, greatest(end_ms, coalesce(gone, end_ms)) as end_ms, text from z where why is null""",
)
def adjacent_duplicates(spark, sf_dir):
    return neighbors.remove_adjacent_duplicates(shown_cues(spark, sf_dir)).select("cue_id", "track_id", "start_ms", "end_ms", "text")


@query(
    "trim_suffix",
    f"""with n as (select cue_id, text, lead(text) over (partition by track_id order by cue_no) as after from {SHOWN}), t as (select *, {S.trimmed('text', 'after')} as cut from n)
select cue_id, coalesce(cut, text) as text, cut is not null as trimmed from t""",
)
def trim_suffix(spark, sf_dir):
    return neighbors.trim_repeated_fragments(shown_cues(spark, sf_dir)).select("cue_id", "text", "trimmed")


REDISTRIBUTED = f"""
n0 as (select track_id, cue_no, text, row_number() over (partition by track_id order by cue_no) as n from {SHOWN}),
w0 as (select track_id, n, cue_no, text as body, false as changed, cast(null as bigint) as done_no, cast(null as varchar) as done, false as done_changed from n0 where n = 1
  union all
  select track_id, n, next_no, case when given then case when h <> '' then l || ' ' || rest else rest end else text end, given, cue_no, case when given then case when h <> '' then trim(h) else a end else body end, changed or given
  from (select *, fits and rest <> '' as given, regexp_extract(a, '^(.*[.!?])( +)([A-ZÁÉÍÓÚÜÑ¡¿].*)$', 1) as h, regexp_extract(a, '^(.*[.!?])( +)([A-ZÁÉÍÓÚÜÑ¡¿].*)$', 3) as l
  from (select *, a <> '' and b <> '' and ka <> kb and starts_with(kb, ka) as fits,
    {S.sub("case when starts_with(b, a) then substr(b, length(a) + 1) else array_to_string(list_slice(string_split(b, ' '), len(string_split(a, ' ')) + 1, len(string_split(b, ' '))), ' ') end", '^[ ,;:-]+|[ ,;:-]+$')} as rest
  from (select *, {S.key('a')} as ka, {S.key('b')} as kb
  from (select w0.*, n0.n as n2, n0.cue_no as next_no, n0.text, {S.squeeze('w0.body')} as a, {S.squeeze('n0.text')} as b from w0 join n0 on n0.track_id = w0.track_id and n0.n = w0.n + 1)))))"""


@query(
    "redistribute_prefix",
    f"""with recursive {REDISTRIBUTED.replace("select track_id, n, next_no,", "select track_id, n2, next_no,")},
m0 as (select track_id, max(n) as n from n0 group by 1)
select track_id, done_no as cue_no, done as text, done_changed as redistributed from w0 where done_no is not null
union all select track_id, cue_no, body as text, changed as redistributed from w0 join m0 using (track_id, n)""",
)
def redistribute_prefix(spark, sf_dir):
    return neighbors.redistribute_prefixes(shown_cues(spark, sf_dir))


@query(
    "paragraph_checks",
    f"""with n as (select *, lag(start_s) over w as ps, lag(end_s) over w as pe from {S.SEGMENTS} where text is not null and transcript_id is not null window w as (partition by transcript_id order by seg_no))
select segment_id, array_to_string(list_filter([case when start_s < coalesce(ps, -1) then 'start not monotonic' end, case when end_s < start_s then 'ends before start' end, case when end_s < coalesce(pe, -1) then 'end not monotonic' end, case when regexp_matches(text, '[ÃÂ�]') then 'garbled sign' end], lambda x: x is not null), '; ') as warnings from n""",
)
def paragraph_checks(spark, sf_dir):
    rows = segments(spark, sf_dir).where("text is not null")
    return neighbors.paragraph_warnings(rows, "transcript_id", "seg_no", "start_s", "end_s").select("segment_id", F.array_join("warnings", "; ").alias("warnings"))


@query("pauses", f"select segment_id, coalesce(start_s - lag(end_s) over (partition by transcript_id order by seg_no) >= 2.5, false) as gap_before from {S.SEGMENTS} where transcript_id is not null")
def pauses(spark, sf_dir):
    return neighbors.gaps(segments(spark, sf_dir), "transcript_id", ["seg_no"], "start_s", "end_s", 2.5).select("segment_id", "gap_before")


@query("renumber", f"select cue_id, row_number() over (partition by track_id order by start_ms nulls first, end_ms nulls first, cue_id) as n from {S.CUES} where track_id is not null")
def renumber(spark, sf_dir):
    return neighbors.renumber(cues(spark, sf_dir), "track_id", ["start_ms", "end_ms", "cue_id"], "n").select("cue_id", "n")


# ---------------------------------------------------------------- folds


@query("wrap_lines", f"select cue_id, {S.wrapped('text')} as lines, ceil(len(list_filter(string_split({S.wrapped('text')}, chr(10)), lambda l: l <> '')) / 2.0)::bigint as n_groups from {S.CUES} where text is not null")
def wrap_lines(spark, sf_dir):
    lined = folds.with_line_groups(cues(spark, sf_dir).where("text is not null"), text.words(F.col("text")))
    return lined.select("cue_id", F.array_join("_lines", "\n").alias("lines"), F.size("_groups").cast("long").alias("n_groups"))


@query(
    "reflow_cues",
    f"""with l as (select cue_id, start_ms as s, end_ms as e, list_filter(string_split({S.wrapped('text')}, chr(10)), lambda x: x <> '') as ls from {S.CUES} where text is not null and start_ms is not null and end_ms is not null),
g as (select cue_id, s, e, list_transform(range(0, (len(ls) + 1) // 2), lambda k: array_to_string(list_slice(ls, 2 * k + 1, 2 * k + 2), chr(10))) as gs from l where len(ls) > 0),
w as (select *, list_transform(gs, lambda x: greatest(1, length(replace(replace(x, ' ', ''), chr(10), '')))) as ws from g),
d as (select *, list_transform(ws, lambda x: greatest(250, cast(round_even((e - s) * x / list_sum(ws), 0) as bigint))) as ds from w),
u as (select cue_id, s, e, gs, ds, unnest(range(1, len(gs) + 1)) as i from d),
p as (select cue_id, i as part_no, case when i = 1 then s else least(e, s + list_sum(list_slice(ds, 1, i - 1))) end as start_ms, case when i = len(gs) then e else least(e, s + list_sum(list_slice(ds, 1, i))) end as end_ms, gs[i] as text from u)
select cue_id, cast(part_no as integer) as part_no, cast(start_ms as bigint) as start_ms, cast(end_ms as bigint) as end_ms, text from p where end_ms > start_ms""",
)
def reflow_cues(spark, sf_dir):
    return folds.reflow_cues(cues(spark, sf_dir).where("text is not null"), ["cue_id"])


def _paragraph_sql(source: str, section_s: float | None = None) -> str:
    """Recursive form of FO4, and of FO5 with section_s, over (transcript_id, seg_no, start_s, end_s, text)."""
    over = "over (partition by transcript_id order by start_s, seg_no)"
    new = f"r0.start_s >= r1.start_of + {section_s}" if section_s else "false"
    cut = f"({new} or r1.chars >= 900 or r0.start_s - r0.pe >= 2.5 or (r0.ps and r1.chars >= 405.0))"
    return f"""
r0 as (select *, row_number() {over} as rn, lag(end_s) {over} as pe, coalesce(regexp_matches(lag(text) {over}, '[.!?。！？]\\s*$'), false) as ps from {source}),
r1 as (select transcript_id, rn, start_s, end_s, text, 1 as para_no, length(text) as chars, 1 as section_no, start_s as start_of from r0 where rn = 1
  union all
  select r0.transcript_id, r0.rn, r0.start_s, r0.end_s, r0.text, case when {cut} then r1.para_no + 1 else r1.para_no end, case when {cut} then length(r0.text) else r1.chars + length(r0.text) end,
    case when {new} then r1.section_no + 1 else r1.section_no end, case when {new} then r0.start_s else r1.start_of end
  from r1 join r0 on r0.transcript_id = r1.transcript_id and r0.rn = r1.rn + 1)
select transcript_id, para_no, {'first(section_no) as section_no, ' if section_s else ''}first(start_s order by rn) as start_s, last(end_s order by rn) as end_s, {S.squeeze("string_agg(text, ' ' order by rn)")} as text from r1 group by 1, 2"""


SIGNS = " + ".join(f"cast(contains(t, {S.q(s)}) as int)" for s in rules.SPANISH_SIGNS)
INFERRED = f"""
i1 as (select transcript_id, {S.repair('text', 'true')} as t, row_number() over (partition by transcript_id order by start_s, seg_no) as n from {S.SEGMENTS} where text is not null and transcript_id is not null),
i2 as (select transcript_id, lower(string_agg(t, ' ' order by n)) as t from i1 where n <= 20 group by 1),
i3 as (select transcript_id, {SIGNS} as signs from i2)"""


@query("infer_spanish", f"with {INFERRED} select transcript_id, signs, signs >= 4 as is_spanish from i3")
def infer_spanish(spark, sf_dir):
    return pipelines.infer_spanish(segments(spark, sf_dir).where("text is not null"))


@query(
    "paragraphs",
    f"""with recursive {INFERRED},
h as (select transcript_id, case when lower(coalesce(detected_language, '')) in {S.listed(['', *rules.UNSURE_LABELS])} and coalesce(signs >= 4, false) then 'es' else detected_language end as language from {S.HEADERS} left join i3 using (transcript_id)),
src as (select s.*, h.language from {S.SEGMENTS} s left join h using (transcript_id)),
{S.cleaned('src')},
d as (select *, {S.bare('cleaned')} as k, lag({S.bare('cleaned')}) over (partition by transcript_id order by start_s, seg_no) as before from c4 where cleaned <> '' and transcript_id is not null),
e as (select transcript_id, seg_no, start_s, coalesce(end_s, start_s) as end_s, cleaned as text from d where (k = '' or before is null or k <> before) and start_s is not null),
{_paragraph_sql('e')}""",
)
def paragraphs(spark, sf_dir):
    heads = headers(spark, sf_dir).select("transcript_id", F.col("detected_language").alias("language"))
    return pipelines.transcript_paragraphs(segments(spark, sf_dir), heads).drop("section_no")


@query(
    "sections",
    f"""with recursive {S.cleaned(S.LABELLED)},
d as (select *, {S.bare('cleaned')} as k, lag({S.bare('cleaned')}) over (partition by transcript_id order by start_s, seg_no) as before from c4 where cleaned <> '' and transcript_id is not null),
e as (select transcript_id, seg_no, start_s, coalesce(end_s, start_s) as end_s, cleaned as text from d where (k = '' or before is null or k <> before) and start_s is not null),
{_paragraph_sql('e', 180.0)}""",
)
def sections(spark, sf_dir):
    rows = pipelines.clean_segments(labelled(spark, sf_dir)).withColumn("end_s", F.coalesce("end_s", "start_s"))
    return folds.build_paragraphs(rows, section_s=folds.SECTION_S)


@query("align_paragraphs")
def align_paragraphs(spark, sf_dir):
    heads = headers(spark, sf_dir).select("transcript_id", F.col("detected_language").alias("language"))
    rows = segments(spark, sf_dir).where("text is not null and start_s is not null").withColumn("end_s", F.coalesce("end_s", "start_s"))
    return folds.align_paragraphs(pipelines.transcript_paragraphs(rows, heads), rows)


FLAGSHIP = "paragraphs"


# ---------------------------------------------------------------- sources and sinks


@query("distinct_cues", f"select distinct track_id, start_ms, end_ms, text from {S.CUES} where text is not null")
def distinct_cues(spark, sf_dir):
    return sinks.distinct_cues(cues(spark, sf_dir).where("text is not null"), "track_id")


@query("txt_files", f"select transcript_id, string_agg({S.squeeze('text')}, chr(10) order by seg_no) || chr(10) as content from {S.SEGMENTS} where text is not null group by 1")
def txt_files(spark, sf_dir):
    rows = segments(spark, sf_dir).where("text is not null").withColumn("text", text.squeeze(F.col("text")))
    return sinks.txt_files(rows, "transcript_id", ["seg_no"])


PLAIN = f"(select cue_id, track_id, cue_no, start_ms, end_ms, {S.squeeze(S.markup('text'))} as text from {S.CUES} where text is not null and start_ms >= 0 and end_ms > start_ms)"


def plain_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of one line without markup, with a positive duration."""
    c = cues(spark, sf_dir).where("text is not null and start_ms >= 0 and end_ms > start_ms")
    return c.withColumn("text", text.squeeze(text.strip_markup(F.col("text"), entities=False))).where("text <> ''")


@query("srt_files", f"select track_id, string_agg(n || chr(10) || {S.srt_time('start_ms')} || ' --> ' || {S.srt_time('end_ms')} || chr(10) || text, chr(10) || chr(10) order by n) || chr(10) as content from (select *, row_number() over (partition by track_id order by start_ms, end_ms, text) as n from {PLAIN} where text <> '') group by 1")
def srt_files(spark, sf_dir):
    return sinks.srt_files(plain_cues(spark, sf_dir), "track_id")


@query("vtt_files", f"select track_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({S.srt_time('start_ms', '.')} || ' --> ' || {S.srt_time('end_ms', '.')} || chr(10) || text, chr(10) || chr(10) order by start_ms, end_ms, text) || chr(10) as content from {PLAIN} where text <> '' group by 1")
def vtt_files(spark, sf_dir):
    return sinks.vtt_files(plain_cues(spark, sf_dir), "track_id")


@query("ass_files")
def ass_files(spark, sf_dir):
    return sinks.ass_files(plain_cues(spark, sf_dir), "track_id")


@query("tv_srt_files")
def tv_srt_files(spark, sf_dir):
    return sinks.tv_srt_files(plain_cues(spark, sf_dir), "track_id")


def _numbered(rows: str) -> str:
    return f"select track_id, start_ms, end_ms, {S.squeeze(S.markup('text'))} as text from {rows} where {S.squeeze(S.markup('text'))} <> ''"


@query("srt_roundtrip", _numbered(f"(select * from {PLAIN} where text <> '')"))
def srt_roundtrip(spark, sf_dir):
    files = sinks.srt_files(plain_cues(spark, sf_dir), "track_id").withColumn("path", F.lit("x.srt"))
    return subtitles.parse_subtitles(files, ["track_id"], entities=False).select("track_id", "start_ms", "end_ms", "text")


@query("vtt_roundtrip", _numbered(f"(select * from {PLAIN} where text <> '' and not regexp_matches(text, '^(NOTE|STYLE|REGION)'))"))
def vtt_roundtrip(spark, sf_dir):
    files = sinks.vtt_files(plain_cues(spark, sf_dir), "track_id").withColumn("path", F.lit("x"))
    return subtitles.parse_subtitles(files, ["track_id"], entities=False).select("track_id", "start_ms", "end_ms", "text")


@query("strict_srt", f"select track_id, start_ms, end_ms, text from {PLAIN} where text <> '' and end_ms < 360000000")
def strict_srt(spark, sf_dir):
    files = sinks.srt_files(plain_cues(spark, sf_dir).where("end_ms < 360000000"), "track_id")
    return subtitles.parse_strict_srt(files, ["track_id"]).select("track_id", "start_ms", "end_ms", "text")


@query("srt_start_times", f"select track_id, row_number() over (partition by track_id order by start_ms, end_ms, text) as cue_no, start_ms from {PLAIN} where text <> ''")
def srt_start_times(spark, sf_dir):
    found = subtitles.start_times(sinks.srt_files(plain_cues(spark, sf_dir), "track_id"), ["track_id"])
    return found.withColumn("cue_no", F.col("cue_no").cast("long"))


@query("ass_lines", f"select track_id, count(*) as n_lines, count_if(in_events) as n_events from (select track_id, unnest([false, true]) as in_events, cue_id from {S.CUES} where text is not null and start_ms >= 0 and end_ms >= 0) where in_events or cue_id in (select min(cue_id) from {S.CUES} where text is not null and start_ms >= 0 and end_ms >= 0 group by track_id) group by 1")
def ass_lines_query(spark, sf_dir):
    lines = ass.dialogue_line(ass_lines(spark, sf_dir).withColumn("raw", F.replace(F.col("raw"), F.lit("\n"), F.lit("\\N"))))
    files = lines.groupBy("track_id").agg(F.concat(F.lit("[Events]\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: F.regexp_replace(x["line"], "\r", "")), "\n")).alias("content"))
    read = ass.read_lines(files, ["track_id"])
    return read.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("in_events") & F.col("raw").isNotNull()).alias("n_events"))


def recogniser_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as recogniser JSON, one document per transcript."""
    rows = segments(spark, sf_dir).where("transcript_id is not null and start_s is not null")
    item = F.struct(F.col("seg_no"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), F.col("text"))
    docs = rows.groupBy("transcript_id").agg(F.sort_array(F.collect_list(item)).alias("segments"))
    return docs.select("transcript_id", F.lit("json").alias("kind"), F.to_json(F.struct(F.lit("es").alias("language"), "segments")).alias("content"))


JSON_ROWS = f"select transcript_id, start_s, case when coalesce(end_s, start_s) <= start_s then start_s + 0.01 else end_s end as end_s, {S.squeeze('text')} as text from {S.SEGMENTS} where transcript_id is not null and start_s is not null and {S.squeeze('text')} <> ''"


@query("whisper_json", JSON_ROWS)
def whisper_json(spark, sf_dir):
    return recogniser.json_segments(recogniser_files(spark, sf_dir), ["transcript_id"]).select("transcript_id", "start_s", "end_s", "text")


@query("source_fallback", f"select transcript_id, start_s, end_s, text from ({JSON_ROWS}) where transcript_id % 2 = 0 union all select transcript_id, 0.0::double as start_s, 0.0::double as end_s, {S.squeeze("string_agg(text, ' ' order by seg_no)")} as text from {S.SEGMENTS} where transcript_id % 2 = 1 group by 1 having {S.squeeze("string_agg(text, ' ' order by seg_no)")} <> ''")
def source_fallback(spark, sf_dir):
    """Even transcripts have JSON and text, odd ones an empty JSON and text."""
    rows = segments(spark, sf_dir).where("transcript_id is not null")
    whole = rows.groupBy("transcript_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_no", "text"))), lambda x: x["text"]), " ").alias("content")).withColumn("kind", F.lit("txt"))
    found = recogniser_files(spark, sf_dir).withColumn("content", F.when(F.col("transcript_id") % 2 == 0, F.col("content")).otherwise(F.lit('{"segments": []}')))
    return recogniser.load_segments(found.unionByName(whole), ["transcript_id"]).select("transcript_id", "start_s", "end_s", "text")


def _timed_sql(source: str, key: str) -> str:
    """FO8 over (key, s, e, text) with words timed evenly between s and e seconds; times are in ms."""
    return f"""
t1 as (select {key}, s, e, {S.words('text')} as ws, list_filter(string_split({S.wrapped('text')}, chr(10)), lambda x: x <> '') as ls from {source}),
t2 as (select *, (e - s) / greatest(len(ws), 1) as step, list_transform(ls, lambda x: len(string_split(x, ' '))) as ns from t1 where len(ls) > 0),
t3 as (select *, unnest(range(1, (len(ls) + 1) // 2 + 1)) as k from t2),
t4 as (select *, coalesce(list_sum(list_slice(ns, 1, 2 * k - 2)), 0) as b, list_sum(list_slice(ns, 2 * k - 1, 2 * k)) as m from t3),
t5 as (select {key}, cast(k as integer) as part_no, cast(round_even((s + step * b) * 1000, 0) as bigint) as start_ms, cast(round_even((s + step * (b + m)) * 1000, 0) as bigint) as end_ms, array_to_string(list_slice(ls, 2 * k - 1, 2 * k), chr(10)) as text from t4)"""


def evenly_timed(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """df with `words`: its text's words, timed evenly between two times in seconds."""
    said = df.withColumn("_w", text.words(F.col("text"))).withColumn("_step", (end - start) / F.greatest(F.size("_w"), F.lit(1)))
    return said.withColumn("words", F.transform("_w", lambda x, i: F.struct(x.alias("word"), (start + F.col("_step") * i).alias("start"), (start + F.col("_step") * (i + 1)).alias("end"))))


@query("timed_words", f"with {_timed_sql(f'(select segment_id, start_s as s, end_s as e, text from {S.SEGMENTS} where text is not null and end_s > start_s)', 'segment_id')} select * from t5 where end_ms > start_ms")
def timed_words(spark, sf_dir):
    """Segments with words timed evenly, grouped to cues."""
    rows = segments(spark, sf_dir).where("text is not null and end_s > start_s")
    return folds.timed_word_cues(evenly_timed(rows, F.col("start_s"), F.col("end_s")), ["segment_id"])


@query("markdown_documents")
def markdown_documents(spark, sf_dir):
    heads = headers(spark, sf_dir).select("transcript_id", F.concat(F.lit("Recording "), "transcript_id").alias("title"), F.col("workspace").alias("source_video"), "backend", F.col("detected_language").alias("language"), "audio_stream_index", F.lit("clean").alias("postprocess_mode"))
    return pipelines.markdown_documents(paragraphs(spark, sf_dir), heads, "transcript_id", "2026-01-01T00:00:00+00:00")


# ---------------------------------------------------------------- languages and tracks


LOOKUP = f"""a as (select lower(trim(alias)) as alias, min(code) as code from language_aliases group by 1),
r as (select distinct doc_id, lang, lower(trim(lang)) as k from documents)"""


@query("language_lookup", f"with {LOOKUP} select doc_id, coalesce(x.code, case when contains(k, '-') then y.code end) as profile_code from r left join a x on r.k = x.alias left join a y on split_part(r.k, '-', 1) = y.alias")
def language_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return languages.with_profile(docs, "lang", table(spark, sf_dir, "language_aliases")).select("doc_id", "profile_code")


_CODES = " ".join(f"when {S.q(k)} then {S.q(c)}" for k, (c, _) in rules.CONTAINER_LANGUAGES.items())
_NAMES = " ".join(f"when {S.q(k)} then {S.q(n)}" for k, (_, n) in rules.CONTAINER_LANGUAGES.items())


@query("container_language", f"with k as (select doc_id, lang, lower(trim(coalesce(lang, ''))) as k from documents) select doc_id, case k {_CODES} when '' then 'und' else k end as mkv_language, case k {_NAMES} when '' then 'desconocido' else lang end as language_display from k")
def container_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return languages.with_container_language(docs, "lang").select("doc_id", "mkv_language", "language_display")


_SHORT = {code: k for k, (code, _) in reversed(list(rules.CONTAINER_LANGUAGES.items())) if len(k) == 2} | {"zho": "zh", "fra": "fr", "deu": "de"}


@query("recogniser_language", f"with k as (select doc_id, split_part(lower(trim(lang)), '-', 1) as k from documents) select doc_id, case k {' '.join(f'when {S.q(a)} then {S.q(b)}' for a, b in _SHORT.items())} {' '.join(f'when {S.q(b)} then {S.q(b)}' for b in sorted(set(_SHORT.values())))} end as recogniser_code from k")
def recogniser_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return languages.with_recogniser_language(docs, "lang").select("doc_id", "recogniser_code")


def subtitle_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tracks").drop("ingested_at").distinct()


@query(
    "best_track",
    f"""select workspace, track_id, stream_index, source_language from (select *, row_number() over (partition by workspace order by is_default desc, forced_like, cc_like,
score.s_supported desc, score.s_textual desc, score.s_not_forced desc, score.s_not_cc desc, score.s_events desc, score.s_audio desc, score.s_default desc, stream_index, track_id) as n from {S.TRACKS} where supported and textual) where n = 1""",
)
def best_track(spark, sf_dir):
    return tracks.best_track(subtitle_tracks(spark, sf_dir)).select("workspace", "track_id", "stream_index", "source_language")


@query(
    "audio_preferences",
    f"""with t as (select *, max(is_default) over (partition by workspace) as any_default from {S.TRACKS}),
f as (select workspace, source_language as code, min(stream_index) as first_at from t where (not any_default or is_default) and coalesce(source_language, '') <> '' group by 1, 2)
select workspace, code, cast(row_number() over (partition by workspace order by first_at, code) - 1 as integer) as rank from f""",
)
def audio_preferences(spark, sf_dir):
    audio = subtitle_tracks(spark, sf_dir).select("workspace", F.col("stream_index").alias("ordinal"), F.col("source_language").alias("code"), "is_default")
    return tracks.audio_preferences(audio)


_SCORE = ("s_supported", "s_textual", "s_not_forced", "s_not_cc", "s_events", "s_audio", "s_default")


@query(
    "subtitle_inventory",
    f"""with a as (select lower(trim(alias)) as alias, min(code) as code from language_aliases group by 1),
t as (select *, max(is_default) over (partition by workspace) as any_default from {S.TRACKS}),
f as (select workspace, source_language as code, min(stream_index) as first_at from t where (not any_default or is_default) and coalesce(source_language, '') <> '' group by 1, 2),
r as (select workspace, code, row_number() over (partition by workspace order by first_at, code) - 1 as rank from f),
k as (select track_id, workspace, stream_index, is_default, event_count, lower(trim(source_language)) as k, lower(codec_name) in {S.listed(rules.TEXT_CODECS + rules.TEXT_CODEC_IDS)} as textual, lower(coalesce(title, '')) as title from t),
c as (select k.*, coalesce(x.code, case when contains(k, '-') then y.code end) as code from k left join a x on k.k = x.alias left join a y on split_part(k.k, '-', 1) = y.alias),
p as (select c.*, contains(title, 'forced') or contains(title, 'forzado') as forced_like, contains(title, 'cc') or contains(title, 'closed caption') or contains(title, 'sdh') as cc_like, cast(coalesce(r.rank, 99) as integer) as audio_rank from c left join r on r.workspace = c.workspace and r.code = c.code)
select track_id, code as source_language, code is not null as supported, textual, forced_like, cc_like, audio_rank, case when code is not null then 0 else -100000 end as s_supported, case when textual then 0 else -100000 end as s_textual,
case when forced_like then 0 else 10000 end as s_not_forced, case when cc_like then 0 else 1000 end as s_not_cc, cast(event_count as integer) as s_events, case when audio_rank = 99 then 0 else 500 - audio_rank end as s_audio, case when coalesce(is_default, false) then 100 else 0 end as s_default from p""",
)
def subtitle_inventory(spark, sf_dir):
    found = inventory(spark, sf_dir)
    return found.select("track_id", "source_language", "supported", "textual", "forced_like", "cc_like", "audio_rank", *[F.col(f"score.{c}").alias(c) for c in _SCORE])


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = subtitle_tracks(spark, sf_dir).select("workspace", "stream_index", "track_id", "codec_name", F.lit("").alias("codec_id"), "title", F.col("source_language").alias("language_raw"), F.lit(False).alias("forced"), "is_default", "event_count")
    return pipelines.subtitle_inventory(raw, table(spark, sf_dir, "language_aliases"), audio_preferences(spark, sf_dir))


@query("choose_audio", f"select workspace, arg_min(stream_index, (case when coalesce(is_default, false) then 0 else 1 end) * 1000000 + stream_index) as stream_index from {S.TRACKS} group by 1")
def choose_audio(spark, sf_dir):
    return tracks.choose_audio(subtitle_tracks(spark, sf_dir), "workspace")


@query("stream_counts", f"select workspace, codec_name, count(*) as n_streams from {S.TRACKS} group by 1, 2")
def stream_counts(spark, sf_dir):
    return tracks.stream_counts(subtitle_tracks(spark, sf_dir), "workspace", "codec_name")


@query(
    "majority_language",
    """with s as (select transcript_id, unnest(samples) as x from (select distinct transcript_id, samples from transcripts)),
v as (select transcript_id, x.language as language, count(*) as votes, avg(x.probability) as p from s group by 1, 2)
select transcript_id, language, votes, round(p, 6) as probability from (select *, row_number() over (partition by transcript_id order by votes desc, p desc, language) as n from v) where n = 1""",
)
def majority_language(spark, sf_dir):
    samples = table(spark, sf_dir, "transcripts").select("transcript_id", "samples").distinct().select("transcript_id", F.explode("samples").alias("x")).select("transcript_id", "x.language", "x.probability")
    return tracks.majority_language(samples, "transcript_id").withColumn("probability", F.round("probability", 6))


@query(
    "timeline_shift",
    f"""with c as (select distinct cue_id, track_id, start_ms from cues where start_ms is not null and track_id is not null), a as (select track_id, start_ms, row_number() over (partition by track_id order by start_ms) as n from c),
b as (select track_id, s, row_number() over (partition by track_id order by s) as n from (select track_id, start_ms + 1250 + cue_id % 3 as s from c)),
p as (select a.track_id, s - start_ms as d from a join b using (track_id, n))
select track_id, count(*) as n_cues, cast(median(d) as double) as median_shift, max(d) - min(d) as spread, max(d) - min(d) <= 5 as steady, max(abs(d)) as delta, max(abs(d)) <= 2 as within, true as same_count from p group by 1""",
)
def timeline_shift(spark, sf_dir):
    c = cues(spark, sf_dir).where("start_ms is not null and track_id is not null").select("cue_id", "track_id", "start_ms")
    moved = c.withColumn("start_ms", F.col("start_ms") + 1250 + F.col("cue_id") % 3)
    return pipelines.check_timeline(c, moved)


@query(
    "changed_cues",
    f"""with b as (select track_id, start_ms, end_ms, {S.squeeze('text')} as text, count(*) as n from {S.CUES} where text is not null group by 1, 2, 3, 4),
a as (select track_id, start_ms, end_ms, {S.squeeze(S.repair('text'))} as text, count(*) as n from {S.CUES} where text is not null group by 1, 2, 3, 4)
select a.track_id, cast(sum(greatest(a.n - coalesce(b.n, 0), 0)) as bigint) as changed from a left join b on a.track_id is not distinct from b.track_id and a.start_ms is not distinct from b.start_ms and a.end_ms is not distinct from b.end_ms and a.text = b.text group by 1""",
)
def changed_cues(spark, sf_dir):
    c = cues(spark, sf_dir).where("text is not null")
    return tracks.changed_cues(c.withColumn("text", text.squeeze(F.col("text"))), c.withColumn("text", text.squeeze(text.repair_encoding(F.col("text")))), "track_id")


@query("stream_preservation", f"with c as (select workspace, codec_name, count(*) as n from {S.TRACKS} group by 1, 2) select workspace, codec_name, n as n_source, case when codec_name = 'subrip' then n + 1 else n end as n_output, true as kept from c")
def stream_preservation(spark, sf_dir):
    source = subtitle_tracks(spark, sf_dir).select("workspace", "codec_name")
    added = source.where("codec_name = 'subrip'").distinct()
    return tracks.check_stream_counts(source, source.unionByName(added), "workspace", "codec_name", added="subrip")


@query("final_tracks", f"select workspace, coalesce(arg_min(source_language, stream_index * 1000000000000 + track_id) = 'es', false) as first_language, count_if(is_default) = 1 as one_default from {S.TRACKS} group by 1")
def final_tracks(spark, sf_dir):
    t = subtitle_tracks(spark, sf_dir).select("workspace", (F.col("stream_index") * F.lit(10**12) + F.col("track_id")).alias("stream_index"), F.col("source_language").alias("language"), "title", "is_default")
    return pipelines.check_final_tracks(t, "workspace", "es").select("workspace", "first_language", "one_default")


# ---------------------------------------------------------------- translation


@query(
    "apply_translations",
    f"""select track_id, cue_no as line_no, case when cue_no % 5 = 0 then 'translated' else 'kept' end as outcome, case when cue_no % 5 = 0 then regexp_extract(text, '^((\\{{[^}}]*\\}})*)', 1) || 'T' || cue_no else text end as raw
from {S.CUES} where start_ms >= 0 and end_ms >= 0 and text is not null""",
)
def apply_translations(spark, sf_dir):
    """Every fifth line has a translation in the second of two map files; the first holds stale and blank ones."""
    lines = ass_lines(spark, sf_dir)
    fifth = lines.where("line_no % 5 = 0").select("track_id", F.col("line_no").cast("string").alias("k"), F.concat(F.lit("T"), "line_no").alias("v"))
    files = fifth.select("track_id", F.lit(1).alias("file_no"), F.create_map("k", F.lit("stale")).alias("entries")).unionByName(fifth.select("track_id", F.lit(2).alias("file_no"), F.create_map("k", F.col("v")).alias("entries"))).unionByName(fifth.select("track_id", F.lit(3).alias("file_no"), F.create_map("k", F.lit("  ")).alias("entries")))
    done = translate.apply_translations(lines, translate.event_entries(translate.merge_maps(files)))
    return done.select("track_id", "line_no", "outcome", "raw")


@query("song_groups", f"select track_id, string_agg(ch, '' order by n) as text from (select track_id, substr(t, n, 1) as ch, n from (select track_id, t, unnest(range(1, length(t) + 1)) as n from (select distinct track_id, 'song' || track_id as t from cues where track_id is not null))) group by 1")
def song_groups(spark, sf_dir):
    """A line sung letter by letter on each track, put together again."""
    sung = cues(spark, sf_dir).where("track_id is not null").select("track_id").distinct().withColumn("t", F.concat(F.lit("song"), "track_id"))
    letters = sung.select("track_id", F.posexplode(F.split("t", "")).alias("i", "ch")).where("ch <> ''")
    x = F.concat(F.lit("{\\pos("), (F.col("i") * 10).cast("string"), F.lit(",5)}"), F.col("ch"))
    lines = letters.select("track_id", (1000 - F.col("i")).alias("line_no"), F.lit("2").alias("layer"), F.lit("0:00:01.00").alias("start"), F.lit("0:00:02.00").alias("end"), F.lit("SongEnglish").alias("style"), F.lit("fx").alias("effect"), x.alias("raw"))
    return translate.song_groups(lines).select("track_id", "text")


_SUSPECT = "regexp_matches(spanish, '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]\\?[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]|(^|[" + rules.SPACE[1:-1] + "\"''(\\[{])\\?[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]')"


@query(
    "sanitize_maps",
    f"""with {S.spanish_steps(f"(select transcript_id as track_id, cast(seg_no as varchar) as key, text from {S.SEGMENTS} where text is not null and transcript_id is not null)", "text")},
c as (select *, spanish <> text as changed, row_number() over (partition by track_id, spanish <> text order by key) as n from s4)
select track_id, count(*) as entries, count_if(changed) as changed, count_if({_SUSPECT}) as suspicious, coalesce(string_agg(key || '=' || text || '>' || spanish, chr(10) order by key) filter (changed and n <= 25), '') as samples from c group by 1""",
)
def sanitize_maps(spark, sf_dir):
    entries = segments(spark, sf_dir).where("text is not null and transcript_id is not null").select(F.col("transcript_id").alias("track_id"), F.col("seg_no").cast("string").alias("key"), F.col("text").alias("value"))
    report = translate.sanitize_maps(entries)[1]
    return report.withColumn("samples", F.array_join(F.transform("samples", lambda x: F.concat(x["key"], F.lit("="), x["before"], F.lit(">"), x["after"])), "\n"))


# ---------------------------------------------------------------- whole pipelines and streams


@query("normalize_files")
def normalize_files(spark, sf_dir):
    _, found, _ = pipelines.normalize_files(ass_lines(spark, sf_dir), "track_id")
    return found


@query("normalize_report")
def normalize_report(spark, sf_dir):
    return pipelines.normalize_files(ass_lines(spark, sf_dir), "track_id")[2]


@query(
    "audio_subtitles",
    f"""with {_timed_sql(f"(select cue_id, track_id, start_ms / 1000 as s, end_ms / 1000 as e, text from {PLAIN} where text <> '' and track_id % 3 = 0)", "track_id, cue_id")},
l as (select cue_id, track_id, start_ms as s, end_ms as e, list_filter(string_split({S.wrapped('text')}, chr(10)), lambda x: x <> '') as ls from {PLAIN} where text <> '' and track_id not in (select track_id from t5 where end_ms > start_ms)),
g as (select cue_id, track_id, s, e, list_transform(range(0, (len(ls) + 1) // 2), lambda k: array_to_string(list_slice(ls, 2 * k + 1, 2 * k + 2), chr(10))) as gs from l where len(ls) > 0),
w as (select *, list_transform(gs, lambda x: greatest(1, length(replace(replace(x, ' ', ''), chr(10), '')))) as ws from g),
d as (select *, list_transform(ws, lambda x: greatest(250, cast(round_even((e - s) * x / list_sum(ws), 0) as bigint))) as ds from w),
u as (select *, unnest(range(1, len(gs) + 1)) as i from d),
p as (select track_id, case when i = 1 then s else least(e, s + list_sum(list_slice(ds, 1, i - 1))) end as start_ms, case when i = len(gs) then e else least(e, s + list_sum(list_slice(ds, 1, i))) end as end_ms, gs[i] as text from u),
c as (select track_id, cast(start_ms as bigint) as start_ms, cast(end_ms as bigint) as end_ms, text from p where end_ms > start_ms union all select track_id, start_ms, end_ms, text from t5 where end_ms > start_ms)
select track_id, string_agg(n || chr(10) || {S.srt_time('start_ms')} || ' --> ' || {S.srt_time('end_ms')} || chr(10) || text, chr(10) || chr(10) order by n) || chr(10) as content from (select *, row_number() over (partition by track_id order by start_ms, end_ms, text) as n from c) group by 1""",
)
def audio_subtitles(spark, sf_dir):
    """Every third track has timed words, the others are reflowed."""
    c = plain_cues(spark, sf_dir)
    heads = subtitle_tracks(spark, sf_dir).select("track_id", F.col("source_language").alias("language"))
    worded = evenly_timed(c.where("track_id % 3 = 0"), F.col("start_ms") / 1000, F.col("end_ms") / 1000)
    return pipelines.audio_subtitles(c, folds.timed_word_cues(worded, ["track_id", "cue_id"]), heads)[0]


@query(
    "stream_arrivals",
    """select date_trunc('day', ingested_at)::timestamp as window_start, workspace, count(*) as n_cues, cast(sum(greatest(coalesce(end_ms - start_ms, 0), 0)) as bigint) as shown_ms from cues
where date_trunc('day', ingested_at) + interval 1 day <= (select max(ingested_at) - interval 7 day from cues) group by 1, 2""",
)
def stream_arrivals(spark, sf_dir):
    """Cues by day of arrival, counted by a stream over the table's files; days that the watermark has not passed are still open."""
    schema = table(spark, sf_dir, "cues").schema
    found = streaming.read_cues(spark, f"{sf_dir}/cues.parquet", schema)
    shown = streaming.drain(streaming.arrivals(found), scratch_folder(spark, "arrivals"))
    return shown.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# ---------------------------------------------------------------- more of the inventory


@query("split_final_sentence", f"select segment_id, case when h <> '' and t <> '' then h else flat end as head, case when h <> '' and t <> '' then t else '' end as tail from (select segment_id, flat, regexp_extract(flat, '^(.*[.!?])( +)([A-ZÁÉÍÓÚÜÑ¡¿].*)$', 1) as h, regexp_extract(flat, '^(.*[.!?])( +)([A-ZÁÉÍÓÚÜÑ¡¿].*)$', 3) as t from (select segment_id, {S.squeeze('text')} as flat from {S.SEGMENTS} where text is not null))")
def split_final_sentence(spark, sf_dir):
    cut = text.split_final_sentence(F.col("text"))
    return segments(spark, sf_dir).where("text is not null").select("segment_id", cut["head"].alias("head"), cut["tail"].alias("tail"))


@query("alignment_keys", f"select segment_id, {S.sub(S.fold('text'), '[^0-9a-záéíóúüñ]+')} as aligned from {S.SEGMENTS} where text is not null")
def alignment_keys(spark, sf_dir):
    return segments(spark, sf_dir).where("text is not null").select("segment_id", text.alignment_key(F.col("text")).alias("aligned"))


@query("repair_phrases", f"select segment_id, {reduce(lambda y, r: S.sub(y, '(?i)' + r[0], r[1].replace('$1', chr(92) + '1')), rules.SPANISH_PHRASES, 'text')} as fixed from {S.SEGMENTS} where text is not null")
def repair_phrases(spark, sf_dir):
    return segments(spark, sf_dir).where("text is not null").select("segment_id", text.repair_phrases(F.col("text")).alias("fixed"))


@query("dense_cues", f"select cue_id, end_ms - start_ms <= 1800 and len({S.words(S.key('text'))}) >= 7 as dense, end_ms > start_ms as positive from {S.CUES} where text is not null and start_ms is not null and end_ms is not null")
def dense_cues(spark, sf_dir):
    c = cues(spark, sf_dir).where("text is not null and start_ms is not null and end_ms is not null")
    return c.select("cue_id", predicates.is_dense_short_cue(F.col("text"), F.col("end_ms") - F.col("start_ms")).alias("dense"), predicates.has_positive_duration(F.col("start_ms"), F.col("end_ms")).alias("positive"))


@query("result_tally", f"select backend, count(*) as n from {S.HEADERS} group by 1")
def result_tally(spark, sf_dir):
    return tracks.result_tally(headers(spark, sf_dir), "backend")


@query("workspace_paths", f"select track_id, workspace as output_name, 'outputs/' || workspace || '/debug/translation/subtitles/source/' || workspace || '.source.ass' as source_ass, 'outputs/' || workspace || '/' || workspace || '.spa.mkv' as output_mkv from {S.TRACKS}")
def workspace_paths(spark, sf_dir):
    w = discovery.workspace(F.concat(F.lit("inputs/"), F.col("workspace"), F.lit(".mkv")))
    return subtitle_tracks(spark, sf_dir).select("track_id", w["output_name"].alias("output_name"), w["source_ass"].alias("source_ass"), w["output_mkv"].alias("output_mkv"))


@query("detected_language", f"select transcript_id, trim(coalesce(detected_language, '')) as language from {S.HEADERS}")
def detected_language(spark, sf_dir):
    docs = headers(spark, sf_dir).select("transcript_id", F.to_json(F.struct(F.col("detected_language").alias("language"))).alias("content"))
    return docs.select("transcript_id", recogniser.detected_language(F.col("content")).alias("language"))


@query("first_stream", f"select workspace, arg_min(track_id, stream_index * 1000000000000 + track_id) as track_id from {S.TRACKS} group by 1")
def first_stream(spark, sf_dir):
    t = subtitle_tracks(spark, sf_dir).select("workspace", "track_id", (F.col("stream_index") * F.lit(10**12) + F.col("track_id")).alias("stream_index"))
    return tracks.find_stream(t, "workspace").select("workspace", "track_id")


@query("mux_commands", f"select track_id, 'mkvmerge --output out.mkv --default-track-flag ' || mkv_track_id || ':no in.mkv --language 0:spa --track-name 0:Español --default-track-flag 0:yes new.srt' as command from {S.TRACKS}")
def mux_commands(spark, sf_dir):
    command = commands.native_mux_command(F.lit("in.mkv"), F.lit("new.srt"), F.lit("out.mkv"), F.lit("spa"), F.lit("Español"), F.array("mkv_track_id"))
    return subtitle_tracks(spark, sf_dir).select("track_id", F.array_join(command, " ").alias("command"))


@query("event_counts", f"select track_id, count_if(not s) as visible, count_if(s) as skipped from (select track_id, t = '' or (length(tight) >= 8 and replace(tight, left(tight, 1), '') = '') or regexp_matches(raw, '\\\\p[1-9]') as s from (select track_id, text as raw, {S.strip_ass('text')} as t, lower({S.sub(S.strip_ass('text'), rules.SPACE + '+')}) as tight from {S.CUES} where start_ms >= 0 and end_ms >= 0 and text is not null)) group by 1")
def event_counts(spark, sf_dir):
    return pipelines.event_counts(pipelines.normalize_ass(ass_lines(spark, sf_dir)), "track_id").drop("changed")


@query(
    "languages_of_tracks",
    f"""with a as (select lower(trim(alias)) as alias, min(code) as code from language_aliases group by 1),
t as (select track_id, workspace, stream_index, codec_name, is_default, lower(trim(source_language)) as k from {S.TRACKS}),
l as (select track_id, workspace, stream_index, codec_name, is_default, coalesce(x.code, case when contains(k, '-') then y.code end) as code from t left join a x on t.k = x.alias left join a y on split_part(t.k, '-', 1) = y.alias)
select track_id, code as source_language, code is not null as supported, lower(codec_name) in {S.listed(rules.TEXT_CODECS + rules.TEXT_CODEC_IDS)} as textual from l""",
)
def languages_of_tracks(spark, sf_dir):
    return inventory(spark, sf_dir).select("track_id", "source_language", "supported", "textual")


_HEAD = sinks.ASS_HEADER.format(title="Converted text subtitles", width=1920, height=1080, font="Arial", size=54, margin_l=80, margin_r=80, margin_v=48)
ORACLES["ass_files"] = f"""with c as (select distinct track_id, start_ms, end_ms, text from {PLAIN} where text <> '')
select track_id, count(*) as n_cues, {S.q(_HEAD)} || string_agg('Dialogue: 0,' || {S.ass_time('start_ms')} || ',' || {S.ass_time('end_ms')} || ',Default,,0,0,0,,' || {S.replaces("translate(replace(text, chr(92), chr(92) || chr(92)), '{}', '()')", [(chr(10), chr(92) + 'N')])}, chr(10) order by start_ms, end_ms, text) || chr(10) as content from c group by 1"""
ORACLES["tv_srt_files"] = f"""with c as (select distinct track_id, start_ms, end_ms, text from {PLAIN} where text <> ''), n as (select *, row_number() over (partition by track_id order by start_ms, end_ms, text) as n from c)
select track_id, chr(65279) || string_agg(n || chr(10) || {S.srt_time('start_ms')} || ' --> ' || {S.srt_time('end_ms')} || chr(10) || text || chr(10), chr(10) order by n) as content from n group by 1"""
ORACLES["markdown_documents"] = f"""with p as ({ORACLES['paragraphs']}),
b as (select transcript_id, string_agg('## ' || {S.clock('start_s')} || ' - ' || {S.clock('end_s')} || chr(10) || chr(10) || text, chr(10) || chr(10) order by para_no) as body from p group by 1)
select transcript_id, '---' || chr(10) || 'title: ''Recording ' || transcript_id || '''' || chr(10) || 'source_video: ''' || replace(coalesce(workspace, ''), '''', '''''') || '''' || chr(10) || 'backend: ''' || replace(coalesce(backend, ''), '''', '''''') || '''' || chr(10)
|| 'language: ''' || replace(case when coalesce(detected_language, '') = '' then 'und' else detected_language end, '''', '''''') || '''' || chr(10) || 'audio_stream_index: ' || coalesce(cast(audio_stream_index as varchar), '') || chr(10) || 'postprocess_mode: ''clean''' || chr(10)
|| 'generated_at: ''2026-01-01T00:00:00+00:00''' || chr(10) || '---' || chr(10) || chr(10) || '# Recording ' || transcript_id || chr(10) || coalesce(chr(10) || body || chr(10), '') as content from {S.HEADERS} left join b using (transcript_id)"""
