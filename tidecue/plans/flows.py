"""Registered queries of whole flows and of the smaller sources, sinks and commands, and the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecue.functions import predicates, rules, text
from tidecue.operators import tracks, translate
from tidecue.plans import commands, pipelines, queries
from tidecue.plans import sql as S
from tidecue.plans.queries import ORACLES, query
from tidecue.session import scratch_folder
from tidecue.sources import discovery, recogniser, sinks
from tidecue.streaming import cues as streaming

GENERATED_AT = "2026-01-01T00:00:00+00:00"


# ---------------------------------------------------------------- whole flows


def transcribed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    heads = queries.headers(spark, sf_dir).select("transcript_id", F.concat(F.lit("Recording "), "transcript_id").alias("title"), F.col("workspace").alias("source_video"), "backend", F.col("detected_language").alias("language"), "audio_stream_index")
    return pipelines.transcribe(queries.segments(spark, sf_dir), heads, GENERATED_AT)


_SETTLED = f"select transcript_id, case when lower(coalesce(detected_language, '')) in {S.listed(['', *rules.UNSURE_LABELS])} and coalesce(signs >= 4, false) then 'es' else detected_language end as language from {S.HEADERS} left join i3 using (transcript_id)"


@query(
    "transcript_report",
    f"""with {queries.INFERRED}, h as ({_SETTLED}), src as (select s.*, h.language from {S.SEGMENTS} s left join h using (transcript_id)), {S.cleaned('src')},
d as (select *, {S.bare('cleaned')} as k, lag({S.bare('cleaned')}) over (partition by transcript_id order by start_s, seg_no) as before from c4 where cleaned <> '' and transcript_id is not null),
k as (select transcript_id, count(*) as n_clean from d where k = '' or before is null or k <> before group by 1),
a as (select transcript_id, count(*) as n_input from {S.SEGMENTS} group by 1)
select transcript_id, case when coalesce(language, '') = '' then 'und' else language end as language, n_input, coalesce(n_clean, 0) as n_clean, n_input - coalesce(n_clean, 0) as n_removed from a left join k using (transcript_id) left join h using (transcript_id)""",
)
def transcript_report(spark, sf_dir):
    return transcribed(spark, sf_dir)[2].select("transcript_id", "language", "n_input", "n_clean", "n_removed")


@query("transcript_alignment")
def transcript_alignment(spark, sf_dir):
    """PL7's aligned paragraphs; their scores come from a sequence matcher that SQL lacks."""
    return transcribed(spark, sf_dir)[0].select("transcript_id", "para_no", "start_s", "end_s", "text", "score", "low", F.array_join("warnings", "; ").alias("warnings"))


@query("transcript_markdown")
def transcript_markdown(spark, sf_dir):
    return transcribed(spark, sf_dir)[1]


MAP_TERMS = [("T", "Term"), ("song", "Song")]
_ASS = f"(select track_id, cue_no, {S.ass_time('start_ms')} as s, {S.ass_time('end_ms')} as e, text from {S.CUES} where start_ms >= 0 and end_ms >= 0 and text is not null)"
_TAGS = r"regexp_extract(text, '^((\{[^}]*\})*)', 1)"


@query(
    "translated_files",
    f"""with last as (select track_id, max(cue_no) as n from {_ASS} group by 1),
songs as (select track_id, 'Sign' as style, s, e, cue_no from {_ASS} where cue_no % 7 = 0),
once as (select track_id, style, s, e from songs group by 1, 2, 3, 4),
numbered as (select *, row_number() over (partition by track_id order by s, style, e) as k from once)
select track_id, cast(cue_no as integer) as line_no, s as start, case when cue_no % 5 = 0 then 'translated' when cue_no % 3 = 0 then 'blanked' else 'kept' end as outcome, case when cue_no % 5 = 0 then {_TAGS} || 'Term' || cue_no when cue_no % 3 = 0 then {_TAGS} else text end as raw from {_ASS}
union all select track_id, cast(n + k as integer), s, 'appended', 'Song of ' || s from numbered join last using (track_id)""",
)
def translated_files(spark, sf_dir):
    """PL5: every fifth line translated by its number, every third one of a sung style, songs for every seventh."""
    lines = queries.ass_lines(spark, sf_dir)
    sung = (F.col("line_no") % 3 == 0).cast("boolean")
    lines = lines.withColumn("style", F.when(sung, F.lit("SongEnglish")).otherwise(F.col("style"))).withColumn("effect", F.when(sung, F.lit("fx")).otherwise(F.col("effect")))
    events = lines.where("line_no % 5 = 0").select("track_id", F.create_map(F.col("line_no").cast("string"), F.concat(F.lit("T"), "line_no")).alias("entries"))
    songs = lines.where("line_no % 7 = 0").select("track_id", F.create_map(F.concat_ws("|", F.lit("Sign"), "start", "end"), F.concat(F.lit("song of "), "start")).alias("entries"))
    maps = events.unionByName(songs).withColumn("file_no", F.lit(1))
    return translate.translated_files(lines, maps, terms=MAP_TERMS, blank_song_letters=True)[0].select("track_id", "line_no", "start", "outcome", "raw")


@query("translated_report", f"select track_id, count_if(cue_no % 5 = 0) as translated, count_if(cue_no % 5 <> 0 and cue_no % 3 = 0) as blanked, count(distinct case when cue_no % 7 = 0 then s || '|' || e end) as appended from {_ASS} group by 1")
def translated_report(spark, sf_dir):
    done = translated_files(spark, sf_dir)
    tally = lambda outcome: F.count_if(F.col("outcome") == outcome).alias(outcome)
    return done.groupBy("track_id").agg(*map(tally, ("translated", "blanked", "appended")))


@query(
    "exported_subtitles",
    f"""with c as (select track_id, start_ms, count(*) as n, count(distinct (end_ms, text)) as m from {queries.PLAIN} where text <> '' group by 1, 2)
select track_id, cast(sum(n) as bigint) as n_cues, cast(sum(m) as integer) as n_dialogues, 1 as delta, sum(n) = sum(m) as passed from c group by 1""",
)
def exported_subtitles(spark, sf_dir):
    """PL9's export, of packets that begin one millisecond after the extracted cues."""
    c = queries.plain_cues(spark, sf_dir)
    return pipelines.export_synchronized(c.select("track_id", (F.col("start_ms") + 1).alias("start_ms")), c)[1]


@query(
    "spanish_tv_cues",
    f"""with {S.spanish_steps(f"(select track_id, {S.ass_time('start_ms')} as s, {S.ass_time('end_ms')} as t, {S.strip_ass('text')} as text, text as raw from {S.CUES} where start_ms >= 0 and end_ms >= 0 and text is not null)", "text")},
f as (select *, lower(replace(spanish, chr(10), ' ')) as low, lower({S.sub('spanish', rules.SPACE + '+')}) as tight from s4),
p as (select track_id, spanish, list_transform(string_split(s, ':'), lambda x: cast(x as double)) as a, list_transform(string_split(t, ':'), lambda x: cast(x as double)) as b from f
where spanish <> '' and not regexp_matches(raw, '\\\\p[1-9]') and not (length(tight) >= 8 and replace(tight, left(tight, 1), '') = '')
and not (regexp_matches(trim(low), '^[mlbns]\\s+-?\\d') and len(regexp_extract_all(low, '\\b[mlbns]\\b')) >= 2 and len(regexp_extract_all(low, '-?\\d+(?:\\.\\d+)?')) >= 8 and not regexp_matches({S.sub('low', chr(92) + 'b[mlbns]' + chr(92) + 'b')}, '[a-zA-Z]'))),
m as (select track_id, cast(round((a[1] * 3600 + a[2] * 60 + a[3]) * 1000) as bigint) as start_ms, cast(round((b[1] * 3600 + b[2] * 60 + b[3]) * 1000) as bigint) as end_ms, spanish as text from p)
select distinct track_id, start_ms, end_ms, text from m where end_ms > start_ms""",
)
def spanish_tv_cues(spark, sf_dir):
    """PL2: television cues with Spanish spelling."""
    return pipelines.tv_safe_cues(queries.ass_lines(spark, sf_dir), "track_id", spanish=True)


def _skipped(raw: str, shown: str) -> str:
    """PR4 of a dialogue of the default style."""
    low, tight = f"lower(replace({shown}, chr(10), ' '))", f"lower({S.sub(shown, rules.SPACE + '+')})"
    vector = f"(regexp_matches(trim({low}), '^[mlbns]\\s+-?\\d') and len(regexp_extract_all({low}, '\\b[mlbns]\\b')) >= 2 and len(regexp_extract_all({low}, '-?\\d+(?:\\.\\d+)?')) >= 8 and not regexp_matches({S.sub(low, chr(92) + 'b[mlbns]' + chr(92) + 'b')}, '[a-zA-Z]'))"
    return f"({shown} = '' or regexp_matches({raw}, '\\\\p[1-9]') or (length({tight}) >= 8 and replace({tight}, left({tight}, 1), '') = '') or {vector})"


def _ms(clock: str) -> str:
    parts = f"list_transform(string_split({clock}, ':'), lambda x: cast(x as double))"
    return f"cast(round(({parts}[1] * 3600 + {parts}[2] * 60 + {parts}[3]) * 1000) as bigint)"


# PL4: spelling, then shared prefixes, then doubled cues, then repeated tails, then cues for television
_LINES = f"(select track_id, cue_no, {S.ass_time('start_ms')} as s, {S.ass_time('end_ms')} as e, text, {_TAGS} as tags, substr(text, length({_TAGS}) + 1) as rest, {S.strip_ass('text')} as shown from {S.CUES} where start_ms >= 0 and end_ms >= 0 and text is not null)"
_FILES = f"""with recursive {S.spanish_steps(_LINES, "rest")},
spelt as materialized (select track_id, cue_no, s, e, {_skipped('text', 'shown')} as skipped, not contains(rest, '{{') and not contains(rest, '}}') and spanish <> {S.strip('rest')} as change, text, tags, spanish from s4),
lines as materialized (select track_id, cue_no, s, e, skipped, not skipped and change as changed, case when not skipped and change then tags || spanish else text end as raw from spelt),
seen as materialized (select track_id, cue_no, s, e, raw, {S.strip_ass('raw')} as text from lines),
src as materialized (select *, {_ms('s')} as start_ms, {_ms('e')} as end_ms from seen where not {_skipped('raw', 'text')}),
{queries.REDISTRIBUTED.replace(queries.SHOWN, 'src').replace("select track_id, n, next_no,", "select track_id, n2, next_no,")},
m0 as (select track_id, max(n) as n from n0 group by 1),
moved as materialized (select track_id, done_no as cue_no, done as text from w0 where done_no is not null and done_changed union all select track_id, cue_no, body from w0 join m0 using (track_id, n) where changed),
timed as materialized (select s.track_id, s.cue_no, s.s, s.e, s.start_ms, s.end_ms, coalesce(m.text, s.text) as text, case when m.text is null then s.raw else regexp_extract(s.raw, '^((\\{{[^}}]*\\}})*)', 1) || m.text end as raw from src s left join moved m using (track_id, cue_no)),
{queries.WHY.replace(queries.SHOWN, 'timed')},
z as (select *, lead(case when why is not null then end_ms end) over (partition by track_id order by cue_no) as gone from y),
kept as (select track_id, cue_no, s, e, raw, text, end_ms as had, greatest(end_ms, coalesce(gone, end_ms)) as end_ms from z where why is null),
tails as (select *, lead(text) over (partition by track_id order by cue_no) as after from kept),
final as materialized (select track_id, s, case when end_ms > had then {S.ass_time('end_ms')} else e end as e, case when cut is null then raw else regexp_extract(raw, '^((\\{{[^}}]*\\}})*)', 1) || cut end as raw from (select *, {S.trimmed('text', 'after')} as cut from tails)
  union all select l.track_id, l.s, l.e, l.raw from lines l anti join timed using (track_id, cue_no)),
{S.spanish_steps(f"(select *, {S.strip_ass('raw')} as text from final)", "text").replace("s1 as", "v1 as").replace("from s1", "from v1").replace("s2 as", "v2 as").replace("from s2", "from v2").replace("s3 as", "v3 as").replace("from s3", "from v3").replace("s4 as", "v4 as")},
shows as materialized (select distinct track_id, {_ms('s')} as start_ms, {_ms('e')} as end_ms, spanish as text from v4 where not {_skipped('raw', 'spanish')} and {_ms('e')} > {_ms('s')})"""

ORACLES["normalize_files"] = f"{_FILES} select * from shows"
ORACLES["normalize_report"] = f"""{_FILES},
marks as (select track_id, count(*) as n from ({S.suspects('final', 'track_id', 'raw')}) group by 1 union all select track_id, count(*) from ({S.suspects('shows', 'track_id', 'text')}) group by 1)
select l.track_id, count_if(not skipped) as visible, count_if(skipped) as skipped, count_if(changed) as changed, coalesce(any_value(m.n), 0) as suspicious from lines l left join (select track_id, sum(n) as n from marks group by 1) m using (track_id) group by 1"""


@query("normalized_lines", f"{_FILES} select track_id, cast(cue_no as integer) as line_no, skipped, changed, raw from lines")
def normalized_lines(spark, sf_dir):
    """PL3, SC12: dialogues with Spanish spelling behind their tags."""
    return pipelines.normalize_ass(queries.ass_lines(spark, sf_dir)).select("track_id", "line_no", "skipped", "changed", "raw")


@query("normalized_counts", f"{_FILES} select track_id, count_if(not skipped) as visible, count_if(skipped) as skipped, count_if(changed) as changed from lines group by 1")
def normalized_counts(spark, sf_dir):
    """AG5 whole."""
    return pipelines.event_counts(pipelines.normalize_ass(queries.ass_lines(spark, sf_dir)), "track_id")


# ---------------------------------------------------------------- text and predicates


@query("visible_text", f"select cue_id, {S.strip(S.replaces(S.sub('text', chr(92) + '{[^{}]*' + chr(92) + '}'), [(chr(92) + 'N', ' '), (chr(92) + 'n', ' ')]))} as visible, {_TAGS} || 'x' as replaced from {S.CUES} where text is not null")
def visible_text(spark, sf_dir):
    t = F.col("text")
    return queries.cues(spark, sf_dir).where("text is not null").select("cue_id", text.visible_text(t).alias("visible"), text.replace_keeping_tags(t, F.lit("x")).alias("replaced"))


@query("quoting", f"select cue_id, '''' || replace(text, '''', '''''') || '''' as quoted, '@(' || array_to_string(list_transform({S.words('text')}, lambda w: '''' || replace(w, '''', '''''') || ''''), ',') || ')' as listed from {S.CUES} where text is not null")
def quoting(spark, sf_dir):
    t = F.col("text")
    return queries.cues(spark, sf_dir).where("text is not null").select("cue_id", text.quote_single(t).alias("quoted"), text.quote_list(text.words(t)).alias("listed"))


@query("song_styles", f"select track_id, contains('Song' || coalesce(title, ''), 'English') as sung from {S.TRACKS}")
def song_styles(spark, sf_dir):
    return queries.subtitle_tracks(spark, sf_dir).select("track_id", predicates.is_song_style(F.concat(F.lit("Song"), F.coalesce("title", F.lit("")))).alias("sung"))


@query("written_natively", f"select track_id, case when codec_name in ('ass', 'subrip') then 'mkvmerge-native' else 'ffmpeg-shared-timeline' end as strategy from {S.TRACKS}")
def written_natively(spark, sf_dir):
    formats = F.when(F.col("codec_name").isin("ass", "subrip"), F.lit("Matroska, webm")).when(F.col("codec_name").isNotNull(), F.lit("mov,mp4"))
    return queries.subtitle_tracks(spark, sf_dir).select("track_id", tracks.remux_strategy(formats).alias("strategy"))


@query("probe_offsets", f"select transcript_id, case when d < 30 then '0.0' else round(d * 0.035, 3) || ' ' || round(d * 0.35, 3) || ' ' || round(d * 0.63, 3) end as offsets from (select transcript_id, floor(max(coalesce(end_s, start_s))) as d from {S.SEGMENTS} where transcript_id is not null and start_s is not null group by 1)")
def probe_offsets(spark, sf_dir):
    """SE6 over the length of each recording in whole seconds."""
    ends = queries.segments(spark, sf_dir).where("transcript_id is not null and start_s is not null").groupBy("transcript_id").agg(F.floor(F.max(F.coalesce("end_s", "start_s"))).cast("double").alias("d"))
    return ends.select("transcript_id", F.array_join(tracks.probe_offsets(F.col("d")).cast("array<string>"), " ").alias("offsets"))


# ---------------------------------------------------------------- sources


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up listings of each transcript's folder: which files there are depends on its number."""
    heads = queries.headers(spark, sf_dir).select("transcript_id").distinct()
    n = F.col("transcript_id")
    names = F.array(F.when(n % 2 == 0, F.lit("talk.json")), F.when(n % 3 == 0, F.lit(".json")), F.lit("b.json"), F.lit("a.json"), F.lit("a.txt"), F.when(n % 2 == 0, F.lit("translations_all.json")), F.lit("translations_b.json"), F.lit("translations_a.json"))
    return heads.select("transcript_id", F.explode(F.array_compact(names)).alias("name")).withColumn("path", F.concat(F.lit("raw/"), n.cast("string"), F.lit("/"), "name"))


_IDS = "(select distinct transcript_id from transcripts)"


@query("backend_outputs", f"select transcript_id, 'raw/' || transcript_id || '/' || case when transcript_id % 2 = 0 then 'talk.json' when transcript_id % 3 = 0 then '.json' else 'a.json' end as path from {_IDS}")
def backend_outputs(spark, sf_dir):
    return recogniser.backend_output(_files(spark, sf_dir), ["transcript_id"], "talk", ".json")


@query("translation_files", f"select transcript_id, cast(i as integer) as file_no, 'raw/' || transcript_id || '/translations_' || case when transcript_id % 2 = 0 then 'all' when i = 0 then 'a' else 'b' end || '.json' as path from (select transcript_id, unnest(range(0, case when transcript_id % 2 = 0 then 1 else 2 end)) as i from {_IDS})")
def translation_files(spark, sf_dir):
    return discovery.translation_maps(_files(spark, sf_dir), ["transcript_id"])


@query("duplicate_stems", "select 'workspace' || transcript_id % 40 as stem, count(*) as n from (select distinct transcript_id from transcripts) group by 1 having count(*) > 1")
def duplicate_stems(spark, sf_dir):
    heads = queries.headers(spark, sf_dir).select("transcript_id").distinct()
    return discovery.duplicate_stems(heads.select(F.concat(F.lit("workspace"), F.col("transcript_id") % 40).alias("stem")))


@query("json_arguments", f"select transcript_id, workspace, backend from {S.HEADERS} where workspace is not null and backend is not null")
def json_arguments(spark, sf_dir):
    """SRC23: settings written as JSON, those of odd recordings as base64."""
    heads = queries.headers(spark, sf_dir).where("workspace is not null and backend is not null")
    written = F.to_json(F.struct("workspace", "backend"))
    argument = F.when(F.col("transcript_id") % 2 == 0, written).otherwise(F.base64(written.cast("binary")))
    return heads.select("transcript_id", recogniser.json_argument(argument, "workspace string, backend string").alias("a")).select("transcript_id", "a.workspace", "a.backend")


# ---------------------------------------------------------------- sinks and commands


@query("report_rows", f"select track_id, '{{\"workspace\":' || coalesce(to_json(workspace)::varchar, 'null') || ',\"title\":' || coalesce(to_json(title)::varchar, 'null') || ',\"event_count\":' || coalesce(event_count::varchar, 'null') || '}}' as report from {S.TRACKS}")
def report_rows(spark, sf_dir):
    return sinks.report_lines(queries.subtitle_tracks(spark, sf_dir).select("track_id", "workspace", "title", "event_count"), "track_id")


@query("written_texts", f"select transcript_id, string_agg({S.squeeze('text')}, chr(10) order by seg_no) || chr(10) as content from {S.SEGMENTS} where text is not null group by 1")
def written_texts(spark, sf_dir):
    """SNK8, SNK11: text files written in the shared folder and read back."""
    folder = scratch_folder(spark, "texts")
    sinks.write_contents(queries.txt_files(spark, sf_dir), folder, "transcript_id", public=False)
    return spark.read.parquet(f"{folder}/debug").select("transcript_id", "content")


@query("recogniser_payloads", f"select transcript_id, 'whisper' as recogniser, 'whisper a/' || transcript_id || '.wav --model turbo --task transcribe --device cuda --fp16 True --verbose False --output_dir raw --output_format all' || case when coalesce(detected_language, '') = '' then '' else ' --language ' || detected_language end as command, case when coalesce(detected_language, '') = '' then 'auto' else detected_language end as language from {S.HEADERS}")
def recogniser_payloads(spark, sf_dir):
    """TK4, PL10: what a run of the only recogniser at hand uses."""
    heads = queries.headers(spark, sf_dir)
    payload = commands.recogniser_payload("auto", lambda name: name == "whisper", F.concat(F.lit("a/"), "transcript_id", F.lit(".wav")), F.lit("raw"), F.col("detected_language"))
    return heads.select("transcript_id", payload.alias("p")).select("transcript_id", "p.recogniser", F.array_join("p.command", " ").alias("command"), F.col("p.settings")["language"].alias("language"))


@query("copy_commands", f"select track_id, 'ffmpeg -y -v error -i in.mp4 -i new.srt -map 0 -map 1:0 -map_metadata 0 -map_chapters 0 -c copy ' || case when track_id % 3 = 0 then '' when track_id % 3 = 1 then '-disposition:s:0 -default ' else '-disposition:s:0 -default -disposition:s:1 -default ' end || '-metadata:s:s:' || track_id % 3 || ' language=spa -metadata:s:s:' || track_id % 3 || ' title=Español -disposition:s:' || track_id % 3 || ' default out.mkv' as command from {S.TRACKS}")
def copy_commands(spark, sf_dir):
    command = commands.copy_mux_command(F.lit("in.mp4"), F.lit("new.srt"), F.lit("out.mkv"), F.lit("spa"), F.lit("Español"), (F.col("track_id") % 3).cast("int"))
    return queries.subtitle_tracks(spark, sf_dir).select("track_id", F.array_join(command, " ").alias("command"))


# ---------------------------------------------------------------- streams


@query("stream_clean_cues", f"select distinct cue_id, track_id, start_ms, end_ms, {S.squeeze(S.repair(S.markup('text')))} as text from cues")
def stream_clean_cues(spark, sf_dir):
    """Each cue once and cleaned, from a stream over the table's files."""
    found = streaming.read_cues(spark, f"{sf_dir}/cues.parquet", queries.table(spark, sf_dir, "cues").schema)
    cleaned = streaming.clean(streaming.once(found)).select("cue_id", "track_id", "start_ms", "end_ms", "text")
    return streaming.drain(cleaned, scratch_folder(spark, "clean-cues"))
