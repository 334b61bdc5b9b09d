"""The rules of tidecue.functions written as DuckDB SQL, for the oracles.

Each function takes and gives SQL text. They are written from the rules'
definitions, apart from the Spark expressions they check.
"""

from __future__ import annotations

from functools import reduce

from tidecue.functions import rules

SP = rules.SPACE
CUES = "(select distinct cue_id, track_id, workspace, cue_no, start_ms, end_ms, text, identifier from cues)"
SEGMENTS = "(select distinct segment_id, transcript_id, seg_no, start_s, end_s, text from segments)"
HEADERS = "(select distinct transcript_id, workspace, backend, audio_stream_index, detected_language from transcripts)"
TRACKS = "(select distinct track_id, workspace, stream_index, mkv_track_id, codec_name, title, source_language, supported, textual, forced_like, cc_like, is_default, event_count, score from tracks)"
LABELLED = f"(select s.*, h.detected_language as language from {SEGMENTS} s left join {HEADERS} h using (transcript_id))"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{SP}+|{SP}+$")


def squeeze(x: str) -> str:
    return f"trim({sub(f"coalesce({x}, '')", SP + '+', ' ')})"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def bare(x: str) -> str:
    return fold(sub(x, rules.NOT_WORD + "+"))


def key(x: str) -> str:
    return squeeze(sub(fold(squeeze(x)), rules.NOT_WORD + "+", " "))


def words(x: str) -> str:
    return f"list_filter(string_split({squeeze(x)}, ' '), lambda w: w <> '')"


def replaces(x: str, pairs) -> str:
    return reduce(lambda y, p: f"replace({y}, {q(p[0])}, {q(p[1])})", pairs, x)


def repair(x: str, spanish: str | None = None) -> str:
    t = replaces(replaces(x, [(d, "") for d in rules.DROPPED]), rules.MOJIBAKE)
    if spanish is None:
        return t
    es = sub(replaces(t, rules.SPANISH_OPENERS), f"(^|{SP})\\?([A-ZÁÉÍÓÚÑ])", r"\1¿\2")
    return f"case when {spanish} then {es} else {t} end"


def markup(x: str) -> str:
    t = strip(sub(x, f"(?m)^{rules.BLANK}+|{rules.BLANK}+$"))
    t = sub(t, r"(?i)<\s*br\s*/?\s*>", "\n")
    t = sub(t, r"(?i)</?(c|i|b|u|ruby|rt|v|lang)(\.[^ >]+)?(\s+[^>]*)?>")
    t = sub(sub(t, "<[^>]+>").join(["replace(", ", chr(65279), '')"]), "[ \t]+", " ")
    return strip(sub(t, " *\n *", "\n"))


def once_words(x: str) -> str:
    w = words(x)
    kept = f"list_filter({w}, lambda v, i: i = 1 or {bare('v')} = '' or {bare('v')} <> {bare(f'({w})[i - 1]')})"
    return f"case when len({w}) < 2 then {x} else array_to_string({kept}, ' ') end"


def phrases(x: str) -> str:
    marks = "[,.;:!?。！？]"
    found = f"list_filter(regexp_extract_all({squeeze(x)}, {q('[^,.;:!?。！？]*' + marks + '?')}), lambda m: {squeeze(sub('m', marks + '$'))} <> '')"
    phrase = lambda v: squeeze(sub(v, marks + "$"))
    whole = f"list_transform(list_filter({found}, lambda v, i: i = 1 or {bare(phrase('v'))} = '' or {bare(phrase('v'))} <> {bare(phrase(f'({found})[i - 1]'))}), lambda v: {phrase('v')} || regexp_extract(v, {q('(' + marks + ')$')}, 1))"
    return squeeze(f"array_to_string({whole}, ' ')")


def noise(x: str) -> str:
    t = squeeze(x)
    hits = " or ".join(f"regexp_matches({t}, {q('(?i)^' + p + '$')})" for p in rules.NOISE)
    return f"({t} = '' or {hits} or not regexp_matches({t}, '[\\p{{L}}\\p{{N}}]'))"


def listed(items) -> str:
    return "(" + ", ".join(map(q, items)) + ")"


def filler(x: str, language: str) -> str:
    t = sub(fold(squeeze(x)), r"^[.,;:!?¡¿()\[\] ]+|[.,;:!?¡¿()\[\] ]+$")
    base = f"split_part(lower(coalesce({language}, '')), '-', 1)"
    own = " or ".join(f"({base} = {q(code)} and {t} in {listed(fs)})" for code, fs in rules.FILLERS.items())
    return f"({t} = '' or {t} in {listed(rules.GENERIC_FILLERS)} or {own})"


def spanish(language: str) -> str:
    return f"starts_with(lower(coalesce({language}, '')), 'es')"


def cleaned(source: str) -> str:
    """Steps of cleaning a table with text and language, as a chain of selects; the last column is `cleaned`."""
    phrase_rules = reduce(lambda y, r: sub(y, f"(?i){r[0]}", r[1].replace("$1", r"\1")), rules.SPANISH_PHRASES, "fixed")
    return f"""
c1 as (select *, {repair('text', spanish('language'))} as fixed from {source} where text is not null),
c2 as (select * replace ({squeeze(f"case when {spanish('language')} then {phrase_rules} else fixed end")} as fixed) from c1),
c3 as (select *, ({noise('fixed')} or {filler('fixed', 'language')}) as gone, {once_words('fixed')} as worded from c2),
c4 as (select * exclude (fixed, gone, worded), case when gone then '' else {phrases('worded')} end as cleaned from c3)"""


def srt_time(ms: str, point: str = ",") -> str:
    return f"printf('%02d:%02d:%02d{point}%03d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"


def ass_time(ms: str) -> str:
    cs = f"(({ms} // 1000) * 100 + cast(round_even(({ms} % 1000) / 10.0, 0) as bigint))"
    return f"printf('%d:%02d:%02d.%02d', {cs} // 360000, ({cs} // 6000) % 60, ({cs} // 100) % 60, {cs} % 100)"


def clock(s: str) -> str:
    t = f"greatest(0, cast(round_even({s}, 0) as bigint))"
    return f"printf('%02d:%02d:%02d', {t} // 3600, ({t} // 60) % 60, {t} % 60)"


def strip_ass(x: str) -> str:
    t = replaces(sub(x, r"\{[^{}]*\}"), [("\\N", "\n"), ("\\n", "\n"), ("\\h", " ")])
    t = sub(t, r"\\[A-Za-z]+(\([^)]*\))?")
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({t}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]'), lambda l: {squeeze('l')}), lambda l: l <> ''), chr(10))"


def wrapped(x: str, width: int = 52) -> str:
    """Lines of a text as one string divided by line feeds."""
    w = words(x)
    return f"coalesce(list_reduce({w}, lambda a, v: case when a = '' then v when length(regexp_extract(a, '[^\\n]*$')) + 1 + length(v) <= {width} then a || ' ' || v else a || chr(10) || v end, ''), '')"


def overlap(left: str, right: str) -> str:
    most = f"least(len({left}), len({right}))"
    return f"coalesce(list_max(list_filter(range(1, {most} + 1), lambda k: list_slice({left}, len({left}) - k + 1, len({left})) = list_slice({right}, 1, k))), 0)"


def trimmed(left: str, right: str) -> str:
    a, b = squeeze(left), squeeze(right)
    stem = f"left({a}, length({a}) - length({b}))"
    cut = sub(stem, "[ ,;:-]+$")
    colon = f"ends_with({sub(stem, SP + '+$')}, ':')"
    short = f"(length({b}) < 18 and len({words(key(b))}) < 4)"
    return f"case when not {short} and {a} <> {b} and ends_with({a}, {b}) and {b} <> '' and {cut} <> '' then {cut} || case when {colon} then '.' else '' end end"


_MARK = ("qzj", "jzq")


def _encoded(text: str) -> str:
    """A text with its letters and digits beyond ASCII written as ASCII words, so that word borders fall where Unicode has them."""
    return "".join(f"{_MARK[0]}{ord(ch)}{_MARK[1]}" if ord(ch) > 127 and ch.isalnum() else ch for ch in text)


def spanish_steps(source: str, column: str, out: str = "spanish") -> str:
    """SC10 of a column as a chain of selects s1 to s4; the last adds `out`."""
    a, z = _MARK
    encoded = f"array_to_string(list_transform(string_split({column}, ''), lambda c: case when unicode(c) > 127 and regexp_matches(c, '[\\p{{L}}\\p{{N}}]') then '{a}' || unicode(c) || '{z}' else c end), '')"
    spelt = reduce(lambda x, rule: sub(x, _encoded(rule[0]), _encoded(rule[1])), rules.SPANISH_SPELLINGS, "enc")
    decoded = f"array_to_string(list_transform(string_split(enc, '{a}'), lambda e, i: case when i = 1 then e else chr(cast(split_part(e, '{z}', 1) as int)) || substr(e, length(split_part(e, '{z}', 1)) + {len(z) + 1}) end), '')"
    before = f"(^|[{SP[1:-1]}\"'(\\[{{])\\?"
    opened = sub("dec", before + r"([A-ZÁÉÍÓÚÜÑ][^?\n!]{0,80}!)", r"\1¡\2")
    asked = sub(opened, before + r"([A-ZÁÉÍÓÚÜÑ][^?\n]{0,80}\?)", r"\1¿\2")
    tagged = replaces(asked, [("?no?", "¿no?"), ("?verdad?", "¿verdad?")])
    single = sub(sub(tagged, "¿{2,}", "¿"), "¡{2,}", "¡")
    tidy = strip(sub(sub(single, "[ \t]+", " "), " *\n *", "\n"))
    return f"""
s1 as (select *, {encoded} as enc from {source}),
s2 as (select * replace ({spelt} as enc) from s1),
s3 as (select * exclude (enc), {decoded} as dec from s2),
s4 as (select * exclude (dec), {tidy} as {out} from s3)"""


def suspects(source: str, key: str, column: str) -> str:
    """SC11: (key, offset, context) of suspicious question marks."""
    letter, lead = "[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]", f"[{SP[1:-1]}\"'(\\[{{]"
    at = lambda k: f"substr({column}, {k}, 1)"
    start = f"case when i = 1 or regexp_matches({at('i - 1')}, {q(letter)}) then i else i - 1 end"
    return f"""select {key}, cast({start} - 1 as integer) as "offset", replace(substr({column}, greatest(1, {start} - 30), i + 31 - greatest(1, {start} - 30)), chr(10), '\\n') as context
from (select {key}, {column}, unnest(range(1, length({column}) + 1)) as i from {source} where contains({column}, '?'))
where {at('i')} = '?' and regexp_matches({at('i + 1')}, {q(letter)}) and (i = 1 or regexp_matches({at('i - 1')}, {q(letter)}) or regexp_matches({at('i - 1')}, {q(lead)}))"""
