"""Predicates and filters (PR1-PR12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidecue.functions import rules
from tidecue.functions.text import comparable_key, fold_case, squeeze, words


def looks_like_vector_path(c: Column) -> Column:
    """PR1: drawing commands and numbers only."""
    t = F.lower(F.trim(F.translate(c, "\n", " ")))
    rest = F.regexp_replace(t, r"\b[mlbns]\b", "")
    return t.rlike(r"^[mlbns]\s+-?\d") & (F.regexp_count(t, F.lit(r"\b[mlbns]\b")) >= 2) & (F.regexp_count(t, F.lit(r"-?\d+(\.\d+)?")) >= 8) & ~rest.rlike("[a-zA-Z]")


def has_drawing_mode(c: Column) -> Column:
    r"""PR2: \p1 to \p9."""
    return c.rlike(r"\\p[1-9]")


def looks_like_placeholder(c: Column) -> Column:
    """PR3: one character only, at least eight times."""
    t = F.lower(F.regexp_replace(c, f"{rules.SPACE}+", ""))
    return (F.length(t) >= 8) & (F.replace(t, F.substring(t, 1, 1), F.lit("")) == "")


def is_skippable(style: Column, effect: Column, raw: Column, text: Column) -> Column:
    """PR4: karaoke, drawings, placeholders and empty events. (Its digit test can never hold.)"""
    return (
        F.lower(style).rlike("romaji|kanji")
        | F.lower(effect).isin("fx", "karaoke")
        | has_drawing_mode(raw)
        | looks_like_vector_path(text)
        | (text == "")
        | looks_like_placeholder(text)
    )


def has_positive_duration(start: Column, end: Column) -> Column:
    """PR5."""
    return end > start


def is_noise(c: Column) -> Column:
    """PR6: empty, a bracketed sound, channel boilerplate, or nothing but marks."""
    t = squeeze(c)
    hit = reduce(lambda a, b: a | b, [t.rlike(f"(?iuU)^{p}$") for p in rules.NOISE])
    return (t == "") | hit | ~t.rlike(r"[\p{L}\p{N}]")


def is_filler_only(c: Column, language: Column) -> Column:
    """PR7: the whole text is a filler word of its language, or a generic one."""
    t = F.regexp_replace(fold_case(squeeze(c)), r"^[.,;:!?¡¿()\[\] ]+|[.,;:!?¡¿()\[\] ]+$", "")
    lang = F.lower(F.coalesce(language, F.lit("")))
    base = F.substring_index(lang, "-", 1)
    own = reduce(lambda a, b: a | b, [base.isin(code) & t.isin(*fillers) for code, fillers in rules.FILLERS.items()])
    return (t == "") | t.isin(*rules.GENERIC_FILLERS) | own


def is_text_codec(name: Column, codec_id: Column | None = None) -> Column:
    """PR8."""
    values = [F.lower(F.coalesce(x, F.lit(""))) for x in (name, codec_id) if x is not None]
    known = rules.TEXT_CODECS + rules.TEXT_CODEC_IDS
    return reduce(lambda a, b: a | b, [v.isin(*known) for v in values])


def is_forced_track(title: Column, flag: Column) -> Column:
    """PR9: flagged, or named so."""
    t = F.lower(F.coalesce(title, F.lit("")))
    return F.coalesce(flag, F.lit(False)) | F.contains(t, F.lit("forced")) | F.contains(t, F.lit("forzado"))


def is_caption_track(title: Column) -> Column:
    """PR9: for the hard of hearing by its title; 'cc' anywhere counts."""
    t = F.lower(F.coalesce(title, F.lit("")))
    return F.contains(t, F.lit("cc")) | F.contains(t, F.lit("closed caption")) | F.contains(t, F.lit("sdh"))


DENSE_MS, DENSE_WORDS = 1800, 7


def is_dense_short_cue(c: Column, duration_ms: Column) -> Column:
    """PR10: seven words or more within 1.8 seconds."""
    return (duration_ms <= DENSE_MS) & (F.size(words(comparable_key(c))) >= DENSE_WORDS)


def is_song_style(style: Column) -> Column:
    """PR12."""
    return F.contains(style, F.lit("English"))


def decoding_options(quality: str = "balanced", beam_size: int | None = None, patience: float | None = None) -> dict:
    """PR11: preset values unless given; an error outside their ranges."""
    if quality not in rules.DECODING_PRESETS:
        raise ValueError(f"unknown quality {quality!r}; one of {sorted(rules.DECODING_PRESETS)}")
    beam, wait = rules.DECODING_PRESETS[quality]
    beam, wait = (beam if beam_size is None else beam_size), (wait if patience is None else patience)
    if beam < 1 or wait <= 0:
        raise ValueError("beam_size must be at least 1 and patience above 0")
    return {"beam_size": int(beam), "patience": float(wait)}


def check_segmentation(onset: float, offset: float, chunk_s: int) -> None:
    """PR11: voice-detection bounds."""
    if not (0 <= onset <= 1 and 0 <= offset <= 1 and 1 <= chunk_s <= 30):
        raise ValueError("onset and offset lie between 0 and 1, chunks between 1 and 30 seconds")
