"""Timestamps of subtitle formats: text to milliseconds and back (TM1-TM7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, MINUTE, SECOND = 3_600_000, 60_000, 1_000


def _int(c: Column) -> Column:
    return c.try_cast("bigint")


def parse_timestamp(c: Column) -> Column:
    """TM1: [HH:]MM:SS.mmm or with a comma, to ms; null if it isn't one. Fractions are cut or filled to three digits."""
    parts = F.split(F.replace(c, F.lit(","), F.lit(".")), ":")
    n = F.size(parts)
    seconds = F.split(F.get(parts, n - 1), r"\.")
    ms = _int(F.rpad(F.substring(F.get(seconds, F.lit(1)), 1, 3), 3, "0"))
    hours = F.when(n == 3, _int(F.get(parts, F.lit(0)))).when(n == 2, F.lit(0))
    return hours * HOUR + _int(F.get(parts, n - 2)) * MINUTE + _int(F.get(seconds, F.lit(0))) * SECOND + ms


def parse_srt_timestamp(c: Column) -> Column:
    """TM2: strictly HH:MM:SS,mmm; null otherwise."""
    return F.when(c.rlike(r"^\d{2}:\d{2}:\d{2},\d{3}$"), parse_timestamp(c))


def ass_time_to_ms(c: Column) -> Column:
    """TM3: H:MM:SS.cc to ms; hundredths are filled or cut to two digits."""
    parts = F.split(F.trim(c), ":")
    seconds = F.split(F.get(parts, F.lit(2)), r"\.")
    cs = _int(F.rpad(F.substring(F.coalesce(F.get(seconds, F.lit(1)), F.lit("0")), 1, 2), 2, "0"))
    return _int(F.get(parts, F.lit(0))) * HOUR + _int(F.get(parts, F.lit(1))) * MINUTE + _int(F.get(seconds, F.lit(0))) * SECOND + cs * 10


def ms_to_ass_time(ms: Column) -> Column:
    """TM4: ms to H:MM:SS.cc, hundredths rounded half to even with carry."""
    ms = ms.cast("bigint")
    cs = (F.floor(ms / SECOND) * 100 + F.rint((ms % SECOND) / 10).cast("bigint")).cast("bigint")
    return F.format_string("%d:%02d:%02d.%02d", (cs / 360_000).cast("bigint"), ((cs / 6_000).cast("bigint") % 60), ((cs / 100).cast("bigint") % 60), cs % 100)


def ms_to_srt_time(ms: Column, point: str = ",") -> Column:
    """TM5: ms to HH:MM:SS,mmm; hours may take more than two digits."""
    ms = ms.cast("bigint")
    return F.format_string(f"%02d:%02d:%02d{point}%03d", (ms / HOUR).cast("bigint"), ((ms / MINUTE).cast("bigint") % 60), ((ms / SECOND).cast("bigint") % 60), ms % 1000)


def seconds_to_ms(s: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.rint(s * 1000).cast("bigint"))


def seconds_to_srt_time(s: Column) -> Column:
    """TM6: seconds to HH:MM:SS,mmm, half to even, never below 0."""
    return ms_to_srt_time(seconds_to_ms(s))


def seconds_to_vtt_time(s: Column) -> Column:
    return ms_to_srt_time(seconds_to_ms(s), ".")


def format_time(s: Column) -> Column:
    """TM7: whole seconds, half to even, as HH:MM:SS, never below 0."""
    t = F.greatest(F.lit(0).cast("bigint"), F.rint(s).cast("bigint"))
    return F.format_string("%02d:%02d:%02d", (t / 3600).cast("bigint"), ((t / 60).cast("bigint") % 60), t % 60)
