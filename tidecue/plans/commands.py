"""Argument lists of the external programs as arrays of strings (PL10, TK4).

The programs themselves are outside Spark; a job hands each row's list to
whatever runs them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidecue.functions.predicates import check_segmentation, decoding_options


def choose_recogniser(preferred: str, has: Callable[[str], bool]) -> str:
    """TK4: the preferred recogniser, or with auto whisperx before whisper; an error if it isn't there."""
    order = ("whisperx", "whisper") if preferred.lower() == "auto" else (preferred.lower(),)
    for name in order:
        if name in ("whisperx", "whisper") and has(name):
            return name
    raise RuntimeError(f"no recogniser for {preferred!r}")


def _optional(flag: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.array(F.lit(flag), value)).otherwise(F.array().cast("array<string>"))


def recogniser_command(recogniser: str, audio: Column, folder: Column, language: Column, device: str = "cuda", quality: str = "balanced", onset: float = 0.5, offset: float = 0.363, chunk_s: int = 30, batch: int = 8) -> Column:
    """Arguments of a recogniser run over each row's audio."""
    if recogniser == "whisperx":
        check_segmentation(onset, offset, chunk_s)
        preset = decoding_options(quality)
        fixed = {"--model": "large-v3", "--device": device, "--compute_type": "float16", "--batch_size": batch, **{f"--{k}": v for k, v in preset.items()}, "--length_penalty": 1.0, "--temperature": 0, "--condition_on_previous_text": False, "--vad_method": "pyannote", "--vad_onset": onset, "--vad_offset": offset, "--chunk_size": chunk_s}
    elif recogniser == "whisper":
        fixed = {"--model": "turbo", "--task": "transcribe", "--device": device, "--fp16": True, "--verbose": False}
    else:
        raise ValueError(f"unknown recogniser {recogniser!r}")
    options = [F.lit(str(x)) for pair in fixed.items() for x in pair]
    return F.concat(F.array(F.lit(recogniser), audio, *options, F.lit("--output_dir"), folder, F.lit("--output_format"), F.lit("all")), _optional("--language", language))


def recogniser_payload(preferred: str, has: Callable[[str], bool], audio: Column, folder: Column, language: Column, device: str = "cuda", quality: str = "balanced") -> Column:
    """PL10: struct (recogniser, command, settings) of what a run over each row's audio uses.

    settings is a map of names to values as text; a blank language is auto.
    """
    recogniser = choose_recogniser(preferred, has)
    settings = {"model": "large-v3", "compute_type": "float16", "quality_profile": quality, **decoding_options(quality)} if recogniser == "whisperx" else {"model": "turbo", "compute_type": "float16"}
    named = [F.lit(x) for name, value in {"backend": recogniser, "device": device, **settings}.items() for x in (name, str(value))]
    spoken = F.coalesce(F.nullif(language, F.lit("")), F.lit("auto"))
    return F.struct(F.lit(recogniser).alias("recogniser"), recogniser_command(recogniser, audio, folder, language, device, quality).alias("command"), F.create_map(*named, F.lit("language"), spoken).alias("settings"))


def native_mux_command(video: Column, subtitles: Column, output: Column, language: Column, title: Column, subtitle_ids: Column) -> Column:
    """Arguments that add a default subtitle track natively; subtitle_ids is an array of the tracks that lose the flag."""
    old = F.flatten(F.transform(subtitle_ids, lambda i: F.array(F.lit("--default-track-flag"), F.concat(i.cast("string"), F.lit(":no")))))
    new = F.array(video, F.lit("--language"), F.concat(F.lit("0:"), language), F.lit("--track-name"), F.concat(F.lit("0:"), title), F.lit("--default-track-flag"), F.lit("0:yes"), subtitles)
    return F.concat(F.array(F.lit("mkvmerge"), F.lit("--output"), output), old, new)


def copy_mux_command(video: Column, subtitles: Column, output: Column, language: Column, title: Column, n_subtitles: Column) -> Column:
    """Arguments that copy all streams and add a default subtitle stream after n_subtitles others."""
    head = F.array(*[F.lit(x) for x in ("ffmpeg", "-y", "-v", "error", "-i")], video, F.lit("-i"), subtitles, *[F.lit(x) for x in ("-map", "0", "-map", "1:0", "-map_metadata", "0", "-map_chapters", "0", "-c", "copy")])
    none = F.array().cast("array<array<string>>")
    old = F.flatten(F.when(n_subtitles > 0, F.transform(F.sequence(F.lit(0), F.greatest(n_subtitles - 1, F.lit(0))), lambda i: F.array(F.concat(F.lit("-disposition:s:"), i.cast("string")), F.lit("-default")))).otherwise(none))
    n = n_subtitles.cast("string")
    tail = F.array(F.concat(F.lit("-metadata:s:s:"), n), F.concat(F.lit("language="), language), F.concat(F.lit("-metadata:s:s:"), n), F.concat(F.lit("title="), title), F.concat(F.lit("-disposition:s:"), n), F.lit("default"), output)
    return F.concat(head, old, tail)
