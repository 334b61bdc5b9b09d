"""Listings of inputs and maps (SRC17, SRC21, SRC22, SC25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecue.functions.text import output_folder_name


def list_inputs(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """SRC21: (path, name, stem) of a folder's files by name, without its subfolders' files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder).select("path")
    name = F.substring_index("path", "/", -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("stem")).orderBy("name")


def duplicate_stems(inputs: DataFrame) -> DataFrame:
    """SRC22: (stem, n) of stems that several inputs share."""
    return inputs.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def translation_maps(files: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """SRC17: (keys, file_no, path): translations_all.json alone where there is one, else translations_*.json by name."""
    name = F.substring_index(path, "/", -1)
    maps = files.withColumn("_name", name).where(F.col("_name").rlike(r"^translations_.*\.json$"))
    whole = maps.where("_name = 'translations_all.json'").select(*keys).distinct()
    chosen = maps.join(whole.withColumn("_all", F.lit(True)), keys, "left").where(F.col("_all").isNull() | (F.col("_name") == "translations_all.json"))
    listed = chosen.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_name", path))).alias("_l"))
    return listed.select(*keys, F.posexplode("_l").alias("file_no", "_f")).select(*keys, "file_no", F.col("_f")[path].alias(path))


def workspace(path: Column, tool: str = "translation", folder: str = "") -> Column:
    """SC25: struct of the paths derived from an input's path, for a tool: translation, audio or text.

    Intermediate files lie in a folder named like the tool, or as given.
    """
    name = output_folder_name(path)
    stem = F.regexp_replace(F.regexp_extract(F.translate(path, "\\", "/"), "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    out = F.concat(F.lit("outputs/"), name)
    debug = F.concat(out, F.lit("/debug/" + (folder or tool)))
    at = lambda base, tail, suffix="": F.concat(base, F.lit("/" + tail), *([stem, F.lit(suffix)] if suffix else []))
    common = [name.alias("output_name"), out.alias("output_dir"), debug.alias("debug_dir"), at(debug, "reports").alias("reports_dir")]
    own = {
        "translation": [at(debug, "subtitles").alias("subtitles_dir"), at(debug, "translations").alias("translations_dir"), at(debug, "subtitles/source/", ".source.ass").alias("source_ass"), at(debug, "subtitles/generated/", ".spa.ass").alias("spanish_ass"), at(debug, "subtitles/generated/", ".spa.srt").alias("tv_safe_srt"), at(debug, "reports/spanish_normalization_report.json").alias("normalization_report"), at(debug, "reports/remux_validation_report.json").alias("remux_validation_report"), at(debug, "checkpoints/translation_checkpoint.json").alias("translation_checkpoint"), at(out, "", ".spa.mkv").alias("output_mkv")],
        "audio": [at(debug, "audio/", ".wav").alias("audio_wav"), at(out, "", ".srt").alias("output_srt"), at(out, "", ".mkv").alias("output_mkv")],
        "text": [at(debug, "audio/", ".wav").alias("audio_wav"), at(out, "", ".md").alias("markdown"), at(out, "", ".srt").alias("output_srt")],
    }[tool]
    return F.struct(*common, *own)
