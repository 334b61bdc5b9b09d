"""Language labels: profiles, container codes, recogniser codes (J2-J4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecue.functions import rules


def with_profile(df: DataFrame, label: str, aliases: DataFrame, out: str = "profile_code") -> DataFrame:
    """J2: df with the profile code of a label: its alias, else that of its part before the first hyphen; null otherwise.

    The alias table has a fixed few dozen rows; Spark decides by its size how to join.
    """
    names = aliases.select(F.lower(F.trim("alias")).alias("_alias"), F.col("code").alias("_code")).dropDuplicates(["_alias"])
    key = F.lower(F.trim(F.col(f"`{label}`")))
    keyed = df.withColumn("_whole", key).withColumn("_base", F.when(F.contains(key, F.lit("-")), F.substring_index(key, "-", 1)))
    exact = keyed.join(names.select(F.col("_alias").alias("_whole"), F.col("_code").alias("_exact")), "_whole", "left")
    both = exact.join(names.select(F.col("_alias").alias("_base"), F.col("_code").alias("_part")), "_base", "left")
    return both.withColumn(out, F.coalesce("_exact", "_part")).drop("_whole", "_base", "_exact", "_part")


def with_container_language(df: DataFrame, label: str) -> DataFrame:
    """J3: container code and display name of a label; unknown labels pass through, blank ones become und."""
    table = F.create_map(*[x for k, (code, name) in rules.CONTAINER_LANGUAGES.items() for x in (F.lit(k), F.struct(F.lit(code).alias("code"), F.lit(name).alias("name")))])
    key = F.lower(F.trim(F.coalesce(F.col(f"`{label}`"), F.lit(""))))
    found = F.try_element_at(table, key)
    code = F.coalesce(found["code"], F.when(key == "", F.lit("und")).otherwise(key))
    name = F.coalesce(found["name"], F.when(key == "", F.lit("desconocido")).otherwise(F.col(f"`{label}`")))
    return df.withColumn("mkv_language", code).withColumn("language_display", name)


def with_recogniser_language(df: DataFrame, label: str, out: str = "recogniser_code") -> DataFrame:
    """J4: two-letter code for the recogniser from a container's three-letter or regional label; null if unknown."""
    short = {code: k for k, (code, _) in reversed(list(rules.CONTAINER_LANGUAGES.items())) if len(k) == 2} | {"zho": "zh", "fra": "fr", "deu": "de"}
    table = F.create_map(*[F.lit(x) for pair in short.items() for x in pair])
    key = F.substring_index(F.lower(F.trim(F.col(f"`{label}`"))), "-", 1)
    return df.withColumn(out, F.coalesce(F.try_element_at(table, key), F.when(key.isin(*sorted(set(short.values()))), key)))
