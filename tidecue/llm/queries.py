"""Registered queries of this subpackage and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecue.llm.encoding import encode_documents
from tidecue.llm.langid import alias_table, document_languages, fit_model, transcript_languages
from tidecue.llm.mojibake import find_garbled, restore_texts
from tidecue.llm.packing import pack_documents
from tidecue.llm.residue import find_residue
from tidecue.llm.runs import collapse_runs
from tidecue.llm.sentences import split_sentences
from tidecue.llm.splitting import split_documents
from tidecue.session import filter_before_shuffles, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def budgets(spark: SparkSession, sf_dir: str, purpose: str) -> list[tuple]:
    """The budgets of a purpose; the table is fixed at a few rows."""
    found = table(spark, sf_dir, "token_budgets").where(F.col("purpose") == purpose).orderBy("budget_id")
    return [tuple(r) for r in found.select("budget_id", "tokenizer", "max_tokens", "overlap_tokens").collect()]


def records(spark: SparkSession, sf_dir: str, *tabs: str) -> DataFrame:
    """(tab, row_id, text) of the text tables named, deliveries included."""
    ids = {"cues": "cue_id", "segments": "segment_id", "documents": "doc_id"}
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("tab"), F.col(ids[t]).alias("row_id"), "text") for t in tabs]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for tab, key in (("segments", "segment_id"), ("documents", "doc_id")):
        found = find_residue(table(spark, sf_dir, tab), key)
        parts.append(found.select(F.lit(tab).alias("tab"), "row_id"))
    return parts[0].unionByName(parts[1]).distinct()


@query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    filter_before_shuffles(spark)
    asked = table(spark, sf_dir, "sentence_checks")
    parts = []
    for tab in ("cues", "segments", "documents"):
        # a Bloom filter of the keys, of at most 8 MB, keeps other texts from being shuffled
        keys = asked.where(F.col("tab") == tab).select("row_id")
        texts = records(spark, sf_dir, tab).where("text is not null")
        parts.append(texts.join(keys, "row_id", "left_semi").dropDuplicates(["row_id"]).select("tab", "row_id", "text"))
    return split_sentences(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["tab", "row_id"])


@query("p3_units")
def p3_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of every record; deliveries count once."""
    return split_sentences(records(spark, sf_dir, "cues", "segments", "documents").dropDuplicates(["tab", "row_id"]), ["tab", "row_id"])


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, row_id, para_no, code, confidence, case) of documents, passages, transcripts and foreign segments."""
    aliases = alias_table(spark, table(spark, sf_dir, "language_aliases"))
    documents = table(spark, sf_dir, "documents")
    model = fit_model(spark, documents, aliases)
    whole, foreign = transcript_languages(table(spark, sf_dir, "segments"), table(spark, sf_dir, "transcripts"), model, aliases)
    found = document_languages(documents, model, aliases)
    tab = F.when(F.col("para_no") == 0, F.lit("documents")).otherwise(F.lit("passages"))
    out = found.select(tab.alias("tab"), F.col("doc_id").alias("row_id"), "para_no", "code", "confidence", "case")
    for name, part in (("transcripts", whole), ("segments", foreign)):
        out = out.unionByName(part.select(F.lit(name).alias("tab"), F.col("id").alias("row_id"), F.lit(0).alias("para_no"), "code", "confidence", "case"))
    return out


@query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(spark, sf_dir).where("case").select("tab", "row_id", "para_no", "code")


@query("p4_languages")
def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(spark, sf_dir).drop("case")


@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(table(spark, sf_dir, "segments")).select("transcript_id", "first_seg_no", "last_seg_no")


@query("p5_runs")
def p5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(table(spark, sf_dir, "segments"), least=1)


@query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(records(spark, sf_dir, "cues", "segments", "documents")).select("tab", "row_id")


@query("p6_restored")
def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore_texts(records(spark, sf_dir, "cues", "segments", "documents"))


@query("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), "byte_bpe_50k")


@query("p8_pack")
def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), [b[:3] for b in budgets(spark, sf_dir, "pack")])


@query("p9_split")
def p9_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(table(spark, sf_dir, "documents"), budgets(spark, sf_dir, "split"))
