"""A corpus pipeline over ``documents``: each stage gets what the one before it kept, and its decisions take effect.

The stages but the last return the columns of ``documents``; the last one adds the tokens'
digests to the documents that are left.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmaspark.llm import bpe, decontam, langid, lines, neardup
from sigmaspark.llm.common import crc_mod, forget, made_dirs, shared_dir, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those it rejects go."""
    model = langid.fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")  # whatever the columns' names
    judged = langid.predict(rows, model)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= langid.REJECT)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites are cut from all documents but the first; a document left without text goes."""
    return lines.cleaned_rows(docs)


def settled(spark: SparkSession, ids: Callable[[], DataFrame]) -> DataFrame:
    """The document ids that ``ids`` gives, written to a folder of their own; what they were worked out from is removed."""
    path, before = shared_dir(spark), len(made_dirs(spark))
    out = stored(ids(), f"{path}/ids")
    for done in made_dirs(spark)[before:]:
        forget(spark, done)
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    kept = settled(spark, lambda: neardup.groups(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct())
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = settled(spark, lambda: decontam.report(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("_id")).distinct())
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]), "left_anti").select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again, and what it was made from is removed."""
    path = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before = len(made_dirs(spark))
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"{path}/{i}-{name}")
            for done in [*made_dirs(spark)[before:], *([f"{path}/{i - 1}-{STAGES[i - 1][0]}"] if i else [])]:
                forget(spark, done)
    return docs


#: Language identification and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None
