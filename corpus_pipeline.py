"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that its predecessor kept and decides anew:
what the language stage rejects is gone, the line stage's texts are without
the dropped lines, the join leaves the document of the smallest id of each
group, decontamination drops documents with benchmark windows, and the rest
is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlark.llm import concat_cut, jaccard_fragments, language_fusion, line_runs, winnowing
from flowlark.llm.shared import materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; see ``language_fusion.accepted_documents``."""
    return language_fusion.accepted_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; n_chars follows the text, other columns stay."""
    found = line_runs.dedup_lines(docs).drop("n_lines", "n_dropped")
    if "n_chars" not in found.columns:
        return found
    kind = docs.schema["n_chars"].dataType
    return found.withColumn("n_chars", F.char_length("text").cast(kind))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; see ``jaccard_fragments.one_of_each``."""
    return jaccard_fragments.one_of_each(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows; see ``winnowing.decontaminate``."""
    return winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; see ``concat_cut.pack``."""
    return concat_cut.pack(docs).drop("ids")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("copies", copies),
    ("benchmarks", benchmarks),
    ("packing", packing),
]

#: Language ID and tokenization are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
