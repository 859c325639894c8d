"""The corpus pipeline: named stages, each written as Parquet and read again for the next.

Defined cases, each as in the stage's operator. A null text is empty; ``quality`` drops it, as it has no words.
Rows that share an id are judged each by ``quality``, and are one document for ``lines``, ``near`` and ``decontaminate``: the
latter two keep or drop them together. A null id is a document of its own that ``near`` and ``decontaminate`` keep. Equal texts of different ids
leave the smallest id. Without labels only the base rules reject; without benchmark items nothing is contaminated; an
empty table of documents gives no rows. Further columns, of any name, pass through all stages but the last, which has its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.bpe import bpe_digests
from colloquy.llm.common import materialise, new_path, sized_semi_join
from colloquy.llm.decontaminate import contaminated
from colloquy.llm.line_dedup import line_dedup
from colloquy.llm.near_dedup import near_duplicates
from colloquy.llm.quality_rules import kept_only


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return kept_only(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that three or more hold; n_chars follows the text."""
    out = line_dedup(docs).select("row.*")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (as op6: two-word shingles, similarity 0.8): the smallest id."""
    others = materialise(near_duplicates(docs, size=2).filter("NOT kept").select(F.col("__id").alias("doc_id")), "near-copies")
    return sized_semi_join(docs, others, "doc_id", how="left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    hits = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return sized_semi_join(docs, hits.select(F.col("__id").alias("doc_id")), "doc_id", how="left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    return bpe_digests(docs)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("decontaminate", decontaminate), ("encode", encode)]
#: The quality, near-duplicate and decontamination stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
