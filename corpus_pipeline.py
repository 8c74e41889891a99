"""From raw documents to piece ids, in five stages. Each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platewise.llm.decontaminate import drop_leaks
from platewise.llm.line_dedup import drop_repeated_lines
from platewise.llm.near_dedup import keep_representatives
from platewise.llm.pieces import encode_pieces, load_vocabulary
from platewise.llm.quality import clean_documents
from platewise.llm.queries import tokenizer
from platewise.session import configure, cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail or lose too much."""
    configure(spark)
    return clean_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies of a line only the first stays; documents left without words go."""
    configure(spark)
    return drop_repeated_lines(docs, tau=2)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id."""
    configure(spark)
    return keep_representatives(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    configure(spark)
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"), stride=1, short=True)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left."""
    configure(spark)
    return encode_pieces(docs, load_vocabulary(tokenizer("piece_bpe_32k.model")))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_copies), ("decontamination", decontaminate), ("pieces", pieces)]

# Edit distance over all lines, shingle sets and piece ids are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
