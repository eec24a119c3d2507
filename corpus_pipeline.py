"""From documents to training tokens: language ID, line dedup, near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns the columns of
documents; the last one returns tokens. A stage's rows are written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratacube import scratch
from stratacube.llm import bpe, decontam, langid, line_dedup, minhash
from stratacube.llm.common import step, table
from stratacube.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones among docs.

    Null, empty and letterless texts go, and without any label all do. Long texts are judged as a whole; repeated rows
    have one fate; columns of any name stay; an empty table stays empty.
    """
    return langid.accepted(docs, langid.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source are taken out of the texts; no row goes.

    Null texts and those of a null source stay as they are, as do empty ones; of long texts all lines are looked at. A
    line just at the ratio stays. Repeated rows count as one page; columns of any name stay; an empty table stays empty.
    """
    return line_dedup.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Rows with a null id, and null, empty and wordless texts stay; rows that repeat a kept id do too. Whole texts are
    compared; just at the threshold is a copy. Columns of any name stay; an empty table stays empty.
    """
    return minhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go.

    Null and empty texts stay; every word of long texts is looked at; repeated rows have one fate. Null items are left
    out, and an empty benchmark takes nothing away. Columns of any name stay; an empty table stays empty.
    """
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded of each document.

    Null and empty texts have no ids and decode to ''; whole texts of any length are encoded; a null id stays null;
    repeated rows repeat; other columns are left behind, whatever their names; an empty table gives an empty one.
    """
    return bpe.encode_texts(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", encoding),
]

#: SQL can't express the classifier or the encoder; the tests hold each stage against plain code.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. When a stage is written, what it made on the way and what it read go."""
    docs, since = table(spark, sf_dir, "documents"), scratch.mark()
    for name, stage in STAGES[:-1]:
        docs = step(stage(spark, docs, sf_dir), f"stage-{name}", since)
    return STAGES[-1][1](spark, docs, sf_dir)
