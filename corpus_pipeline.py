"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vistalake.llm import decontaminate, language_id, line_dedup, packing, simhash_dedup
from vistalake.llm.common import materialize, release, scratch_scope, table

#: Documents whose language is less certain than this are rejected, like those without a language.
LANGUAGE_FLOOR = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a determined language; learned from the labelled rows outside the held-out bucket.

    Null, empty and letterless texts go; very long ones are scored whole; repeated rows stay or go alike; without a
    labelled row no document has a language; other columns, whatever their names, stay as they are.
    """
    return language_id.reject(docs, language_id.train(docs), LANGUAGE_FLOOR)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that many sites have (their first occurrence stays).

    A null text stays null, an empty one empty; a null source is a site of its own; repeated rows are changed alike;
    ties of first occurrence go to the smallest id; an empty table stays empty; other columns stay but for ``n_chars``.
    """
    return line_dedup.remove_boilerplate(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id.

    Texts without a word are one group; rows that repeat an id stay or go together; rows without an id stay; very
    long texts are compared whole; an empty table stays empty; other columns stay as they are.
    """
    return simhash_dedup.keep_representatives(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts stay; very long ones are searched whole; repeated rows stay or go alike; an empty table stays
    empty; other columns stay as they are.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document is in the training sequences.

    A null or empty text is one token; a very long one is cut into pieces; repeated rows are packed each on its own;
    an empty table gives no rows; other columns are ignored.
    """
    return packing.sequences(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_copies),
    ("packing", pack_sequences),
]

#: SQL can't express the language model, the fingerprints or the tokenizer; a test compares with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has written is deleted when the next one has been written."""
    with scratch_scope(spark) as kept:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            with scratch_scope(spark) as stays:
                before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
                stays.append(docs)
            release(before)
        kept.append(materialize(STAGES[-1][1](spark, docs, sf_dir), "sequences"))
    return kept[0]
