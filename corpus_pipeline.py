"""The training-data pipeline: each stage works on all rows that the one before kept, written as Parquet and read again.

Every stage takes any table with doc_id, text and source, reads its columns by name and gives all columns of its rows back
as they are. Null and empty texts, missing and repeated ids, repeated rows, ties, empty tables and columns of any other
name have the results that the operators' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.bpe import tokenized
from marlstone.llm.common import cleanup, discard, stash, table, written
from marlstone.llm.exact_dedup import drop_copies
from marlstone.llm.mixing import mixed_documents
from marlstone.llm.near_dedup import drop_near_copies
from marlstone.llm.quality_rules import keep_good
from marlstone.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor a learned rule rejects. A null or empty text is rejected for its length."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id. Rows go by id and text; rows alike in both share one answer."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts, the row with the least id. Rows that share an id are judged each by its own text."""
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each reading that the mix takes, whole, in training order; a text without words is never taken."""
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each reading; a null text counts as empty."""
    return tokenized(docs, vocabulary())


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("source mix", source_mix), ("bpe", bpe)]

#: No stage chain: the learned rules and the tokenizer can't be said in SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again; what the stages wrote besides is removed."""
    docs, mark = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        before, docs = docs, stash(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(before)
    cleanup(spark, keep=docs, since=mark)
    return STAGES[-1][1](spark, docs, sf_dir)
