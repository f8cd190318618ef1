"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the one before has kept, and returns a DataFrame; all but the last return the
columns of documents. Stages hand over files, which are read in no order, so the mixture's order goes along as ``mix_position`` (from 0).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm.byte_bpe import token_digests
from ridgeline.llm.common import materialise, table
from ridgeline.llm.line_dedup import without_repeated_lines
from ridgeline.llm.mixing import in_order, mixed
from ridgeline.llm.near_dedup import keep_one_of_each
from ridgeline.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; every document stays."""
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return keep_one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture, and mix_position."""
    return mixed(docs, position_col="mix_position")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of what they decode to, the ids (little-endian, unsigned 32 bits) and mix_position, in the order of the mixture."""
    return token_digests(in_order(docs, "mix_position"), with_ids=True, carry=("mix_position",))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: No SQL can express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
