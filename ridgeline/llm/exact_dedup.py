"""Exact deduplication by skew-safe combining.

Whole texts are compared at every stage; digests only deal rows out:

1. local: the map side of the first aggregation meets equal (digest, salt, text) keys inside one
   partition, so a text leaves a partition once however often it stands there;
2. salted: those rows are merged by (digest, salt, text), so that the partitions' rows of one hot text are
   spread over ``salts`` reducers;
3. global: the at most ``salts`` winners of a text are merged by (digest, text), after which it is known how many texts each digest names;
4. documents look up their group, by digest alone where the third stage has found that it names one text, and by whole text where it names several.
   No text is shuffled for the first. A hot digest on the documents' side is a skewed left side of a join, which AQE splits.

Of rows that repeat a group's largest id the first by row number stays; numbers are given once, in a written table, and compared by a partial maximum.

Defined results: null is the empty text; empty texts form one group; a null id counts as the smallest; repeated ids are separate
rows, of which one stays; further columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, whole_text

SALTS = 16


def normalised(text: Column) -> Column:
    """A-Z to lower case and nothing else. lower() is far quicker and the same for ASCII texts."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), normalised(whole_text(text_col)).alias("_text"))


def groups(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct text of rows (_id, _text, _digest): _digest, _text, keep_id, group_size."""
    salt = F.pmod(F.xxhash64("_id") + F.spark_partition_id(), F.lit(salts))
    salted = rows.withColumn("_salt", salt).groupBy("_digest", "_salt", "_text").agg(F.max("_id").alias("_top"), F.count(F.lit(1)).alias("_n"))
    return salted.groupBy("_digest", "_text").agg(F.max("_top").alias("keep_id"), F.sum("_n").alias("group_size"))


def _looked_up(rows: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Rows (_row, _id, ``key``) with keep_id, group_size and kept, of groups by the same key."""
    first = rows.groupBy(*key).agg(F.max(F.struct("_id", (-F.col("_row")).alias("_row"))).alias("_first"))
    placed = rows.join(found.join(first, key), key)
    return placed.withColumn("kept", F.col("_row") == -F.col("_first._row"))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (of the normalised text). ``digest`` deals texts out; any function of the text will do."""
    rows = _rows(docs, id_col, text_col).withColumn("_digest", digest(F.col("_text")))
    named = [F.col("_digest").alias("text_sha256")] if digest is sha256 else [sha256(F.col("_text")).alias("text_sha256")]
    light = materialise(rows.select("_id", "_digest", *named).withColumn("_row", F.monotonically_increasing_id()), "digests")
    found = groups(rows, salts).groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    found = materialise(found, "groups")
    out = [F.col("_id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256"]
    single = _looked_up(light, found.where("_texts = 1").drop("_texts"), ["_digest"]).select(*out)
    shared = found.where("_texts > 1").select("_digest")
    if not shared.limit(1).count():
        return single
    # a digest that names several texts
    mixed = materialise(rows.join(shared, "_digest", "left_semi").withColumn("_row", F.monotonically_increasing_id()), "collisions")
    return single.unionByName(_looked_up(mixed, groups(mixed, salts), ["_digest", "_text"]).withColumn("text_sha256", sha256(F.col("_text"))).select(*out))
