"""Exact deduplication by skew-safe combining (DataFrame functions only).

Equal texts are texts that are identical after lower-casing A-Z.  Three
combines, each grouping by the digest *and* the full normalised text:

1. every task deduplicates its own rows (the map-side half of the first group),
2. the tasks' survivors merge within (digest, salt), the salt being taken from
   the task number, so that one group never meets in fewer than ``salts`` places,
3. the salt winners of a digest merge into one global winner.

Afterwards each row looks its group up by digest, length and a second hash;
only groups of two or more are looked up, and a hot digest is dealt over salts.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import salted_lookup


def lower_ascii(text):
    """Lower-case A-Z only; pure ASCII texts take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty.  The largest id of a group stays; rows that
    repeat that id are all marked kept, since they can't be told apart.  Null
    ids are smaller than any other.  An empty table gives an empty result.
    Other columns of ``docs`` are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), lower_ascii(text).alias("norm")).select(
        "doc_id", "norm", F.sha2("norm", 256).alias("text_sha256")
    )
    local = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("text_sha256", "salt", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    )
    winners = local.groupBy("text_sha256", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    checks = [F.octet_length("norm").alias("_len"), F.xxhash64("norm").alias("_hash")]
    copied = winners.where("group_size > 1").select("text_sha256", *checks, "keep_id", "group_size")
    found = salted_lookup(rows.select("doc_id", "text_sha256", *checks), copied, ["text_sha256", "_len", "_hash"], F.col("doc_id"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stay = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_stay")).distinct()
    return docs.join(stay, docs[id_col].eqNullSafe(stay["_stay"]), "left_semi")
