"""Exact dedup: group by a 128-bit content hash, keep one stable id, and
compare bytes inside the groups to exclude collisions.

Only DataFrame expressions.  The hash table is narrow (id, md5, sha-256);
texts are shuffled only to be met by the table of hashes that occur more
than once, and compared with the text of their group's kept row.  A group
of any size is spread over salts for that comparison (one salt per
``COMPARE_ROWS`` copies), so no task holds a whole group.

Defined results
---------------
* null text counts as the empty text; all empty texts are equal.
* rows without an id: they are copies like others but lose against any row
  with an id; in a group without any id ``keep_id`` is null and every row
  is kept.
* repeated rows (same id and same text) are one document: they share the
  verdict.
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, empty_if_null, write_table

COMPARE_ROWS = 500


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "smallest", hash_bits: int = 128, merge_join: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``.  Texts are equal when identical after lower-casing A-Z.
    ``keep`` names the id that stays: ``smallest`` or ``largest``.
    ``hash_bits`` below 128 shortens the hash (tests force collisions).
    ``merge_join`` shuffles the texts to the repeated hashes even where those
    are small enough to broadcast: the same plan at every size."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = ascii_lower(empty_if_null(F.col(text_col)))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("norm"))
    rows = rows.withColumn("h", F.substring(F.unhex(F.md5(F.col("norm").cast("binary"))), 1, hash_bits // 8))

    ids = write_table(
        rows.select("doc_id", "h", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha")), "dedup-ids")
    groups = write_table(
        ids.groupBy("h").agg(F.count(F.lit(1)).alias("n"), best("doc_id").alias("keep_id")).where("n > 1"),
        "dedup-groups")

    # Bytes: every copy against the text of the row that its hash keeps.
    repeated = groups.hint("merge") if merge_join else groups
    members = write_table(rows.join(repeated, "h"), "dedup-members")
    salts = F.ceil(F.col("n") / F.lit(COMPARE_ROWS)).cast("int")
    kept_text = (
        members.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("h", "n").agg(F.min("norm").alias("kept_norm"))
        .select("h", "kept_norm", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    )
    # Of copies without an id the text itself deals the salt.
    salt = F.pmod(F.xxhash64("doc_id", F.length("norm")), salts).cast("int")
    differ = (
        members.withColumn("salt", salt)
        .join(kept_text, ["h", "salt"])
        .where(F.col("norm") != F.col("kept_norm"))
        .select("h").distinct()
    )
    collided = write_table(differ, "dedup-collided")
    collided_none = collided.isEmpty()

    plain = ids if collided_none else ids.join(collided, "h", "left_anti")
    out = plain.join(groups, "h", "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    if not collided_none:
        # Different texts under one hash: group those rows by the text itself.
        clash = members.join(collided, "h").select("doc_id", "norm")
        exact = clash.groupBy("norm").agg(F.count(F.lit(1)).alias("n"), best("doc_id").alias("keep_id"))
        out = out.unionByName(clash.join(exact, "norm").select(
            "doc_id", "keep_id", F.col("n").alias("group_size"),
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")))
    return out.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )
