"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of ``block`` bytes.  The distinct blocks are sorted and
numbered; the number is the block's name.  Adjacent names are paired, the distinct
pairs sorted and numbered in turn, and so on until each text has one name.  A name
stands for one content only, so two texts are equal exactly if their last names
are: no hash decides.  A hash only spares work: a text whose (length, 64-bit hash)
no other row has differs from all others and needs no name.

Defined cases: null text counts as empty; rows that repeat a ``doc_id`` are rows
like any other; null ids sort below all others; an empty table gives an empty
result; only the two named columns are read, so others may clash at will.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posolog.llm.common import partitions, stored, text_or_empty


#: Ranges are drawn from so many first bytes of a block and a hash of the whole, which
#: parts blocks that begin alike: their sample goes to the driver.
RANGE_BYTES = 16


def numbered(values: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct rows, numbered from 1 in sorted order (with gaps), as ``_name``.

    Blocks are ordered by their first bytes, then hash, then all bytes.  Equal rows meet within each task before the range-partitioned sort, and the
    table is written, so that every reader sees the same numbers.
    """
    kinds = dict(values.dtypes)
    ranges = []
    for c in columns:
        ranges += [F.substring(c, 1, RANGE_BYTES), F.xxhash64(c)] if kinds[c] == "binary" else [F.col(c)]
    return stored(
        values.select(*columns)
        .distinct()
        .repartitionByRange(partitions(values.sparkSession), *ranges)
        .sortWithinPartitions(*ranges, *columns)
        .withColumn("_name", F.monotonically_increasing_id() + F.lit(1))
    )


def identities(blocks: DataFrame) -> DataFrame:
    """(row, bytes, name): equal (bytes, name) exactly where all blocks are equal.

    ``blocks`` has row, bytes, at (0, 1, ...) and block.  A level halves the number
    of names of a row; a row without a right neighbour pairs with 0, no name.
    """
    level = stored(
        blocks.join(numbered(blocks, ["block"]), "block").select("row", "bytes", "at", "_name")
    )
    most = level.agg(F.max("at")).first()[0] or 0
    for _ in range(math.ceil(math.log2(most + 1))):
        left = level.filter(F.col("at") % 2 == 0).select(
            "row", "bytes", (F.col("at") / 2).cast("int").alias("at"), F.col("_name").alias("_a")
        )
        right = level.filter(F.col("at") % 2 == 1).select(
            "row", ((F.col("at") - 1) / 2).cast("int").alias("at"), F.col("_name").alias("_b")
        )
        pairs = stored(left.join(right, ["row", "at"], "left").fillna(0, ["_b"]))
        level = stored(
            pairs.join(numbered(pairs, ["_a", "_b"]), ["_a", "_b"]).select("row", "bytes", "at", "_name")
        )
    return level.select("row", "bytes", F.col("_name").alias("name"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 4096
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The largest id of equal texts stays (of rows that share it too, all do).
    """
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        text.cast("binary").alias("_text"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.xxhash64(text).alias("_hash"),
        F.sha2(text, 256).alias("text_sha256"),
    )
    slim = stored(rows.drop("_text"))
    shared = stored(slim.groupBy("bytes", "_hash").agg(F.count("*").alias("_n")).filter("_n > 1"))
    shared = shared.select("bytes", "_hash")
    count = F.greatest(F.ceil(F.col("bytes") / block), F.lit(1)).cast("int")
    blocks = stored(
        rows.join(shared, ["bytes", "_hash"], "left_semi")
        .withColumn("row", F.monotonically_increasing_id())
        .select(
            "row", "doc_id", "bytes", "text_sha256", "_text",
            F.explode(F.sequence(F.lit(0), count - 1)).alias("at"),
        )
        .select(
            "row", "bytes", "at",
            F.substring("_text", F.col("at") * block + 1, F.lit(block)).alias("block"),
            F.when(F.col("at") == 0, F.struct("doc_id", "text_sha256")).alias("head"),
        )
    )
    named = stored(
        blocks.filter("at = 0").select("row", "head.*").join(identities(blocks.drop("head")), "row")
    )
    groups = named.groupBy("bytes", "name").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    several = named.join(groups, ["bytes", "name"])
    single = slim.join(shared, ["bytes", "_hash"], "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256"
    )
    return (
        several.select(single.columns)
        .unionByName(single)
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


#: The same result from plain grouping by the text itself.
SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""
