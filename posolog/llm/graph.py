"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posolog.llm.common import stored

#: Links of a round that are written to one file.
ROWS_A_FILE = 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) lead to.

    Only nodes with an edge to another node appear.  Each round hangs the larger
    neighbours of a node, then the smaller ones, on the smallest; rounds grow with
    the logarithm of the longest path.  Minima are combined before they are shuffled
    and joined back, so a node with very many neighbours is no group in one task.
    Every round is written to the shared folder once, where its lineage ends, in as many
    files as its rows need: on a local folder each file costs a process of its own.
    """
    links = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen, rows = None, links.count()
    while True:
        # Large star: neighbours above a node hang on the least of it and its neighbours.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(least, "a")
            .filter("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        # Small star: a node and its smaller neighbours hang on the least of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .filter("a <> b")
            .distinct()
        )
        links = stored(small.repartition(1 + rows // ROWS_A_FILE))
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen, rows = mark, mark[0]
