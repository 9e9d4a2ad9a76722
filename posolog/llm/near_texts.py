"""Near-duplicate texts: sets of five-word shingles with a Jaccard share of 0.8 or more.

Candidates are first those of SimHash: each set has a fingerprint, the majority of the
bits of its shingles' hashes, and the byte-position index of ``simhash`` with its count
of five shared bytes finds the fingerprints that differ in up to 3 bits.  A pair at 0.8
differs in about 10 of the 64 bits (standard deviation 3), beyond what an index of
positional bytes can promise (7 bits), so the sets also meet by min-hashes: two are
candidates as well if all five min-hashes of one of 24 bands are equal, which misses a
pair at 0.8 with a chance of 7 in 100,000, a closer one more seldom.  Every candidate of
either kind is checked on its whole sets, so no pair below 0.8 is linked.

Equal sets are one node, named by 128 bits.  Each band's nodes are first linked to
its smallest only, so many copies of one text are never all pairs.  Nodes of a band
that are in different components after that (texts that share a long passage, say)
are not paired either: these nodes' shingles are put in one order, rare ones first,
and of two sets at 0.8 the smaller has one of the pair's common shingles in its first
ninth, the larger has it in its first fifth.  Shingles of a passage that many such
texts share come late in that order, so they bring no pairs.

Defined cases: words are those of ``simhash.fingerprint``; a text of fewer than five
words is one shingle; null text and text without words have the empty set, which
equals only itself; rows that repeat a ``doc_id`` are nodes by their sets; a null id
is smaller than none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posolog.llm.common import stored, text_or_empty
from posolog.llm.graph import components
from posolog.llm.simhash import SEED, bit_counts, majority, near_fingerprints

SHINGLE = 5
BANDS = 24
ROWS = 5

_RANDOM = np.random.default_rng(SEED)
_FLIPS = _RANDOM.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
_FACTORS = _RANDOM.integers(0, 2**63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the text's different shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    hashes = (xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True))
    return np.unique(np.fromiter(hashes, np.uint64, n))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One hash a band, of the band's number and its min-hashes; none of the empty set."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        mixed = (hashes[at : at + 4096] ^ _FLIPS) * _FACTORS
        np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(1), out=least)
    return np.array([xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def set_fingerprint(hashes: np.ndarray) -> int:
    """The majority of the bits of a set's hashes; 0 of the empty set."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        total += bit_counts(hashes[at : at + 65536])
    return majority(total, len(hashes))


def _node(hashes: np.ndarray) -> bytes:
    from xxhash import xxh128_digest

    return xxh128_digest(hashes.tobytes(), SEED)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(text.as_py()) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([_node(s) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array(np.array([set_fingerprint(s) for s in sets], np.uint64).view(np.int64)),
                pa.array([bands(s).view(np.int64) for s in sets], pa.list_(pa.int64())),
            ],
            ["doc_id", "node", "n", "value", "bands"],
        )


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = [_node(shingles(text.as_py())) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), batch.column("text")], ["node", "text"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(text.as_py()).view(np.int64) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])


def _may_be_near(one: Column, other: Column) -> Column:
    """The smaller set must hold 0.8 of the larger one's number."""
    return F.least(one, other) * 5 >= F.greatest(one, other) * 4


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets share 0.8 of their union."""
    pairs = stored(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("one")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("hashes").alias("other")), "b"
    )
    both = F.size(F.array_intersect("one", "other"))
    return joined.filter(both * 9 >= (F.size("one") + F.size("other")) * 4).select("a", "b")


def simhash_candidates(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of (node, n, value) whose fingerprints the index of ``simhash`` links.

    Of equal fingerprints the smallest node stands for all and is paired with each.
    """
    marked = nodes.filter("n > 0").select("node", "n", "value")
    first = stored(marked.groupBy("value").agg(F.min(F.struct("node", "n")).alias("first")))
    equal = marked.join(first, "value").select(
        F.col("node").alias("a"), F.col("n").alias("one"), F.col("first.node").alias("b"), F.col("first.n").alias("other")
    )
    ends = [
        first.select(F.col("value").alias(end), F.col("first.node").alias(f"{end}_node"), F.col("first.n").alias(f"{end}_n"))
        for end in ("a", "b")
    ]
    linked = near_fingerprints(first.select("value")).distinct().join(ends[0], "a").join(ends[1], "b")
    near = linked.select(F.col("a_node").alias("a"), F.col("a_n").alias("one"), F.col("b_node").alias("b"), F.col("b_n").alias("other"))
    pairs = equal.filter("a <> b").unionByName(near)
    return pairs.filter(_may_be_near(F.col("one"), F.col("other"))).select("a", "b")


def candidates(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different parts that may share 0.8 of their union.

    ``sets`` has (node, part, hashes).  Two sets at 0.8 share 8/9 of the smaller and 4/5
    of the larger at least, so their first common shingle, in any order of all shingles,
    is among the first n - ceil(8n/9) + 1 of the smaller and n - ceil(4n/5) + 1 of the
    larger.  The order is by the number of sets that hold a shingle, then by hash.
    """
    each = stored(sets.select("node", "part", F.size("hashes").alias("n"), F.explode("hashes").alias("hash")))
    common = each.groupBy("hash").agg(F.count("*").alias("held")).filter("held > 1")
    ordered = (
        each.join(common, "hash", "left")
        .groupBy("node", "part", "n")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(1)).alias("held"), "hash"))).alias("ranked"))
    )
    first = stored(
        ordered.select("node", "part", "n", F.posexplode(F.expr("slice(ranked, 1, cast(n - (4 * n + 4) div 5 + 1 AS int))")).alias("at", "rare"))
        .filter("rare.held > 1")
        .select("node", "part", "n", "at", "rare.hash")
    )
    a, b = first.filter("at <= n - (8 * n + 8) div 9").alias("a"), first.alias("b")
    smaller = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.n") <= F.col("b.n")) & (F.col("a.part") != F.col("b.part"))
    left = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    enough = left * 9 >= (F.col("a.n") + F.col("b.n")) * 4
    pairs = a.join(b, smaller & enough & _may_be_near(F.col("a.n"), F.col("b.n")))
    return pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id: one row per row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    marked = stored(rows.mapInArrow(_marked, f"doc_id {kind}, node binary, n int, value long, bands array<long>"))
    nodes = stored(
        marked.groupBy("node").agg(
            F.min("doc_id").alias("least"),
            *[F.any_value(c).alias(c) for c in ("n", "value", "bands")],
        )
    )
    by_fingerprint = stored(simhash_candidates(nodes))
    postings = nodes.select("node", "n", F.explode("bands").alias("band"))
    smallest = postings.groupBy("band").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("nodes"))
    met = stored(postings.join(smallest.filter("nodes > 1").drop("nodes"), "band"))
    # The sets are needed of nodes that have met another only.
    needed = met.select("node").unionByName(
        by_fingerprint.select(F.explode(F.array("a", "b")).alias("node"))
    )
    texts = (
        rows.mapInArrow(_named, "node binary, text string")
        .join(needed.distinct(), "node", "left_semi")
        .groupBy("node")
        .agg(F.any_value("text").alias("text"))
    )
    sets = stored(texts.mapInArrow(_sets, "node binary, hashes array<long>"))
    stars = met.filter(_may_be_near(F.col("n"), F.col("first.n")))
    starred = stars.select(F.col("node").alias("a"), F.col("first.node").alias("b"))
    links = stored(_near(by_fingerprint.unionByName(starred), sets))
    parts = stored(components(links))
    # Nodes of a band that are still apart meet by their rare shingles.
    placed = stored(
        met.select("band", "node")
        .join(parts, "node", "left")
        .select("band", "node", F.coalesce("component", "node").alias("part"))
    )
    several = placed.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
    apart = stored(placed.join(several.select("band"), "band", "left_semi").select("node", "part").distinct())
    pairs = candidates(sets.join(apart, "node"))
    parts = components(links.unionByName(stored(_near(pairs, sets))))
    placed = stored(nodes.join(parts, "node", "left").select("node", "least", F.coalesce("component", "node").alias("part")))
    first = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    named = placed.join(first, "part").select("node", "component_id")
    return marked.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def one_of_each_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id is their component's; of repeated rows all stay.

    A row with a null id stays if its component has no other id.
    """
    kept = (
        near_components(docs, id_col, text_col)
        .filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select("doc_id")
        .distinct()
    )
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(kept, F.col(f"row.{id_col}").eqNullSafe(F.col("doc_id")), "left_semi").select("row.*")
