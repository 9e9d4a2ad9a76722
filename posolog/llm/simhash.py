"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight bytes.  Two that differ in at most three bits share at least
five of them in place, so the count of shared positional bytes of a pair must reach
five.  Lists of single bytes would hold a 256th of all fingerprints each; the index
is therefore kept on five positional bytes at once (56 lists of 40-bit entries), in
which a pair that reaches the count meets at least once, and hardly any other pair
does.  The fingerprints of an entry differ in their other 24 bits only; they are
verified there.  Equal fingerprints are one node from the start.

An entry's links are reduced to a tree in its task: a pair of a large group is never
a row.  Entries of up to ``PAIRWISE`` fingerprints compare all pairs in blocks;
larger ones (at most 2^24 distinct values) look up the 2324 neighbours of each value
instead, so work stays in proportion.

Defined cases: null text has no words and fingerprint zero, which links like any
other; rows that repeat a ``doc_id`` are nodes by fingerprint, too; a null id is
smaller than none: it is component only where no other id is; an empty table gives
an empty result; only the named columns are read by ``simhash_components``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posolog.llm.common import partitions, runs, stored, text_or_empty, whole_groups
from posolog.llm.graph import components

SHINGLE = 3
SEED = 42
MOST_BITS = 3
PAIRWISE = 4096

_SUBSETS = list(itertools.combinations(range(8), 5))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The majority of the bits of all shingle hashes; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[-n:].tolist()
    total = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = np.array(
            [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[at : at + 65536].tolist(), last[at : at + 65536])],
            np.uint64,
        )
        total[:] += bit_counts(part)
    return majority(total, n)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def majority(total: np.ndarray, n: int) -> int:
    """The fingerprint of ``n`` hashes from their counts of set bits."""
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, value): the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(text.as_py()) for text in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "value"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, value long")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, value) for each five bytes of each fingerprint; an entry is 46 bits."""
    for batch in batches:
        values = batch.column("value").to_numpy(zero_copy_only=False).view(np.uint64)
        for number, subset in enumerate(_SUBSETS):
            entry = np.full(len(values), number, np.uint64)
            for byte in subset:
                entry = (entry << np.uint64(8)) | ((values >> np.uint64(8 * byte)) & np.uint64(255))
            yield pa.RecordBatch.from_arrays([pa.array(entry.view(np.int64)), pa.array(values.view(np.int64))], ["entry", "value"])


def tree(values: np.ndarray, bits: int = MOST_BITS) -> list[tuple[int, int]]:
    """Links among distinct fingerprints that differ in up to ``bits`` bits, as trees.

    Breadth-first over what is not reached yet: each fingerprint is linked to one
    that it is near to.
    """
    out: list[tuple[int, int]] = []
    if len(values) <= PAIRWISE:
        rest = values
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                near = np.bitwise_count(rest ^ queue[-1]) <= bits
                root = queue.pop()
                found = rest[near]
                if len(found):
                    out += [(int(root), int(v)) for v in found]
                    queue += list(found)
                    rest = rest[~near]
        return out
    varying = np.bitwise_or.reduce(values ^ values[0])
    places = [1 << b for b in range(64) if int(varying) >> b & 1]
    flips = np.array(
        [sum(c) for k in range(1, bits + 1) for c in itertools.combinations(places, k)], np.uint64
    )
    waiting = set(values.tolist())
    while waiting:
        queue = [waiting.pop()]
        while queue and waiting:
            root = queue.pop()
            for v in waiting.intersection((flips ^ np.uint64(root)).tolist()):
                out.append((root, v))
                waiting.discard(v)
                queue.append(v)
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in whole_groups(batches, "entry"):
        entry = group.column("entry").to_numpy()
        values = group.column("value").to_numpy().view(np.uint64)
        starts, lengths = runs(entry)
        several = lengths > 1
        pairs: list[tuple[int, int]] = []
        for start, length in zip(starts[several], lengths[several], strict=True):
            pairs += tree(values[start : start + length])
        if pairs:
            ends = np.array(pairs, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def near_fingerprints(values: DataFrame) -> DataFrame:
    """(a, b): links among distinct fingerprints (``value``) through the index, as trees of its entries."""
    # One fingerprint has 56 postings: spread them before they are written.
    index = values.mapInArrow(_postings, "entry long, value long")
    return (
        index.repartition(partitions(values.sparkSession), "entry")
        .sortWithinPartitions("entry", "value")
        .mapInArrow(_links, "a long, b long")
    )


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``."""
    marked = stored(fingerprints(docs, id_col, text_col))
    nodes = stored(marked.groupBy("value").agg(F.min("doc_id").alias("least")))
    links = near_fingerprints(nodes.select("value"))
    parts = components(links)  # written there, without repeats
    placed = nodes.join(parts, F.col("value") == F.col("node"), "left").select(
        "value", "least", F.coalesce("component", "value").alias("part")
    )
    first = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    named = placed.join(first, "part").select("value", "component_id")
    return marked.join(named, "value").select(
        "doc_id", F.lpad(F.lower(F.hex("value")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id is their component's; of repeated rows all stay.

    A row with a null id stays if its component has no other id.
    """
    kept = (
        simhash_components(docs, id_col, text_col)
        .filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select("doc_id")
        .distinct()
    )
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(kept, F.col(f"row.{id_col}").eqNullSafe(F.col("doc_id")), "left_semi").select("row.*")
