"""Ranked lexical search over hashed max-sketches.

A term's impact in a document, ``tf * 10^9 div (1000 tf + 8 m)``, does not depend on
the query.  A document folds the impacts of all its terms into two sketches: a term is
hashed to one of S places of each, and a place keeps the largest impact that falls on it
(S is a power of two, at least ``LOAD`` times the document's distinct terms).  All terms
of a batch of queries are looked up in a block of sketches at once; the smaller of the
two values is no less than the term's own impact, so the sums over a query's terms,
times their weights, are upper bounds.  Impacts are kept in one byte, rounded up.

For each query a task takes the documents of a block by descending bound, scores them
exactly, and stops at the first bound below its tenth best score so far (bounds equal
to it are scored too, as ties are broken by id).  The tasks' best are then reduced
to the best of all.

Corpus statistics come from two passes before: the number of documents with a term,
all terms with repeats, and for the terms of a batch the documents that hold them.
Queries are dealt into batches of at most ``BATCH_TERMS`` distinct terms each (a single
query is never cut), so what a task is sent has a fixed size; each batch is one more
pass over the documents.

Defined cases: null text has no term; a document without terms counts nowhere and is
never found; a query without terms, or whose terms occur nowhere, has no rows; rows
that repeat a ``doc_id`` are documents of their own, rows that repeat an ``item_id``
queries of their own; null ids rank behind all others among equal scores; an empty
table on either side gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posolog.llm.common import stored
from posolog.llm.token_counts import Memory

BEST = 10
#: Distinct terms that the queries of a batch hold together.
BATCH_TERMS = 20_000
#: Sketch places that a task holds at a time (one byte each), terms and documents.
BLOCK_PLACES = 1 << 24
BLOCK_TERMS = 1 << 20
BLOCK_DOCUMENTS = 1 << 13
LEAST_PLACES = 64
LOAD = 8
#: Values looked up in sketches at a time.
LOOKED_UP = 1 << 21
TOP_IMPACT = 1_000_000

_KEPT = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _KEPT else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Terms in order, as UTF-8: runs of ASCII letters, digits and all other characters."""
    return text.encode().translate(_FOLD).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    m = 10 + (90 * length * documents) // all_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = all_terms = 0
    for batch in batches:
        for text in batch.column("text"):
            n = len(terms(text.as_py()))
            documents += n > 0
            all_terms += n
    yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([all_terms], pa.int64())], ["documents", "all_terms"])


def _holding(wanted):
    """Documents of a partition that hold each wanted term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = wanted.value
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                held.update(sought.intersection(terms(text.as_py())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["term", "holding"]
        )

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set(terms(text.as_py()))) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item"), batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], ["item", "item_id", "terms"]
        )


@dataclass
class Queries:
    """A batch of queries: weights of their terms, and the corpus totals."""

    documents: int
    all_terms: int
    items: list[int]
    weights: list[dict[bytes, int]]

    def __post_init__(self) -> None:
        held = [n for n, w in enumerate(self.weights) if w]  # the others find nothing
        self.items, self.weights = [self.items[n] for n in held], [self.weights[n] for n in held]
        self.sought = {t for w in self.weights for t in w}
        lengths = np.array([len(w) for w in self.weights], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.hash = np.array([zlib.crc32(t) for w in self.weights for t in w], np.int64)
        self.weight = np.array([x for w in self.weights for x in w.values()], np.float64)

    def bounds(self, sketches: np.ndarray) -> np.ndarray:
        """Upper bounds of all scores, by document and query.

        The sums are whole numbers below 2^53; only the last product is rounded.
        """
        one, two = places(self.hash, sketches.shape[2])
        value = np.minimum(sketches[:, 0, one], sketches[:, 1, two])
        return np.add.reduceat(value * self.weight, self.starts, axis=1) * (TOP_IMPACT / 255 * (1 + 1e-12))


def places(hashes: np.ndarray, size) -> tuple[np.ndarray, np.ndarray]:
    """Places of terms in the two sketches: low bits of the hash, high bits of a multiple."""
    return hashes & (size - 1), (hashes * 0x9E3779B1 & 0xFFFFFFFF) * size >> 32


class Block:
    """Documents of a task that are bounded together."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.sizes: list[int] = []
        self.lengths: list[int] = []
        self.distinct: list[int] = []
        self.hashes: list[int] = []
        self.counts: list[int] = []
        self.sought: list[dict[bytes, int]] = []
        self.places = 0

    def add(self, doc_id, found: list[bytes], sought: set[bytes], hashed: Memory) -> None:
        counts = Counter(found)
        size = max(LEAST_PLACES, 1 << (LOAD * len(counts) - 1).bit_length())
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.lengths.append(len(found))
        self.distinct.append(len(counts))
        self.hashes.extend(map(hashed.__getitem__, counts))
        self.counts.extend(counts.values())
        self.sought.append({t: counts[t] for t in counts.keys() & sought})
        self.places += 2 * size

    def full(self) -> bool:
        return self.places >= BLOCK_PLACES or len(self.hashes) >= BLOCK_TERMS or len(self.ids) >= BLOCK_DOCUMENTS

    def sketches(self, queries: Queries) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Documents of one size and their sketches (document, sketch, place), size by size."""
        sizes, distinct = np.array(self.sizes), np.array(self.distinct)
        doc = np.repeat(np.arange(len(sizes)), distinct)
        held = impacts(np.array(self.counts), np.array(self.lengths)[doc], queries.documents, queries.all_terms)
        byte = (-(-held * 255 // TOP_IMPACT)).astype(np.uint8)
        starts = 2 * (np.cumsum(sizes) - sizes)
        flat = np.zeros(self.places, np.uint8)
        for n, place in enumerate(places(np.array(self.hashes), sizes[doc])):
            np.maximum.at(flat, starts[doc] + n * sizes[doc] + place, byte)
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            yield own, flat[starts[own][:, None] + np.arange(2 * size)].reshape(-1, 2, size)


class Search:
    """The best documents of a task for each query of a batch."""

    def __init__(self, queries: Queries, best: int) -> None:
        self.queries, self.best = queries, best
        self.found: list[list[tuple[int, bool, int]]] = [[] for _ in queries.weights]
        self.floor = np.zeros(len(queries.weights))
        self.rescored = 0

    def score(self, q: int, counts: dict[bytes, int], length: int) -> int:
        documents, all_terms = self.queries.documents, self.queries.all_terms
        m = 10 + (90 * length * documents) // all_terms
        weights = self.queries.weights[q]
        shared = counts.keys() & weights.keys()
        return sum(weights[t] * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in shared)

    def take(self, block: Block) -> None:
        if not len(self.queries.hash):
            return
        rows = max(1, LOOKED_UP // len(self.queries.hash))
        bounds = np.zeros((len(block.ids), len(self.queries.items)))
        for own, sketches in block.sketches(self.queries):
            for at in range(0, len(own), rows):
                bounds[own[at : at + rows]] = self.queries.bounds(sketches[at : at + rows])
        for q in range(len(self.queries.items)):
            self._descend(q, bounds[:, q], block)

    def _descend(self, q: int, bounds: np.ndarray, block: Block) -> None:
        open_ = np.flatnonzero((bounds >= self.floor[q]) & (bounds > 0))
        for doc in open_[np.argsort(-bounds[open_], kind="stable")]:
            if bounds[doc] < self.floor[q]:
                return
            self.rescored += 1
            score = self.score(q, block.sought[doc], block.lengths[doc])
            if score > 0 and score >= self.floor[q]:
                self._keep(q, score, block.ids[doc])

    def _keep(self, q: int, score: int, doc_id: int | None) -> None:
        found = self.found[q]
        found.append((-score, doc_id is None, doc_id or 0))
        if len(found) >= self.best:
            found.sort()
            del found[self.best :]
            self.floor[q] = -found[-1][0]

    def rows(self) -> pa.RecordBatch:
        flat = [(i, -s, None if none else d) for i, f in zip(self.queries.items, self.found, strict=True) for s, none, d in f]
        columns = list(zip(*flat, strict=True)) if flat else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["item", "score", "doc_id"])


def _best(shared, best: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        search, block = Search(queries, best), Block()
        hashed = Memory(zlib.crc32)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                found = terms(text.as_py())
                if found:
                    block.add(doc_id.as_py(), found, queries.sought, hashed)
                if block.full():
                    search.take(block)
                    block = Block()
        if block.ids:
            search.take(block)
        yield search.rows()

    return run


def _batched(items: DataFrame) -> tuple[DataFrame, int]:
    """Items with the number of their batch, and the number of batches."""
    sizes = items.select("item", F.size("terms").alias("n"))
    n_items, total = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    batches = max(1, -(-total // BATCH_TERMS))
    while True:
        batch = F.pmod(F.xxhash64("item"), F.lit(batches)).cast("int")
        largest = (
            sizes.groupBy(batch.alias("batch"))
            .agg(F.sum("n").alias("n"), F.count("*").alias("items"))
            .filter("items > 1")
            .agg(F.max("n"))
            .first()[0]
        )
        if batches >= n_items**2 or (largest or 0) <= BATCH_TERMS:
            return items.withColumn("batch", batch), batches
        batches *= 2


def search(
    docs: DataFrame,
    items: DataFrame,
    best: int = BEST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score of the ``best`` documents of each item."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    texts = rows.select("text")
    id_type = items.schema[item_col].dataType.simpleString()
    queries = stored(
        items.select(
            F.monotonically_increasing_id().alias("item"),
            F.col(item_col).alias("item_id"),
            F.coalesce(F.col(item_text_col), F.lit("")).alias("text"),
        ).mapInArrow(_item_terms, f"item long, item_id {id_type}, terms array<binary>")
    )
    totals = texts.mapInArrow(_totals, "documents long, all_terms long").agg(F.sum("documents"), F.sum("all_terms")).first()
    documents, all_terms = (int(n or 0) for n in totals)
    queries, n_batches = _batched(queries)
    found = spark.createDataFrame([], "item long, score long, doc_id long")
    for number in range(n_batches if documents else 0):
        # One batch: at most BATCH_TERMS distinct terms, or one item.
        batch = [(i, list(map(bytes, t))) for i, t in queries.filter(F.col("batch") == number).select("item", "terms").collect()]
        wanted = {t for _, own in batch for t in own}
        if not wanted:
            continue
        holding = dict(
            (bytes(t), n)
            for t, n in texts.mapInArrow(_holding(spark.sparkContext.broadcast(wanted)), "term binary, holding long")
            .groupBy("term")
            .agg(F.sum("holding").alias("holding"))
            .collect()
        )
        weights = [{t: w for t in own if t in holding and (w := weight(documents, holding[t])) > 0} for _, own in batch]
        shared = spark.sparkContext.broadcast(Queries(documents, all_terms, [i for i, _ in batch], weights))
        part = rows.mapInArrow(_best(shared, best), "item long, score long, doc_id long")
        found = found.unionByName(stored(part) if n_batches > 1 else part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.join(queries.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


#: The same ranking by joins of terms, without sketches.
SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS doc, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
kept AS (SELECT doc, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM kept),
held AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM kept) GROUP BY ALL),
queries AS (
  SELECT DISTINCT item, item_id, term FROM (
    SELECT row_number() OVER () AS item, item_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark)),
weights AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), totals),
scores AS (
  SELECT item, item_id, doc, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM queries JOIN held USING (term) JOIN weights USING (term) JOIN kept USING (doc), totals
  GROUP BY ALL),
ranked AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
