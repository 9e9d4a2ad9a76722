"""Near-duplicate embeddings by spherical-cap filters of a random product code.

Dimensions are split into blocks; each block has a seeded code of random unit
vectors, and a filter is one code word a block, that is, a direction on the sphere.
A vector belongs to the filters whose inner product with it exceeds its threshold, the
level that ``filters_per_vector`` directions reach: no part of the sphere is left
without filters, and none has very many.  List decoding finds these without trying all:
of a sum of blocks that is among the k largest, each block's word is among its k best.
Vectors are joined on label and filter and verified there by cosine in double precision.

The code grows with the number of vectors, so that a filter's lists stay short.  A pair
at cosine 0.98 shares a filter with a chance of 0.995 or more (measured from 6,000 to
10^6 vectors of 32, 64 and 384 dimensions), a closer one with a higher chance.

Equal vectors of a label are one node from the start.  A pair is counted in the
smallest filter that both have, so each link counts once; a list's links leave its
task as counts and stars, never as all pairs.  Long lists are dealt out in tiles of
``tile`` by ``tile`` vectors.

Defined cases: a vector that is null, empty, zero or has a null or non-finite
component, or whose label is null, links with nothing; vectors of different lengths
do not link; rows that repeat a ``vec_id`` count each and link like others; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posolog.llm.common import partitions, runs, stored, whole_groups
from posolog.llm.graph import components

COSINE = 0.98
BLOCKS = 3
FILTERS_PER_VECTOR = 16
#: Vectors of a list that a filter shall have, all labels together.
LIST_LENGTH = 16
TILE = 2048
SEED = 9


@functools.lru_cache(maxsize=64)
def code(dims: int, words: int, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Code words of each block (unit vectors divided by the root of the blocks)."""
    parts = [dims * (b + 1) // BLOCKS - dims * b // BLOCKS for b in range(BLOCKS)]
    out = []
    for block, part in enumerate(parts):
        drawn = np.random.default_rng([seed, dims, words, block]).standard_normal((words, max(part, 1)))[:, :part]
        norm = np.linalg.norm(drawn, axis=1, keepdims=True) if part else 1.0
        out.append(drawn / norm * math.sqrt(part / dims))
    return tuple(out)


def code_words(vectors: int, filters_per_vector: int = FILTERS_PER_VECTOR) -> int:
    """Code words a block: filters in proportion to the vectors, at least 512."""
    filters = max(512, vectors * filters_per_vector / LIST_LENGTH)
    return math.ceil(filters ** (1 / BLOCKS))


def decode(directions: np.ndarray, words: int, k: int) -> np.ndarray:
    """The ``k`` filters of largest inner product, ascending, for each row."""
    n, dims = directions.shape
    most = min(words, k)
    at = 0
    chosen, total = np.zeros((n, 1), np.int64), np.zeros((n, 1))
    for block in code(dims, words):
        score = directions[:, at : at + block.shape[1]] @ block.T
        at += block.shape[1]
        order = np.argsort(-score, axis=1, kind="stable")[:, :most]
        best = np.take_along_axis(score, order, 1)
        total = (total[:, :, None] + best[:, None, :]).reshape(n, -1)
        chosen = (chosen[:, :, None] * words + order[:, None, :]).reshape(n, -1)
        if total.shape[1] > k:  # what is not among the k best so far cannot be in the end
            kept = np.argsort(-total, axis=1, kind="stable")[:, :k]
            total, chosen = np.take_along_axis(total, kept, 1), np.take_along_axis(chosen, kept, 1)
    return np.sort(chosen, axis=1)


def _usable(vector: str) -> Column:
    part = F.col(vector)
    return F.coalesce(
        F.size(part) > 0, F.lit(False)
    ) & F.forall(part, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(part, lambda x: x != 0)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int, kind: type = np.float64) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def _directions(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)  # no overflow in the squares
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _filters_of(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            dims = np.diff(vectors.offsets.to_numpy())
            filters = np.zeros((batch.num_rows, k), np.int64)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                for at in range(0, len(rows), 1024):
                    part = rows[at : at + 1024]
                    filters[part] = decode(_directions(_matrix(vectors.take(pa.array(part)), d)), words, k)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(filters.ravel()), k).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("label"), lists, vectors, batch.column("copies")],
                ["node", "label", "filters", "vector", "copies"],
            )

    return run


def _owned(left: np.ndarray, right: np.ndarray, filter_id: int) -> np.ndarray:
    """Whether ``filter_id`` is the smallest filter that two vectors share, pair by pair."""
    out = np.zeros(len(left), bool)
    for at in range(0, len(left), 4096):
        one, two = left[at : at + 4096], right[at : at + 4096]
        first = (one[:, :, None] == two[:, None, :]).any(2).argmax(1)
        out[at : at + 4096] = one[np.arange(len(one)), first] == filter_id
    return out


def _stars(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member) of the components that pairs of numbers form."""
    members, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = flat[: len(i)], flat[len(i) :]
    least = np.arange(len(members))
    while True:
        low = np.minimum(least[a], least[b])
        after = least.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == least).all():
            break
        least = after
    some = least != np.arange(len(members))
    return members[some], members[least[some]]


def _links(cosine: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "list"):
            group = group.combine_chunks()
            node, copies, side, ids = (group.column(c).to_numpy() for c in ("node", "copies", "side", "filter"))
            filters = _matrix(group.column("filters"), k, np.int64)
            vectors = group.column("vector").combine_chunks()
            offsets, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            stars: list[tuple[np.ndarray, np.ndarray]] = []
            for start, length in zip(*runs(group.column("list").to_numpy()), strict=True):
                direction = _directions(flat[offsets[start] : offsets[start + length]].reshape(length, -1))
                rows = [np.flatnonzero(side[start : start + length] == s) for s in (0, 1, 2)]
                own: list[tuple[np.ndarray, np.ndarray]] = []
                for left, right in ((rows[0], rows[0]), (rows[1], rows[2])):
                    if not len(left) or not len(right):
                        continue
                    i, j = np.nonzero(direction[left] @ direction[right].T >= cosine)
                    if left is right:
                        i, j = i[i < j], j[i < j]
                    i, j = left[i] + start, right[j] + start
                    owned = _owned(filters[i], filters[j], ids[start])
                    own.append((i[owned], j[owned]))
                own = [(i, j) for i, j in own if len(i)]
                found += own
                stars += [_stars(i, j) for i, j in own]
            if not found:
                continue
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            a, b = (np.concatenate(x) for x in zip(*stars, strict=True))
            linked, place = np.unique(np.concatenate([node[i], node[j]]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([copies[j], copies[i]])).astype(np.int64)
            none = np.zeros(len(a), np.int64)
            columns = [np.concatenate(x) for x in ((node[a], linked), (node[b], linked), (none, counts))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n"])

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    filters_per_vector: int = FILTERS_PER_VECTOR,
    tile: int = TILE,
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``."""
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    usable = rows.filter(F.col("label").isNotNull() & _usable("vector"))
    # Zeros have one sign, so that equal vectors are one group.
    plain = usable.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    nodes = stored(
        plain.groupBy("label", "vector")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    words = code_words(nodes.count(), filters_per_vector)
    k = min(filters_per_vector, words**BLOCKS)
    filtered = nodes.select("node", "label", "vector", "copies").mapInArrow(
        _filters_of(words, k), "node long, label string, filters array<long>, vector array<double>, copies long"
    )
    filtered = stored(filtered.withColumn("dims", F.size("vector")))
    postings = filtered.select("label", "dims", "node", F.explode("filters").alias("filter"))
    lists = (
        postings.groupBy("label", "dims", "filter")
        .agg(F.count("*").alias("length"))
        .filter("length > 1")
        .withColumn("tiles", F.ceil(F.col("length") / tile).cast("int"))
    )
    keys = ["label", "dims", "filter"]
    chunk = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    # Tile (x, y), x <= y: side 0 where x = y, else side 1 from x and side 2 from y.
    members = postings.join(lists, keys).withColumn("chunk", chunk)
    placed = members.select(
        "node",
        *keys,
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("tiles") - 1),
                lambda other: F.struct(
                    F.least("chunk", other).alias("x"),
                    F.greatest("chunk", other).alias("y"),
                    F.when(other == F.col("chunk"), 0).when(F.col("chunk") < other, 1).otherwise(2).cast("int").alias("side"),
                ),
            )
        ).alias("tile"),
    )
    rows_of = placed.join(filtered.select("node", "filters", "vector", "copies"), "node").select(
        F.xxhash64(*keys, "tile.x", "tile.y").alias("list"), "filter", "tile.side", "node", "filters", "vector", "copies"
    )
    found = stored(
        rows_of.repartition(partitions(spark), "list")
        .sortWithinPartitions("list")
        .mapInArrow(_links(cosine, k), "a long, b long, n long")
    )
    parts = components(found.filter("a <> b").select("a", "b"))
    counts = found.filter("a = b").groupBy("a").agg(F.sum("n").alias("n"))
    known = stored(
        nodes.select("node", "label", "vector", "least", "copies")
        .join(parts, "node", "left")
        .join(counts, F.col("node") == F.col("a"), "left")
        .select(
            "label", "vector", "least",
            F.coalesce("component", "node").alias("part"),
            (F.col("copies") - 1 + F.coalesce("n", F.lit(0).cast("long"))).alias("n_links"),
        )
    )
    first = known.groupBy("part").agg(F.min("least").alias("component_id"))
    known = known.join(first, "part").select("label", "vector", "n_links", "component_id")
    linked = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))).join(known, ["label", "vector"], "left")
    component = F.coalesce("component_id", "vec_id")
    return linked.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
