"""Document quality by kernel ridge regression on random Fourier features.

Every text gives ``STATISTICS``: its size, the shares of letters, capitals, digits,
marks and white space, word and line lengths, how words begin and end, and how often
words, neighbouring words and lines repeat.  They are brought to the mean and deviation
of all documents.  ``FEATURES`` random cosines approximate a Gaussian kernel over them
(frequencies are drawn from a normal law by a fixed seed).  Ridge weights solve

    (Z'Z + ridge n I) w = Z'y

where each partition of the labelled rows sums its part of Z'Z and Z'y, and the parts
are summed row by row of the matrix: what reaches the driver has one size, and all
labelled rows count.  An isotonic fit turns ridge scores into shares of label 1: scores
are counted by ``CELLS`` cells of one width, neighbouring cells that fall are pooled, and
scores between the middles of two pools are interpolated.

Labels train only on documents whose crc32(id) mod 5 is not 0: remainders 1 to 3 give the
ridge weights, remainder 4 the isotonic fit (remainders 1 to 3 do, too, where it has not
both labels).

Defined cases: null text is empty; an empty text has statistics of zero and is scored
like any other; rows that repeat a ``doc_id`` are scored each; of repeated labels the
largest counts; labels other than 0 and 1 count as none; a null id trains nothing and is
not held out; where the training rows have not both labels every score is their only
label, or 0 without any; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posolog.llm.common import partitions, stored, text_or_empty

FEATURES = 384
WIDTH = 4.0
RIDGE = 1e-5
SEED = 20
THRESHOLD = 0.3
CELLS = 2000
#: Statistics further than this from the mean, in deviations, count as this far.
FARTHEST = 6.0
#: Rows whose cosines a task holds at a time.
ROWS = 4096

STATISTICS = [
    "log_chars", "log_words", "letters", "capitals", "digits", "marks", "spaces", "stops", "brackets",
    "word_mean", "word_deviation", "long_words", "short_words", "plain_words", "marked_ends", "capital_words",
    "distinct_words", "commonest_word", "repeated_pairs", "log_lines", "line_mean", "repeated_lines", "stopped_lines", "byte_entropy",
]

# Kinds of bytes: 0 letter, 1 capital, 2 digit, 3 space, 4 line end, 5 sentence mark, 6 bracket or quote, 7 other mark
_KIND = np.zeros(256, np.uint8)
for _b in range(128):
    _c = chr(_b)
    _KIND[_b] = (
        0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 4 if _c in "\r\n"
        else 3 if _c in " \t\x0b\x0c" else 5 if _c in ".,;:!?" else 6 if _c in "()[]{}\"'" else 7
    )


def statistics(text: str) -> list[float]:
    raw = text.encode()
    if not raw:
        return [0.0] * len(STATISTICS)
    codes = np.frombuffer(raw, np.uint8)
    by_byte = np.bincount(codes, minlength=256)
    kinds = np.bincount(_KIND, by_byte, 8) / len(raw)
    seen = by_byte[by_byte > 0] / len(raw)
    words = raw.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [line for line in raw.splitlines() if line.strip()]
    last = _KIND[np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)]
    first = _KIND[np.frombuffer(b"".join(w[:1] for w in words), np.uint8)]
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        kinds[0],
        kinds[1],
        kinds[2],
        kinds[7],
        kinds[3] + kinds[4],
        kinds[5],
        kinds[6],
        float(lengths.mean()),
        float(lengths.std()),
        float((lengths > 12).sum()) / n,
        float((lengths < 3).sum()) / n,
        float((last == 0).sum()) / n,
        float((last == 7).sum()) / n,
        float((first == 1).sum()) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        float(np.log1p(len(lines))),
        float(np.log1p(len(raw) / max(1, len(lines)))),
        1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
        sum(line.rstrip()[-1:] in b".!?" for line in lines) / max(1, len(lines)),
        float(-(seen * np.log2(seen)).sum()),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([statistics(text.as_py()) for text in batch.column("text")], np.float64).reshape(-1)
        values = pa.FixedSizeListArray.from_arrays(pa.array(found), len(STATISTICS)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], ["doc_id", "statistics"])


class Kernel:
    """Random cosines of standardised statistics: a Gaussian kernel of ``WIDTH``."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.frequency = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, statistics: np.ndarray) -> np.ndarray:
        x = np.clip((statistics - self.mean) / self.deviation, -FARTHEST, FARTHEST)
        z = np.sqrt(2 / FEATURES) * np.cos(x @ self.frequency + self.phase)
        return np.column_stack([z, np.ones(len(z))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def _normal_rows(matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(matrix)), pa.int32()), pa.array([row.tobytes() for row in matrix], pa.binary())], ["row", "sums"]
    )


def _normal(shared):
    """A partition's part of (Z'Z | Z'y), one row of the matrix a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = shared.value
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            for block in _blocks(batch):
                z = kernel(_matrix(block.column("statistics")))
                y = block.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
                total += z.T @ np.column_stack([z, y])
        if total.any():
            yield _normal_rows(total)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, part in zip(batch.column("row").to_pylist(), batch.column("sums"), strict=True):
            part = np.frombuffer(part.as_py())
            sums[row] = sums[row] + part if row in sums else part
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["row", "sums"]
    )


def _ridge_scores(shared):
    """``ridge`` in place of the statistics, other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, weights = shared.value
        for batch in batches:
            for block in _blocks(batch):
                ridge = kernel(_matrix(block.column("statistics"))) @ weights
                kept = block.drop_columns(["statistics"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(ridge)], [*kept.schema.names, "ridge"])

    return run


def _calibrated(middles: np.ndarray, shares: np.ndarray):
    """Straight lines between the pools; scores beyond the outer ones stay level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.interp(batch.column("ridge").to_numpy(), middles, shares)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    return run


def solved(sums: np.ndarray) -> np.ndarray:
    """Ridge weights from (Z'Z | Z'y); the last feature, the constant, is not held down."""
    square, y = sums[:, :-1], sums[:, -1]
    rows = square[-1, -1]
    penalty = np.full(len(square), RIDGE * rows)
    penalty[-1] = 1e-9 * rows
    return np.linalg.solve(square + np.diag(penalty), y)


def isotonic(cells: np.ndarray, ones: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middles of the pools and their shares of label 1, both ascending."""
    pools: list[list[float]] = []
    for x, one, n in zip(cells, ones, rows, strict=True):
        pools.append([float(x) * float(n), float(one), float(n)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    held = np.array(pools).reshape(-1, 3)
    # One more row of either label keeps a pool's share off 0 and 1.
    return held[:, 0] / held[:, 2], (held[:, 1] + held[:, 1].sum() / held[:, 2].sum()) / (held[:, 2] + 1)


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, ridge, score, predicted: a row per row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    measured = stored(rows.mapInArrow(_measure, f"doc_id {id_type}, statistics array<double>"))
    known = (
        labels.select(F.col("doc_id").alias("labelled"), F.col("quality").cast("int").alias("label"))
        .filter("label in (0, 1) and labelled is not null")
        .groupBy("labelled")
        .agg(F.max("label").alias("label"))
    )
    # Labels grow with the corpus, so they are dealt by id with the rows at every size, not broadcast.
    training = measured.filter(remainder("doc_id") > 0).join(
        known.filter(remainder("labelled") > 0).hint("shuffle_hash"), F.col("doc_id") == F.col("labelled")
    )
    training = stored(training.select("doc_id", "label", "statistics"))
    held_out = F.coalesce(remainder("doc_id") == 0, F.lit(False))
    n, ones = training.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if ones in (0, n):
        score = F.lit(1.0 if ones else 0.0)
        plain = measured.select("doc_id", held_out.alias("held_out"), F.lit(0.0).alias("ridge"), score.alias("score"))
        return plain.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

    value = F.col("statistics")
    moments = measured.agg(
        *[F.avg(value[i]).alias(f"m{i}") for i in range(len(STATISTICS))],
        *[F.stddev_pop(value[i]).alias(f"d{i}") for i in range(len(STATISTICS))],
    ).first()
    kernel = Kernel(np.array(moments[: len(STATISTICS)], float), np.array(moments[len(STATISTICS) :], float))
    fitting = training.filter(remainder("doc_id") < 4)
    both = fitting.agg(F.min("label"), F.max("label")).first()
    if tuple(both) != (0, 1):
        fitting = training
    sums = (
        fitting.mapInArrow(_normal(spark.sparkContext.broadcast(kernel)), "row int, sums binary")
        .repartition(partitions(spark), "row")
        .mapInArrow(_summed, "row int, sums binary")
        .collect()  # FEATURES + 1 rows of the normal equations, however many documents
    )
    weights = solved(np.array([np.frombuffer(bytes(part)) for _, part in sorted(sums)]))
    model = spark.sparkContext.broadcast((kernel, weights))

    def cells(of: DataFrame) -> np.ndarray:
        """Cells of ridge scores with their labels: at most ``CELLS`` + 1."""
        ridge = F.greatest(F.lit(-0.5), F.least(F.lit(1.5), F.col("ridge")))
        counted = (
            of.mapInArrow(_ridge_scores(model), f"doc_id {id_type}, label int, ridge double")
            .groupBy(F.floor((ridge + 0.5) * (CELLS / 2)).alias("cell"))
            .agg(F.sum("label"), F.count("*"))
        )
        return np.array(sorted(map(tuple, counted.collect())), float).reshape(-1, 3)

    found = cells(training.filter(remainder("doc_id") == 4))
    if not len(found) or found[:, 1].sum() in (0, found[:, 2].sum()):
        found = cells(training)
    middles, shares = isotonic((found[:, 0] + 0.5) / (CELLS / 2) - 0.5, found[:, 1], found[:, 2])

    return (
        measured.mapInArrow(_ridge_scores(model), f"doc_id {id_type}, ridge double")
        .mapInArrow(_calibrated(middles, shares), f"doc_id {id_type}, ridge double, score double")
        .select("doc_id", held_out.alias("held_out"), "ridge", "score")
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    )
