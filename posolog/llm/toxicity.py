"""Toxicity by class-conditional Kneser-Ney models.

A toxic and an ordinary model each give a word

    p(w) = (c(w) - D)+ / N  +  D V / N * q(stem) * r(w | stem)
    q(s) = (d(s) - D)+ / M  +  D U / M * shared(s)

with c: the word's count in the class, d: the number of the class's documents that
hold a word of the stem (its continuation count; a stem is a word's first five
letters), N, V, M, U: sums and numbers of these, and shared(s), r(w | s): document
and word counts over all documents, labelled or not, one added to each.  A rare expression thus falls
back on its stem, and an unknown stem on counts that both classes share, where the
ratio says nothing.

A text's statistics are of its words' log ratios, divided by its length: their mean
(the difference of the length-normalised log-likelihoods), their median, what
exceeds ``EXCESS`` on the mean (also over the median, as a language or subject
shifts all words), the three largest, and the length.  A logistic model turns them
into a score.

Labels train only on documents whose crc32(id) mod 4 is not 2: remainders 0 and 1
give the class counts, all of them; remainder 3 fits the six weights, all of them too:
each Newton step adds up its sums over the rows where they lie.

All counts are of the words and stems themselves, so what is counted grows with the
vocabulary; no machine holds all of it.  Each text is read once: a task numbers the words
it comes across, keeps a text as such numbers with counts, and closes the chunk with its
words and their totals at ``CHUNK_WORDS`` different ones.  The chunks' words meet by
buckets of stems (a stem's words stand in one bucket, of some ``BUCKET_WORDS`` words of
chunks), and every chunk gets back the counts of its own words.  Sums over the whole
tables reach the driver, nothing by word.

Defined cases: null text is empty; a text without words has neutral statistics; rows
that repeat a ``doc_id`` are scored each; of repeated labels the largest counts;
labels other than 0 and 1 count as none; a null id trains nothing and is not held
out; without both labels every score is 0; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posolog.llm.common import partitions, runs, stored, stored_alone, text_or_empty, whole_groups

#: Different words at which a task closes a chunk, and words of chunks that make a bucket.
CHUNK_WORDS = 1 << 18
BUCKET_WORDS = 1 << 17
STEM_LETTERS = 5
DISCOUNT = 0.75
EXCESS = 1.5
THRESHOLD = 0.3
RIDGE = 1.0
STEPS = 50
FEATURES = ["mean", "median", "excess", "top", "over_median", "log_length"]

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


class Packed:
    """Whole numbers as bytes: lowest bytes first, then the next ones, compressed."""

    def __init__(self) -> None:
        import zstandard

        self.small, self.large = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress

    def numbers(self, values: np.ndarray) -> bytes:
        most = int(values.max()) if len(values) else 0
        width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
        return bytes([width]) + self.small(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())

    def read(self, packed: bytes) -> np.ndarray:
        width = packed[0]
        flat = np.frombuffer(self.large(packed[1:]), np.uint8).reshape(width, -1)
        return np.ascontiguousarray(flat.T).view(f"<u{width}").ravel().astype(np.int64)

    def words(self, words: list[str]) -> bytes:
        return self.small("\n".join(words).encode())  # a word holds no white space

    def read_words(self, packed: bytes) -> list[str]:
        return self.large(packed).decode().split("\n")


def _grown(counts: np.ndarray, size: int) -> np.ndarray:
    """``counts`` with room for ``size`` columns at least."""
    have = counts.shape[-1]
    if have >= size:
        return counts
    return np.concatenate([counts, np.zeros((*counts.shape[:-1], max(size, 2 * have) - have), counts.dtype)], -1)


class Words(dict):
    """Numbers of words in the order they come up; ``of`` has the numbers of their stems."""

    def __init__(self) -> None:
        self.stems: dict[str, int] = {}
        self.of = np.zeros(1024, np.int64)

    def __missing__(self, word: str) -> int:
        n = len(self)
        self[word] = n
        if n >= len(self.of):
            self.of = _grown(self.of, n + 1)
        self.of[n] = self.stems.setdefault(word[:STEM_LETTERS], len(self.stems))
        return n

    def numbered(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _bag(packed: Packed, bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    values = packed.read(bag)
    half = len(values) // 2
    return np.cumsum(values[:half]), values[half:]


def _read(most: int):
    """A row per text (its bag of a chunk's word numbers) and a row per chunk (its words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, chunk = Packed(), TaskContext.get().partitionId() << 32

        def opened() -> tuple[Words, np.ndarray, np.ndarray]:
            return Words(), np.zeros(1024, np.int64), np.zeros(1024, np.int64)

        def closed() -> pa.RecordBatch:
            row = [chunk, packed.words(list(words)), packed.numbers(tokens[: len(words)]), packed.numbers(documents[: len(words.stems)]), len(words)]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            at, *rest = (pa.array([v], kind) for v, kind in zip(row, kinds, strict=True))
            return pa.RecordBatch.from_arrays([at, pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *rest], _READ)

        words, tokens, documents = opened()
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            chunks, bags = [], []
            for text in batch.column("text"):
                local, counts = np.unique(words.numbered(_WORD.findall(text.as_py().lower())), return_counts=True)
                tokens, documents = _grown(tokens, len(words)), _grown(documents, len(words.stems))
                tokens[local] += counts
                documents[np.unique(words.of[local])] += 1
                chunks.append(chunk)
                bags.append(packed.numbers(np.concatenate([np.diff(local, prepend=0), counts])))
                if len(words) >= most:
                    yield closed()
                    chunk += 1
                    words, tokens, documents = opened()
            n = batch.num_rows
            none = [pa.nulls(n, kind) for kind in (pa.binary(), pa.binary(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunks, pa.int64()), batch.column("doc_id"), batch.column("content"), pa.array(bags, pa.binary()), *none], _READ
            )
        if words:
            yield closed()

    return run


_READ = ["chunk", "doc_id", "content", "bag", "words", "tokens", "documents", "n"]


def _dealt(buckets: int):
    """Each chunk's words with their counts, by class too, dealt to the buckets of their stems."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = Packed()
        chunk = None

        def rows() -> pa.RecordBatch:
            bucket = np.fromiter((zlib.crc32(stem.encode()) % buckets for stem in numbers.stems), np.int64, len(numbers.stems))
            made: dict[str, list] = {"bucket": [], "chunk": [], "words": [], "places": [], "counts": []}
            of_word, texts = bucket[stems], list(numbers)
            by_word, by_stem = np.argsort(of_word, kind="stable"), np.argsort(bucket, kind="stable")
            first = np.searchsorted(of_word[by_word], np.arange(buckets + 1))
            stem_first = np.searchsorted(bucket[by_stem], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(first)):
                w, s = by_word[first[b] : first[b + 1]], by_stem[stem_first[b] : stem_first[b + 1]]
                made["bucket"].append(int(b))
                made["chunk"].append(chunk)
                made["words"].append(packed.words([texts[i] for i in w]))
                made["places"].append(packed.numbers(np.diff(w, prepend=0)))
                made["counts"].append(packed.numbers(np.concatenate([of_words[:, w].ravel(), of_stems[:, s].ravel()])))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(made.values(), kinds, strict=True)], list(made))

        for batch in batches:
            for at, toxic, bag, words, tokens, documents in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if words is not None:
                    if chunk is not None:
                        yield rows()
                    chunk, numbers = at, Words()
                    numbers.numbered(packed.read_words(words))
                    stems = numbers.of[: len(numbers)]
                    of_words, of_stems = np.zeros((3, len(numbers)), np.int64), np.zeros((3, len(numbers.stems)), np.int64)
                    of_words[0], of_stems[0] = packed.read(tokens), packed.read(documents)
                elif at == chunk:  # else its texts have no words
                    local, counts = _bag(packed, bag)
                    of_words[1 + toxic][local] += counts
                    of_stems[1 + toxic][np.unique(stems[local])] += 1
        if chunk is not None:
            yield rows()

    return run


#: Sums over all words: words and stems seen, tokens and stem documents by class; stem documents of all texts.
_TOTALS = ["v0", "v1", "u0", "u1", "n0", "n1", "m0", "m1", "shared"]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a bucket over all chunks: for each chunk those of its words, and a row of totals."""
    packed = Packed()
    for table in whole_groups(batches, "bucket"):
        starts, lengths = runs(table.column("bucket").to_numpy())
        for start, length in zip(starts, lengths, strict=True):
            numbers, held = Words(), []
            of_words, of_stems = np.zeros((3, 1024), np.int64), np.zeros((3, 1024), np.int64)
            rows = table.slice(int(start), int(length))
            for chunk, words, places, counts in zip(*(rows.column(c).to_pylist() for c in ("chunk", "words", "places", "counts")), strict=True):
                w = numbers.numbered(packed.read_words(words))
                stems, first = np.unique(numbers.of[w], return_index=True)
                s = stems[np.argsort(first)]  # as they come up in the chunk
                values = packed.read(counts)
                of_words, of_stems = _grown(of_words, len(numbers)), _grown(of_stems, len(numbers.stems))
                of_words[:, w] += values[: 3 * len(w)].reshape(3, -1)
                of_stems[:, s] += values[3 * len(w) :].reshape(3, -1)
                held.append((chunk, places, w))
            of = numbers.of[: len(numbers)]
            of_words, of_stems = of_words[:, : len(numbers)], of_stems[:, : len(numbers.stems)]
            in_stem = np.zeros(len(numbers.stems), np.int64)
            np.add.at(in_stem, of, of_words[0] + 1)
            found = np.concatenate([of_words, in_stem[None, of], of_stems[:, of]])
            totals = [*(of_words[1:] > 0).sum(1), *(of_stems[1:] > 0).sum(1), *of_words[1:].sum(1), *of_stems[1:].sum(1), (of_stems[0] + 1).sum()]
            n = len(held)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk for chunk, _, _ in held] + [None], pa.int64()),
                    pa.array([places for _, places, _ in held] + [None], pa.binary()),
                    pa.array([packed.numbers(found[:, w].ravel()) for _, _, w in held] + [None], pa.binary()),
                    *(pa.array([None] * n + [int(total)], pa.int64()) for total in totals),
                ],
                ["chunk", "places", "counts", *_TOTALS],
            )


def log_ratios(counts: np.ndarray, totals: dict[str, int]) -> np.ndarray:
    """log p_toxic(w) / p_ordinary(w) of words with the seven counts that ``_merged`` gives."""
    tokens, in_stem, documents = (counts[i].astype(np.float64) for i in (0, 3, 4))
    below = (documents + 1) / totals["shared"]
    share = (tokens + 1) / in_stem
    p = []
    for c in (0, 1):
        n, m = totals[f"n{c}"], totals[f"m{c}"]
        stem = np.maximum(counts[5 + c] - DISCOUNT, 0) / m + DISCOUNT * totals[f"u{c}"] / m * below
        p.append(np.maximum(counts[1 + c] - DISCOUNT, 0) / n + DISCOUNT * totals[f"v{c}"] / n * stem * share)
    return np.log(p[1] / p[0])


def statistics(ratios: np.ndarray) -> list[float]:
    if not len(ratios):
        return [0.0] * len(FEATURES)
    median = float(np.median(ratios))
    top = np.partition(ratios, max(0, len(ratios) - 3))[-3:]
    return [
        float(ratios.mean()),
        median,
        float(np.maximum(ratios - EXCESS, 0).mean()),
        float(top.mean()),
        float(np.maximum(ratios - median - EXCESS, 0).mean()),
        math.log1p(len(ratios)),
    ]


def _measure(totals: dict[str, int]):
    """The statistics of texts; a chunk's counts stand before its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = Packed()
        chunk, parts, ratios = None, [], np.zeros(0)
        for batch in batches:
            rows, at_rows = [], []
            columns = (batch.column(c).to_pylist() for c in ("chunk", "bag", "places", "counts"))
            for i, (at, bag, places, counts) in enumerate(zip(*columns, strict=True)):
                if at != chunk:
                    chunk, parts, ratios = at, [], np.zeros(0)
                if bag is None:
                    parts.append((np.cumsum(packed.read(places)), log_ratios(packed.read(counts).reshape(7, -1), totals)))
                    continue
                if parts:
                    ratios = np.zeros(sum(len(w) for w, _ in parts))
                    for w, values in parts:
                        ratios[w] = values
                    parts = []
                local, times = _bag(packed, bag)
                at_rows.append(i)
                rows.append(statistics(np.repeat(ratios[local], times)))
            values = np.array(rows, np.float64).reshape(-1, len(FEATURES))
            kept = batch.take(pa.array(at_rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column("doc_id"), kept.column("content"), *(pa.array(values[:, i]) for i in range(len(FEATURES)))],
                ["doc_id", "content", *FEATURES],
            )

    return run


def fitted(rows: DataFrame) -> tuple[list[float], list[float], list[float]] | None:
    """Means, deviations and weights (bias first) of a logistic model over all ``rows``.

    They hold ``FEATURES`` and ``toxic`` and are read once for the moments and once for
    each Newton step; sums of one size reach the driver.  None without both labels.
    """
    n, ones, *moments = rows.agg(
        F.count("*"),
        F.sum("toxic"),
        *[of(f) for of in (F.avg, F.stddev_pop) for f in FEATURES],
    ).first()
    if not ones or ones == n:
        return None
    mean, deviation = moments[: len(FEATURES)], [d if d > 1e-9 else 1.0 for d in moments[len(FEATURES) :]]
    x = [F.lit(1.0), *[(F.col(f) - F.lit(m)) / F.lit(d) for f, m, d in zip(FEATURES, mean, deviation, strict=True)]]
    scaled = rows.select(F.col("toxic").cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
    size = len(x)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    weights = np.zeros(size)
    penalty = np.full(size, RIDGE)
    penalty[0] = 1e-3
    for _ in range(STEPS):
        logit = sum((F.col(f"x{i}") * F.lit(float(w)) for i, w in enumerate(weights)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))
        sums = (
            scaled.withColumn("p", p)
            .agg(
                *[F.sum((F.col("y") - F.col("p")) * F.col(f"x{i}")) for i in range(size)],
                *[F.sum(F.col(f"x{i}") * F.col(f"x{j}") * F.col("p") * (1 - F.col("p"))) for i, j in pairs],
            )
            .first()
        )
        square = np.diag(penalty)
        for (i, j), value in zip(pairs, sums[size:], strict=True):
            square[i, j] += value
            if i != j:
                square[j, i] += value
        step = np.linalg.solve(square, np.array(sums[:size]) - penalty * weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, deviation, weights.tolist()


def measured_texts(rows: DataFrame, known: DataFrame) -> DataFrame | None:
    """doc_id, content and ``FEATURES`` of every row; None where a class has no words."""
    spark = rows.sparkSession
    id_type = rows.schema["doc_id"].dataType.simpleString()
    read = stored(
        rows.mapInArrow(
            _read(CHUNK_WORDS), f"chunk long, doc_id {id_type}, content long, bag binary, words binary, tokens binary, documents binary, n long"
        )
    )
    words, texts = read.filter("bag is null"), read.filter("bag is not null")
    buckets = 1 + (words.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS
    # Labels grow with the corpus, so they are dealt by id with the texts at every size, not broadcast.
    classes = known.filter(remainder("labelled") < 2).hint("shuffle_hash")
    training = texts.filter(remainder("doc_id") < 2).join(classes, F.col("doc_id") == F.col("labelled"))
    none = [F.lit(None).cast("binary").alias(c) for c in ("words", "tokens", "documents")]
    counts = stored_alone(
        words.select("chunk", F.lit(None).cast("int").alias("toxic"), "bag", "words", "tokens", "documents")
        .unionByName(training.select("chunk", "toxic", "bag", *none))
        .repartition(partitions(spark), "chunk")
        .sortWithinPartitions("chunk", F.col("words").isNull())
        .mapInArrow(_dealt(buckets), "bucket long, chunk long, words binary, places binary, counts binary")
        .repartition(partitions(spark), "bucket")
        .sortWithinPartitions("bucket", "chunk")
        .mapInArrow(_merged, "chunk long, places binary, counts binary, " + ", ".join(f"{t} long" for t in _TOTALS))
    )
    totals = counts.agg(*[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in _TOTALS]).first().asDict()
    if not totals["n0"] or not totals["n1"]:
        return None
    none = [F.lit(None).cast("binary").alias(c) for c in ("places", "counts")]
    return stored_alone(
        texts.select("chunk", "doc_id", "content", "bag", *none)
        .unionByName(counts.filter("chunk is not null").select("chunk", "places", "counts"), allowMissingColumns=True)
        .repartition(partitions(spark), "chunk")
        .sortWithinPartitions("chunk", F.col("bag").isNotNull())
        .mapInArrow(_measure(totals), f"doc_id {id_type}, content long, " + ", ".join(f"{f} double" for f in FEATURES))
    )


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, content (hash of the text), held_out, score, predicted: a row per row of ``docs``."""
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("content"), text.alias("text"))
    held_out = F.coalesce(remainder("doc_id") == 2, F.lit(False))
    known = (
        labels.select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic"))
        .filter("toxic in (0, 1) and labelled is not null")
        .groupBy("labelled")
        .agg(F.max("toxic").alias("toxic"))
    )
    measured = measured_texts(rows, known)
    if measured is None:
        return rows.select("doc_id", "content", held_out.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    sample = (
        measured.filter(remainder("doc_id") == 3)
        .join(known.filter(remainder("labelled") == 3).hint("shuffle_hash"), F.col("doc_id") == F.col("labelled"))
        .select("toxic", *FEATURES)
    )
    model = fitted(stored(sample))
    if model is None:
        score: Column = F.lit(0.0)
    else:
        logit: Column = F.lit(model[2][0])
        for f, m, d, w in zip(FEATURES, model[0], model[1], model[2][1:], strict=True):
            logit = logit + (F.col(f) - F.lit(m)) / F.lit(d) * F.lit(w)
        score = 1 / (1 + F.exp(-logit))
    return measured.select("doc_id", "content", held_out.alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic."""
    toxic = toxicity_scores(docs, labels, id_col, text_col).filter("predicted = 1").select("doc_id", "content").distinct()
    text = text_or_empty(f"row.{text_col}")
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col(f"row.{id_col}").eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("content"))
    return rows.join(toxic, same, "left_anti").select("row.*")
