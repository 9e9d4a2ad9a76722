"""Removal of repeated byte strings by blockwise sorting of suffixes.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier
(in a smaller document, or before in the same one).  All strings of that length are
judged, each as the first bytes of a suffix; suffixes that share a block of bytes
form a bucket, and one bucket at a time is sorted in a task.

Which suffixes can be equal, and where ties end, follows from a cover sample of
positions, such that two equal strings always hold a sample position at the same
offset.  ``cover="difference"`` fixes these by place, as a difference cover modulo
73 (9 of every 73; each string holds 9).  ``cover="content"`` takes, in each string,
the leftmost block of ``BLOCK`` bytes with the least hash (about 1 position in 37;
each string has one); it gives the same result with less to sort.  Each sample
position has a name (the block's hash) and a rank of long ties (the hash of all
bytes of the strings that it stands for):

1. In each portion of text the sample positions are found, and of equal (name, rank)
   the first stays; strings of the others are repeated.
2. Buckets by name: of equal ranks the first stays again.  A name with one rank is
   done; of the others only the first of each rank goes on.
3. For these, the bytes around the position are read and the suffixes of the bucket
   sorted at each offset; all but the first of equal ones are repeated.

Names and ranks are hashes of 56 and 48 bits, compared together (104 bits for a string;
among the 10^13 sample positions of 100 TB, a chance of about 1 in 200,000 that any two
strings are taken for equal that are not); no text is compared beyond them.  A task
holds a portion of text or a bucket, of which there are four times as many as shuffle
partitions.  The occurrences of one block
whose surroundings all differ meet in one bucket, at about 34 bytes each in step 2.

Defined cases: null text is empty; a null id comes before all others; rows that
repeat a ``doc_id`` are one place: the same start in them is not earlier, and what is
repeated in one is taken out of each; an empty table gives an empty result; other
columns are not read.  Texts of any length are cut into portions that overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posolog.llm.common import partitions, runs, stored, stored_alone, text_or_empty, whole_groups

LENGTH = 100
BLOCK = 28
#: Block positions in a string.
PLACES = LENGTH - BLOCK + 1
PORTION = 2 << 20
# Fixed value: a perfect difference set modulo PLACES (73); every difference occurs.
DIFFERENCES = [1, 2, 4, 8, 16, 32, 37, 55, 64]
#: What is kept of the hashes of a block and of its strings: 56 and 48 bits.
NAME_MASK, RANK_MASK = np.uint64(0xFFFFFFFFFFFFFF00), np.uint64(0xFFFFFFFFFFFF0000)
_ROOT = 6364136223846793005
_NO_ID = -(1 << 63)
_SCHEMA = "bucket int, n int, data binary"


def _power_tables(n: int, tables: dict[str, np.ndarray] = {}) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: B006
    """Random odd values of bytes, and powers of the root and its inverse mod 2^64."""
    if not tables or len(tables["power"]) < n:
        size = max(n, PORTION + 2 * LENGTH)
        values = np.random.default_rng(4).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        root = np.full(size, _ROOT, np.uint64)
        inverse = np.full(size, pow(_ROOT, -1, 1 << 64), np.uint64)
        root[0] = inverse[0] = 1
        tables.update(values=values, power=np.multiply.accumulate(root), inverse=np.multiply.accumulate(inverse))
    return tables["values"], tables["power"], tables["inverse"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _packed(*columns: np.ndarray) -> bytes:
    """Columns by byte planes, compressed."""
    import zstandard

    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.compress(b"".join(planes), 1)


def _unpacked(data: bytes, n: int, kinds: list[str]) -> list[np.ndarray]:
    import zstandard

    body, at, out = np.frombuffer(zstandard.decompress(data), np.uint8), 0, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(body[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def portions(texts: Iterator[tuple[int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (document, offset, bytes) of about ``PORTION`` bytes; long texts overlap
    so that each string is in one of them."""
    held: list[tuple[int, int, bytes]] = []
    weight = 0
    for doc, body in texts:
        for at in range(0, max(1, len(body) - LENGTH + 1), PORTION):
            part = body[at : at + PORTION + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if held and weight + len(part) > PORTION + LENGTH:
                yield held
                held, weight = [], 0
            held.append((doc, at, part))
            weight += len(part)
    if held:
        yield held


def _by_content(names: np.ndarray, start: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
    """Position, first and last string start of each run of strings with one least block."""
    mask = np.uint64((1 << 23) - 1)
    least = (names & ~mask) | np.arange(len(names), dtype=np.uint64)
    width = 1
    while 2 * width <= PLACES:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = PLACES - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    position = (least[start] & mask).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (position[1:] != position[:-1]) | (of[1:] != of[:-1])]))
    last = np.append(new[1:], len(start)) - 1
    return position[new], start[new], start[last], of[new]


def _by_place(place: np.ndarray, first: np.ndarray, last: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Difference-cover positions of each text with the strings around them."""
    at = np.flatnonzero(np.isin(place % PLACES, DIFFERENCES) & (last[owner] >= first[owner]))
    of = owner[at]
    low, high = np.maximum(first[of], at - PLACES + 1), np.minimum(last[of], at)
    held = low <= high
    return at[held], low[held], high[held], of[held]


def sample(portion: list[tuple[int, int, bytes]], cover: str) -> tuple[np.ndarray, ...]:
    """name, rank, document, position, and the farthest and nearest string starts
    before the position, for each sample position of a portion."""
    sizes = np.array([len(body) for _, _, body in portion])
    values, power, inverse = _power_tables(int(sizes.sum()) + 1)
    text = np.frombuffer(b"".join(body for _, _, body in portion), np.uint8)
    n = len(text)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[text] * power[:n], out=sums[1:])
    names = _mixed((sums[BLOCK:] - sums[:-BLOCK]) * inverse[: n + 1 - BLOCK])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    offsets = np.array([offset for _, offset, _ in portion], np.int64)
    if cover == "content":
        start = np.flatnonzero(np.arange(n - LENGTH + 1) + LENGTH <= ends[owner[: n - LENGTH + 1]])
        at, low, high, of = _by_content(names, start, owner[start])
    else:
        begins = ends - sizes
        # Blocks reach to the end of the bytes of the last string only.
        place = np.arange(len(names)) - begins[owner[: len(names)]] + offsets[owner[: len(names)]]
        at, low, high, of = _by_place(place, begins, ends - LENGTH, owner[: len(names)])
    rank = _mixed((sums[high + LENGTH] - sums[low]) * inverse[low] + ((at - low) * 128 + at - high).astype(np.uint64))
    docs = np.array([doc for doc, _, _ in portion], np.int64)
    shift = offsets - (ends - sizes)
    return names[at] & NAME_MASK, rank & RANK_MASK, docs[of], at + shift[of], (at - low).astype(np.uint8), (at - high).astype(np.uint8)


def firsts(columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (name, rank, document, position); which of these are first of their
    (name, rank); which come after the first."""
    name, rank, doc, at = columns[:4]
    order = np.lexsort((at, doc, rank, name))
    name, rank, doc, at = name[order], rank[order], doc[order], at[order]
    first = np.concatenate([[True], (name[1:] != name[:-1]) | (rank[1:] != rank[:-1])]) if len(name) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    later = (doc != doc[head]) | (at != at[head])
    return order, first, later


_KINDS = ["<u8", "<u8", "<i8", "<i8", "u1", "u1"]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _dealt(columns: tuple[np.ndarray, ...], bits: int) -> pa.RecordBatch:
    """Packed rows by bucket of columns sorted by name (the first column)."""
    bucket = (columns[0] >> np.uint64(64 - bits)).astype(np.int64)
    rows = []
    for start, length in zip(*runs(bucket), strict=True):
        part = [c[start : start + length] for c in columns]
        rows.append((int(bucket[start]), int(length), _packed(*part)))
    return _batch(rows, ["bucket", "n", "data"], [pa.int32(), pa.int32(), pa.binary()])


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray, number: int) -> pa.RecordBatch:
    data = _packed(doc.astype("<i8"), start.astype("<i8"), end.astype("<i8"))
    return _batch([(-1 - number, len(doc), data)], ["bucket", "n", "data"], [pa.int32(), pa.int32(), pa.binary()])


def _step1(bits: int, cover: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((d.as_py(), t.as_py()) for batch in batches for d, t in zip(batch.column("doc"), batch.column("body"), strict=True))
        for number, portion in enumerate(portions(texts)):
            columns = sample(portion, cover)
            order, first, later = firsts(columns)
            columns = tuple(c[order] for c in columns)
            if later.any():
                doc, at, far, near = (c[later] for c in columns[2:])
                yield _spans(doc, at - far, at - near + LENGTH, number % (1 << bits))
            yield _dealt(tuple(c[first] for c in columns), bits)

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    for group in whole_groups(batches, "bucket"):
        bucket, n, data = (group.column(c) for c in ("bucket", "n", "data"))
        for start, length in zip(*runs(bucket.to_numpy()), strict=True):
            part = range(start, start + length)
            yield bucket[start].as_py(), [(n[i].as_py(), data[i].as_py()) for i in part]


def _step2(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated spans (name null) and sample positions that go on (with their name)."""

    def out(doc: np.ndarray, a: np.ndarray, b: np.ndarray, name: np.ndarray | None) -> pa.RecordBatch:
        names = pa.nulls(len(doc), pa.int64()) if name is None else pa.array(name.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(a), pa.array(b), names], ["doc", "a", "b", "name"])

    for bucket, parts in _buckets(batches):
        if bucket < 0:
            for n, data in parts:
                yield out(*_unpacked(data, n, ["<i8", "<i8", "<i8"]), None)
            continue
        columns = [np.concatenate(c) for c in zip(*(_unpacked(data, n, _KINDS) for n, data in parts), strict=True)]
        by_name = np.sort(columns[0])
        tied = np.unique(by_name[1:][by_name[1:] == by_name[:-1]])
        if not len(tied):
            continue
        place = np.minimum(np.searchsorted(tied, columns[0]), len(tied) - 1)
        columns = tuple(c[tied[place] == columns[0]] for c in columns)
        order, first, later = firsts(columns)
        name, _, doc, at, far, near = (c[order] for c in columns)
        if later.any():
            yield out(doc[later], at[later] - far[later], at[later] - near[later] + LENGTH, None)
        name, doc, at, far, near = (c[first] for c in (name, doc, at, far, near))
        starts, lengths = runs(name)
        several = np.repeat(lengths > 1, lengths)
        if several.any():
            reach = far.astype(np.int64) * 128 + near
            yield out(doc[several], at[several], reach[several], name[several])


def _step3_read(bits: int):
    """Packed rows of the bytes around sample positions, the position at column PLACES - 1."""
    before, width = PLACES - 1, PLACES - 1 + LENGTH

    def pack(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        name, doc, at, reach, around = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((at, doc, name))
        return _dealt(tuple(c[order] for c in (name, doc, at, reach, around)), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            for doc, body, places in zip(batch.column("doc"), batch.column("body"), batch.column("places"), strict=True):
                at = places.values.field("a").to_numpy()
                reach = places.values.field("b").to_numpy()
                name = places.values.field("name").to_numpy().view(np.uint64)
                raw = body.as_buffer()
                text = np.zeros(len(raw) + 2 * width, np.uint8)
                text[width : width + len(raw)] = np.frombuffer(raw, np.uint8)
                columns = np.arange(width)
                for i in range(0, len(at), 8192):
                    far, near = reach[i : i + 8192] >> 7, reach[i : i + 8192] & 127
                    around = text[width + at[i : i + 8192, None] - before + columns]
                    around[(columns < before - far[:, None]) | (columns >= before - near[:, None] + LENGTH)] = 0
                    rows = np.ascontiguousarray(around).view(f"V{width}").reshape(-1)
                    ids = np.full(len(rows), doc.as_py(), np.int64)
                    parts.append((name[i : i + 8192], ids, at[i : i + 8192], reach[i : i + 8192].astype("<u2"), rows))
                    held += len(rows)
                if held >= 100_000:
                    yield pack(parts)
                    parts, held = [], 0
        if parts:
            yield pack(parts)

    return run


def repeated_at(name: np.ndarray, doc: np.ndarray, at: np.ndarray, reach: np.ndarray, around: np.ndarray) -> np.ndarray:
    """For rows sorted by (name, document, position): row x offset, whether the string
    that starts so far before the position equals that of an earlier row."""
    before = PLACES - 1
    far, near = reach.astype(np.int64) >> 7, reach.astype(np.int64) & 127
    values, power, _ = _power_tables(1)
    rolled = np.zeros(len(name), np.uint64)
    for j in range(LENGTH):
        rolled += values[around[:, before + j]] * power[j]
    repeated = np.zeros((len(name), PLACES), bool)
    for offset in range(PLACES):
        if offset:
            start = before - offset
            rolled = values[around[:, start]] + rolled * power[1] - values[around[:, start + LENGTH]] * power[LENGTH]
        rows = np.flatnonzero((near <= offset) & (offset <= far))
        key = _mixed(rolled[rows] + name[rows])
        order = np.argsort(key, kind="stable")
        key, rows = key[order], rows[order]
        starts, lengths = runs(key)
        head = np.repeat(rows[starts], lengths)
        repeated[rows, offset] = (name[rows] == name[head]) & ((doc[rows] != doc[head]) | (at[rows] != at[head]))
    return repeated


def _step3(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = PLACES - 1 + LENGTH
    for _, parts in _buckets(batches):
        kinds = ["<u8", "<i8", "<i8", "<u2", f"V{width}"]
        columns = [np.concatenate(c) for c in zip(*(_unpacked(data, n, kinds) for n, data in parts), strict=True)]
        order = np.lexsort((columns[2], columns[1], columns[0]))
        name, doc, at, reach, around = (c[order] for c in columns)
        around = around.view(np.uint8).reshape(-1, width)
        repeated = np.zeros((len(name) + 0, PLACES + 2), bool)
        repeated[:, 1:-1] = repeated_at(name, doc, at, reach, around)
        edge = repeated[:, 1:] != repeated[:, :-1]
        row, offset = np.nonzero(edge)  # in turn: first offset of a run, one past its last
        row, first, after = row[::2], offset[::2], offset[1::2]
        if len(row):
            start, end = at[row] - after + 1, at[row] - first + LENGTH
            yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(start), pa.array(end)], ["doc", "a", "b"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for body, spans in zip(batch.column("body"), batch.column("spans"), strict=True):
            raw = body.as_py()
            if not spans.is_valid:
                rows.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                continue
            n = len(raw)
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, np.clip(spans.values.field("a").to_numpy(), 0, n), 1)
            np.add.at(change, np.clip(spans.values.field("b").to_numpy(), 0, n), -1)
            gone = np.cumsum(change[:-1]) > 0
            count = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows.append((n, int(gone.sum()), count, hashlib.sha256(kept).hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(rows: DataFrame, cover: str = "difference") -> DataFrame:
    """(doc, a, b): byte ranges of ``rows`` (see ``_rows``) to remove; they overlap."""
    spark = rows.sparkSession
    n = partitions(spark)
    bits = max(4, (4 * n - 1).bit_length())
    names = stored_alone(  # its packed sample positions are three times the texts
        rows.select("doc", "body").mapInArrow(_step1(bits, cover), _SCHEMA)
        .repartition(n, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_step2, "doc long, a long, b long, name long")
    )
    places = (
        names.filter("name is not null")
        .groupBy(F.col("doc").alias("of"))
        .agg(F.collect_list(F.struct("a", "b", "name")).alias("places"))
    )
    # The same columns as in ``without_repeats``, so that texts are shuffled once for both joins.
    around = rows.join(places, F.col("doc") == F.col("of")).select("doc_id", "doc", "body", "places")
    later = (
        around.mapInArrow(_step3_read(bits), _SCHEMA)
        .repartition(n, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_step3, "doc long, a long, b long")
    )
    return names.filter("name is null").select("doc", "a", "b").unionByName(later)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, doc, body: ``doc`` orders documents by id and is equal for equal texts of an id only.

    Where an id (or null) stands for different texts, ids and texts are numbered anew: a
    range partitioning by (id, text hash), written, and numbers that ascend with it.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("doc"), text_or_empty(text_col).cast("binary").alias("body"))
    content = F.xxhash64("body")
    several = rows.groupBy("doc").agg(F.min(content).alias("low"), F.max(content).alias("high")).filter("low <> high")
    if several.isEmpty():
        return rows
    numbered = stored(
        rows.select(F.col("doc").alias("of"), content.alias("content"))
        .distinct()
        .repartitionByRange("of", "content")
        .sortWithinPartitions("of", "content")
        .withColumn("number", F.monotonically_increasing_id())
    )
    same = (F.col("doc") == F.col("of")) & (content == F.col("content"))
    return rows.join(numbered, same).select("doc_id", F.col("number").alias("doc"), "body")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cover: str = "difference") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of ``docs``."""
    rows = _rows(docs, id_col, text_col)
    spans = (
        repeated_spans(rows, cover)
        .groupBy(F.col("doc").alias("of"))
        .agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return (
        rows.join(spans, F.col("doc") == F.col("of"), "left")
        .select("doc_id", "body", "spans")
        .mapInArrow(_finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )
