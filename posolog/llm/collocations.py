"""Phrases of two to four words by direct-address tiling of pairs of ids.

Words of a language that occur often enough are ranked by frequency.  The ``HEAD`` most
frequent have their rank as id; the others a hash of 62 bits, and a bit table of fixed
size tells rare words apart (a rare word that it lets through is only counted in vain).
A phrase of m + 1 words is a pair of neighbouring ids of m words, so one counter serves
every length:

* pairs of two ranks below ``HEAD`` fall into tiles of ``SIDE`` x ``SIDE`` cells.  A tile
  with many pairs is counted directly, by ``numpy.bincount`` on the cell numbers;
* pairs in sparse tiles, and pairs with a hashed id, are kept as sorted coordinates
  with their counts, merged run by run.

A task counts its own texts, in bounded memory; its counts by pair are then summed by a
grouped sum, so a pair that fills the corpus is one row a task.  Pairs that occur often
enough are ranked by frequency again, and their ids are the words of the next length:
no phrase is counted of which a part is too rare (none of its occurrences is lost, as
a phrase is no more frequent than its parts).

The counts of all parts are then at hand: the first and last m words of a phrase are its
two ids.  A phrase is dropped if a longer candidate of nearly its frequency holds it;
one word more is enough to look at, as a still longer one is no more frequent.

Defined cases: null text is empty; null ``lang`` is ``und``, together with a language of
that name; rows that repeat an id count each; texts without phrases give no rows; an
empty table gives an empty result; other columns are not read.  Two different ids of
62 bits agree with a chance of about 1 in 1,000 at 10^8 hashed phrases.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posolog.llm.common import partitions, runs, stored
from posolog.llm.token_counts import Memory

LEAST = 30
LONGEST = 4
TOP = 2000
#: A phrase goes if a longer one has at least this share (in 100) of its occurrences.
HELD = 80
SCALE = 2_000_000

HEAD_BITS = 16
HEAD = 1 << HEAD_BITS
SIDE_BITS = 10
SIDE = 1 << SIDE_BITS
TILES = 1 << 2 * (HEAD_BITS - SIDE_BITS)
#: Pairs of one tile in a block of ids that are worth a table of all its cells.
DENSE_PAIRS = SIDE * SIDE // 16
DENSE_TILES = 8
#: Bits of the table that tells rare ids apart, and bits of it a row carries.
TABLE_BITS = 1 << 25
TABLE_ROW = 1 << 15
#: Words that a task turns into ids at a time, and coordinates it holds.
BLOCK_WORDS = 1 << 19
HELD_PAIRS = 1 << 21
HELD_WORDS = 1 << 18
HELD_NAMES = 1 << 19
HELD_LANGUAGES = 256

_HASHED = np.int64(1 << 62)
_BREAK = b"\n"
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x0A if b in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if b == 0x09 else b for b in range(256)
)


def words(text: str) -> list[bytes]:
    """Words in order, with ``_BREAK`` between pieces; empty strings are no words."""
    return text.encode().translate(_FOLD).replace(_BREAK, b" \n ").split(b" ")


def _pair_hash(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """62 mixed bits of a pair, with the mark of a hashed id."""
    with np.errstate(over="ignore"):
        x = i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (j.astype(np.uint64) ^ np.uint64(0xD1B54A32D192ED03))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            x += j.astype(np.uint64)
    x ^= x >> np.uint64(31)
    return ((x & np.uint64((1 << 62) - 1)) | np.uint64(1 << 62)).astype(np.int64)


def _places(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a hashed id in the bit table."""
    return hashed & (TABLE_BITS - 1), (hashed >> 31) & (TABLE_BITS - 1)


def _in_table(table: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashed), bool)
    for place in _places(hashed):
        found &= (table[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
    return found


def _table_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of hashed ids, a row for each ``TABLE_ROW`` of the table."""
    table = np.zeros(TABLE_BITS // 8, np.uint8)
    for batch in batches:
        hashed = batch.column("id").to_numpy()
        for place in _places(hashed):
            np.bitwise_or.at(table, place >> 3, (1 << (place & 7)).astype(np.uint8))
    rows = table.reshape(-1, TABLE_ROW // 8)
    some = np.flatnonzero(rows.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), pa.array([rows[r].tobytes() for r in some], pa.binary())], ["row", "bits"]
    )


def _table_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, bits in zip(batch.column("row").to_pylist(), batch.column("bits"), strict=True):
            part = np.frombuffer(bits.as_py(), np.uint8)
            rows[row] = rows[row] | part if row in rows else part
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(rows), pa.int32()), pa.array([r.tobytes() for r in rows.values()], pa.binary())], ["row", "bits"]
    )


def _bit_table(ids: DataFrame) -> np.ndarray:
    """The bit table of ``ids``: 4 MB, whatever their number."""
    found = (
        ids.select("id")
        .mapInArrow(_table_rows, "row int, bits binary")
        .repartition(partitions(ids.sparkSession), "row")
        .mapInArrow(_table_sums, "row int, bits binary")
    )
    table = np.zeros((TABLE_BITS // TABLE_ROW, TABLE_ROW // 8), np.uint8)
    for row, bits in found.collect():
        table[row] = np.frombuffer(bytes(bits), np.uint8)
    return table.reshape(-1)


class Names:
    """Ids of words: rank of a frequent one, hash of another that may be frequent, else -1."""

    def __init__(self, ranked: list[tuple[str, str]], table: np.ndarray) -> None:
        self.rank: dict[str, dict[bytes, int]] = {}
        for n, (lang, word) in enumerate(ranked):
            self.rank.setdefault(lang, {})[word.encode()] = n
        self.table = table

    def of(self, lang: str) -> Memory:
        import xxhash

        ranks, table = self.rank.get(lang, {}), self.table.tobytes()
        seed, mask = xxhash.xxh64_intdigest(lang.encode(), seed=42), (1 << 62) - 1
        low = TABLE_BITS - 1

        def name(word: bytes) -> int:
            """``_in_table`` for one word, without arrays: tasks meet many rare words once."""
            rank = ranks.get(word)
            if rank is not None:
                return rank
            if word == _BREAK:
                return -1
            hashed = (xxhash.xxh64_intdigest(word, seed=seed) & mask) | (1 << 62)
            one, two = hashed & low, (hashed >> 31) & low
            return hashed if table[one >> 3] >> (one & 7) & 1 and table[two >> 3] >> (two & 7) & 1 else -1

        return Memory(name)


class Pairs:
    """Ids of pairs of ids: rank of a frequent pair, hash of another that may be frequent, else -1."""

    def __init__(self, i: np.ndarray, j: np.ndarray, table: np.ndarray) -> None:
        hashed = _pair_hash(i, j)
        order = np.argsort(hashed)
        self.sorted, self.rank = hashed[order], order
        self.table = table

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        """Ids one word longer; the last place has none."""
        out = np.full(len(ids), -1, np.int64)
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        hashed = _pair_hash(ids[at], ids[at + 1])
        found = np.where(_in_table(self.table, hashed), hashed, -1)
        if len(self.sorted):
            slot = np.minimum(np.searchsorted(self.sorted, hashed), len(self.sorted) - 1)
            found = np.where(self.sorted[slot] == hashed, self.rank[slot], found)
        out[at] = found
        return out


class Tiles:
    """Counts of pairs of ids: tables of crowded tiles, sorted coordinates of the rest."""

    def __init__(self) -> None:
        self.dense: dict[int, np.ndarray] = {}
        self.ranked: list[tuple[np.ndarray, np.ndarray]] = []
        self.hashed: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        ranked = (i < HEAD) & (j < HEAD)
        self._add_ranked(i[ranked], j[ranked])
        i, j = i[~ranked], j[~ranked]
        if len(i):
            self.hashed.append(_merged_pairs(i, j, np.ones(len(i), np.int64)))
            self.held += len(self.hashed[-1][0])
        if self.held > HELD_PAIRS:
            self._merge()

    def _add_ranked(self, i: np.ndarray, j: np.ndarray) -> None:
        tile = (i >> SIDE_BITS) << (HEAD_BITS - SIDE_BITS) | (j >> SIDE_BITS)
        crowded = np.flatnonzero(np.bincount(tile, minlength=TILES) >= DENSE_PAIRS)
        for t in crowded[: max(0, DENSE_TILES - len(self.dense))]:
            self.dense.setdefault(int(t), np.zeros(SIDE * SIDE, np.int64))
        rest = np.ones(len(i), bool)
        for t, cells in self.dense.items():
            own = tile == t
            cells += np.bincount((i[own] & (SIDE - 1)) << SIDE_BITS | (j[own] & (SIDE - 1)), minlength=SIDE * SIDE)
            rest &= ~own
        code = np.sort(i[rest] << HEAD_BITS | j[rest])
        starts, lengths = runs(code)
        if len(code):
            self.ranked.append((code[starts], lengths))
            self.held += len(starts)

    def _merge(self) -> None:
        if self.ranked:
            code, n = (np.concatenate(x) for x in zip(*self.ranked, strict=True))
            self.ranked = [_summed(code, n)]
        if self.hashed:
            self.hashed = [_merged_pairs(*(np.concatenate(x) for x in zip(*self.hashed, strict=True)))]
        self.held = sum(len(x[0]) for x in (*self.ranked, *self.hashed))

    def crowded(self) -> bool:
        return self.held > HELD_PAIRS

    def rows(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        parts = [(code >> HEAD_BITS, code & (HEAD - 1), n) for code, n in self.ranked] + self.hashed
        for t, cells in self.dense.items():
            cell = np.flatnonzero(cells)
            row, column = t >> (HEAD_BITS - SIDE_BITS), t & (HEAD // SIDE - 1)
            parts.append((row << SIDE_BITS | cell >> SIDE_BITS, column << SIDE_BITS | cell & (SIDE - 1), cells[cell]))
        for part in parts:
            for at in range(0, len(part[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)], pa.int64()) for x in part], ["i", "j", "n"])


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    starts, _ = runs(keys)
    return keys[starts], np.add.reduceat(n, starts)


def _merged_pairs(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((j, i))
    i, j, n = i[order], j[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    return i[starts], j[starts], np.add.reduceat(n, starts)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, word); the row of a null word tells all words of the language."""
    counts: dict[str, Counter[bytes]] = {}
    totals: Counter[str] = Counter()
    held = 0

    def rows() -> pa.RecordBatch:
        flat = [(lang, word, n) for lang, own in counts.items() for word, n in own.items()]
        flat += [(lang, None, n) for lang, n in totals.items()]
        langs, found, n = zip(*flat, strict=True) if flat else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"]
        )

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            found = Counter(words(text.as_py()))
            del found[_BREAK], found[b""]
            own = counts.setdefault(lang, Counter())
            held -= len(own)
            own.update(found)
            held += len(own)
            totals[lang] += found.total()
        if held > HELD_WORDS:
            yield rows()
            counts.clear()
            totals.clear()
            held = 0
    yield rows()


def _count_pairs(shared):
    """Counts of neighbouring ids, after ``longer`` has named ever longer phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, longer = shared.value
        memories: dict[str, Memory] = {}
        tiles = Tiles()
        block: list[np.ndarray] = []
        held = 0

        def count() -> None:
            ids = np.concatenate(block)
            for level in longer:
                ids = level(ids)
            at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            tiles.add(ids[at], ids[at + 1])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                if lang not in memories:
                    if len(memories) >= HELD_LANGUAGES:
                        memories.clear()
                    memories[lang] = names.of(lang)
                found = [w for w in words(text.as_py()) if w]
                found.append(_BREAK)
                block.append(np.fromiter(map(memories[lang].__getitem__, found), np.int64, len(found)))
                held += len(found)
                if held >= BLOCK_WORDS:
                    count()
                    block, held = [], 0
                    if tiles.crowded():
                        yield from tiles.rows()
                        tiles = Tiles()
                    if sum(map(len, memories.values())) > HELD_NAMES:
                        memories.clear()
        if block:
            count()
        yield from tiles.rows()

    return run


def _with_ids(ranks: dict[tuple[int, int], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = (batch.column(c).to_numpy() for c in "ij")
            ids = _pair_hash(i, j)
            head = [ranks.get(pair, -1) for pair in zip(i.tolist(), j.tolist(), strict=True)]
            ids = np.where(np.array(head, np.int64) >= 0, head, ids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], [*batch.schema.names, "id"])

    return run


def _ranked_words(frequent: DataFrame) -> tuple[DataFrame, Names]:
    """Frequent words with their ids, and what tasks need to name words."""
    spark = frequent.sparkSession
    head = [(r.lang, r.word) for r in frequent.orderBy(F.desc("n"), "lang", "word").limit(HEAD).collect()]
    ranks = spark.createDataFrame([(*key, n) for n, key in enumerate(head)], "lang string, word string, rank long")
    hashed = F.xxhash64("lang", "word").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    named = stored(
        frequent.join(F.broadcast(ranks), ["lang", "word"], "left").select(
            F.coalesce("rank", hashed).alias("id"), "lang", "word", "n"
        )
    )
    return named, Names(head, _bit_table(named.filter(F.col("id") >= HEAD)))


def _ranked_pairs(counted: DataFrame, least: int) -> tuple[DataFrame, Pairs]:
    """Frequent pairs with their ids, and what tasks need to name them."""
    frequent = stored(counted.groupBy("i", "j").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    head = [(r.i, r.j) for r in frequent.orderBy(F.desc("n"), "i", "j").limit(HEAD).collect()]
    named = stored(frequent.mapInArrow(_with_ids({pair: n for n, pair in enumerate(head)}), "i long, j long, n long, id long"))
    i, j = (np.array([pair[k] for pair in head], np.int64) for k in (0, 1))
    return named, Pairs(i, j, _bit_table(named.filter(F.col("id") >= HEAD)))


def _floored(a: Column, parts: Column) -> Column:
    """floor(SCALE * a / parts); the product may pass 64 bits."""
    product = F.lit(SCALE).cast("decimal(7,0)") * a.cast("decimal(19,0)")
    return F.call_function("div", product, parts.cast("decimal(19,0)"))


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, phrase, m (its words), a, l, r, n, score, dropped: every frequent phrase."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).filter("text is not null")
    counted = stored(
        rows.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        .filter(F.col("word").isNull() | (F.col("n") >= least))
    )
    totals = counted.filter("word is null").select("lang", F.col("n").alias("total"))
    named, names = _ranked_words(counted.filter("word is not null"))

    # Of a phrase: itself, its first and last word, and its counts by number of words from either end.
    level = named.select(
        "id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", F.array("n").alias("heads"), F.array("n").alias("tails")
    )
    longer: list[Pairs] = []
    found = None
    for m in range(2, longest + 1):
        shared = spark.sparkContext.broadcast((names, list(longer)))
        pairs, lookup = _ranked_pairs(rows.mapInArrow(_count_pairs(shared), "i long, j long, n long"), least)
        longer.append(lookup)
        first = level.select(F.col("id").alias("i"), "lang", "phrase", "heads")
        second = level.select(F.col("id").alias("j"), "last", "tails")
        level = stored(
            pairs.join(first, "i").join(second, "j").select(
                "id", "i", "j", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "n",
                F.concat("heads", F.array("n")).alias("heads"), F.concat("tails", F.array("n")).alias("tails"),
            )
        )
        cuts = F.transform(
            F.sequence(F.lit(1), F.lit(m - 1)),
            lambda k: F.struct(F.get("heads", k - 1).alias("l"), F.get("tails", F.lit(m - 1) - k).alias("r")),
        )
        scored = level.select(
            "id", "i", "j", "lang", "phrase", F.lit(m).alias("m"), F.col("n").alias("a"),
            F.array_min(
                F.transform(
                    cuts,
                    lambda c, k: F.struct(
                        _floored(F.col("n"), c["l"] + c["r"]).alias("score"),
                        k.alias("k"), c["l"].alias("l"), c["r"].alias("r"),
                    ),
                )
            ).alias("cut"),
        )
        found = scored if found is None else found.unionByName(scored)
    # The most frequent phrase of one word more that begins or ends with a phrase.
    holders = (
        found.filter("m > 2")
        .select((F.col("m") - 1).alias("m"), "a", F.explode(F.array("i", "j")).alias("id"))
        .groupBy("m", "id")
        .agg(F.max("a").alias("held"))
    )
    return (
        found.join(holders, ["m", "id"], "left")
        .join(totals, "lang")
        .select(
            "lang", "phrase", "m", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score",
            F.coalesce(100 * F.col("held") >= HELD * F.col("a"), F.lit(False)).alias("dropped"),
        )
    )


def top_phrases(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        phrases(docs)
        .filter("not dropped")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )


#: The same by plain counting of all phrases.
SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
starts AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS s FROM listed),
counted AS (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, array_to_string(ws[s:s + m - 1], ' ') AS phrase
    FROM starts, (VALUES (1), (2), (3), (4)) AS lengths(m) WHERE s + m - 1 <= len(ws))
  GROUP BY ALL HAVING count(*) >= 30 ),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM listed GROUP BY lang),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counted WHERE m > 1),
cuts AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, x.f AS l, y.f AS r,
         ((2000000 * c.a::HUGEINT) // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM candidates) c
  JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:k], ' ')
  JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1:], ' ')),
best AS (
  SELECT lang, m, phrase, a, l, r, score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (
  SELECT DISTINCT lang, f, array_to_string(ws[s:s + p - 1], ' ') AS part
  FROM (SELECT lang, a AS f, ws, m, unnest(generate_series(1, m)) AS s FROM candidates), (VALUES (2), (3)) AS lengths(p)
  WHERE p < m AND s + p - 1 <= m),
kept AS (
  SELECT * FROM best b
  WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.lang = b.lang AND p.part = b.phrase AND 100 * p.f >= 80 * b.a)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
