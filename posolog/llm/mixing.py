"""Mixing sources to target weights by Sainte-Lague apportionment of word blocks.

Targets: sources, ranked by name (null last), weigh 1, 2, 3, 1, ...; they share all
words by weight, none above ``most_repeats`` times its own words (what is cut off
is shared again by weight).

Words are handed out in equal blocks.  A seat goes to the highest quotient
votes / (2 seats + 1), first among sources (votes: targets), then among the shards
of each source (votes: words).  A shard is a hashed part of a source; its words
form a stream in seeded order, and its seats take that many blocks of the stream:
whole passes first, then blocks from its start.  A document's share of the last
pass may be a part of it.  What blocks exceed a shard's ``most_repeats`` passes by
goes to the source's other shards, in proportion to what they may still give, so
that a small source of short texts reaches its target, too.

No block is a row: the seats that are certain follow from the exact quota, and
only about three candidate seats a party are ranked.  Shards number about the
square root of the documents, so that neither the shards of one source nor the
documents of one shard become a large group, however large one source is.  Only
the sources themselves (one row each, a setting of the mix) are ranked together.

Defined cases: null text has size 0; null is a source like any other; rows that
repeat a ``doc_id`` are taken each on its own, in the order of their size; equal
quotients go to the smaller source or shard; an empty table gives an empty result;
other columns are not read by ``mix`` and are kept by ``mixed_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posolog.llm.common import WORD_PATTERN, stored, text_or_empty

SEED = 7
MOST_REPEATS = 3
#: A block is this part of the smallest target, from 1 to 1024 words.
BLOCK_SHARE = 128
MOST_BLOCK_WORDS = 1024


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def order_key(id_col: str, seed: int) -> Column:
    """Seeded place of a document, the same in every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def seats(parties: DataFrame, within: list[str], votes: str, house: str, order: list[str]) -> DataFrame:
    """``parties`` with ``seats``: exact highest quotients, ``house`` seats a group.

    With exact shares x (summing to the house) and K parties, the true divisor gives
    each between x - x K / (2 house) - 1/2 and x + x K / (2 house) + 1/2 seats;
    seats below that range are certain, those within it are ranked.
    """
    group = Window.partitionBy(*within)
    x = F.col(votes) * F.col(house) / F.col("_all")
    spread = F.col(votes) * F.col("_k") / (2 * F.col("_all")) + 0.5
    party = [c for c in parties.columns]
    bounds = (
        parties.withColumn("_all", F.sum(votes).over(group))
        .withColumn("_k", F.sum(F.when(F.col(votes) > 0, 1).otherwise(0)).over(group))
        .withColumn("_low", F.when(F.col("_all") > 0, F.greatest(F.floor(x - spread) - 1, F.lit(0))).otherwise(0).cast("long"))
        .withColumn("_high", F.when(F.col(votes) > 0, F.ceil(x + spread) + 1).otherwise(0).cast("long"))
        .withColumn("_open", F.col(house) - F.sum("_low").over(group))
    )
    ranked = (
        bounds.filter("_high > _low")
        .select(*party, "_low", "_open", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_seat"))
        .withColumn("_quotient", F.col(votes) / (2 * F.col("_seat") + 1))
        .withColumn("_rank", F.row_number().over(group.orderBy(F.desc("_quotient"), *order, "_seat")))
        .filter(F.col("_rank") <= F.col("_open"))
        .groupBy(*within, *order)
        .agg(F.count("*").alias("_won"))
    )
    keys = [*within, *order]
    return (
        bounds.join(ranked, keys, "left")
        .withColumn("seats", F.col("_low") + F.coalesce("_won", F.lit(0).cast("long")))
        .select(*party, "seats")
    )


def targets(sources: DataFrame, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) to (source_no, weight, target): shares filled up to the cap.

    Sources in order of cap / weight: one is capped if the level reached without
    capping it exceeds its own; the level is then the same for all others.
    """
    everything = Window.partitionBy()
    ranked = sources.withColumn(
        "source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ).withColumn("weight", (F.col("source_no") - 1) % 3 + 1)
    by_level = Window.orderBy(F.col("_cap") / F.col("weight"), "source_no")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return (
        ranked.withColumn("_cap", F.col("source_size") * most_repeats)
        .withColumn("_rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), zero))
        .withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero))
        .withColumn("_capped", F.col("_rest") * F.col("weight") > F.col("_cap") * F.col("_weights"))
        .withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(everything), zero))
        .withColumn("_sharing", F.sum(F.when(~F.col("_capped"), F.col("weight"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(
                F.col("_left") * F.col("weight") / F.col("_sharing")
            ),
        )
        .select("source", "source_size", "source_no", "weight", "target")
    )


def handed_on(given: DataFrame, most_repeats: int) -> DataFrame:
    """``given`` with ``_words`` of each shard: its blocks' words, none above its cap.

    A source's words above the caps are shared by the room below them: a shard gets
    the difference of two rounded running shares, which is never above its room.
    """
    source = Window.partitionBy("source_no")
    upto = source.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    wide = "decimal(19,0)"

    def share(room: str) -> Column:
        return F.expr(f"coalesce(cast(_over as {wide}) * cast({room} as {wide}) div nullif(cast(_room_all as {wide}), 0), 0)")

    return (
        given.withColumn("_cap", F.col("shard_size") * most_repeats)
        .withColumn("_won", F.col("seats") * F.col("block"))
        .withColumn("_room", F.greatest(F.col("_cap") - F.col("_won"), F.lit(0).cast("long")))
        .withColumn("_room_all", F.sum("_room").over(source))
        .withColumn("_over", F.sum(F.greatest(F.col("_won") - F.col("_cap"), F.lit(0).cast("long"))).over(source))
        .withColumn("_over", F.least("_over", "_room_all"))
        .withColumn("_room_upto", F.sum("_room").over(upto))
        .withColumn("_room_before", F.col("_room_upto") - F.col("_room"))
        .withColumn("_words", F.least("_won", "_cap") + share("_room_upto") - share("_room_before"))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", seed: int = SEED, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken, and passes (whole), part (words more)."""
    sized = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            words(text_or_empty()).alias("size"),
        )
    )
    n_shards = max(1, math.ceil(math.sqrt(sized.count())))
    key = order_key("doc_id", seed)
    shard = F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % n_shards
    placed = sized.select(
        "doc_id", "size", key.alias("_place"), shard.alias("shard"),
        F.col("source"), F.coalesce("source", F.lit("")).alias("_src"), F.col("source").isNull().alias("_none"),
    )
    shards = stored(placed.groupBy("source", "_src", "_none", "shard").agg(F.sum("size").alias("shard_size")))
    sources = targets(shards.groupBy("source").agg(F.sum("shard_size").alias("source_size")), most_repeats)
    everything = Window.partitionBy()
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    block = F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCK_WORDS), F.floor(least / BLOCK_SHARE))).cast("long")
    sources = sources.withColumn("block", F.coalesce(block, F.lit(1).cast("long"))).withColumn(
        "_house", F.floor(F.sum("source_size").over(everything) / F.col("block") + 0.5).cast("long")
    )
    sources = stored(seats(sources, [], "target", "_house", ["source_no"]))
    quotas = sources.select(
        F.coalesce("source", F.lit("")).alias("_src"), F.col("source").isNull().alias("_none"),
        "source_size", "target", "block", F.col("seats").alias("_house"), "source_no",
    )
    shared = shards.join(quotas, ["_src", "_none"])
    given = handed_on(seats(shared, ["source_no"], "shard_size", "_house", ["shard"]), most_repeats)
    given = stored(given.select("_src", "_none", "shard", "shard_size", "source_size", "target", "_words"))
    order = Window.partitionBy("_src", "_none", "shard").orderBy("_place", "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("_words") / F.col("shard_size"))).otherwise(0).cast("long")
    rest = F.col("_words") - F.col("passes") * F.col("shard_size")
    return (
        placed.join(given, ["_src", "_none", "shard"])
        .withColumn("_before", before)
        .withColumn("passes", passes)
        .withColumn("part", F.greatest(F.least(rest - F.col("_before"), F.col("size")), F.lit(0).cast("long")))
        .select(
            "doc_id", "size", "source_size", "target",
            (F.col("size") * F.col("passes") + F.col("part")).alias("taken"), "passes", "part",
        )
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The mix as rows of ``docs``: a row a pass, the last one cut after its words.

    Where rows repeat an id, each is taken as the most taken of them in the mix is.
    """
    taken = (
        mix(docs, id_col, seed)
        .groupBy("doc_id")
        .agg(F.max("passes").alias("passes"), F.max("part").alias("part"))
        .filter("passes + part > 0")
    )
    text = F.coalesce(F.col("row.text"), F.lit(""))
    word = F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")
    first_words = F.array_join(
        F.slice(F.regexp_extract_all(text, word, F.lit(0)), 1, F.col("part").cast("int")), ""
    )
    in_part = (F.col("turn") > F.col("passes")) & (F.col("part") < words(text))
    return (
        docs.select(F.col(id_col).alias("id"), F.struct("*").alias("row"))
        .join(taken, F.col("id").eqNullSafe(F.col("doc_id")))
        .withColumn("turn", F.explode(F.expr("sequence(1, passes + if(part > 0, 1, 0))")))
        .select(
            F.col("row").withField("text", F.when(in_part, first_words).otherwise(F.col("row.text"))).alias("row")
        )
        .select("row.*")
    )


def _seats_sql(name: str, parties: str, within: str, votes: str, order: str) -> str:
    """SQL of ``seats``: every candidate seat below the bound is ranked."""
    by = f"PARTITION BY {within}" if within else ""
    keys = f"{within}, {order}" if within else order
    on = f"USING ({keys})"
    return f"""
{name}_x AS (
  SELECT *, sum({votes}) OVER ({by}) AS s_all, count(*) FILTER (WHERE {votes} > 0) OVER ({by}) AS s_k FROM {parties}),
{name}_b AS (
  SELECT *,
    CASE WHEN s_all > 0 THEN greatest(floor({votes} * house / s_all - {votes} * s_k / (2 * s_all) - 0.5) - 1, 0) ELSE 0 END::BIGINT AS lo,
    CASE WHEN {votes} > 0 THEN ceil({votes} * house / s_all + {votes} * s_k / (2 * s_all) + 0.5) + 1 ELSE 0 END::BIGINT AS hi
  FROM {name}_x),
{name}_c AS (SELECT *, house - sum(lo) OVER ({by}) AS free FROM {name}_b),
{name}_q AS (
  SELECT {keys}, free, row_number() OVER ({by} ORDER BY {votes} / (2 * seat + 1) DESC, {order}, seat) AS place
  FROM (SELECT *, unnest(range(lo, hi)) AS seat FROM {name}_c WHERE hi > lo)),
{name}_w AS (SELECT {keys}, count(*) AS won FROM {name}_q WHERE place <= free GROUP BY {keys}),
{name} AS (SELECT c.* EXCLUDE (house, s_all, s_k, lo, hi, free), lo + coalesce(won, 0) AS seats FROM {name}_c c LEFT JOIN {name}_w {on})"""


SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS place
  FROM documents),
p AS (
  SELECT *, ('0x' || substr(place, 1, 8))::BIGINT % greatest(1, ceil(sqrt((SELECT count(*) FROM d))))::BIGINT AS shard FROM d),
h AS (SELECT source, shard, sum(size)::BIGINT AS shard_size FROM p GROUP BY ALL),
r AS (
  SELECT source, sum(shard_size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_no
  FROM h GROUP BY source),
f AS (SELECT *, (source_no - 1) % 3 + 1 AS weight, source_size * {MOST_REPEATS} AS cap FROM r),
l AS (
  SELECT *,
    sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
  FROM f),
m AS (SELECT *, rest * weight > cap * weights AS capped FROM l),
t AS (
  SELECT source, source_size, source_no,
    CASE WHEN capped THEN cap::DOUBLE ELSE
      (sum(source_size) OVER () - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0))::BIGINT * weight
      / (sum(weight) FILTER (WHERE NOT capped) OVER ())::BIGINT END AS target
  FROM m),
b AS (
  SELECT *, greatest(1, least({MOST_BLOCK_WORDS}, floor(coalesce(min(target) FILTER (WHERE target > 0) OVER () / {BLOCK_SHARE}, 1))))::BIGINT AS block FROM t),
bh AS (SELECT *, ((2 * sum(source_size) OVER () + block) // (2 * block))::BIGINT AS house FROM b),
{_seats_sql("st", "bh", "", "target", "source_no")},
sh AS (
  SELECT h.shard, h.shard_size, st.source, st.source_size, st.source_no, st.target, st.block, st.seats AS house
  FROM h JOIN st ON h.source IS NOT DISTINCT FROM st.source),
{_seats_sql("gv", "sh", "source_no", "shard_size", "shard")},
g1 AS (
  SELECT *, shard_size * {MOST_REPEATS} AS cap, seats * block AS won,
    greatest(shard_size * {MOST_REPEATS} - seats * block, 0) AS room,
    sum(greatest(seats * block - shard_size * {MOST_REPEATS}, 0)) OVER (PARTITION BY source_no) AS excess
  FROM gv),
g2 AS (
  SELECT *, sum(room) OVER (PARTITION BY source_no) AS room_all,
    sum(room) OVER (PARTITION BY source_no ORDER BY shard) AS room_upto
  FROM g1),
g AS (
  SELECT *, (least(won, cap)
    + coalesce(least(excess, room_all) * room_upto // nullif(room_all, 0), 0)
    - coalesce(least(excess, room_all) * (room_upto - room) // nullif(room_all, 0), 0))::BIGINT AS words
  FROM g2),
o AS (
  SELECT p.doc_id, p.size, g.source_size, g.target, words, shard_size,
    coalesce(sum(size) OVER (PARTITION BY g.source_no, g.shard ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END::BIGINT AS passes
  FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source AND p.shard = g.shard)
SELECT doc_id, size, source_size, target, (size * passes + part)::BIGINT AS taken, passes, part
FROM (SELECT *, greatest(least(words - passes * shard_size - before, size), 0)::BIGINT AS part FROM o)
"""
