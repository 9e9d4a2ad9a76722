"""Recurring lines by a fixed-depth template tree.

A line goes down the tree by its number of words, then by its leading words; words
that hold a digit count as variable on the way (and everywhere below).  In the leaf
the template keeps the word that more than half of the leaf's lines have at a
place; other places are variable.  A line belongs to the template if it has the
template's word in at least ``LEAST_SHARE`` of its places.  The lines that do not
belong get further templates of the leaf, all in one pass: a place is fixed if enough
of these lines have the line's word there (``2^k``, for every k), else variable, and
at least ``LEAST_SHARE`` of the places must be fixed; a line takes the template that
stands in most texts.  What is left goes down the tree by up to ``SPLITS`` further
words, whichever are common there; after that lines are matched word by word.
A template is recurring if lines of it stand in
``LEAST_TEXTS`` different texts or more and have ``LEAST_WORDS`` fixed words or more.
Copies of a text count once, and a line that two texts alone share stays: both are
left to the dedup of documents.

Of a recurring template the first line (smallest document, then place) stays; all
others are dropped.  The remaining lines are joined again by a line feed.

Counts are combined within tasks before they are shuffled; lines meet only as
counts of (leaf, place, word), never as a group.

Defined cases: null text has no lines and stays null; blank lines stay; rows that
repeat a ``doc_id`` with the same text count as one; a null id sorts first; an
empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posolog.llm.common import WORD_PATTERN, stored, text_or_empty

DEPTH = 4
LEAST_TEXTS = 3
LEAST_WORDS = 3
LEAST_SHARE = 0.7
SPLITS = 3
VARIABLE = "<*>"


def _words(line: str) -> Column:
    return F.regexp_extract_all(F.col(line), F.lit(WORD_PATTERN), F.lit(0))


def _masked(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(w.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(w))


def _texts(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand in enough different texts."""
    return (
        rows.select(key, "content")
        .distinct()
        .groupBy(key)
        .agg(F.count("*").alias("texts"))
        .filter(F.col("texts") >= LEAST_TEXTS)
        .select(key)
    )


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, content, at): lines to drop, by document and place from 0.

    ``content`` is the 64-bit hash of the text, which tells rows of one id apart.
    """
    text = text_or_empty(text_col)
    lines = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("content"),
        F.posexplode(F.split(text, "\n", -1)).alias("at", "line"),
    )
    leaf = F.xxhash64(F.size("words"), _masked(F.slice("words", 1, DEPTH)))
    slim = stored(
        lines.withColumn("words", _words("line"))
        .filter(F.size("words") >= LEAST_WORDS)
        .select("doc_id", "content", "at", leaf.alias("leaf"))
    )
    places = (
        slim.join(_texts(slim, "leaf"), "leaf")
        .groupBy("doc_id", "content")
        .agg(F.collect_set(F.struct("at", "leaf")).alias("places"))
    )
    # The words are needed of lines in shared leaves only: read them off the texts.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("content"), text.alias("text"))
    rows = rows.dropDuplicates(["doc_id", "content"])
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.content") == F.col("p.content"))
    shared = stored(
        rows.alias("d")
        .join(places.alias("p"), same)
        .select("d.doc_id", "d.content", F.split("d.text", "\n", -1).alias("lines"), F.explode("places").alias("place"))
        .select("doc_id", "content", "place.at", "place.leaf", F.get("lines", F.col("place.at")).alias("line"))
        .select("doc_id", "content", "at", "leaf", _masked(_words("line")).alias("words"))
    )
    placed = stored(_placed(shared))
    templated = stored(
        placed.filter("belongs")
        .select("doc_id", "content", "at", F.xxhash64("leaf", F.lit("leaf")).alias("template"))
        .unionByName(_further(placed.filter("NOT belongs").drop("belongs")))
    )
    first = templated.groupBy("template").agg(F.min(F.struct("doc_id", "content", "at")).alias("first"))
    return (
        templated.join(_texts(templated, "template"), "template")
        .join(first, "template")
        .filter(~F.struct("doc_id", "content", "at").eqNullSafe(F.col("first")))
        .select("doc_id", "content", "at")
        .distinct()
    )


def _placed(lines: DataFrame) -> DataFrame:
    """Lines with their leaf's template compared: does the line belong to it?

    Lines that neither belong nor have enough words of their own are left out.
    """
    # Lines of one text count once a text, so that copies do not decide the words.
    voters = stored(lines.groupBy("leaf", "content", "at").agg(F.any_value("words").alias("words")))
    totals = voters.groupBy("leaf").agg(F.count("*").alias("total"))
    models = (
        voters.select("leaf", F.posexplode("words").alias("place", "word"))
        .filter(F.col("word") != VARIABLE)
        .groupBy("leaf", "place", "word")
        .agg(F.count("*").alias("votes"))
        .join(totals, "leaf")
        .filter(F.col("votes") * 2 > F.col("total"))
        .groupBy("leaf")
        .agg(F.map_from_entries(F.collect_list(F.struct("place", "word"))).alias("fixed"))
    )
    equal = F.size(
        F.filter(F.transform("words", lambda w, i: F.equal_null(F.col("fixed")[i], w)), lambda same: same)
    )
    own = F.size(F.filter("words", lambda w: w != VARIABLE))
    belongs = (F.col("equal") >= LEAST_WORDS) & (F.col("equal") >= LEAST_SHARE * F.size("words"))
    return (
        lines.join(models, "leaf", "left")
        .withColumn("equal", F.when(F.col("fixed").isNull(), 0).otherwise(equal))
        .withColumn("belongs", belongs)
        .filter(F.col("belongs") | (own >= LEAST_WORDS))
        .select("doc_id", "content", "at", "leaf", "words", "belongs")
    )


def _further(lines: DataFrame) -> DataFrame:
    """Further templates of the leaves, for the lines that their first one did not take.

    A word's votes are the lines of the leaf that have it at its place.  The words of a
    line with 2^k votes or more are its template of level k; a place below that is
    variable.  A line's levels number at most the logarithm of its leaf, and all are
    counted in one pass.  Of its templates that stand in enough texts a line takes the
    one with most (then with most fixed words, then by hash).  The others go one step
    down, to the leaf of their commonest word that not all lines of their leaf have,
    ``SPLITS`` steps at most; after that they are matched word by word.
    """
    lines = stored(lines.withColumn("form", F.xxhash64("leaf", "words")))
    texts_of = stored(lines.select("form", "content").distinct())
    placed = F.filter(
        F.transform("words", lambda w, i: F.struct(i.alias("place"), w.alias("word"))), lambda w: w["word"] != VARIABLE
    )
    forms = stored(
        lines.select("leaf", "words", "form", "content", "at")
        .distinct()
        .groupBy("form")
        .agg(F.any_value("leaf").alias("leaf"), F.any_value("words").alias("words"), F.count("*").alias("n"))
        .select("form", "leaf", "n", F.size("words").alias("size"), placed.alias("words"))
    )
    chosen = None
    for _ in range(SPLITS + 1):
        places = forms.select("form", "leaf", "n", "size", F.inline("words"))
        votes = (
            places.groupBy("leaf", "place", "word")
            .agg(F.sum("n").alias("votes"))
            .filter(F.col("votes") >= LEAST_TEXTS)
            .join(forms.groupBy("leaf").agg(F.sum("n").alias("total")), "leaf")
        )
        part = F.when(F.col("votes") < F.col("total"), F.struct("votes", (-F.col("place")).alias("before"), "word"))
        voted = stored(
            places.join(votes, ["leaf", "place", "word"])
            .groupBy("form")
            .agg(
                *(F.any_value(c).alias(c) for c in ("leaf", "n", "size")),
                F.array_sort(F.collect_list(F.struct("place", "word", F.floor(F.log2("votes")).alias("level")))).alias("words"),
                F.max(part).alias("part"),
            )
            .filter((F.size("words") >= LEAST_WORDS) & (F.size("words") >= LEAST_SHARE * F.col("size")))
        )
        fixed = F.filter("words", lambda w: w["level"] >= F.col("level"))
        bare = F.transform("fixed", lambda w: F.struct(w["place"].alias("place"), w["word"].alias("word")))
        enough = (F.size("fixed") >= LEAST_WORDS) & (F.size("fixed") >= LEAST_SHARE * F.col("size"))
        templates = stored(
            voted.select("*", F.explode(F.array_distinct(F.col("words.level"))).alias("level"))
            .withColumn("fixed", fixed)
            .filter(enough)
            .select("form", F.size("fixed").alias("n_fixed"), F.xxhash64("leaf", bare).alias("template"))
        )
        texts = (
            texts_of.join(templates, "form")
            .select("template", "content")
            .distinct()
            .groupBy("template")
            .agg(F.count("*").alias("texts"))
            .filter(F.col("texts") >= LEAST_TEXTS)
        )
        found = stored(
            templates.join(texts, "template")
            .groupBy("form")
            .agg(F.max(F.struct("texts", "n_fixed", "template")).alias("most"))
            .select("form", F.col("most.template").alias("chosen"))
        )
        chosen = found if chosen is None else chosen.unionByName(found)
        below = F.xxhash64("leaf", "part.before", "part.word")
        forms = stored(
            voted.filter("part IS NOT NULL")
            .join(found, "form", "left_anti")
            .withColumn("words", F.transform("words", lambda w: F.struct(w["place"].alias("place"), w["word"].alias("word"))))
            .select("form", below.alias("leaf"), "n", "size", "words")
        )
        if forms.isEmpty():
            break
    return lines.join(chosen, "form", "left").select(
        "doc_id", "content", "at", F.coalesce("chosen", F.xxhash64("words")).alias("template")
    )


def without_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the recurring lines taken out of its text, and what was dropped.

    Returns (row, n_lines, n_dropped): ``row`` is a struct of the input's columns.
    """
    drops = (
        recurring_lines(docs, id_col, text_col)
        .groupBy("doc_id", "content")
        .agg(F.collect_set("at").alias("drops"))
    )
    text = text_or_empty(f"row.{text_col}")
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", F.col(f"row.{id_col}").alias("id"), F.xxhash64(text).alias("hash")
    )
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("content"))
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("drops", i)), "\n")
    return rows.join(drops, same, "left").select(
        F.col("row")
        .withField(text_col, F.when(F.col("drops").isNull(), F.col(f"row.{text_col}")).otherwise(kept))
        .alias("row"),
        F.when(F.col(f"row.{text_col}").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )
