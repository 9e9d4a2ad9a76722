"""A training corpus from raw documents: each stage's result is written and reread.

1. toxicity: documents that the class models reject go.
2. line_templates: recurring lines are taken out of the texts; no document goes.
3. simhash: one document of each group of near-duplicates stays.  Candidates come from
   SimHash fingerprints of five-word shingles through op7's byte-position index, those
   beyond its bits from min-hash bands; a Jaccard share of 0.8 or more is checked exactly
   (see ``near_texts``).
4. mixture: sources are brought to their target weights; a document's row stands
   once for each time it is taken, the last one perhaps cut short.
5. packing: pieces of token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posolog.llm.common import stored, table
from posolog.llm.line_dedup import without_recurring_lines
from posolog.llm.mixing import mixed_documents
from posolog.llm.near_texts import one_of_each_near
from posolog.llm.packing import packed
from posolog.llm.queries import vocabulary
from posolog.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = without_recurring_lines(docs).select("row.*")
    if "n_chars" in cleaned.columns:  # it describes the text
        kind = cleaned.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)
    return cleaned


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_near(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixed_documents(docs)
    if "n_chars" in mixed.columns:
        kind = mixed.schema["n_chars"].dataType
        mixed = mixed.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)
    return mixed


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_templates", line_templates),
    ("simhash", simhash),
    ("mixture", mixture),
    ("packing", packing),
]

#: Fingerprints, hashed counts and token ids have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
