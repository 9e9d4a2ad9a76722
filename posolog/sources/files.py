"""Reading input files and writing result tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posolog.functions.values import day, number
from posolog.schema import EXPOSURE, GOLD


def read_exposure_csv(spark: SparkSession, path: str) -> DataFrame:
    """Exposure rows from CSV with a header.

    Columns are taken from the header and read as text first: a malformed row
    then leaves a NULL in a numeric column instead of losing the row;
    ``unreadable_cells`` tells what was lost.
    """
    return _typed(_read_text_columns(spark, path), EXPOSURE)


def read_gold_csv(spark: SparkSession, path: str) -> DataFrame:
    return _typed(_read_text_columns(spark, path), GOLD)


def read_concept_ids(spark: SparkSession, path: str) -> DataFrame:
    """One-column allow-list of concept ids, without a header."""
    return (
        spark.read.schema("concept_id string")
        .csv(path)
        .select(F.trim("concept_id").try_cast("bigint").alias("concept_id"))
        .where("concept_id IS NOT NULL")
    )


def unreadable_cells(
    spark: SparkSession, path: str, contract: T.StructType = EXPOSURE
) -> DataFrame:
    """(file, column, cell, reason, record): what reading ``path`` could not keep.

    A cell that is neither empty nor a date or number where the contract wants one
    becomes NULL in the table; here it stands with its text and its whole record.
    A line with too few or too many fields has one row, without column and cell.
    """
    names = _read_text_columns(spark, path).columns
    fields = [T.StructField(name, T.StringType()) for name in [*names, _LINE]]
    raw = (
        spark.read.schema(T.StructType(fields))
        .option("header", True)
        .option("columnNameOfCorruptRecord", _LINE)
        .csv(path)
        .select(
            *[_present(name).alias(name) for name in names],
            _LINE,
            F.col("_metadata.file_name").alias("__file"),
        )
    )
    kinds = {f.name: f.dataType for f in contract.fields}
    found = [_finding(F.col(_LINE).isNotNull(), F.lit(None), F.lit(None), "wrong number of fields")]
    for name, column in _typed_columns(raw.select(*names), contract).items():
        kind = kinds.get(name.lower(), T.StringType())
        if not isinstance(kind, T.StringType):
            reason = "not a date" if isinstance(kind, T.DateType) else "not a number"
            lost = (F.trim(F.col(name)) != "") & column.isNull()
            found.append(_finding(lost, F.lit(name.lower()), F.col(name), reason))
    record = F.coalesce(F.col(_LINE), F.to_json(F.struct(*names)))
    return raw.select(
        F.col("__file").alias("file"),
        record.alias("record"),
        F.inline(F.array_compact(F.array(*found))),
    ).select("file", "column", "cell", "reason", "record")


_LINE = "__line"


def _finding(when: Column, column: Column, cell: Column, reason: str) -> Column:
    text = F.struct(
        column.cast("string").alias("column"),
        cell.cast("string").alias("cell"),
        F.lit(reason).alias("reason"),
    )
    return F.when(when, text)


def _read_text_columns(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return raw.select(*[_present(name).alias(name) for name in raw.columns])


def _present(name: str) -> Column:
    """A cell's text; an empty cell and ``NA`` hold nothing."""
    return F.when(~F.col(name).isin("", "NA"), F.col(name))


def _typed(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Columns of the contract in their type, other columns as text."""
    return df.select(
        *[c.alias(name.lower()) for name, c in _typed_columns(df, contract).items()]
    )


def _typed_columns(df: DataFrame, contract: T.StructType) -> dict[str, Column]:
    types = {f.name: f.dataType for f in contract.fields}
    out = {}
    for name in df.columns:
        dtype = types.get(name.lower(), T.StringType())
        if isinstance(dtype, T.DateType):
            out[name] = day(df, name)
        elif isinstance(dtype, T.StringType):
            out[name] = F.col(name)
        else:
            out[name] = number(df, name).cast(dtype)
    return out


def write_ordered(
    df: DataFrame, path: str, *keys: str, files: int | None = None, mode: str = "overwrite"
) -> str:
    """Write parquet files whose rows, read file by file, ascend by ``keys``.

    The order is made at the writer by ranges sampled from the data, each sorted in
    its own task; no task sorts the table.  The number of files follows from the
    measured size unless given.
    """
    ranged = df.repartitionByRange(*([files] if files else []), *keys)
    ranged.sortWithinPartitions(*keys).write.mode(mode).parquet(path)
    return path


def write_tables(
    tables: Mapping[str, DataFrame],
    directory: str,
    file_format: str = "parquet",
    mode: str = "overwrite",
) -> dict[str, str]:
    """Write each table to its own folder; returns the paths.

    CSV has no nested types, so a column that holds one is written as JSON text.
    """
    paths = {}
    for name, df in tables.items():
        path = f"{directory.rstrip('/')}/{name}"
        writer = (_flat(df) if file_format == "csv" else df).write.mode(mode)
        if file_format == "csv":
            writer = writer.option("header", True)
        writer.format(file_format).save(path)
        paths[name] = path
    return paths


def _flat(df: DataFrame) -> DataFrame:
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else f.name
            for f in df.schema.fields
        ]
    )
