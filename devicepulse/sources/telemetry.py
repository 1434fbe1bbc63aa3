"""Reading and writing telemetry tables, and the built-in scenarios."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from devicepulse import schema as S
from devicepulse.session import local_table
from devicepulse.sources.errors import DatasetNotFound

# Cell texts that stand for a missing value.
MISSING_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
CORRUPT = "_corrupt_record"
# Types whose values are all values of another one. Single precision is read as the text
# that it is written as.
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType)
FITTING = {
    T.IntegerType: INTEGERS,
    T.LongType: (*INTEGERS, T.LongType),
    T.DoubleType: (*INTEGERS, T.DoubleType),
}


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating-point column."""
    floats = [
        f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def _typed(value: Column, kind: T.DataType) -> Column:
    """``value`` as ``kind``, or NULL. A whole number may be written with a point, as
    other tools do once a cell of its column is missing; 3.7 is no whole number."""
    if isinstance(kind, T.IntegralType):
        number = value.try_cast("decimal(38,6)")
        return F.when(number == F.floor(number), F.floor(number)).try_cast(kind)
    return value.try_cast(kind)


def _fits(kind: T.DataType, wanted: T.DataType) -> bool:
    """Whether numbers of one type can be cast to the other without a check."""
    return isinstance(kind, FITTING.get(type(wanted), ()))


def _typed_cells(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast text cells, with a reason for each cell that is not of its type. Columns of
    numbers that fit as they are do not become text in between."""
    typed, bad = [], []
    for field in schema:
        if _fits(df.schema[field.name].dataType, field.dataType):
            typed.append(F.col(field.name).cast(field.dataType).alias(field.name))
            continue
        cell = F.when(~F.col(field.name).isin(MISSING_CELLS), F.col(field.name))
        value = _typed(cell, field.dataType)
        typed.append(value.alias(field.name))
        bad.append(F.when(cell.isNotNull() & value.isNull(), F.lit(f"unreadable:{field.name}")))
    bad.append(F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed_row")))
    return df.select(*typed, F.array_compact(F.array(*bad)).alias("read_errors"))


def read_telemetry(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    schema: T.StructType = S.TELEMETRY,
    keep_errors: bool = False,
) -> DataFrame:
    """Read telemetry as ``csv``, ``json``, ``parquet`` or ``orc`` with a fixed schema.

    CSV columns are found by the names in the header, which must be the same in all
    files; other columns are ignored. NaN and the usual spellings of a missing cell
    become NULL, as does a cell of the wrong type; with ``keep_errors`` the column
    ``read_errors`` says which. Files with types are read with their own and cast.
    """
    try:
        if fmt == "csv":
            header = spark.read.option("header", True).csv(path).columns
            absent = [name for name in schema.fieldNames() if name not in header]
            if absent:
                raise ValueError(f"no column {', '.join(absent)} in {path}")
            cells = T.StructType([T.StructField(c, T.StringType()) for c in [*header, CORRUPT]])
            raw = (
                spark.read.schema(cells)
                .option("header", True)
                .option("enforceSchema", False)
                .option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", CORRUPT)
                .csv(path)
            )
            df = _typed_cells(raw, schema)
        elif fmt == "json":
            cells = T.StructType([T.StructField(c, T.StringType()) for c in schema.fieldNames()])
            raw = spark.read.schema(cells.add(CORRUPT, "string")).json(
                path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT
            )
            df = _typed_cells(raw, schema)
        elif fmt in ("parquet", "orc"):
            raw = nan_to_null(spark.read.format(fmt).load(path))
            absent = {c: F.lit(None).cast("string") for c in schema.fieldNames() if c not in raw.columns}
            raw = raw.withColumns(absent)
            cells = [
                F.col(f.name)
                if _fits(raw.schema[f.name].dataType, f.dataType)
                else F.col(f.name).cast("string").alias(f.name)
                for f in schema
            ]
            df = _typed_cells(raw.select(*cells, F.lit(None).cast("string").alias(CORRUPT)), schema)
        else:
            raise ValueError(f"unknown format: {fmt}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise DatasetNotFound(f"no telemetry at {path}") from error
        raise
    df = nan_to_null(df)
    return df if keep_errors else df.drop("read_errors")


def write_telemetry(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists"
) -> None:
    """Write a table, with a header row where the format has one."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def scenarios(spark: SparkSession) -> DataFrame:
    """The built-in what-if devices, one row each."""
    return local_table(spark, S.SCENARIO_ROWS, S.SCENARIOS_SCHEMA)


def device_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Devices from literals; a field left out takes its form default."""
    fields = T.StructType([S.TELEMETRY[c] for c in S.FEATURES])
    values = [tuple((S.FORM_DEFAULTS | row)[c] for c in S.FEATURES) for row in rows]
    return local_table(spark, values, fields)
