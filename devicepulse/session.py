"""Session settings and the few helpers that run a job while a plan is built."""

from __future__ import annotations

import functools
import operator
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def build_session(
    app: str = "devicepulse", master: str | None = None, **conf: str
) -> SparkSession:
    """A session with adaptive execution and UTC timestamps; ``conf`` overrides.

    Checkpoint files are removed once nothing refers to them. Generated methods
    over 8000 bytes, which the JVM would only interpret, are left to smaller ones.
    Sessions are merged before the shuffle, so that a key with very many events
    does not send them all to one task of a debounced stream.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in ``spark.checkpoint.dir``.

    Where it is unset, a folder in the warehouse is used, which is shared as well.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so it is computed once and
    keeps its partitions when executors are lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, tag: str) -> str:
    """The name of a new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{tag}-{uuid.uuid4().hex}"


def reread(df: DataFrame) -> DataFrame:
    """``df`` written once as parquet below the shared checkpoint folder and read again,
    so that later scans parse nothing and read only the columns they need."""
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and cached on the executors, spilling to disk.

    Use it for an aggregate that is read more than once or joined with. A cached
    relation has an exact size in bytes, so Spark's own threshold decides between a
    broadcast and a shuffled join. Blocks of lost executors are computed again.
    """
    df = df.persist()
    df.count()
    return df


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A few literal rows as a local relation (which plain rows do not become)."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    table = pa.table({f.name: list(c) for f, c in zip(schema, columns)})
    return spark.createDataFrame(table, schema)


def names(columns: str | list[str] | None) -> list[str]:
    """Column names given as one name, several or none."""
    if columns is None:
        return []
    return [columns] if isinstance(columns, str) else list(columns)


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL, keeping the keys of ``left`` once."""
    if not keys:
        raise ValueError("match needs at least one key")
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = functools.reduce(
        operator.and_, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    )
    return left.join(renamed, same, how).drop(*[f"__{k}" for k in keys])
