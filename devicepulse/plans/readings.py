"""The telemetry view over ``events``: one reading per event.

The test tables hold no telemetry, so each reading is derived from a hash of its
event, in the same way here and in the check SQL. ``DIRTY`` and ``REQUEST`` derive
faulty readings and JSON requests from it, again one per event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from devicepulse.functions.rules import risk_score, threshold_label
from devicepulse.streaming.live import arriving

EVENT = ["event_id", "user_id", "ts"]
HASHES = {letter: f"md5(concat('{letter}', CAST(event_id AS STRING)))" for letter in "ab"}
# Ten 16-bit words of the two hashes. A filter on a reading would be pushed below a
# plain projection and hash each event again for every column it names; it is not
# pushed below a generated row.
WORDS = [
    f"CAST(conv(substr(h{letter}, {1 + 4 * j}, 4), 16, 10) AS BIGINT)"
    for letter, j in [("a", j) for j in range(8)] + [("b", 0), ("b", 1)]
]
WORD_ROW = ", ".join(f"'u{i}', {word}" for i, word in enumerate(WORDS))
ID_DIGITS = "CAST(user_id + 1 AS STRING)"
DRAWN = [
    "event_id AS Reading_ID",
    f"concat('DEV-', lpad({ID_DIGITS}, greatest(length({ID_DIGITS}), 5), '0')) AS Device_ID",
    "ts AS Reading_TS",
    "CASE WHEN u0 % 2 = 0 THEN 'Router' ELSE 'Switch' END AS Device_Type",
    "CAST(1000 + u1 % 9001 AS DOUBLE) / 100 AS CPU_Usage",
    "CAST(2000 + u2 % 8001 AS DOUBLE) / 100 AS Memory_Usage",
    "CAST(2500 + u3 % 6501 AS DOUBLE) / 100 AS Temperature",
    "CAST(100 + (u4 * 2) % 99901 AS DOUBLE) / 100 AS Uptime",
    "CAST(CASE WHEN u5 < 62000 THEN 10 + u5 % 21 ELSE 80 + u5 % 300 END AS INT) "
    "AS Interface_Errors",
    "CAST(u6 % 1001 AS DOUBLE) / 100 AS Packet_Loss",
    "CAST(1000 + u7 % 9001 AS DOUBLE) / 100 AS Bandwidth_Usage",
    "CAST(CASE WHEN u8 < 62000 THEN u8 % 11 ELSE 12 + u8 % 17 END AS INT) AS Log_Errors",
    "(CAST(u9 AS DOUBLE) / 65535 - 0.5D) * 0.1732D AS _noise",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table, replayed as a stream. The pattern stands for a folder as well
    as for one file, which alone would not do."""
    return arriving(spark, f"{sf_dir}/{name}.parquet*", table(spark, sf_dir, name).schema)


def readings(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Telemetry with ``Reading_ID``, ``Reading_TS`` and the noise-free ``Risk_Score``.

    A scan has no more tasks with rows than its files have row groups. ``spread`` deals
    the events over all cores first, for work that takes long per row.
    """
    events = table(spark, sf_dir, "events")
    if spread:
        events = events.select(*EVENT).repartition(3 * spark.sparkContext.defaultParallelism)
    return readings_of(events)


def readings_of(events: DataFrame) -> DataFrame:
    """One reading per event, of a table or a stream."""
    hashed = events.selectExpr(
        *EVENT, *[f"{hash_} AS h{letter}" for letter, hash_ in HASHES.items()]
    )
    words = hashed.selectExpr(*EVENT, f"inline(array(named_struct({WORD_ROW})))")
    scored = words.selectExpr(*DRAWN).withColumn("Risk_Score", risk_score())
    failed = threshold_label(F.col("Risk_Score") + F.col("_noise"))
    return scored.withColumn("Failed", failed).drop("_noise")


# Both engines: faults by the remainder of the reading number.
DIRTY = """
  CASE Reading_ID % 17 WHEN 6 THEN 'Firewall' ELSE Device_Type END AS Device_Type,
  CASE Reading_ID % 17 WHEN 0 THEN 101 WHEN 7 THEN NULL ELSE CPU_Usage END AS CPU_Usage,
  CASE Reading_ID % 17 WHEN 1 THEN NULL WHEN 7 THEN -3 ELSE Memory_Usage END AS Memory_Usage,
  CASE Reading_ID % 17 WHEN 2 THEN 150.5 ELSE Temperature END AS Temperature,
  CASE Reading_ID % 17 WHEN 3 THEN -1 ELSE Uptime END AS Uptime,
  CASE Reading_ID % 17 WHEN 4 THEN -5 ELSE Interface_Errors END AS Interface_Errors,
  CASE Reading_ID % 17 WHEN 5 THEN 100.5 ELSE Packet_Loss END AS Packet_Loss,
  Bandwidth_Usage,
  CASE Reading_ID % 17 WHEN 8 THEN NULL ELSE Log_Errors END AS Log_Errors
"""

# Both engines: one JSON request per reading, some of them unusable.
REQUEST = """
  CASE Reading_ID % 16
    WHEN 0 THEN '{}'
    WHEN 1 THEN '{"CPU_Usage": 5'
    WHEN 2 THEN '[1, 2]'
    ELSE concat('{',
      CASE Reading_ID % 16
        WHEN 3 THEN '"Device_Type": " rOUTER ", '
        WHEN 4 THEN '"Device_Type": "firewall", '
        WHEN 5 THEN '"Device_Type": null, '
        WHEN 6 THEN ''
        ELSE concat('"Device_Type": "', Device_Type, '", ') END,
      CASE Reading_ID % 16
        WHEN 7 THEN '"CPU_Usage": "abc", '
        WHEN 8 THEN '"CPU_Usage": null, '
        WHEN 9 THEN '"CPU_Usage": " 1.5 ", '
        WHEN 10 THEN ''
        ELSE concat('"CPU_Usage": ', CAST(CPU_Usage AS VARCHAR(30)), ', ') END,
      CASE Reading_ID % 16
        WHEN 11 THEN '"Interface_Errors": 3.7, '
        WHEN 12 THEN '"Interface_Errors": "3.7", '
        WHEN 13 THEN '"Interface_Errors": "12", '
        ELSE concat('"Interface_Errors": ', CAST(Interface_Errors AS VARCHAR(30)), ', ') END,
      '"Uptime": ', CAST(Uptime AS VARCHAR(30)), '}')
  END
"""
