"""Fleet summary and the riskiest devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicepulse import schema as S
from devicepulse.functions.rules import fires, known
from devicepulse.session import names
from devicepulse.sources.requests import NO_MODEL


def fleet_summary(
    df: DataFrame, by: str | list[str] | None = None, active_model: str = NO_MODEL
) -> DataFrame:
    """Totals, health rate in percent and average readings, overall or per group.

    A NaN reading is missing. An empty table gives zero counts and NULL rates. Works on a stream as well.
    """
    total = F.count("*")
    failed = F.coalesce(F.sum(F.nanvl(F.col(S.LABEL).cast("double"), F.lit(None)).cast("long")), F.lit(0))
    average = lambda c: F.round(F.avg(known(F.col(c))), 2)
    return df.groupBy(*names(by)).agg(
        F.lit(True).alias("success"),
        total.alias("total_devices"),
        failed.alias("failed_count"),
        (total - failed).alias("healthy_count"),
        F.round(F.try_divide(total - failed, total) * 100, 2).alias("health_rate"),
        average("CPU_Usage").alias("avg_cpu"),
        average("Memory_Usage").alias("avg_mem"),
        average("Temperature").alias("avg_temp"),
        average("Packet_Loss").alias("avg_loss"),
        F.count_if(F.col("Device_Type") == "Router").alias("routers_count"),
        F.count_if(F.col("Device_Type") == "Switch").alias("switches_count"),
        F.lit(active_model).alias("active_model"),
    )


AVERAGED = {"avg_cpu": "CPU_Usage", "avg_mem": "Memory_Usage", "avg_temp": "Temperature", "avg_loss": "Packet_Loss"}


def summary_parts(df: DataFrame, by: list[str]) -> DataFrame:
    """What ``merged_summary`` needs of the rows of each group: sums and counts, which
    add up over any division of the rows."""
    sums = []
    for name, c in AVERAGED.items():
        sums += [F.sum(known(F.col(c))).alias(f"{name}_sum"), F.count(known(F.col(c))).alias(f"{name}_n")]
    return df.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.sum(known(F.col(S.LABEL)).cast("long")).alias("failed"),
        F.count_if(F.col("Device_Type") == "Router").alias("routers"),
        F.count_if(F.col("Device_Type") == "Switch").alias("switches"),
        *sums,
    )


def merged_summary(
    parts: DataFrame, by: str | list[str] | None = None, active_model: str = NO_MODEL
) -> DataFrame:
    """``fleet_summary`` of all rows, from the ``summary_parts`` of each share of them."""
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    total, failed = whole("total"), whole("failed")
    return parts.groupBy(*names(by)).agg(
        F.lit(True).alias("success"),
        total.alias("total_devices"),
        failed.alias("failed_count"),
        (total - failed).alias("healthy_count"),
        F.round(F.try_divide(total - failed, total) * 100, 2).alias("health_rate"),
        *[
            F.round(F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_n")), 2).alias(name)
            for name in AVERAGED
        ],
        whole("routers").alias("routers_count"),
        whole("switches").alias("switches_count"),
        F.lit(active_model).alias("active_model"),
    )


def as_json(df: DataFrame, name: str = "response") -> DataFrame:
    """Each row as one JSON object; NULL fields are kept."""
    body = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(body.alias(name))


def advisory_counts(
    df: DataFrame, rules: list[tuple[str, str, float]] = S.ADVISORY_RULES
) -> DataFrame:
    """How many rows each advisory rule fires on, and how many it is silent on."""
    hits = {key: fires(column, limit) for key, column, limit in rules}
    silent: Column = F.lit(True)
    for hit in hits.values():
        silent = silent & ~hit
    counts = df.agg(
        *[F.count_if(hit).alias(key) for key, hit in hits.items()],
        F.count_if(silent).alias(S.NO_ADVISORY),
    )
    return counts.unpivot([], [*hits, S.NO_ADVISORY], "advisory", "n")


def riskiest(df: DataFrame, score: str, key: str | list[str], k: int) -> DataFrame:
    """The ``k`` rows with the highest score, ties by key; without missing scores."""
    scored = df.where(known(F.col(score)).isNotNull())
    return scored.orderBy(F.desc(score), *names(key)).limit(k)
