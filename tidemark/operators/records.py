"""Patient records: harmonising, de-duplicating, validating, describing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Months in a unit of time.
MONTHS = {"days": 1 / 30.4375, "weeks": 7 / 30.4375, "months": 1.0, "years": 12.0}


def harmonize_ipd(source: DataFrame, columns: dict[str, str], unit: str, endpoint: str) -> DataFrame:
    """Standard columns from a source's own; times in months."""
    factor = F.lit(MONTHS[unit])
    pick = lambda k: F.col(columns[k])
    return source.select(
        pick("study_id").cast("string").alias("study_id"),
        pick("subject_id").cast("string").alias("subject_id"),
        pick("arm").cast("string").alias("arm"),
        (pick("time_start") * factor if "time_start" in columns else F.lit(0.0)).alias("time_start"),
        (pick("time_end") * factor).alias("time_end"),
        pick("event").cast("int").alias("event"),
        F.lit(endpoint).alias("endpoint"),
    )


def dedupe_subjects(ipd: DataFrame, quasi: list[str]) -> DataFrame:
    """One record for each (study, subject); a null subject is known by its quasi-identifiers.

    The record with the longest follow-up stays, then the one with the event.
    """
    key = F.coalesce(F.col("subject_id").cast("string"), F.concat(F.lit("#"), F.xxhash64(*quasi).cast("string")))
    w = Window.partitionBy("study_id", "__key").orderBy(F.desc("time_end"), F.desc("event"), "arm")
    return ipd.withColumn("__key", key).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__key", "__n")


def validate_ipd(ipd: DataFrame, longest: float = 600.0) -> DataFrame:
    """Each record with ``valid`` and the first failing ``reason``."""
    start, end = F.col("time_start"), F.col("time_end")
    reason = (
        F.when(start.isNull() | end.isNull() | F.col("event").isNull(), "missing value")
        .when(start < 0, "negative start")
        .when(end < start, "end before start")
        .when(~F.col("event").isin(0, 1), "event not 0 or 1")
        .when(end - start > longest, "implausible follow-up")
    )
    return ipd.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def manifest_rows(ipd: DataFrame, keys: list[str]) -> DataFrame:
    """Subjects, events and median follow-up."""
    return ipd.groupBy(*keys).agg(F.count("*").alias("n_subjects"), F.sum("event").alias("n_events"), F.median("time").alias("median_follow_up"))


def study_summary(ipd: DataFrame) -> DataFrame:
    """Subjects and events of each arm of each study."""
    return ipd.groupBy("study_id", "arm").agg(F.count("*").alias("n"), F.sum("event").alias("events"))


def pool_arms(*arms: DataFrame) -> DataFrame:
    """The records of all arms in one table."""
    out = arms[0]
    for more in arms[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
