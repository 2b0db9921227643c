"""Writers: catalogue, results, curves, artefacts, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_curve_points(points: DataFrame, path: str, keys: list[str]) -> None:
    """Points as CSV in folders by ``keys``, in order within a file."""
    points.repartition(*keys).sortWithinPartitions(*keys, "time").write.mode("overwrite").option("header", True).partitionBy(*keys).csv(path)


def curve_file(doc: Column, page: Column, figure: Column, curve: Column) -> Column:
    """The file name of a curve."""
    name = F.concat_ws("_", doc, F.concat(F.lit("p"), page), figure, F.concat(F.lit("curve"), curve + 1))
    return F.concat(name, F.lit(".csv"))


def curve_catalog(results: DataFrame) -> DataFrame:
    from tidemark.sources.curves import flatten_results

    flat = flatten_results(results)
    name = curve_file(F.col("pdf_name"), F.col("page"), F.col("figure_id"), F.col("curve_id"))
    return flat.select("pdf_name", "figure_id", "page", "curve_id", "n_points", name.alias("csv_path"), "calibration_valid")


def write_curve_catalog(results: DataFrame, path: str) -> None:
    curve_catalog(results).write.mode("overwrite").parquet(path)


def write_results_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def write_summary_json(summary: DataFrame, path: str) -> None:
    """The totals of a run (one row), with the documents that gave no curve."""
    summary.withColumn("failed", F.col("documents") - F.col("with_curves")).coalesce(1).write.mode("overwrite").json(path)


def km_artifact(km: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON text a stratum with arrays by time."""
    fields = ["time", "survival", "std_err", "n_risk", "n_event", "n_censor"]
    rows = km.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("r"))
    arrays = [F.col(f"r.{c}").alias(c) for c in fields]
    return rows.select(*keys, F.to_json(F.struct(*keys, *arrays)).alias("json"))


def write_km_artifact(km: DataFrame, keys: list[str], path: str) -> None:
    km_artifact(km, keys).select("json").write.mode("overwrite").text(path)


def write_manifest(rows: DataFrame, provenance: DataFrame, key: str, path: str) -> None:
    """Subjects, events and follow-up of each study with its provenance."""
    rows.join(provenance, key, "left").write.mode("overwrite").option("header", True).csv(path)
