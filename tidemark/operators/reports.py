"""Reports over catalogues and run results: one aggregation each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar


def batch_summary(docs: DataFrame) -> DataFrame:
    """Totals of a run: ``docs`` has one row a document with its numbers of figures, curves and errors."""
    ok = F.col("curves") > 0
    return docs.agg(
        F.count("*").alias("documents"), F.count_if(ok).alias("with_curves"), F.sum("figures").alias("figures"), F.sum("curves").alias("curves"),
        F.sum("errors").alias("errors"), (F.count_if(ok) / F.count("*")).alias("success_rate"),
    )


def curve_stats(points: DataFrame, keys: list[str], short: int = 50) -> DataFrame:
    """Per curve: n, ranges, whether time rises and survival stays in [0, 1]."""
    back = F.col("time") - F.lag("time").over(Window.partitionBy(*keys).orderBy("seq")) < 0
    s = points.withColumn("__back", back).groupBy(*keys).agg(
        F.count("*").alias("n"), (F.max("time") - F.min("time")).alias("time_range"), (F.max("survival") - F.min("survival")).alias("survival_range"),
        (F.count_if("__back") == 0).alias("time_monotone"),
        F.bool_and(F.col("survival").between(0, 1)).alias("bounded"),
    )
    return s.withColumn("short", F.col("n") < short)


def curve_stats_summary(stats: DataFrame, by: str) -> DataFrame:
    """Totals by figure and overall (``by`` null)."""
    return stats.rollup(by).agg(
        F.count("*").alias("curves"), F.avg("n").alias("mean_n"), F.median("n").alias("median_n"), F.count_if("time_monotone").alias("monotone"), F.count_if("bounded").alias("bounded"), F.count_if("short").alias("short")
    )


def unprocessed_docs(downloaded: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    return downloaded.select(key).distinct().join(processed.select(key).distinct(), key, "left_anti")


def detection_rate(downloaded: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Documents downloaded, processed among them, and the share."""
    d = downloaded.select(key).distinct().join(processed.select(key).distinct().withColumn("__p", F.lit(1)), key, "left")
    return d.agg(F.count("*").alias("downloaded"), F.count("__p").alias("processed"), (F.count("__p") / F.count("*")).alias("rate"))


def calibration_report(figures: DataFrame) -> DataFrame:
    """Valid share, figures by method, and scores: ``figures`` has ``valid, reason, score``."""
    return figures.withColumn("method", scalar.calibration_method(F.col("reason"))).groupBy("method").agg(
        F.count("*").alias("figures"), F.count_if("valid").alias("valid"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score")
    )


def top_warnings(curves: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent warnings; the limit is the report's length."""
    return curves.select(F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "warning").limit(n)


def improvement_vs_baseline(report: DataFrame, baseline: float, target: float = 90.0) -> DataFrame:
    """Percentage points gained on ``baseline`` and missing to ``target``."""
    share = 100.0 * F.sum("valid") / F.sum("figures")
    return report.agg(share.alias("success"), (share - baseline).alias("gain"), F.greatest(F.lit(0.0), F.lit(target) - share).alias("gap"))


def download_report(log: DataFrame) -> DataFrame:
    """Fetches, failures and bytes by server and overall."""
    return log.rollup("server").agg(F.count("*").alias("fetches"), F.count_if(~F.col("ok")).alias("failed"), F.sum(F.when(F.col("ok"), F.col("bytes")).otherwise(0)).alias("bytes"))


def rebuild_results(curves: DataFrame) -> DataFrame:
    """Document -> figures -> curves, nested with counts, from a flat listing of curves."""
    figures = curves.groupBy("doc_id", "figure_id").agg(F.sort_array(F.collect_list(F.struct("curve_id", "n_points"))).alias("curves"))
    nested = figures.withColumn("n_curves", F.size("curves"))
    return nested.groupBy("doc_id").agg(
        F.count("*").alias("n_figures"), F.sum("n_curves").alias("n_curves"), F.sort_array(F.collect_list(F.struct("figure_id", "n_curves", "curves"))).alias("figures")
    )
