"""Registered queries of the network meta-analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import nma
from tidemark.plans import adapters
from tidemark.registry import query

_N = "WITH " + adapters.NMA


@query(
    "treatment_edges",
    _N + ", a AS (SELECT DISTINCT study_id, arm FROM nma) SELECT x.arm AS t1, y.arm AS t2, count(*) AS weight FROM a x JOIN a y ON x.study_id = y.study_id AND x.arm < y.arm GROUP BY ALL",
)
def treatment_edges(spark, sf_dir):
    return nma.treatment_edges(adapters.nma(spark, sf_dir))


@query("network_components", _N + " SELECT DISTINCT arm AS treatment, (SELECT min(arm) FROM nma) AS component FROM nma")
def network_components(spark, sf_dir):
    ipd = adapters.nma(spark, sf_dir)
    return nma.network_components(nma.treatment_edges(ipd), ipd.select(F.col("arm").alias("treatment")).distinct())


@query(
    "risk_sets",
    _N + """, c AS (SELECT arm, time, sum(event) AS d, count(*) AS m FROM nma GROUP BY ALL), t AS (SELECT DISTINCT time FROM c WHERE d > 0),
 g AS (SELECT arm, t.time FROM (SELECT DISTINCT arm FROM c), t)
 SELECT g.time, g.arm, coalesce((SELECT d FROM c WHERE c.arm = g.arm AND c.time = g.time), 0)::BIGINT AS d, coalesce((SELECT sum(m) FROM c WHERE c.arm = g.arm AND c.time >= g.time), 0)::BIGINT AS n FROM g""",
)
def risk_sets(spark, sf_dir):
    return nma.risk_sets(adapters.nma(spark, sf_dir), [])


@query("cox_hr")
def cox_hr(spark, sf_dir):
    hr = nma.cox_hr(adapters.nma(spark, sf_dir))
    return hr.select("treatment", *[F.round(c, 6).alias(c) for c in ("hr", "lower", "upper", "p_value")], "warning")


@query("cox_hr_stratified")
def cox_hr_stratified(spark, sf_dir):
    hr = nma.cox_hr(adapters.nma(spark, sf_dir), stratify=True)
    return hr.select("treatment", *[F.round(c, 6).alias(c) for c in ("hr", "lower", "upper", "p_value")], "warning")


_RATE = _N + ", hr AS (SELECT arm AS treatment, (sum(event)::DOUBLE / sum(time)) * 100.0 AS hr FROM nma GROUP BY arm)"


def _rates(spark, sf_dir):
    """Event rates in the place of hazard ratios, so that the tables have an SQL twin."""
    ipd = adapters.nma(spark, sf_dir)
    return ipd.groupBy(F.col("arm").alias("treatment")).agg((F.sum("event").cast("double") / F.sum("time") * 100.0).alias("hr"))


@query(
    "rank_treatments",
    _RATE + ", r AS (SELECT treatment, hr, row_number() OVER (ORDER BY hr, treatment) AS rank, count(*) OVER () AS n FROM hr) SELECT treatment, round(hr, 6) AS hr, rank::INT AS rank, (n - rank) / (n - 1)::DOUBLE * 100.0 AS sucra, (n - rank) / (n - 1)::DOUBLE AS p_score FROM r",
)
def rank_treatments(spark, sf_dir):
    return nma.rank_treatments(_rates(spark, sf_dir)).withColumn("hr", F.round("hr", 6))


@query("league_table", _RATE + " SELECT a.treatment AS row, b.treatment AS col, CASE WHEN a.treatment = b.treatment THEN a.treatment ELSE printf('%.2f', a.hr / b.hr) END AS cell FROM hr a, hr b")
def league_table(spark, sf_dir):
    return nma.league_long(_rates(spark, sf_dir))


@query("league_table_as_written", _RATE + " SELECT a.treatment AS row, b.treatment AS col, CASE WHEN a.treatment = b.treatment THEN a.treatment WHEN a.treatment > b.treatment THEN printf('%.2f', b.hr / a.hr) ELSE printf('%.2f', a.hr / b.hr) END AS cell FROM hr a, hr b")
def league_table_as_written(spark, sf_dir):
    return nma.league_long(_rates(spark, sf_dir), as_written=True)


@query("nma_ranking")
def nma_ranking(spark, sf_dir):
    out = nma.run_nma(adapters.nma(spark, sf_dir))["ranking"]
    return out.withColumn("hr", F.round("hr", 6))
