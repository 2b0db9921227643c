"""Registered queries of the time-to-event operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import records, survival
from tidemark.plans import adapters
from tidemark.registry import query

GRID = [0.0, 6.0, 12.0, 18.0, 24.0, 36.0, 48.0, 60.0]


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


_TABLE = """, e AS (SELECT {keys}, time, sum(event) AS n_event, sum(1 - event) AS n_censor FROM {src} GROUP BY ALL),
 r AS (SELECT *, sum(n_event + n_censor) OVER (PARTITION BY {keys} ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS n_risk FROM e)"""
_KM = """, k AS (SELECT *, sum(CASE WHEN n_event < n_risk THEN ln(1.0 - n_event::DOUBLE / n_risk) ELSE 0.0 END) OVER w AS log_s,
 sum(CASE WHEN n_event < n_risk THEN n_event::DOUBLE / (n_risk::DOUBLE * (n_risk - n_event)) ELSE 0.0 END) OVER w AS v,
 max((n_event >= n_risk)::INT) OVER w AS ended FROM r WINDOW w AS (PARTITION BY {keys} ORDER BY time ROWS UNBOUNDED PRECEDING)),
 km AS (SELECT *, CASE WHEN ended = 1 THEN 0.0 ELSE exp(log_s) END AS survival FROM k)"""
_KM_OUT = """ SELECT {keys}, time, n_event::BIGINT AS n_event, n_censor::BIGINT AS n_censor, n_risk::BIGINT AS n_risk, round(survival, 6) AS survival,
 round(survival * sqrt(v), 6) AS std_err, round(CASE WHEN survival > 0 THEN exp(log_s - 1.959963984540054 * sqrt(v)) END, 6) AS lower,
 round(CASE WHEN survival > 0 THEN least(1.0, exp(log_s + 1.959963984540054 * sqrt(v))) END, 6) AS upper FROM km"""


def _km_sql(keys: str, src: str = "ipd", view: str = adapters.IPD) -> str:
    return "WITH " + view + _TABLE.format(keys=keys, src=src) + _KM.format(keys=keys)


@query("km_by_arm", _km_sql("study_id, arm") + _KM_OUT.format(keys="study_id, arm"))
def km_by_arm(spark, sf_dir):
    return _rounded(survival.km_fit(adapters.ipd(spark, sf_dir), ["study_id", "arm"]), "survival", "std_err", "lower", "upper")


_TRUNC = adapters.IPD + """, tr AS (SELECT study_id, arm, time, event, (subject_id % 6)::DOUBLE AS time_start FROM ipd WHERE subject_id % 6 < time),
 a AS (SELECT study_id, arm, time, event AS n_event, 1 - event AS n_censor, 0 AS n_enter FROM tr UNION ALL SELECT study_id, arm, time_start, 0, 0, 1 FROM tr),
 b AS (SELECT study_id, arm, time, sum(n_event) AS n_event, sum(n_censor) AS n_censor, sum(n_enter) AS n_enter FROM a GROUP BY ALL),
 c AS (SELECT *, sum(n_event + n_censor - n_enter) OVER (PARTITION BY study_id, arm ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS n_risk FROM b),
 r AS (SELECT study_id, arm, time, n_event, n_censor, n_risk FROM c WHERE n_event + n_censor > 0)"""


@query("km_left_truncated", "WITH " + _TRUNC + _KM.format(keys="study_id, arm") + _KM_OUT.format(keys="study_id, arm"))
def km_left_truncated(spark, sf_dir):
    entry = (F.col("subject_id") % 6).cast("double")
    ipd = adapters.ipd(spark, sf_dir).withColumn("time_start", entry).filter("time_start < time")
    return _rounded(survival.km_fit(ipd, ["study_id", "arm"], start="time_start"), "survival", "std_err", "lower", "upper")


@query(
    "at_risk_table",
    "WITH " + adapters.IPD + ", g AS (SELECT unnest([0.0, 6.0, 12.0, 18.0, 24.0, 36.0, 48.0, 60.0])::DOUBLE AS grid_time),"
    " s AS (SELECT DISTINCT study_id, arm FROM ipd) SELECT s.study_id, s.arm, grid_time,"
    " (SELECT count(*) FROM ipd i WHERE i.study_id = s.study_id AND i.arm = s.arm AND i.time >= grid_time)::BIGINT AS n_risk FROM s, g",
)
def at_risk_table(spark, sf_dir):
    return survival.at_risk_table(adapters.ipd(spark, sf_dir), ["study_id", "arm"], GRID)


@query(
    "median_survival",
    _km_sql("study_id, arm") + " SELECT study_id, arm, min(CASE WHEN survival <= 0.75 + 1e-12 THEN time END) AS q25,"
    " min(CASE WHEN survival <= 0.5 + 1e-12 THEN time END) AS q50, min(CASE WHEN survival <= 0.25 + 1e-12 THEN time END) AS q75 FROM km GROUP BY ALL",
)
def median_survival(spark, sf_dir):
    return survival.survival_quantiles(adapters.ipd(spark, sf_dir), ["study_id", "arm"])


def _area(t: str) -> str:
    return f"round(least(min(time), {t}) + sum(CASE WHEN time < {t} THEN survival * (least(coalesce(nxt, {t}), {t}) - time) ELSE 0.0 END), 6) AS rmst_{t[:-2]}"


@query(
    "rmst",
    _km_sql("study_id, arm") + ", n AS (SELECT *, lead(time) OVER (PARTITION BY study_id, arm ORDER BY time) AS nxt FROM km) SELECT study_id, arm, "
    + ", ".join(map(_area, ("12.0", "24.0", "36.0"))) + " FROM n GROUP BY study_id, arm",
)
def rmst(spark, sf_dir):
    return _rounded(survival.rmst(adapters.ipd(spark, sf_dir), ["study_id", "arm"]), "rmst_12", "rmst_24", "rmst_36")


_TWO = adapters.IPD + ", two AS (SELECT * FROM ipd WHERE arm IN ('A', 'R'))"


@query(
    "logrank",
    "WITH " + _TWO + """, g AS (SELECT study_id, min(arm) AS first_group FROM two GROUP BY study_id HAVING count(DISTINCT arm) = 2),
 t AS (SELECT study_id, time, sum(event) AS d, count(*) AS m, sum(CASE WHEN arm = first_group THEN event ELSE 0 END) AS d1,
  sum((arm = first_group)::INT) AS m1 FROM two JOIN g USING (study_id) GROUP BY ALL),
 n AS (SELECT *, sum(m) OVER w AS n, sum(m1) OVER w AS n1 FROM t WINDOW w AS (PARTITION BY study_id ORDER BY time DESC ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT study_id, sum(d1) AS observed, sum(d * n1::DOUBLE / n) AS expected,
  sum(CASE WHEN n > 1 THEN d * (n1::DOUBLE / n) * (1 - n1::DOUBLE / n) * (n - d) / (n - 1) ELSE 0.0 END) AS variance FROM n GROUP BY ALL)
 SELECT study_id, first_group, observed::BIGINT AS observed, round(expected, 6) AS expected, round(variance, 6) AS variance,
 round(CASE WHEN variance > 0 THEN (observed - expected) ** 2 / variance END, 6) AS chi2 FROM s JOIN g USING (study_id)""",
)
def logrank(spark, sf_dir):
    two = adapters.ipd(spark, sf_dir).filter(F.col("arm").isin("A", "R"))
    return _rounded(survival.logrank(two, ["study_id"], "arm"), "expected", "variance", "chi2")


@query(
    "logrank_k_groups",
    "WITH " + adapters.IPD + """, t AS (SELECT study_id, arm, time, sum(event) AS d, count(*) AS m FROM ipd GROUP BY ALL),
 a AS (SELECT study_id, time, sum(d) AS d_all, sum(m) AS m_all FROM t GROUP BY ALL),
 g AS (SELECT k.study_id, k.arm, a.time, a.d_all, a.m_all, coalesce(t.d, 0) AS d, coalesce(t.m, 0) AS m
  FROM (SELECT DISTINCT study_id, arm FROM t) k JOIN a USING (study_id) LEFT JOIN t ON t.study_id = k.study_id AND t.arm = k.arm AND t.time = a.time),
 n AS (SELECT *, sum(m) OVER w AS n, sum(m_all) OVER w AS n_all FROM g WINDOW w AS (PARTITION BY study_id, arm ORDER BY time DESC ROWS UNBOUNDED PRECEDING))
 SELECT study_id, arm, sum(d)::BIGINT AS observed, round(sum(d_all * n::DOUBLE / n_all), 6) AS expected FROM n GROUP BY ALL""",
)
def logrank_k_groups(spark, sf_dir):
    return _rounded(survival.logrank_terms(adapters.ipd(spark, sf_dir), ["study_id"], "arm"), "expected")


@query(
    "logrank_test",
    "WITH " + adapters.IPD + """, t AS (SELECT study_id, arm, time, sum(event) AS d, count(*) AS m FROM ipd GROUP BY ALL),
 w AS (SELECT study_id, time, sum(d)::DOUBLE AS d, sum(m)::DOUBLE AS m, sum(CASE WHEN arm = 'A' THEN d ELSE 0 END)::DOUBLE AS da, sum(CASE WHEN arm = 'A' THEN m ELSE 0 END)::DOUBLE AS ma,
  sum(CASE WHEN arm = 'N' THEN d ELSE 0 END)::DOUBLE AS db, sum(CASE WHEN arm = 'N' THEN m ELSE 0 END)::DOUBLE AS mb FROM t GROUP BY ALL),
 r AS (SELECT *, sum(m) OVER k AS n, sum(ma) OVER k AS na, sum(mb) OVER k AS nb FROM w WINDOW k AS (PARTITION BY study_id ORDER BY time DESC ROWS UNBOUNDED PRECEDING)),
 x AS (SELECT *, CASE WHEN n > 1 THEN d * (n - d) / (n - 1) ELSE 0.0 END AS v FROM r WHERE d > 0),
 s AS (SELECT study_id, sum(da - d * na / n) AS a, sum(db - d * nb / n) AS b, sum(v * na / n * (1 - na / n)) AS vaa, sum(v * nb / n * (1 - nb / n)) AS vbb, -sum(v * na / n * nb / n) AS vab FROM x GROUP BY study_id),
 c AS (SELECT study_id, (a * a * vbb - 2 * a * b * vab + b * b * vaa) / (vaa * vbb - vab * vab) AS chi2 FROM s)
 SELECT study_id, 3::INT AS groups, round(chi2, 6) AS chi2, 2::INT AS df, round(exp(-chi2 / 2), 6) AS p_value FROM c""",
)
def logrank_test(spark, sf_dir):
    """Three arms a study: the twin solves two equations and has the tail of two degrees in closed form."""
    return _rounded(survival.logrank_test(adapters.ipd(spark, sf_dir), ["study_id"], "arm"), "chi2", "p_value")


_SCORED = adapters.IPD + ", sc AS (SELECT study_id, time, event, subject_id % 7 AS risk FROM ipd)"


def _scored(spark, sf_dir):
    return adapters.ipd(spark, sf_dir).withColumn("risk", F.col("subject_id") % 7)


@query(
    "c_index",
    "WITH " + _SCORED + """, c AS (SELECT study_id, time, risk, sum(event) AS d, count(*) AS m FROM sc GROUP BY ALL)
 SELECT a.study_id, sum(a.d * b.m)::BIGINT AS pairs,
 round(sum(a.d * b.m * CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0.0 END) / sum(a.d * b.m), 6) AS c_index
 FROM c a JOIN c b ON a.study_id = b.study_id AND b.time > a.time WHERE a.d > 0 GROUP BY a.study_id""",
)
def c_index(spark, sf_dir):
    return _rounded(survival.c_index(_scored(spark, sf_dir), ["study_id"], "risk"), "c_index")


@query(
    "time_auc",
    "WITH " + _SCORED + """, c AS (SELECT study_id, risk, sum((time <= 24 AND event = 1)::INT) AS cases, sum((time > 24)::INT) AS controls FROM sc GROUP BY ALL),
 w AS (SELECT *, cases * (coalesce(sum(controls) OVER (PARTITION BY study_id ORDER BY risk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5 * controls) AS won FROM c)
 SELECT study_id, sum(cases)::BIGINT AS cases, sum(controls)::BIGINT AS controls, round(sum(won) / nullif(sum(cases) * sum(controls), 0), 6) AS auc FROM w GROUP BY ALL""",
)
def time_auc(spark, sf_dir):
    return _rounded(survival.time_auc(_scored(spark, sf_dir), ["study_id"], "risk", 24.0), "auc")


@query(
    "reconstruct_ipd",
    _km_sql("study_id") + """, q AS (SELECT study_id, row_number() OVER (PARTITION BY study_id ORDER BY time) AS seq, time, round(survival, 6) AS survival, n_risk FROM km),
 l AS (SELECT *, lead(survival) OVER w AS s2, lead(n_risk) OVER w AS n2, lead(time) OVER w AS t2 FROM q WINDOW w AS (PARTITION BY study_id ORDER BY seq)),
 x AS (SELECT *, CASE WHEN s2 IS NULL OR survival <= 0 THEN 0 ELSE least(n_risk - n2, greatest(0, round(n_risk * (1 - s2 / survival)))) END::INT AS events FROM l),
 c AS (SELECT *, CASE WHEN n2 IS NULL THEN n_risk ELSE n_risk - n2 - events END::INT AS censored FROM x),
 p AS (SELECT study_id, seq, coalesce(t2, time) AS time, list_concat(list_transform(range(events), lambda x: 1), list_transform(range(censored), lambda x: 0)) AS each FROM c)
 SELECT study_id, time, sum(ev)::BIGINT AS events, count(*)::BIGINT AS patients FROM (SELECT study_id, seq, time, unnest(each) AS ev FROM p) GROUP BY ALL""",
)
def reconstruct_ipd(spark, sf_dir):
    from pyspark.sql import Window

    km = survival.km_fit(adapters.ipd(spark, sf_dir), ["study_id"])
    steps = km.select("study_id", F.row_number().over(Window.partitionBy("study_id").orderBy("time")).alias("seq"), "time", F.round("survival", 6).alias("survival"), "n_risk")
    return survival.reconstruct_ipd(steps, ["study_id"]).groupBy("study_id", "time").agg(F.sum("event").alias("events"), F.count("*").alias("patients"))


@query(
    "fit_ipd",
    "WITH " + adapters.IPD + ", g AS (SELECT unnest([0.0, 6.0, 12.0, 18.0, 24.0, 36.0, 48.0, 60.0])::DOUBLE AS grid_time), s AS (SELECT DISTINCT study_id FROM ipd)"
    " SELECT s.study_id, grid_time, (SELECT count(*) FROM ipd i WHERE i.study_id = s.study_id AND i.time >= grid_time)::BIGINT AS n_risk FROM s, g",
)
def fit_ipd(spark, sf_dir):
    """Records fitted to each study's curve and numbers at risk; the twin counts the true records at risk."""
    ipd = adapters.ipd(spark, sf_dir)
    km = survival.km_fit(ipd, ["study_id"]).select("study_id", "time", "survival")
    risk = survival.at_risk_table(ipd, ["study_id"], GRID).select("study_id", F.col("grid_time").alias("time"), "n_risk")
    return survival.at_risk_table(survival.fit_ipd(km, risk, ["study_id"]), ["study_id"], GRID)


@query(
    "study_summary",
    "WITH " + adapters.NMA + " SELECT study_id, arm, count(*) AS n, sum(event)::BIGINT AS events FROM nma GROUP BY ALL",
)
def study_summary(spark, sf_dir):
    return records.study_summary(adapters.nma(spark, sf_dir))


@query(
    "pool_arms",
    "WITH " + adapters.IPD + " SELECT arm, count(*) AS n, sum(event)::BIGINT AS events FROM ipd WHERE arm IN ('A', 'N', 'R') GROUP BY arm",
)
def pool_arms(spark, sf_dir):
    ipd = adapters.ipd(spark, sf_dir)
    pooled = records.pool_arms(*[ipd.filter(F.col("arm") == a) for a in ("A", "N", "R")])
    return pooled.groupBy("arm").agg(F.count("*").alias("n"), F.sum("event").alias("events"))


@query(
    "validate_ipd",
    "WITH " + adapters.IPD_RAW + """ SELECT study_id, CASE WHEN time_end < time_start THEN 'end before start' WHEN time_end - time_start > 600 THEN 'implausible follow-up' END AS reason,
 count(*) AS n FROM ipd_raw GROUP BY ALL""",
)
def validate_ipd(spark, sf_dir):
    return records.validate_ipd(adapters.ipd_raw(spark, sf_dir)).groupBy("study_id", "reason").agg(F.count("*").alias("n"))


@query(
    "dedupe_subjects",
    "WITH " + adapters.IPD_RAW + """ SELECT study_id, subject_id, time_end, event, arm FROM (SELECT *, row_number() OVER (PARTITION BY study_id, subject_id
 ORDER BY time_end DESC, event DESC, arm) AS n FROM ipd_raw) WHERE n = 1""",
)
def dedupe_subjects(spark, sf_dir):
    return records.dedupe_subjects(adapters.ipd_raw(spark, sf_dir), ["arm", "time_end"]).select("study_id", "subject_id", "time_end", "event", "arm")


@query(
    "harmonize_ipd",
    "WITH " + adapters.IPD_RAW + """ SELECT study_id, arm, endpoint, count(*) AS n, round(sum(time_end), 3) AS months FROM (SELECT study_id, arm, 'OS' AS endpoint,
 time_end * (1 / 30.4375::DOUBLE) AS time_end FROM ipd_raw) GROUP BY ALL""",
)
def harmonize_ipd(spark, sf_dir):
    names = {k: k for k in ("study_id", "subject_id", "arm", "time_end", "event")}
    out = records.harmonize_ipd(adapters.ipd_raw(spark, sf_dir), names, "days", "OS")
    return out.groupBy("study_id", "arm", "endpoint").agg(F.count("*").alias("n"), F.round(F.sum("time_end"), 3).alias("months"))


@query(
    "manifest_rows",
    "WITH " + adapters.IPD + " SELECT study_id, count(*) AS n_subjects, sum(event)::BIGINT AS n_events, median(time) AS median_follow_up FROM ipd GROUP BY study_id",
)
def manifest_rows(spark, sf_dir):
    return records.manifest_rows(adapters.ipd(spark, sf_dir), ["study_id"])
