"""Registered queries over curve points: shaping, validation, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import shape, validate
from tidemark.plans import adapters
from tidemark.registry import query

_P = "WITH " + adapters.POINTS
_D = "WITH " + adapters.POINTS_DIRTY
_ORDER = "PARTITION BY figure_id, curve_id ORDER BY time, seq"


def _r(df, *names):
    return df.select(*[F.round(F.col(c) + 1e-9, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def _p(spark, sf_dir):
    return adapters.points(spark, sf_dir)


# ------------------------------------------------------------ calibration


_CAL = "WITH " + adapters.POINTS + ", " + adapters.CALIBRATION + ", px AS (SELECT figure_id, curve_id, seq, time * 8.0 AS x, (1.0 - survival) * 400.0 AS y FROM points)"


def _pixels_of(spark, sf_dir):
    p = _p(spark, sf_dir)
    return p.select("figure_id", "curve_id", "seq", (F.col("time") * 8.0).alias("x"), ((F.lit(1.0) - F.col("survival")) * 400.0).alias("y"))


@query(
    "calibrate_range",
    _CAL + """ SELECT figure_id, curve_id, seq, round(x_lo + x / 480.0 * (x_hi - x_lo), 6) AS time,
 round(least(greatest(y_hi - y / 400.0 * (y_hi - y_lo), y_lo), y_hi), 6) AS survival FROM px JOIN calibration USING (figure_id)""",
)
def calibrate_range(spark, sf_dir):
    rows = _pixels_of(spark, sf_dir).join(adapters.calibration(spark, sf_dir), "figure_id")
    t = scalar.calibrate_time(F.col("x"), F.lit(480.0), F.col("x_lo"), F.col("x_hi"))
    s = scalar.calibrate_survival(F.col("y"), F.lit(400.0), F.col("y_lo"), F.col("y_hi"))
    return rows.select("figure_id", "curve_id", "seq", F.round(t, 6).alias("time"), F.round(s, 6).alias("survival"))


@query(
    "calibrate_extent",
    _CAL + """, m AS (SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x1, min(y) OVER w AS y0, max(y) OVER w AS y1 FROM px WINDOW w AS (PARTITION BY figure_id, curve_id))
 SELECT figure_id, curve_id, seq, round(x_lo + (x - x0) / nullif(x1 - x0, 0) * (x_hi - x_lo) + 1e-9, 6) AS time,
 round(y_hi - (y - y0) / nullif(y1 - y0, 0) * (y_hi - y_lo) + 1e-9, 6) AS survival FROM m JOIN calibration USING (figure_id)""",
)
def calibrate_extent(spark, sf_dir):
    from tidemark.operators.calibrate import calibrate_extent as op

    return _r(op(_pixels_of(spark, sf_dir), adapters.calibration(spark, sf_dir)), "time", "survival")


@query(
    "calibrate_linear",
    _CAL + """ SELECT figure_id, curve_id, seq, round(0.125 * x + 1e-9, 6) AS time,
 round(min(least(greatest(-0.0025 * y + 1.0, 0.0), 1.0)) OVER (PARTITION BY figure_id, curve_id ORDER BY 0.125 * x, seq ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS survival FROM px""",
)
def calibrate_linear(spark, sf_dir):
    rows = _pixels_of(spark, sf_dir).select("figure_id", "curve_id", "seq", (F.lit(0.125) * F.col("x")).alias("time"), scalar.linear_survival(F.col("y"), F.lit(-0.0025), F.lit(1.0)).alias("survival"))
    return _r(shape.monotone_envelope(rows), "time", "survival")


@query("loose_survival", _D + " SELECT figure_id, curve_id, seq, least(greatest(survival, -0.05), 1.05) AS survival FROM dirty")
def loose_survival(spark, sf_dir):
    return adapters.points_dirty(spark, sf_dir).select("figure_id", "curve_id", "seq", scalar.loose_survival(F.col("survival")).alias("survival"))


@query(
    "normalize_percent_axis",
    "WITH " + adapters.CALIBRATION + " SELECT figure_id, CASE WHEN y_unit = 'percentage' THEN y_lo / 100.0 ELSE y_lo END AS y_lo, CASE WHEN y_unit = 'percentage' THEN y_hi / 100.0 ELSE y_hi END AS y_hi FROM calibration",
)
def normalize_percent_axis(spark, sf_dir):
    c = adapters.calibration(spark, sf_dir)
    return c.select("figure_id", *[scalar.normalize_percent(F.col(x), F.col("y_unit")).alias(x) for x in ("y_lo", "y_hi")])


# ------------------------------------------------------------ shaping


@query("monotone_envelope", _P + f" SELECT figure_id, curve_id, seq, time, min(survival) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS survival FROM points")
def monotone_envelope(spark, sf_dir):
    return shape.monotone_envelope(_p(spark, sf_dir))


_BINS = _CAL + """, m AS (SELECT *, floor(min(x) OVER w) AS x0, count(*) OVER w AS n FROM px WINDOW w AS (PARTITION BY figure_id, curve_id)),
 b AS (SELECT figure_id, curve_id, x0, n, floor((x - x0) / 5) AS bin, x, y FROM m)"""


def _bin_sql(value: str) -> str:
    return _BINS + f" SELECT figure_id, curve_id, CASE WHEN n < 2 THEN min(x) ELSE x0 + bin * 5 + 2.5 END AS x, round({value} + 1e-9, 6) AS y FROM b GROUP BY figure_id, curve_id, x0, n, bin"


@query("bin_points_median", _bin_sql("median(y)"))
def bin_points_median(spark, sf_dir):
    return _r(shape.bin_points(_pixels_of(spark, sf_dir), 5, "median"), "y")


@query("bin_points_mean", _bin_sql("avg(y)"))
def bin_points_mean(spark, sf_dir):
    return _r(shape.bin_points(_pixels_of(spark, sf_dir), 5, "mean"), "y")


@query(
    "bin_points_mode",
    _BINS + """, c AS (SELECT figure_id, curve_id, x0, bin, floor(y) AS y, count(*) AS c FROM b GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY figure_id, curve_id, bin ORDER BY c DESC, y) AS k FROM c)
 SELECT figure_id, curve_id, x0 + bin * 5 + 2.5 AS x, y::DOUBLE AS y FROM r WHERE k = 1""",
)
def bin_points_mode(spark, sf_dir):
    return shape.bin_points(_pixels_of(spark, sf_dir), 5, "mode", truncate=True).withColumn("y", F.col("y").cast("double"))


@query("bin_time", _P + " SELECT figure_id, curve_id, floor(time)::DOUBLE AS time, round(median(survival) + 1e-9, 6) AS survival FROM points GROUP BY ALL")
def bin_time(spark, sf_dir):
    return _r(shape.bin_time(_p(spark, sf_dir)), "survival")


@query(
    "moving_average",
    _P + f""" SELECT figure_id, curve_id, seq, time, round(CASE WHEN count(*) OVER (PARTITION BY figure_id, curve_id) < 5 THEN survival ELSE
 avg(survival) OVER ({_ORDER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END + 1e-9, 6) AS survival FROM points""",
)
def moving_average(spark, sf_dir):
    return _r(shape.moving_average(_p(spark, sf_dir)), "survival")


@query(
    "decimate",
    _P + f""", d AS (SELECT *, count(*) OVER (PARTITION BY figure_id, curve_id) AS n, row_number() OVER w - 1 AS i, coalesce(abs(survival - lag(survival) OVER w) > 0.05, false) AS j
 FROM points WINDOW w AS ({_ORDER})) SELECT figure_id, curve_id, seq, time, survival FROM d WHERE n <= 50 OR i % greatest(n // 50, 1) = 0 OR i = n - 1 OR j""",
)
def decimate(spark, sf_dir):
    return shape.decimate(_p(spark, sf_dir), 50)


_ENV = f", env AS (SELECT figure_id, curve_id, seq, time, least(1.0, greatest(0.0, min(survival) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING))) AS survival FROM points)"


@query(
    "enforce_km",
    _P + _ENV + f""", l AS (SELECT *, time - lag(time) OVER w AS dt, lag(survival) OVER w - survival AS ds FROM env WINDOW w AS ({_ORDER}))
 SELECT figure_id, curve_id, seq, time, survival FROM l WHERE coalesce(dt > 1e-6 OR ds > 1e-6, true)""",
)
def enforce_km(spark, sf_dir):
    return shape.enforce_km(_p(spark, sf_dir))


@query(
    "classify_segments",
    _P + f""", l AS (SELECT *, abs(time - lag(time) OVER w) AS dt, lag(survival) OVER w - survival AS ds FROM points WINDOW w AS ({_ORDER}))
 SELECT figure_id, curve_id, seq, time, survival FROM l WHERE ds IS NULL OR (ds > 0.001 AND dt < 0.5)""",
)
def classify_segments(spark, sf_dir):
    return shape.classify_segments(_p(spark, sf_dir))


def _fold_sql(keep: str, source: str = "points", survival: str = "survival") -> str:
    return _P + f""", o AS (SELECT figure_id, curve_id, seq, time, {survival} AS survival, row_number() OVER ({_ORDER}) AS i FROM {source}),
 f AS (SELECT figure_id, curve_id, list({{'i': i, 'time': time, 'seq': seq, 'survival': survival}} ORDER BY i) AS pts FROM o GROUP BY ALL),
 k AS (SELECT figure_id, curve_id, list_reduce(list_transform(pts, lambda x: [x]), lambda a, x: CASE WHEN {keep} THEN list_concat(a, x) ELSE a END) AS kept FROM f)
 SELECT figure_id, curve_id, p.seq AS seq, p.time AS time, p.survival AS survival FROM (SELECT figure_id, curve_id, unnest(kept) AS p FROM k)"""


@query("keep_significant", _fold_sql("abs(x[1].survival - a[-1].survival) > 0.02"))
def keep_significant(spark, sf_dir):
    return shape.keep_significant(_p(spark, sf_dir), 0.02)


@query("detect_level_changes", _fold_sql("abs(x[1].survival - a[-1].survival) > 1e-4", survival="round(survival + 1e-9, 5)"))
def detect_level_changes(spark, sf_dir):
    return shape.detect_level_changes(_p(spark, sf_dir).withColumn("survival", F.col("survival") + 1e-9))


@query("dedupe_consecutive", _fold_sql("NOT (abs(x[1].time - a[-1].time) < 0.2 AND abs(x[1].survival - a[-1].survival) < 0.2)"))
def dedupe_consecutive(spark, sf_dir):
    return shape.dedupe_consecutive(_p(spark, sf_dir), 0.2)


@query(
    "step_regularize",
    _P + f""", o AS (SELECT *, row_number() OVER ({_ORDER}) AS i FROM points),
 f AS (SELECT figure_id, curve_id, list({{'time': time, 'seq': seq, 'survival': survival}} ORDER BY i) AS pts FROM o GROUP BY ALL),
 k AS (SELECT figure_id, curve_id, list_reduce(list_transform(pts, lambda x: [x]), lambda a, x: CASE WHEN abs(x[1].time - a[-1].time) < 0.02 AND abs(x[1].survival - a[-1].survival) < 0.02 THEN a
  WHEN abs(x[1].time - a[-1].time) < abs(x[1].survival - a[-1].survival) THEN list_append(a, {{'time': a[-1].time, 'seq': x[1].seq, 'survival': x[1].survival}})
  ELSE list_append(a, {{'time': x[1].time, 'seq': x[1].seq, 'survival': a[-1].survival}}) END) AS kept FROM f)
 SELECT figure_id, curve_id, p.seq AS seq, p.time AS time, p.survival AS survival FROM (SELECT figure_id, curve_id, unnest(kept) AS p FROM k)""",
)
def step_regularize(spark, sf_dir):
    return shape.step_regularize(_p(spark, sf_dir), 0.02)


_STEPS = _P + f""", d AS (SELECT *, lead(survival) OVER w - survival AS ds, lead(time) OVER w - time AS gap, count(*) OVER (PARTITION BY figure_id, curve_id) AS n FROM points WINDOW w AS ({_ORDER})),
 s AS (SELECT *, ds / CASE WHEN gap = 0 THEN 1e-10 ELSE gap END AS slope FROM d),
 q AS (SELECT figure_id, curve_id, quantile_cont(abs(slope), 0.75) AS p75 FROM s GROUP BY ALL),
 st AS (SELECT s.figure_id, s.curve_id, seq, time, survival, coalesce(n >= 5 AND ds IS NOT NULL AND (slope < -p75 OR abs(ds) > 0.01), false) AS is_step FROM s JOIN q USING (figure_id, curve_id))"""
_PLATEAUS = _STEPS + f""", b AS (SELECT *, coalesce(lag(is_step::INT) OVER ({_ORDER}), 0) AS bf FROM st),
 g AS (SELECT *, sum(bf) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS segment FROM b),
 pl AS (SELECT figure_id, curve_id, segment::BIGINT AS segment, min(time) AS t_start, max(time) AS t_end, median(survival) AS level FROM g GROUP BY ALL HAVING count(*) >= 2)"""


@query("detect_steps", _STEPS + " SELECT * FROM st")
def detect_steps(spark, sf_dir):
    return shape.detect_steps(_p(spark, sf_dir))


@query("segment_plateaus", _PLATEAUS + " SELECT figure_id, curve_id, segment, t_start, t_end, round(level + 1e-9, 6) AS level FROM pl")
def segment_plateaus(spark, sf_dir):
    return _r(shape.segment_plateaus(_p(spark, sf_dir)), "level")


_REBUILT = _PLATEAUS + """, nx AS (SELECT *, lead(level) OVER (PARTITION BY figure_id, curve_id ORDER BY segment) AS nxt FROM pl),
 c AS (SELECT figure_id, curve_id, (segment * 2)::INT AS seq, t_start AS time, level AS survival FROM nx UNION ALL
  SELECT figure_id, curve_id, (segment * 2 + 1)::INT, t_end, coalesce(nxt, level) FROM nx),
 e AS (SELECT figure_id, curve_id, seq, time, least(1.0, greatest(0.0, min(survival) OVER (PARTITION BY figure_id, curve_id ORDER BY time, seq ROWS UNBOUNDED PRECEDING))) AS survival FROM c),
 o AS (SELECT *, row_number() OVER (PARTITION BY figure_id, curve_id ORDER BY time, seq) AS i FROM e),
 f AS (SELECT figure_id, curve_id, list({'i': i, 'time': time, 'seq': seq, 'survival': survival} ORDER BY i) AS pts FROM o GROUP BY ALL),
 k AS (SELECT figure_id, curve_id, list_reduce(list_transform(pts, lambda x: [x]), lambda a, x: CASE WHEN abs(x[1].survival - a[-1].survival) > 0.005 THEN list_concat(a, x) ELSE a END) AS kept FROM f)"""


@query("reconstruct_steps", _REBUILT + " SELECT figure_id, curve_id, p.seq AS seq, p.time AS time, round(p.survival + 1e-9, 6) AS survival FROM (SELECT figure_id, curve_id, unnest(kept) AS p FROM k)")
def reconstruct_steps(spark, sf_dir):
    return _r(shape.reconstruct_steps(_p(spark, sf_dir)), "survival")


@query(
    "step_function",
    _REBUILT + """, r AS (SELECT figure_id, curve_id, p.seq AS seq, p.time AS time, p.survival AS survival FROM (SELECT figure_id, curve_id, unnest(kept) AS p FROM k)),
 env2 AS (SELECT figure_id, curve_id, seq, time, least(1.0, greatest(0.0, min(survival) OVER (PARTITION BY figure_id, curve_id ORDER BY time, seq ROWS UNBOUNDED PRECEDING))) AS survival FROM r),
 l2 AS (SELECT *, time - lag(time) OVER w AS dt, lag(survival) OVER w - survival AS ds FROM env2 WINDOW w AS (PARTITION BY figure_id, curve_id ORDER BY time, seq))
 SELECT figure_id, curve_id, seq, time, round(survival + 1e-9, 6) AS survival FROM l2 WHERE coalesce(dt > 1e-6 OR ds > 1e-6, true)""",
)
def step_function(spark, sf_dir):
    return _r(shape.step_function(_p(spark, sf_dir)), "survival")


_GRID = _P + """, g AS (SELECT figure_id, curve_id, unnest(range(0, 31))::DOUBLE * 2.0 AS grid_time FROM (SELECT DISTINCT figure_id, curve_id FROM points)),
 lp AS (SELECT figure_id, curve_id, time, arg_max(survival, seq) AS survival FROM points GROUP BY ALL),
 a AS (SELECT g.*, lp.time AS t0, lp.survival AS s0 FROM g ASOF LEFT JOIN lp ON g.figure_id = lp.figure_id AND g.curve_id = lp.curve_id AND g.grid_time >= lp.time),
 b AS (SELECT a.*, lp.time AS t1, lp.survival AS s1 FROM a ASOF LEFT JOIN lp ON a.figure_id = lp.figure_id AND a.curve_id = lp.curve_id AND a.grid_time <= lp.time),
 sampled AS (SELECT figure_id, curve_id, grid_time, CASE WHEN t0 IS NULL THEN s1 WHEN t1 IS NULL OR t0 = t1 THEN s0 ELSE s0 + (s1 - s0) / (t1 - t0) * (grid_time - t0) END AS survival FROM b)"""


@query("sample_step", _GRID + " SELECT figure_id, curve_id, grid_time, round(survival + 1e-9, 6) AS survival FROM sampled")
def sample_step(spark, sf_dir):
    p = _p(spark, sf_dir)
    return _r(shape.sample_step(p, shape.grid_for(p, 2.0, 60.0)), "survival")


_ISO = _P + """, m AS (SELECT figure_id, curve_id, time, avg(survival) AS y, count(*) AS w FROM points GROUP BY ALL),
 s AS (SELECT *, row_number() OVER o AS k, sum(w) OVER o AS sw, sum(y * w) OVER o AS sy FROM m WINDOW o AS (PARTITION BY figure_id, curve_id ORDER BY time)),
 a AS (SELECT i.figure_id, i.curve_id, i.k AS i, j.k AS j, (j.sy - (i.sy - i.y * i.w)) / (j.sw - (i.sw - i.w)) AS m FROM s i JOIN s j ON i.figure_id = j.figure_id AND i.curve_id = j.curve_id AND i.k <= j.k),
 b AS (SELECT figure_id, curve_id, j, max(m) OVER (PARTITION BY figure_id, curve_id, i ORDER BY j DESC ROWS UNBOUNDED PRECEDING) AS m FROM a),
 f AS (SELECT figure_id, curve_id, j AS k, min(m) AS fit FROM b GROUP BY ALL)"""


@query("isotonic_min_max", _ISO + " SELECT figure_id, curve_id, time, round(fit + 1e-9, 6) AS survival FROM s JOIN f USING (figure_id, curve_id, k)")
def isotonic_min_max(spark, sf_dir):
    return _r(shape.isotonic_min_max(_p(spark, sf_dir)), "survival")


@query("isotonic_clean")
def isotonic_clean(spark, sf_dir):
    return _r(shape.isotonic_clean(_p(spark, sf_dir)), "survival")


@query("parametric_fit")
def parametric_fit(spark, sf_dir):
    return _r(shape.parametric_fit(_p(spark, sf_dir), rounds=12), "lam", "k", "sse")


@query("fitted_curve", "WITH " + adapters.POINTS + """, f AS (SELECT figure_id, curve_id, min(time) AS lo, max(time) AS hi, max(time) / 2 AS lam FROM points GROUP BY ALL), g AS (SELECT *, unnest(range(100)) AS seq FROM f),
 t AS (SELECT *, lo + seq * (hi - lo) / 99 AS tm FROM g) SELECT figure_id, curve_id, seq::INT AS seq, round(tm + 1e-9, 6) AS time, round(exp(-pow(tm / lam, 1.5)) + 1e-9, 6) AS survival FROM t""")
def fitted_curve(spark, sf_dir):
    p = _p(spark, sf_dir)
    return _r(shape.fitted_curve(p, p.groupBy("figure_id", "curve_id").agg((F.max("time") / 2).alias("lam"), F.lit(1.5).alias("k"))), "time", "survival")


# ------------------------------------------------------------ validation


_MOVES = ", mv AS (SELECT *, survival - lag(survival) OVER w AS ds, time - lag(time) OVER w AS dt FROM {src} WINDOW w AS (PARTITION BY figure_id, curve_id ORDER BY seq))"
_VALID = _MOVES + """, s AS (SELECT figure_id, curve_id, count(*) AS n, max(time) - min(time) AS t, max(survival) - min(survival) AS v, min(time) AS t_lo, min(survival) AS s_lo, max(survival) AS s_hi,
 count(*) FILTER (dt < -0.5) AS back, count(*) FILTER (ds < -0.01) AS down, count(*) FILTER (ds > 0.01) AS up FROM mv GROUP BY ALL),
 v AS (SELECT *, CASE WHEN n < {least} THEN 'too few points' WHEN n > 500000 THEN 'too many points' WHEN t < 5 THEN 'time range too small' WHEN v < 0.15 THEN 'survival range too small'
 WHEN s_lo < -0.01 THEN 'survival below 0' WHEN s_hi > 1.01 THEN 'survival above 1' WHEN t_lo < -1 THEN 'starts before 0' WHEN back > 0 THEN 'time runs backward' END AS reason FROM s),
 sc AS (SELECT *, greatest(0, least(100, 100 - CASE WHEN t < 12 THEN 10 ELSE 0 END - CASE WHEN v < 0.3 THEN 10 ELSE 0 END - CASE WHEN n > 10000 THEN 20 WHEN n > 5000 THEN 10 ELSE 0 END
 - CASE WHEN n < 200 THEN 5 ELSE 0 END - 5 + CASE WHEN t > 36 AND v > 0.5 THEN 5 ELSE 0 END)) AS score,
 CASE WHEN down > up THEN 'decreasing' WHEN up > down THEN 'increasing' ELSE 'mixed' END AS direction FROM v)"""


def _valid_sql(least: str = "20") -> str:
    return _D + _VALID.replace("{src}", "dirty").replace("{least}", least)


@query(
    "curve_direction",
    _D + _MOVES.replace("{src}", "dirty") + """, n AS (SELECT figure_id, curve_id, count(*) FILTER (ds < -0.01) AS down, count(*) FILTER (ds > 0.01) AS up FROM mv GROUP BY ALL)
 SELECT *, CASE WHEN down > up THEN 'decreasing' WHEN up > down THEN 'increasing' ELSE 'mixed' END AS direction FROM n""",
)
def curve_direction(spark, sf_dir):
    return validate.curve_direction(adapters.points_dirty(spark, sf_dir))


@query(
    "validate_curve",
    _valid_sql() + """ SELECT figure_id, curve_id, n, reason IS NULL AS is_valid, CASE WHEN reason IS NULL THEN score ELSE 0 END::INT AS quality_score, reason,
 CASE WHEN reason IS NULL THEN concat_ws('; ', CASE WHEN t < 12 THEN 'short time range' END, CASE WHEN v < 0.3 THEN 'low survival range' END, CASE WHEN n > 10000 THEN 'very dense curve' END,
 CASE WHEN n > 5000 AND n <= 10000 THEN 'dense curve' END, CASE WHEN n < 200 THEN 'sparse curve' END, 'fallback calibration') ELSE '' END AS warnings, direction FROM sc""",
)
def validate_curve(spark, sf_dir):
    v = validate.validate_curve(adapters.points_dirty(spark, sf_dir), min_points=20, fallback=True)
    return v.withColumn("warnings", F.array_join("warnings", "; "))


@query("filter_curves", _valid_sql() + " SELECT figure_id, curve_id, seq, time, survival FROM dirty JOIN sc USING (figure_id, curve_id) WHERE reason IS NULL AND score >= 70 AND n <= 2000")
def filter_curves(spark, sf_dir):
    return validate.filter_curves(adapters.points_dirty(spark, sf_dir), min_points=20)


@query("rejection_report", _valid_sql() + " SELECT coalesce(reason, 'valid') AS reason, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM sc GROUP BY 1")
def rejection_report(spark, sf_dir):
    return validate.rejection_report(adapters.points_dirty(spark, sf_dir), min_points=20)


@query(
    "validate_monotone",
    _D + f""", l AS (SELECT *, survival - lag(survival) OVER w AS ds FROM dirty WINDOW w AS ({_ORDER})) SELECT figure_id, curve_id, count(*) AS n, coalesce(bool_and(ds <= 0.08), true) AS monotone FROM l GROUP BY ALL""",
)
def validate_monotone(spark, sf_dir):
    return validate.validate_monotone(adapters.points_dirty(spark, sf_dir), 0.08)


@query(
    "outlier_fence",
    _P + """, q AS (SELECT figure_id, curve_id, quantile_cont(survival, 0.25) AS q1, quantile_cont(survival, 0.75) AS q3 FROM points GROUP BY ALL)
 SELECT points.* FROM points JOIN q USING (figure_id, curve_id) WHERE survival BETWEEN q1 - (q3 - q1) * 0.3 AND q3 + (q3 - q1) * 0.3""",
)
def outlier_fence(spark, sf_dir):
    return validate.outlier_fence(_p(spark, sf_dir), 0.3)


_PAIR = _GRID.replace("range(0, 31))::DOUBLE * 2.0", "range(0, 21))::DOUBLE * 3.0") + """, y AS (SELECT figure_id, curve_id, grid_time, survival AS s1 FROM sampled), z AS (SELECT figure_id, curve_id - 1 AS curve_id, grid_time, survival AS s2 FROM sampled WHERE curve_id > 0),
 both_ AS (SELECT * FROM y JOIN z USING (figure_id, curve_id, grid_time)),
 er AS (SELECT figure_id, curve_id, sqrt(avg((s1 - s2) * (s1 - s2))) AS rmse, avg(abs(s1 - s2)) AS mae, max(abs(s1 - s2)) AS max_error,
  min(CASE WHEN s1 <= 0.5 THEN grid_time END) - min(CASE WHEN s2 <= 0.5 THEN grid_time END) AS median_error FROM both_ GROUP BY ALL),
 ta AS (SELECT p.figure_id, p.curve_id, sum(sign((p.s1 - q.s1) * (p.s2 - q.s2)))::DOUBLE / count(*) AS tau FROM both_ p JOIN both_ q ON p.figure_id = q.figure_id AND p.curve_id = q.curve_id AND p.grid_time < q.grid_time GROUP BY ALL)"""


@query(
    "curve_agreement",
    _PAIR + " SELECT figure_id, curve_id, round(rmse + 1e-9, 6) AS rmse, round(mae + 1e-9, 6) AS mae, round(max_error + 1e-9, 6) AS max_error, median_error, round(tau + 1e-9, 6) AS tau FROM er JOIN ta USING (figure_id, curve_id)",
)
def curve_agreement(spark, sf_dir):
    a = _p(spark, sf_dir)
    b = a.filter("curve_id > 0").withColumn("curve_id", (F.col("curve_id") - 1).cast("int"))
    return _r(validate.curve_agreement(a, b, 60.0, n=21), "rmse", "mae", "max_error", "tau")


@query(
    "ks_distance",
    _P + """, u AS (SELECT figure_id, curve_id, survival, 1 AS a FROM points UNION ALL SELECT figure_id, curve_id - 1, survival, 0 FROM points WHERE curve_id > 0),
 t AS (SELECT figure_id, curve_id, survival, sum(a) AS na, sum(1 - a) AS nb FROM u GROUP BY ALL),
 g AS (SELECT figure_id, curve_id, abs(sum(na) OVER o / nullif(sum(na) OVER w, 0)::DOUBLE - sum(nb) OVER o / nullif(sum(nb) OVER w, 0)::DOUBLE) AS gap FROM t WINDOW w AS (PARTITION BY figure_id, curve_id),
  o AS (PARTITION BY figure_id, curve_id ORDER BY survival)) SELECT figure_id, curve_id, round(max(gap) + 1e-9, 6) AS ks FROM g GROUP BY ALL""",
)
def ks_distance(spark, sf_dir):
    a = _p(spark, sf_dir)
    b = a.filter("curve_id > 0").withColumn("curve_id", (F.col("curve_id") - 1).cast("int"))
    return _r(validate.ks_distance(a, b), "ks")


@query(
    "qc_best",
    _valid_sql() + " SELECT figure_id, curve_id, n, CASE WHEN reason IS NULL THEN score ELSE 0 END::INT AS quality_score FROM sc QUALIFY row_number() OVER (PARTITION BY figure_id ORDER BY CASE WHEN reason IS NULL THEN score ELSE 0 END DESC, curve_id) = 1",
)
def qc_best(spark, sf_dir):
    v = validate.validate_curve(adapters.points_dirty(spark, sf_dir), min_points=20, fallback=True)
    return validate.qc_best(v, ["figure_id"], "quality_score", "curve_id").select("figure_id", "curve_id", "n", "quality_score")


_AXIS = "WITH " + adapters.CALIBRATION + ", ax AS (SELECT *, (figure_id % 7) / 10.0 AS confidence, figure_id % 4 AS n_x, figure_id % 3 + 1 AS n_y, figure_id % 2 = 0 AS hough FROM calibration)"


def _axis(spark, sf_dir):
    f = F.col("figure_id")
    return adapters.calibration(spark, sf_dir).select("*", ((f % 7) / 10.0).alias("confidence"), (f % 4).alias("n_x"), (f % 3 + 1).alias("n_y"), (f % 2 == 0).alias("hough"))


@query(
    "validate_axis_text",
    _AXIS + ", r AS (SELECT figure_id, CASE WHEN n_x < 2 OR n_y < 2 THEN 'too few ticks' WHEN confidence < 0.5 THEN 'low confidence' WHEN y_hi > 1.5 THEN 'y out of range' END AS reason FROM ax) SELECT *, reason IS NULL AS ok FROM r",
)
def validate_axis_text(spark, sf_dir):
    return validate.validate_axis(_axis(spark, sf_dir), "text").select("figure_id", "reason", "ok")


@query("validate_axis_ocr", _AXIS + ", r AS (SELECT figure_id, CASE WHEN confidence < 0.3 THEN 'low confidence' END AS reason FROM ax) SELECT *, reason IS NULL AS ok FROM r")
def validate_axis_ocr(spark, sf_dir):
    return validate.validate_axis(_axis(spark, sf_dir), "ocr").select("figure_id", "reason", "ok")


@query("validate_axis_ocr2", _AXIS + ", r AS (SELECT figure_id, CASE WHEN confidence <= 0.2 AND NOT hough THEN 'low confidence' END AS reason FROM ax) SELECT *, reason IS NULL AS ok FROM r")
def validate_axis_ocr2(spark, sf_dir):
    return validate.validate_axis(_axis(spark, sf_dir), "ocr2").select("figure_id", "reason", "ok")
