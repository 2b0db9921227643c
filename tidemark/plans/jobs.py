"""Composite jobs: what users call by name, made of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import calibrate, cluster, shape, spatial, validate
from tidemark.operators.shared import written

KEYS = ["figure_id", "curve_id"]


def curves_from_pixels(pixels: DataFrame, k: int | None = None, light: float = 0.85, dotted: float = 0.5) -> DataFrame:
    """Solid curves by colour: pixels of one cluster are a curve, ordered by mean y; ``k`` is found if not given."""
    h, s, l = scalar.rgb_to_hsl(F.col("r"), F.col("g"), F.col("b"))  # noqa: E741
    rows = pixels.select("*", h.alias("h"), s.alias("s"), l.alias("l")).filter(scalar.is_curve_pixel(F.col("l"), light))
    rows = rows.withColumn("id", F.col("y") * 100_000 + F.col("x")).dropDuplicates(["figure_id", "id"])
    angle = F.radians("h")
    feats = rows.select("figure_id", "id", "x", "y", F.col("l").alias("f0"), (F.col("s") * F.cos(angle)).alias("f1"), (F.col("s") * F.sin(angle)).alias("f2"))
    std = cluster.standardize(feats, ["figure_id"])
    if k is None:
        every = written(cluster.kmeans_for(std, ["figure_id"], [1, 2, 3, 4, 5, 6], 5))
        grouped = every.join(cluster.choose_k(every, ["figure_id"]), ["figure_id", "k"], "left_semi").drop("k")
    else:
        grouped = cluster.kmeans_groups(std, ["figure_id"], k, 5)
    order = cluster.order_curves_by_height(grouped.withColumn("cluster", F.col("cluster")), ["figure_id", "cluster"]).select("figure_id", "cluster", (F.col("rank") - 1).alias("curve_id"))
    curves = grouped.join(order, ["figure_id", "cluster"]).select("figure_id", "curve_id", "x", "y")
    return cluster.filter_solid(curves, cluster.dotted_score(curves, KEYS), KEYS, dotted)


def curves_from_paths(paths: DataFrame, panels: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Paths flattened, clipped to a panel, made rectangular and numbered by style."""
    keys = ["figure_id", "path_id"]
    flat = spatial.flatten_path(paths, keys)
    inside = spatial.clip_to_panel(flat, panels, ["figure_id"])
    steps = shape.step_regularize(inside.select(*keys, F.col("idx").alias("seq"), F.col("px").alias("time"), F.col("py").alias("survival")), tolerance, keys)
    styled = steps.join(paths.select(*keys, scalar.style_key(F.col("stroke"), F.lit(None).cast("string"), F.lit(1.0)).alias("style_key")), keys)
    numbered = cluster.curve_numbering(styled, ["figure_id"], "style_key")
    return numbered.select("figure_id", "curve_id", "seq", F.col("time").alias("px"), F.col("survival").alias("py"))


def curves_from_dark_pixels(pixels: DataFrame, dpi: float, svg_dpi: float, xmin: float, ymin: float) -> DataFrame:
    """Dark pixels split by column into curves, in vector units."""
    dark = pixels.filter(scalar.is_dark(F.col("r"), F.col("g"), F.col("b")))
    return cluster.raster_to_vector_coords(cluster.raster_column_split(dark, ["figure_id"]), dpi, svg_dpi, xmin, ymin)


def vector_page_curves(paths: DataFrame, ticks: DataFrame, least: int = 20) -> DataFrame:
    """Events of each path: two-point axes, candidates, calibration, vertical drops."""
    keys = ["figure_id", "path_id"]
    axes = calibrate.fit_axis_two_point(ticks, ["figure_id", "axis"])
    x, y = (axes.filter(F.col("axis") == a).select("figure_id", F.col("slope").alias(f"m{a}"), F.col("intercept").alias(f"b{a}")) for a in "xy")
    pts = spatial.flatten_path(spatial.path_candidates(paths, keys, least), keys)
    rows = pts.join(x, "figure_id").join(y, "figure_id").select(
        "figure_id", F.col("path_id").alias("curve_id"), F.col("idx").alias("seq"), (F.col("mx") * F.col("px") + F.col("bx")).alias("time"), scalar.linear_survival(F.col("py"), F.col("my"), F.col("by")).alias("survival")
    )
    return shape.classify_segments(shape.dedupe_consecutive(shape.monotone_envelope(rows), 0.01))


def panels_from_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes that pass as panels, with their at-risk regions, best first on each page."""
    good = spatial.at_risk_region(spatial.panel_confidence(boxes))
    return good.withColumn("order", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "panel_id")))


def clean_validate_catalog(pixels: DataFrame, calibration: DataFrame, width: float, height: float) -> dict[str, DataFrame]:
    """Pixels to ``points``, a ``catalog`` of good curves and ``errors`` with reasons."""
    inside = pixels.filter(scalar.is_interior(F.col("x"), F.col("y"), F.lit(width), F.lit(height)))
    binned = shape.bin_points(inside, 3, "median").join(calibration, "figure_id")
    t = scalar.calibrate_time(F.col("x"), F.lit(width), F.col("x_lo"), F.col("x_hi"))
    s = scalar.calibrate_survival(F.col("y"), F.lit(height), F.col("y_lo"), F.col("y_hi"), bounded=False)
    s = scalar.normalize_percent(s, F.col("y_unit"))
    order = Window.partitionBy(*KEYS).orderBy("x")
    points = binned.select(*KEYS, (F.row_number().over(order) - 1).cast("int").alias("seq"), t.alias("time"), s.alias("survival"))
    clean = shape.isotonic_clean(points)
    verdict = validate.validate_curve(clean, min_points=0, fallback=True)
    good = verdict.filter(F.col("is_valid") & (F.col("quality_score") >= 70))
    kept = shape.decimate(clean.join(good.select(*KEYS), KEYS, "left_semi"), 500)
    catalog = kept.groupBy(*KEYS).agg(F.count("*").alias("n_points")).join(good.select(*KEYS, "quality_score", "direction"), KEYS)
    errors = verdict.join(good.select(*KEYS), KEYS, "left_anti").select(*KEYS, F.coalesce("reason", F.lit("low quality")).alias("reason"))
    return {"points": kept, "catalog": catalog, "errors": errors}


def sample_monthly_series(pixels: DataFrame, calibration: DataFrame, width: float, height: float) -> DataFrame:
    """Clipped calibration, then the median of each month."""
    rows = pixels.join(calibration, "figure_id")
    t = scalar.calibrate_time(F.col("x"), F.lit(width), F.col("x_lo"), F.col("x_hi"))
    s = scalar.calibrate_survival(F.col("y"), F.lit(height), F.col("y_lo"), F.col("y_hi"))
    return shape.bin_time(rows.select(*KEYS, t.alias("time"), s.alias("survival")))


def page_analysis(lines: DataFrame, words: DataFrame | None = None, paths: DataFrame | None = None, mode: str = "best", keep_insets: bool = False) -> dict[str, DataFrame]:
    """The tables of vector pages: ``axes`` and ``panels`` from ``lines`` alone.

    With ``words`` (``doc_id, word_id, text, left, top``) also ``chosen``, the
    panels with a fitted x and y axis, scored and picked by ``mode``, the numbers
    at risk ``nar`` under them and the ``legend`` outside of them; with ``paths``
    (``doc_id, path_id, d, stroke, dash, sw``) also their ``curves`` in time and
    survival, unmixed and labelled, and the censor ``ticks`` on them.
    """
    page, panel = ["doc_id"], ["doc_id", "panel_id"]
    axes = spatial.axis_lines(lines, page)
    panels = spatial.flag_insets(spatial.build_panels(axes, page, top=12), page)
    out = {"axes": axes, "panels": panels}
    if words is None:
        return out
    box = panels.select(*panel, "xmin", "xmax", "ymin", "ymax", "is_inset") if keep_insets else panels.filter("not is_inset").select(*panel, "xmin", "xmax", "ymin", "ymax", "is_inset")
    fits = _panel_axes(words, box)
    at_risk = cluster.extract_nar(words.withColumnRenamed("doc_id", "figure_id"), box.withColumnRenamed("doc_id", "figure_id")).withColumnRenamed("figure_id", "doc_id")
    hit = at_risk.select(*panel).distinct().withColumn("nar_hit", F.lit(True))
    calibrated = box.join(fits, panel).join(hit, panel, "left").fillna(False, ["nar_hit"])
    chosen = written(spatial.choose_panels(spatial.score_panels(calibrated, page), page, mode))
    style = scalar.style_key(F.col("stroke"), F.col("dash"), F.col("sw"))
    labels = words.filter(F.col("text").try_cast("double").isNull()).select("doc_id", F.col("text").alias("label"), F.col("left").alias("tx"), F.col("top").alias("ty"))
    legend = spatial.nearest_label(lines.withColumn("style_key", style), labels, page, panels=chosen)
    out |= {"chosen": chosen, "nar": at_risk.join(chosen.select(*panel), panel, "left_semi"), "legend": legend}
    if paths is None:
        return out
    styled = paths.select("doc_id", "path_id", style.alias("style_key"))
    inside = spatial.clip_to_panel(spatial.flatten_path(paths, ["doc_id", "path_id"]), chosen, page)
    steps = shape.step_regularize(inside.select(*panel, "path_id", F.col("idx").alias("seq"), F.col("px").alias("time"), F.col("py").alias("survival")), 0.5, [*panel, "path_id"])
    points = steps.join(styled, ["doc_id", "path_id"]).select(*panel, "style_key", "path_id", "seq", F.col("time").alias("x"), F.col("survival").alias("y"))
    unmixed = cluster.unmix_overlaps(written(points), [*panel, "style_key"])
    numbered = unmixed.withColumn("curve_id", F.dense_rank().over(Window.partitionBy(*panel).orderBy("style_key", "label"))).drop("label", "bin", "k")
    mapped = numbered.join(chosen.select(*panel, "x_slope", "x_intercept", "y_slope", "y_intercept"), panel).select(
        *panel, "curve_id", "style_key", "path_id", "seq", F.col("x").alias("px"), F.col("y").alias("py"), (F.col("x_slope") * F.col("x") + F.col("x_intercept")).alias("time"),
        scalar.loose_survival(F.col("y_slope") * F.col("y") + F.col("y_intercept")).alias("survival"),
    )
    curves = written(spatial.attach_legend(mapped, legend, page))
    ticks = spatial.assign_censor_ticks(lines, curves.select(*panel, "curve_id", "px", "py"), page, panels=chosen)
    return out | {"curves": curves, "ticks": ticks}


def _panel_axes(words: DataFrame, panels: DataFrame, below: float = 20.0, beside: float = 60.0) -> DataFrame:
    """Panels whose numbers below and to the left fit an axis each: slopes, intercepts and ``y_max``, the largest number on y."""
    panel = ["doc_id", "panel_id"]
    numbers = words.withColumn("value", F.col("text").try_cast("double")).filter("value is not null").select("doc_id", "left", "top", "value")
    zone = lambda x1, x2, y1, y2: panels.select(*panel, *[e.alias(c) for c, e in zip(spatial.BOX, (x1, x2, y1, y2))])
    xmin, xmax, ymin, ymax = (F.col(c) for c in spatial.BOX)
    x = spatial.in_boxes(numbers, zone(xmin - 5, xmax + 5, ymax, ymax + below), ["doc_id"], "left", "top").select(*panel, F.col("left").alias("pos"), "value")
    y = spatial.in_boxes(numbers, zone(xmin - beside, xmin, ymin - 5, ymax + 5), ["doc_id"], "left", "top").select(*panel, F.col("top").alias("pos"), "value")
    fit = lambda ticks, a: calibrate.fit_axis_linear(ticks, panel).filter("slope is not null").select(*panel, F.col("slope").alias(f"{a}_slope"), F.col("intercept").alias(f"{a}_intercept"))
    return fit(x, "x").join(fit(y, "y"), panel).join(y.groupBy(*panel).agg(F.max("value").alias("y_max")), panel)


def axis_text_success(pages: DataFrame) -> DataFrame:
    """Share of pages whose texts give two numbers or more on both axes."""
    ok = (F.size(scalar.extract_numbers(F.col("x_text"), "x", 200.0)) >= 2) & (F.size(scalar.extract_numbers(F.col("y_text"), "y")) >= 2)
    return pages.agg(F.count("*").alias("pages"), F.count_if(ok).alias("success"), (F.count_if(ok) / F.count("*")).alias("rate"))
