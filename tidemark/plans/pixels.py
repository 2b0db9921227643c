"""Registered queries over pixels, colours and positioned words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import cluster, validate
from tidemark.operators.shared import written
from tidemark.plans import adapters
from tidemark.registry import query

_X = "WITH " + adapters.PIXELS
_HSL = _X + """, n AS (SELECT *, r / 255.0::DOUBLE AS rf, g / 255.0::DOUBLE AS gf, b / 255.0::DOUBLE AS bf FROM pixels),
 m AS (SELECT *, greatest(rf, gf, bf) AS hi, least(rf, gf, bf) AS lo FROM n),
 hsl AS (SELECT figure_id, x, y, r, g, b, (CASE WHEN hi = lo THEN 0.0 WHEN bf = hi THEN (rf - gf) / (hi - lo) + 4.0 WHEN gf = hi THEN (bf - rf) / (hi - lo) + 2.0
  ELSE (gf - bf) / (hi - lo) + CASE WHEN gf < bf THEN 6.0 ELSE 0.0 END END) * 60.0 AS h,
  CASE WHEN hi = lo THEN 0.0 WHEN (hi + lo) / 2.0 < 0.5 THEN (hi - lo) / (hi + lo) ELSE (hi - lo) / (2.0 - hi - lo) END AS s, (hi + lo) / 2.0 AS l FROM m)"""


def _hsl(spark, sf_dir):
    p = adapters.pixels(spark, sf_dir)
    h, s, l = scalar.rgb_to_hsl(F.col("r"), F.col("g"), F.col("b"))  # noqa: E741
    return p.select("*", h.alias("h"), s.alias("s"), l.alias("l"))


@query("rgb_to_hsl", _HSL + " SELECT DISTINCT r, g, b, round(h, 6) AS h, round(s, 6) AS s, round(l, 6) AS l FROM hsl")
def rgb_to_hsl(spark, sf_dir):
    return _hsl(spark, sf_dir).select("r", "g", "b", *[F.round(c, 6).alias(c) for c in "hsl"]).distinct()


@query(
    "color_name",
    _HSL + """ SELECT figure_id, CASE WHEN l < 0.2 THEN 'black' WHEN l > 0.9 THEN 'white' WHEN s < 0.1 THEN 'gray' WHEN h < 15 THEN 'red' WHEN h < 45 THEN 'orange' WHEN h < 75 THEN 'yellow'
 WHEN h < 165 THEN 'green' WHEN h < 255 THEN 'blue' WHEN h < 285 THEN 'purple' WHEN h < 345 THEN 'pink' ELSE 'red' END AS name, count(*) AS n FROM hsl GROUP BY ALL""",
)
def color_name(spark, sf_dir):
    return _hsl(spark, sf_dir).groupBy("figure_id", scalar.color_name(F.col("h"), F.col("s"), F.col("l")).alias("name")).agg(F.count("*").alias("n"))


@query("curve_pixels", _HSL + " SELECT figure_id, count(*) AS n, count(*) FILTER (x >= 30 AND x < 610 AND y >= 30 AND y < 450) AS interior, count(*) FILTER ((r + g + b) / 3.0 / 255.0 < 0.5) AS dark FROM hsl WHERE l > 0.1 AND l < 0.85 GROUP BY ALL")
def curve_pixels(spark, sf_dir):
    rows = _hsl(spark, sf_dir).filter(scalar.is_curve_pixel(F.col("l")))
    inside, dark = scalar.is_interior(F.col("x"), F.col("y"), 640, 480), scalar.is_dark(F.col("r"), F.col("g"), F.col("b"))
    return rows.groupBy("figure_id").agg(F.count("*").alias("n"), F.count_if(inside).alias("interior"), F.count_if(dark).alias("dark"))


@query(
    "dominant_color",
    _X + """, t AS (SELECT *, row_number() OVER (PARTITION BY figure_id ORDER BY y, x, r, g, b) AS k FROM pixels),
 d AS (SELECT figure_id, median(r) AS r, median(g) AS g, median(b) AS b, avg(r) AS mr FROM t WHERE k <= 1000 GROUP BY ALL)
 SELECT figure_id, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b, round(mr, 4) AS mean_r, '#' || printf('%02x', floor(r)::INT) || printf('%02x', floor(g)::INT) || printf('%02x', floor(b)::INT) AS hex FROM d""",
)
def dominant_color(spark, sf_dir):
    d = cluster.dominant_color(adapters.pixels(spark, sf_dir), ["figure_id"])
    return d.select("figure_id", *[F.col(c).cast("double").alias(c) for c in "rgb"], F.round("mean_r", 4).alias("mean_r"), "hex")


@query(
    "dotted_density",
    _X + """, d AS (SELECT figure_id, g % 4 AS grp, count(*)::DOUBLE / greatest(max(x) - min(x), 1) AS per_x FROM pixels GROUP BY ALL)
 SELECT figure_id, grp, round(per_x, 6) AS per_x, (CASE WHEN per_x < 3 THEN 0.9 WHEN per_x < 8 THEN 0.6 WHEN per_x < 15 THEN 0.3 ELSE 0.1 END)::DOUBLE AS density FROM d""",
)
def dotted_density(spark, sf_dir):
    return cluster.dotted_density(_groups(spark, sf_dir), ["figure_id", "grp"]).withColumn("per_x", F.round("per_x", 6))


def _groups(spark, sf_dir):
    return adapters.pixels(spark, sf_dir).withColumn("grp", F.col("g") % 4)


@query(
    "dotted_horizontal",
    _X + """, d AS (SELECT figure_id, g % 4 AS grp, (max(y) - min(y))::DOUBLE / greatest(max(x) - min(x), 1) AS ratio, stddev_pop(y) AS y_std FROM pixels GROUP BY ALL)
 SELECT figure_id, grp, round(ratio, 6) AS ratio, round(y_std, 6) AS y_std, (CASE WHEN ratio < 0.01 THEN 0.9 WHEN ratio < 0.05 THEN 0.6 WHEN ratio < 0.1 THEN 0.3 ELSE 0.0 END)::DOUBLE AS horizontal FROM d""",
)
def dotted_horizontal(spark, sf_dir):
    d = cluster.dotted_horizontal(_groups(spark, sf_dir), ["figure_id", "grp"])
    return d.withColumn("ratio", F.round("ratio", 6)).withColumn("y_std", F.round("y_std", 6))


@query(
    "dotted_periodicity",
    _X + """, h AS (SELECT figure_id, g % 4 AS grp, x, count(*) AS c FROM pixels GROUP BY ALL),
 sp AS (SELECT figure_id, grp, min(x) AS x0, max(x) - min(x) + 1 AS n, sum(c) AS dc FROM h GROUP BY ALL),
 f AS (SELECT *, unnest(range(greatest(1, ceil(n / 30.0)::INT), greatest(1, floor(n / 5.0)::INT) + 1)) AS k FROM sp),
 p AS (SELECT figure_id, grp, k, dc, sum(c * cos(2 * pi() * k * (x - x0) / n)) AS re, sum(c * sin(2 * pi() * k * (x - x0) / n)) AS im FROM h JOIN f USING (figure_id, grp) GROUP BY ALL),
 q AS (SELECT figure_id, grp, max((re * re + im * im) / (dc * dc)) AS power FROM p GROUP BY ALL)
 SELECT figure_id, grp, round(power, 6) AS power, (CASE WHEN power > 0.3 THEN 0.8 WHEN power > 0.15 THEN 0.5 WHEN power > 0.05 THEN 0.2 ELSE 0.0 END)::DOUBLE AS periodicity FROM q""",
)
def dotted_periodicity(spark, sf_dir):
    return cluster.dotted_periodicity(_groups(spark, sf_dir), ["figure_id", "grp"]).withColumn("power", F.round("power", 6))


@query("dotted_score")
def dotted_score(spark, sf_dir):
    s = cluster.dotted_score(_groups(spark, sf_dir), ["figure_id", "grp"])
    return s.select("figure_id", "grp", "n", F.round("score", 6).alias("score"), "is_dotted")


@query(
    "raster_column_split",
    _X + """, d AS (SELECT DISTINCT figure_id, x, y FROM pixels WHERE (r + g + b) / 3.0 / 255.0 < 0.5),
 n AS (SELECT *, coalesce((y - lag(y) OVER w > 5)::INT, 1) AS new_ FROM d WINDOW w AS (PARTITION BY figure_id, x ORDER BY y)),
 r AS (SELECT *, sum(new_) OVER (PARTITION BY figure_id, x ORDER BY y ROWS UNBOUNDED PRECEDING) AS curve_id FROM n),
 a AS (SELECT figure_id, curve_id, x, avg(y) AS y FROM r GROUP BY ALL)
 SELECT figure_id, curve_id::BIGINT AS curve_id, x, round(y, 6) AS y FROM a QUALIFY count(*) OVER (PARTITION BY figure_id, curve_id) >= 10""",
)
def raster_column_split(spark, sf_dir):
    dark = adapters.pixels(spark, sf_dir).filter(scalar.is_dark(F.col("r"), F.col("g"), F.col("b")))
    return cluster.raster_column_split(dark, ["figure_id"]).withColumn("y", F.round("y", 6))


@query("raster_to_vector_coords", _X + " SELECT figure_id, x, y, 10.0 + x / (300.0::DOUBLE / 144.0) AS svg_x, 20.0 + y / (300.0::DOUBLE / 144.0) AS svg_y FROM pixels")
def raster_to_vector_coords(spark, sf_dir):
    return cluster.raster_to_vector_coords(adapters.pixels(spark, sf_dir).select("figure_id", "x", "y"), 300.0, 144.0, 10.0, 20.0)


@query(
    "unmix_overlaps",
    _X.replace("WITH", "WITH RECURSIVE", 1) + """, d AS (SELECT DISTINCT figure_id, x, y FROM pixels), b AS (SELECT *, greatest(1, ceil((x - min(x) OVER (PARTITION BY figure_id)) / 30.0))::BIGINT AS bin FROM d),
 sd AS (SELECT figure_id, bin, len(list_reduce(list([y::DOUBLE] ORDER BY x, y), lambda a, v: CASE WHEN len(a) >= 4 OR len(list_filter(a, lambda s: abs(s - v[1]) <= 1.5)) > 0 THEN a ELSE list_concat(a, v) END)) AS n FROM b GROUP BY ALL),
 k AS (SELECT figure_id, max(n)::INT AS k FROM sd GROUP BY ALL),
 c AS (SELECT b.*, k, ((row_number() OVER (PARTITION BY figure_id, bin ORDER BY y, x) - 1) % k + 1)::INT AS cls FROM b JOIN k USING (figure_id)),
 ce AS (SELECT figure_id, bin, cls, sum(y)::DOUBLE AS s, count(*)::BIGINT AS n FROM c GROUP BY ALL),
 o AS (SELECT figure_id, bin, row_number() OVER (PARTITION BY figure_id ORDER BY bin) AS i, cs FROM (SELECT figure_id, bin, list({'c': cls, 's': s, 'n': n} ORDER BY cls) AS cs FROM ce GROUP BY ALL)),
 r AS (SELECT figure_id, bin, i, list_transform(cs, lambda e: {'c': e.c, 'label': e.c}) AS m, cs AS prev FROM o WHERE i = 1
  UNION ALL SELECT figure_id, bin, i, list_transform(m, lambda e: {'c': e.c, 'label': e.label}) AS m,
   list_transform(list_sort(list_distinct(list_transform(m, lambda e: e.label))), lambda l: {'c': l, 's': list_sum(list_transform(list_filter(m, lambda e: e.label = l), lambda e: e.s)), 'n': list_sum(list_transform(list_filter(m, lambda e: e.label = l), lambda e: e.n))::BIGINT}) AS prev
   FROM (SELECT o.figure_id, o.bin, o.i, list_transform(o.cs, lambda e: {'c': e.c, 'label': list_sort(list_transform(r.prev, lambda q: {'d': abs(e.s / e.n - q.s / q.n), 'c': q.c}))[1].c, 's': e.s, 'n': e.n}) AS m FROM r JOIN o ON o.figure_id = r.figure_id AND o.i = r.i + 1)),
 l AS (SELECT figure_id, bin, unnest(m) AS u FROM r)
 SELECT figure_id, bin, x, y, k, u.label AS label FROM c JOIN l USING (figure_id, bin) WHERE u.c = cls""",
)
def unmix_overlaps(spark, sf_dir):
    return cluster.unmix_overlaps(adapters.pixels(spark, sf_dir).select("figure_id", "x", "y").distinct(), ["figure_id"])


@query("order_curves_by_height", _X + ", m AS (SELECT figure_id, g % 4 AS grp, avg(y) AS mean_y FROM pixels GROUP BY ALL) SELECT figure_id, grp, round(mean_y, 6) AS mean_y, row_number() OVER (PARTITION BY figure_id ORDER BY mean_y, grp)::INT AS rank FROM m")
def order_curves_by_height(spark, sf_dir):
    return cluster.order_curves_by_height(_groups(spark, sf_dir), ["figure_id", "grp"]).withColumn("mean_y", F.round("mean_y", 6))


@query(
    "filter_candidates",
    "WITH " + adapters.RASTER + """, l AS (SELECT figure_id, curve_id, x, y, x - lag(x) OVER w AS dx, abs(y - lag(y) OVER w) AS dy FROM raster WINDOW w AS (PARTITION BY figure_id, curve_id ORDER BY x, y)),
 s AS (SELECT figure_id, curve_id, count(*) AS n, max(x) - min(x) AS w, max(y) - min(y) AS h, max(dx) AS gap, avg(dy) AS dy FROM l GROUP BY ALL),
 q AS (SELECT * FROM s WHERE n >= 100 AND w::DOUBLE / greatest(h, 1) >= 1.5 AND w >= 0.3 * 640 AND gap <= 100 AND dy <= 10)
 SELECT figure_id, curve_id, n, w, h, gap, row_number() OVER (PARTITION BY figure_id ORDER BY n DESC, curve_id)::INT AS rank FROM q QUALIFY rank <= 3""",
)
def filter_candidates(spark, sf_dir):
    found = cluster.filter_candidates(adapters.raster(spark, sf_dir), 640.0, 3)
    return found.select("figure_id", "curve_id", "n", "w", "h", "gap", "rank")


def _vectors(spark, sf_dir):
    v = adapters.table(spark, sf_dir, "embeddings")
    f = v.select((F.col("label") % 4).alias("figure_id"), F.col("vec_id").alias("id"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(3)])
    return cluster.standardize(f, ["figure_id"])


@query(
    "standardize_features",
    """WITH f AS (SELECT label % 4 AS figure_id, vec_id AS id, embedding[1]::DOUBLE AS f0, embedding[2]::DOUBLE AS f1, embedding[3]::DOUBLE AS f2 FROM embeddings)
 SELECT figure_id, id, round((f0 - avg(f0) OVER w) / stddev_pop(f0) OVER w, 6) AS f0, round((f1 - avg(f1) OVER w) / stddev_pop(f1) OVER w, 6) AS f1,
 round((f2 - avg(f2) OVER w) / stddev_pop(f2) OVER w, 6) AS f2 FROM f WINDOW w AS (PARTITION BY figure_id)""",
)
def standardize_features(spark, sf_dir):
    return _vectors(spark, sf_dir).select("figure_id", "id", *[F.round(f"f{i}", 6).alias(f"f{i}") for i in range(3)])


@query("kmeans_colors")
def kmeans_colors(spark, sf_dir):
    c = cluster.kmeans_groups(_vectors(spark, sf_dir), ["figure_id"], 3)
    return c.groupBy("figure_id", "cluster").agg(F.count("*").alias("n"), F.round(F.sum("d2"), 4).alias("inertia"))


@query("auto_k")
def auto_k(spark, sf_dir):
    """All three methods over one clustering for k from 1 to 4."""
    groups = written(cluster.kmeans_for(_vectors(spark, sf_dir), ["figure_id"], [1, 2, 3, 4], 3))
    found = [cluster.choose_k(groups, ["figure_id"], m).withColumn("method", F.lit(m)) for m in ("silhouette", "elbow", "combined")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "silhouette",
    """WITH f AS (SELECT label % 4 AS figure_id, vec_id AS id, embedding[1]::DOUBLE AS f0, embedding[2]::DOUBLE AS f1, embedding[3]::DOUBLE AS f2, vec_id % 3 AS cluster FROM embeddings),
 d AS (SELECT a.figure_id, a.id, a.cluster, b.cluster AS other, sum((a.f0 - b.f0) ** 2 + (a.f1 - b.f1) ** 2 + (a.f2 - b.f2) ** 2) AS s, count(*) AS n
  FROM f a JOIN f b ON a.figure_id = b.figure_id GROUP BY ALL),
 r AS (SELECT figure_id, id, max(CASE WHEN cluster = other THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN cluster <> other THEN s / n END) AS b FROM d GROUP BY ALL)
 SELECT figure_id, round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM r GROUP BY ALL""",
)
def silhouette(spark, sf_dir):
    """From moments; the twin takes every pair."""
    v = adapters.table(spark, sf_dir, "embeddings")
    rows = v.select((F.col("label") % 4).alias("figure_id"), (F.col("vec_id") % 3).alias("cluster"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(3)])
    return cluster.silhouette(rows, ["figure_id"]).withColumn("silhouette", F.round("silhouette", 6))


@query("cluster_confidence")
def cluster_confidence(spark, sf_dir):
    c = cluster.cluster_confidence(cluster.kmeans_groups(_vectors(spark, sf_dir), ["figure_id"], 3), ["figure_id"])
    return c.withColumn("confidence", F.round("confidence", 6))


@query(
    "cluster_confidence_given",
    """WITH f AS (SELECT label % 4 AS figure_id, vec_id % 3 AS cluster, embedding[1]::DOUBLE AS f0, embedding[2]::DOUBLE AS f1, embedding[3]::DOUBLE AS f2 FROM embeddings),
 c AS (SELECT figure_id, cluster, count(*) AS n, avg(f0) AS c0, avg(f1) AS c1, avg(f2) AS c2 FROM f GROUP BY ALL),
 s AS (SELECT figure_id, cluster, avg(sqrt((f0 - c0) ** 2 + (f1 - c1) ** 2 + (f2 - c2) ** 2)) AS spread FROM f JOIN c USING (figure_id, cluster) GROUP BY ALL),
 g AS (SELECT a.figure_id, a.cluster, min(sqrt((a.c0 - b.c0) ** 2 + (a.c1 - b.c1) ** 2 + (a.c2 - b.c2) ** 2)) AS gap FROM c a JOIN c b ON a.figure_id = b.figure_id AND a.cluster <> b.cluster GROUP BY ALL)
 SELECT figure_id, cluster, n, round(0.4 * least(1.0, n::DOUBLE / sum(n) OVER (PARTITION BY figure_id) * count(*) OVER (PARTITION BY figure_id)) + 0.4 * least(1.0, coalesce(gap, 1.0)) + 0.2 / (1.0 + spread), 6) AS confidence
 FROM c JOIN s USING (figure_id, cluster) LEFT JOIN g USING (figure_id, cluster)""",
)
def cluster_confidence_given(spark, sf_dir):
    """Confidence of clusters that are given, so that the twin knows them."""
    v = adapters.table(spark, sf_dir, "embeddings")
    rows = v.select((F.col("label") % 4).alias("figure_id"), (F.col("vec_id") % 3).alias("cluster"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(3)])
    centres = rows.groupBy("figure_id", "cluster").agg(*[F.avg(f"f{i}").alias(f"c{i}") for i in range(3)])
    d2 = sum(((F.col(f"f{i}") - F.col(f"c{i}")) * (F.col(f"f{i}") - F.col(f"c{i}")) for i in range(3)), F.lit(0.0))
    given = rows.join(centres, ["figure_id", "cluster"]).withColumn("d2", d2).drop("c0", "c1", "c2")
    return cluster.cluster_confidence(given, ["figure_id"]).withColumn("confidence", F.round("confidence", 6))


def _clustered_pixels(spark, sf_dir):
    p = adapters.pixels(spark, sf_dir).groupBy("figure_id", "x", "y").agg(F.min("g").alias("g"))
    return p.select("figure_id", (F.col("y") * 640 + F.col("x")).alias("id"), "x", "y", (F.col("g") % 3).alias("cluster"))


@query(
    "knn_coherence",
    _X + """, p AS (SELECT figure_id, x, y, min(g) % 3 AS cluster, y * 640 + x AS id FROM pixels GROUP BY figure_id, x, y),
 d AS (SELECT a.figure_id, a.id, b.id AS other, a.cluster = b.cluster AS same, sqrt(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE) AS d FROM p a JOIN p b ON a.figure_id = b.figure_id AND a.id <> b.id),
 r AS (SELECT *, row_number() OVER (PARTITION BY figure_id, id ORDER BY d, other) AS k FROM d)
 SELECT figure_id, id, round(sum(CASE WHEN same THEN 1.0 ELSE -1.0 END / greatest(d, 0.1) ** 2) / 5 + 1e-9, 5) AS coherence FROM r WHERE k <= 5 GROUP BY ALL""",
)
def knn_coherence(spark, sf_dir):
    c = cluster.knn_coherence(_clustered_pixels(spark, sf_dir), ["figure_id"], k=5)
    return c.withColumn("coherence", F.round(F.col("coherence") + 1e-9, 5))


@query(
    "envelope_by_coherence",
    _X + """, w AS (SELECT figure_id, g % 4 AS grp, x, y, b AS coherence FROM pixels QUALIFY count(*) OVER (PARTITION BY figure_id, g % 4) >= 10),
 m AS (SELECT figure_id, grp, x, arg_max(y, coherence * 10000 - y) AS y FROM w GROUP BY ALL), s AS (SELECT figure_id, grp, min(x) AS lo, max(x) AS hi FROM m GROUP BY ALL),
 g AS (SELECT figure_id, grp, unnest(range(lo, hi + 1))::INT AS x FROM s),
 f AS (SELECT figure_id, grp, x, last_value(y IGNORE NULLS) OVER (PARTITION BY figure_id, grp ORDER BY x ROWS UNBOUNDED PRECEDING) AS y FROM g LEFT JOIN m USING (figure_id, grp, x))
 SELECT figure_id, grp, x, max(y) OVER (PARTITION BY figure_id, grp ORDER BY x ROWS UNBOUNDED PRECEDING) AS y FROM f""",
)
def envelope_by_coherence(spark, sf_dir):
    return cluster.envelope_by_coherence(_groups(spark, sf_dir).withColumn("coherence", F.col("b")), ["figure_id", "grp"]).select("figure_id", "grp", "x", "y")


# ------------------------------------------------------------ positioned words

_WORDS = "WITH " + adapters.IPD + """, gr AS (SELECT study_id, arm, unnest([0.0, 12.0, 24.0, 36.0, 48.0]) AS t FROM (SELECT DISTINCT study_id, arm FROM ipd)),
 nr AS (SELECT g.study_id, g.arm, g.t, count(i.time) AS n FROM gr g LEFT JOIN ipd i ON i.study_id = g.study_id AND i.arm = g.arm AND i.time >= g.t GROUP BY ALL),
 cells AS (SELECT dense_rank() OVER (ORDER BY study_id) - 1 AS figure_id, ascii(arm) % 3 AS grp, (t / 12)::INT AS col, n FROM nr),
 words AS (SELECT figure_id::INT AS figure_id, (grp * 10 + col + 100)::BIGINT AS word_id, n::VARCHAR AS text, 100.0 + 40 * col AS left_, 500.0 + 20 * grp + col AS top, 60 + (n % 40)::INT AS conf FROM cells
  UNION ALL SELECT DISTINCT figure_id::INT, (grp + 50)::BIGINT, 'Group' || grp::VARCHAR, 20.0, 500.0 + 20 * grp, -1 FROM cells
  UNION ALL SELECT DISTINCT figure_id::INT, (col + 10)::BIGINT, (col * 12)::VARCHAR, 100.0 + 40 * col, 600.0, 90 FROM cells
  UNION ALL SELECT DISTINCT figure_id::INT, 1::BIGINT, 'Number at risk', 20.0, 480.0, 95 FROM cells)"""


def words(spark, sf_dir):
    from tidemark.operators import survival

    n = survival.at_risk_table(adapters.ipd(spark, sf_dir), ["study_id", "arm"], [0.0, 12.0, 24.0, 36.0, 48.0])
    studies = n.select("study_id").distinct().select("study_id", (F.row_number().over(Window.orderBy("study_id")) - 1).cast("int").alias("figure_id"))
    cells = n.join(studies, "study_id").select("figure_id", (F.ascii("arm") % 3).alias("grp"), (F.col("grid_time") / 12).cast("int").alias("col"), F.col("n_risk").alias("n"))

    def word(df, word_id, text, left, top, conf):
        return df.select("figure_id", word_id.cast("long").alias("word_id"), text.alias("text"), left.cast("double").alias("left"), top.cast("double").alias("top"), conf.cast("int").alias("conf"))

    g, c = F.col("grp"), F.col("col")
    return (
        word(cells, g * 10 + c + 100, F.col("n").cast("string"), F.lit(100) + 40 * c, F.lit(500) + 20 * g + c, 60 + F.col("n") % 40)
        .union(word(cells.select("figure_id", "grp").distinct(), g + 50, F.concat(F.lit("Group"), g.cast("string")), F.lit(20), F.lit(500) + 20 * g, F.lit(-1)))
        .union(word(cells.select("figure_id", "col").distinct(), c + 10, (c * 12).cast("string"), F.lit(100) + 40 * c, F.lit(600), F.lit(90)))
        .union(word(cells.select("figure_id").distinct(), F.lit(1), F.lit("Number at risk"), F.lit(20), F.lit(480), F.lit(95)))
    )


@query(
    "cluster_rows_gap",
    _WORDS + ", g AS (SELECT *, coalesce((top - lag(top) OVER w > 10)::INT, 0) AS n FROM words WINDOW w AS (PARTITION BY figure_id ORDER BY top)) SELECT figure_id, word_id, sum(n) OVER (PARTITION BY figure_id ORDER BY top)::INT AS row_id FROM g",
)
def cluster_rows_gap(spark, sf_dir):
    return cluster.cluster_rows_gap(words(spark, sf_dir), ["figure_id"]).select("figure_id", "word_id", "row_id")


@query("cluster_rows_anchor", _WORDS + ", g AS (SELECT *, floor((top - 480) / 20) AS k FROM words) SELECT figure_id, word_id, (dense_rank() OVER (PARTITION BY figure_id ORDER BY k) - 1)::INT AS row_id FROM g")
def cluster_rows_anchor(spark, sf_dir):
    return cluster.cluster_rows_anchor(words(spark, sf_dir), ["figure_id"]).select("figure_id", "word_id", "row_id")


_NAR = _WORDS + """, confs AS (SELECT figure_id, floor((top - 500) / 20) AS grp, avg(CASE WHEN conf <> -1 THEN conf / 100.0 END) AS confidence FROM words WHERE top >= 500 AND top < 600 GROUP BY ALL),
 nar AS (SELECT c.figure_id::INT AS figure_id, (dense_rank() OVER (PARTITION BY c.figure_id ORDER BY c.grp) - 1)::INT AS group_id, 'Group' || c.grp::VARCHAR AS label, c.col, c.col * 12.0::DOUBLE AS time, c.n::INT AS n_risk, confidence
  FROM cells c JOIN confs f ON f.figure_id = c.figure_id AND f.grp = c.grp)"""


@query("parse_at_risk", _NAR + " SELECT figure_id, group_id, label, col, time, n_risk, round(confidence, 6) AS confidence FROM nar")
def parse_at_risk(spark, sf_dir):
    return cluster.parse_at_risk(words(spark, sf_dir), ["figure_id"]).withColumn("confidence", F.round("confidence", 6))


@query("validate_at_risk", _NAR + ", g AS (SELECT figure_id, count(DISTINCT group_id) AS k FROM nar GROUP BY ALL) SELECT figure_id, k = 3 AS is_valid, CASE WHEN k <> 3 THEN 'unexpected number of groups' END AS reason FROM g")
def validate_at_risk(spark, sf_dir):
    return validate.validate_at_risk(cluster.parse_at_risk(words(spark, sf_dir), ["figure_id"]), ["figure_id"], 3)


@query("monotone_repair", _NAR + ", e AS (SELECT figure_id, group_id, col, n_risk + CASE WHEN col = 2 THEN 500 ELSE 0 END AS n FROM nar) SELECT figure_id, group_id, col, min(n) OVER w AS n_risk, min(n) OVER w <> n AS edited FROM e WINDOW w AS (PARTITION BY figure_id, group_id ORDER BY col ROWS UNBOUNDED PRECEDING)")
def monotone_repair(spark, sf_dir):
    t = cluster.parse_at_risk(words(spark, sf_dir), ["figure_id"]).withColumn("n_risk", F.col("n_risk") + F.when(F.col("col") == 2, 500).otherwise(0))
    return validate.monotone_repair(t, ["figure_id", "group_id"]).select("figure_id", "group_id", "col", "n_risk", "edited")


@query(
    "extract_nar",
    _WORDS + """, i AS (SELECT * FROM words WHERE left_ >= 50 AND left_ <= 400 AND top > 495 AND top <= 535 AND text NOT LIKE 'G%' AND text NOT LIKE 'N%'),
 g AS (SELECT *, coalesce((top - lag(top) OVER w > 3)::INT, 0) AS nw FROM i WINDOW w AS (PARTITION BY figure_id ORDER BY top)),
 y AS (SELECT *, sum(nw) OVER (PARTITION BY figure_id ORDER BY top)::INT AS y_grp FROM g)
 SELECT figure_id, 0 AS panel_id, y_grp, (row_number() OVER (PARTITION BY figure_id, y_grp ORDER BY left_, word_id) - 1)::INT AS col, text::DOUBLE AS num FROM y""",
)
def extract_nar(spark, sf_dir):
    w = words(spark, sf_dir)
    panels = w.select("figure_id").distinct().select("figure_id", F.lit(0).alias("panel_id"), F.lit(50.0).alias("xmin"), F.lit(400.0).alias("xmax"), F.lit(495.0).alias("ymax"))
    return cluster.extract_nar(w, panels)
