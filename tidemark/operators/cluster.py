"""Pixels and words: colour groups, dotted lines, rows of a table."""

from __future__ import annotations

from math import ceil, log2, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators.shared import written
from tidemark.operators.spatial import in_boxes

# ------------------------------------------------------------ rows of words


def cluster_rows_gap(words: DataFrame, keys: list[str], column: str = "top", gap: float = 10.0) -> DataFrame:
    """``row_id``: a new row wherever the next word lies more than ``gap`` below."""
    w = Window.partitionBy(*keys).orderBy(column)
    new = F.coalesce((F.col(column) - F.lag(column).over(w) > gap).cast("int"), F.lit(0))
    return words.withColumn("__new", new).withColumn("row_id", F.sum("__new").over(w).cast("int")).drop("__new")


def cluster_rows_anchor(words: DataFrame, keys: list[str], reach: float = 10.0) -> DataFrame:
    """``row_id``: a word joins a row if it lies within ``reach`` of the row's first word."""
    row = F.struct("top", "left", "word_id")
    page = words.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("__w"))
    placed = F.aggregate(
        "__w",
        F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("row"), F.array().cast("array<struct<word_id:bigint,row_id:int>>").alias("out")),
        lambda a, x: F.element_at(
            F.transform(
                F.array(a["anchor"].isNull() | (x["top"] - a["anchor"] > reach)),
                lambda new: F.struct(
                    F.when(new, x["top"]).otherwise(a["anchor"]).alias("anchor"),
                    F.when(new, a["row"] + 1).otherwise(a["row"]).alias("row"),
                    F.array_append(a["out"], F.struct(x["word_id"].cast("long").alias("word_id"), F.when(new, a["row"] + 1).otherwise(a["row"]).alias("row_id"))).alias("out"),
                ),
            ),
            1,
        ),
        lambda a: a["out"],
    )
    rows = page.select(*keys, F.inline(placed))
    return words.join(rows, [*keys, "word_id"])


HEADER = r"(?i)(number|no\.?|patients?)\s*(at)?\s*risk|at\s+risk"


def parse_at_risk(words: DataFrame, keys: list[str], reach: float = 10.0) -> DataFrame:
    """``keys, group_id, label, col, time, n_risk, confidence`` from the positioned words below a figure.

    The first row of numbers alone holds the times; rows with a label and
    numbers are groups, in order; the longer of times and counts is cut.
    """
    rows = cluster_rows_anchor(words, keys, reach)
    number = scalar.is_number(F.col("text"))
    at = rows.groupBy(*keys, "row_id").agg(
        F.sort_array(F.collect_list(F.when(number, F.struct("left", F.col("text").try_cast("double").alias("v"))))).alias("nums"),
        F.sort_array(F.collect_list(F.when(~number, F.struct("left", "text")))).alias("names"),
        F.avg(F.when(F.col("conf") != -1, F.col("conf") / 100.0)).alias("confidence"),
    )
    at = at.withColumn("label", F.array_join(F.transform("names", lambda x: x["text"]), " ")).withColumn("nums", F.transform("nums", lambda x: x["v"]))
    at = at.filter(~F.col("label").rlike(HEADER) & (F.size("nums") > 0))
    times = at.filter("label = ''").groupBy(*keys).agg(F.min_by("nums", "row_id").alias("times"))
    groups = at.filter("label <> ''").withColumn("group_id", F.row_number().over(Window.partitionBy(*keys).orderBy("row_id")) - 1)
    n = F.least(F.size("nums"), F.size("times"))
    both = groups.join(times, keys).withColumn("__c", F.arrays_zip(F.slice("times", 1, n).alias("time"), F.slice("nums", 1, n).alias("n_risk")))
    return both.select(*keys, "group_id", "label", F.posexplode("__c").alias("col", "c"), "confidence").select(
        *keys, "group_id", "label", "col", F.col("c.time").alias("time"), F.col("c.n_risk").cast("int").alias("n_risk"), "confidence"
    )


def extract_nar(words: DataFrame, panels: DataFrame, band: float = 40.0, gap: float = 3.0) -> DataFrame:
    """Numbers in the band under each panel, as ``y_grp, col, num``; at least 3 numbers a panel."""
    w = words.withColumn("num", scalar.parse_number(F.col("text"))).filter("num is not null")
    under = panels.withColumn("__to", F.col("ymax") + band)
    rows = in_boxes(w, under, ["figure_id"], "left", "top", ("xmin", "xmax", "ymax", "__to")).filter("top > ymax").drop("__to")
    rows = rows.withColumn("__n", F.count("*").over(Window.partitionBy("figure_id", "panel_id"))).filter("__n >= 3").drop("__n")
    banded = cluster_rows_gap(rows, ["figure_id", "panel_id"], "top", gap).withColumnRenamed("row_id", "y_grp")
    col = F.row_number().over(Window.partitionBy("figure_id", "panel_id", "y_grp").orderBy("left", "word_id")) - 1
    return banded.select("figure_id", "panel_id", "y_grp", col.cast("int").alias("col"), "num")


# ------------------------------------------------------------ colour groups

FEATURES = ["f0", "f1", "f2"]


def standardize(rows: DataFrame, keys: list[str], features: list[str] = FEATURES) -> DataFrame:
    """Features with mean 0 and deviation 1 in each figure; a constant one becomes 0."""
    w = Window.partitionBy(*keys)
    unit = lambda c: (F.col(c) - F.avg(c).over(w)) / F.when(F.stddev_pop(c).over(w) == 0, F.lit(1.0)).otherwise(F.stddev_pop(c).over(w))
    return rows.select(*[c for c in rows.columns if c not in features], *[unit(c).alias(c) for c in features])


def _distance(a: str, b: str) -> Column:
    out = F.lit(0.0)
    for i in range(len(FEATURES)):
        d = F.col(f"{a}{i}") - F.col(f"{b}{i}")
        out = out + d * d
    return out


def _nearest(rows: DataFrame, centres: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Each row with its nearest centre; centres are k rows a figure (and other columns of ``by``), packed into one array."""
    packed = centres.groupBy(*(by or keys)).agg(F.sort_array(F.collect_list(F.struct("cluster", *[f"c{i}" for i in range(len(FEATURES))]))).alias("__c"))
    dist = lambda c: sum(((F.col(f"f{i}") - c[f"c{i}"]) * (F.col(f"f{i}") - c[f"c{i}"]) for i in range(len(FEATURES))), F.lit(0.0))
    best = F.array_min(F.transform("__c", lambda c: F.struct(dist(c).alias("d2"), c["cluster"].alias("cluster"))))
    return rows.join(packed, keys).withColumn("__b", best).withColumn("cluster", F.col("__b.cluster")).withColumn("d2", F.col("__b.d2")).drop("__b", "__c")


STARTS = 10


def _mean(c: str) -> Column:
    """The mean of a feature over rows that stand for ``n`` each."""
    return F.sum(F.col("n") * F.col(c)) / F.sum("n")


def _seeds(rows: DataFrame, keys: list[str], k: int, starts: int) -> DataFrame:
    """``keys, __start, cluster, c0..c2``: ``k`` seeds for each start, all starts in one aggregation a seed.

    Start 0 takes the row nearest the mean, then again and again the row farthest
    from its seeds. The others draw a row with weights by squared distance to
    their seeds: the largest of log(u) / weight, where u comes from a hash of row,
    start and seed.
    """
    tries = F.explode(F.sequence(F.lit(0), F.lit(starts - 1)))
    mean = rows.groupBy(*keys).agg(*[_mean(f"f{i}").alias(f"c{i}") for i in range(len(FEATURES))]).select("*", tries.alias("__start"))
    by = [*keys, "__start"]

    def pick(df: DataFrame, far: Column, weight: Column, j: int) -> DataFrame:
        u = (F.pmod(F.xxhash64("id", "__start", F.lit(j)), F.lit(1 << 52)) + 1) / float(1 << 52)
        draw = F.when(weight > 0, F.log(u) / weight).otherwise(F.lit(float("-inf")))
        order = F.when(F.col("__start") == 0, far).otherwise(draw)
        best = df.groupBy(*by).agg(F.max_by(F.struct(*FEATURES), F.struct(order, -F.col("id"))).alias("s"))
        return best.select(*by, F.lit(j).alias("cluster"), *[F.col(f"s.f{i}").alias(f"c{i}") for i in range(len(FEATURES))])

    centres = pick(rows.join(mean, keys), -_distance("f", "c"), F.col("n"), 0)
    for j in range(1, k):
        centres = written(centres)
        centres = centres.unionByName(pick(_nearest(rows, centres, keys, by), F.col("d2"), F.col("n") * F.col("d2"), j))
    return written(centres)


def kmeans_for(rows: DataFrame, keys: list[str], ks: list[int], rounds: int = 8, starts: int = STARTS) -> DataFrame:
    """``rows`` (with f0..f2 and ``id``) once for each ``k``, with ``cluster`` and squared distance ``d2``, for all figures at once.

    Every k and every start is a key, so a Lloyd round is one aggregation for all
    of them; the first k seeds of a start serve each k. The start with the least
    inertia is kept. Clusters are numbered by their centres, so labels do not
    depend on seeds.
    """
    by = [*keys, "k", "__start"]
    # rows alike move together: one row stands for all of them
    kinds = written(rows.groupBy(*keys, *FEATURES).agg(F.min("id").alias("id"), F.count("*").alias("n")))
    centres = _seeds(kinds, keys, max(ks), starts).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("cluster < k")
    for _ in range(rounds):
        centres = written(_nearest(kinds, centres, keys, by).groupBy(*by, "cluster").agg(*[_mean(f"f{i}").alias(f"c{i}") for i in range(len(FEATURES))]))
    cost = _nearest(kinds, centres, keys, by).groupBy(*by).agg(F.sum(F.col("n") * F.col("d2")).alias("cost"))
    best = cost.groupBy(*keys, "k").agg(F.min_by("__start", F.struct("cost", "__start")).alias("__start"))
    centres = written(centres.join(best, by, "left_semi"))
    order = F.row_number().over(Window.partitionBy(*keys, "k").orderBy(*[f"c{i}" for i in range(len(FEATURES))])) - 1
    return _nearest(rows, centres.withColumn("cluster", order), keys, [*keys, "k"])


def kmeans_groups(rows: DataFrame, keys: list[str], k: int, rounds: int = 8, starts: int = STARTS) -> DataFrame:
    """``rows`` with ``cluster`` and ``d2`` for one k."""
    return kmeans_for(rows, keys, [k], rounds, starts).drop("k")


def inertia(clustered: DataFrame, keys: list[str]) -> DataFrame:
    return clustered.groupBy(*keys).agg(F.sum("d2").alias("inertia"))


def silhouette(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, silhouette``: mean of (b - a) / max(a, b) over squared distances, as if from all pairs of rows.

    a is the mean squared distance to the other rows of the own cluster, b the
    least mean squared distance to those of another. A cluster's count, sum and
    sum of squared norms give both: the squared distances of x to n rows add up
    to n |x|^2 + sum |y|^2 - 2 x . sum y. A row alone in its cluster scores 0.
    Halved if a cluster holds less than 1 % of the rows; -1 for a single cluster.
    """
    features = range(len(FEATURES))
    norm = sum((F.col(f"f{i}") * F.col(f"f{i}") for i in features), F.lit(0.0))
    moments = clustered.groupBy(*keys, "cluster").agg(F.count("*").alias("n"), F.sum(norm).alias("q"), *[F.sum(f"f{i}").alias(f"s{i}") for i in features])
    packed = moments.groupBy(*keys).agg(F.collect_list(F.struct("cluster", "n", "q", *[f"s{i}" for i in features])).alias("__c"), (F.min("n") < 0.01 * F.sum("n")).alias("__small"))
    total = lambda c: F.greatest(c["n"] * norm + c["q"] - 2.0 * sum((F.col(f"f{i}") * c[f"s{i}"] for i in features), F.lit(0.0)), F.lit(0.0))
    part = lambda own: F.filter("__c", lambda c: (c["cluster"] == F.col("cluster")) == F.lit(own))
    own = F.get(F.transform(part(True), lambda c: F.when(c["n"] > 1, total(c) / (c["n"] - 1))), F.lit(0))
    other = F.array_min(F.transform(part(False), lambda c: total(c) / c["n"]))
    rows = clustered.join(packed, keys).select(*keys, "__small", (F.size("__c") > 1).alias("__two"), own.alias("a"), other.alias("b"))
    one = F.when(F.col("a").isNull() | (F.greatest("a", "b") <= 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    mean = F.when(F.bool_and("__two"), F.avg(one) * F.when(F.max("__small"), F.lit(0.5)).otherwise(F.lit(1.0))).otherwise(F.lit(-1.0))
    return rows.groupBy(*keys).agg(mean.alias("silhouette"))


def auto_k(rows: DataFrame, keys: list[str], most: int = 6, rounds: int = 5, method: str = "silhouette", starts: int = STARTS) -> DataFrame:
    """``keys, k``: the number of groups in 1..most; 1 below 100 rows.

    ``silhouette`` takes the k with the largest one, ``elbow`` that at the
    sharpest bend of inertia; ``combined`` takes the first, but no more than one
    above the second.
    """
    if method not in ("silhouette", "elbow", "combined"):
        raise ValueError(f"no such method: {method}")
    return choose_k(kmeans_for(rows, keys, list(range(1, most + 1)), rounds, starts), keys, method)


def choose_k(groups: DataFrame, keys: list[str], method: str = "silhouette") -> DataFrame:
    """``keys, k`` from rows clustered for every k from 1 on."""
    groups = written(groups.select(*keys, "k", "cluster", "d2", *FEATURES))
    each = inertia(groups, [*keys, "k"])
    if method != "elbow":
        each = each.join(silhouette(groups, [*keys, "k"]), [*keys, "k"])
    each = written(each)
    by_silhouette = each.groupBy(*keys).agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k")) if method != "elbow" else None
    by_elbow = None
    if method != "silhouette":
        w = Window.partitionBy(*keys).orderBy("k")
        bend = F.lag("inertia").over(w) - 2 * F.col("inertia") + F.lead("inertia").over(w)
        bent = each.withColumn("bend", bend).groupBy(*keys).agg(F.max_by("k", F.when(F.col("bend").isNotNull(), F.struct("bend", -F.col("k")))).alias("e"))
        by_elbow = bent.select(*keys, F.coalesce("e", F.lit(1)).alias("k"))
    if method == "combined":
        best = by_silhouette.join(by_elbow.withColumnRenamed("k", "e"), keys).withColumn("k", F.least("k", F.col("e") + 1)).drop("e")
    else:
        best = by_silhouette if method == "silhouette" else by_elbow
    size = groups.filter("k = 1").groupBy(*keys).agg(F.count("*").alias("n"))
    return best.join(size, keys).select(*keys, F.when(F.col("n") < 100, 1).otherwise(F.col("k")).alias("k"))


def cluster_confidence(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """0.4 size + 0.4 separation + 0.2 compactness of each cluster, each in [0, 1]."""
    whole = Window.partitionBy(*keys)
    s = clustered.groupBy(*keys, "cluster").agg(F.count("*").alias("n"), F.avg(F.sqrt("d2")).alias("spread"), *[F.avg(f"f{i}").alias(f"c{i}") for i in range(len(FEATURES))])
    a, b = s, s.select(*keys, F.col("cluster").alias("other"), *[F.col(f"c{i}").alias(f"o{i}") for i in range(len(FEATURES))])
    near = a.join(b, keys).filter("cluster <> other").groupBy(*keys, "cluster").agg(F.min(F.sqrt(_distance("c", "o"))).alias("gap"))
    size = F.least(F.lit(1.0), F.col("n") / F.sum("n").over(whole) * F.count("*").over(whole))
    return s.join(near, [*keys, "cluster"], "left").select(
        *keys, "cluster", "n",
        (0.4 * size + 0.4 * F.least(F.lit(1.0), F.coalesce(F.col("gap"), F.lit(1.0))) + 0.2 / (1.0 + F.col("spread"))).alias("confidence"),
    )


def dominant_color(pixels: DataFrame, keys: list[str], first: int = 1000) -> DataFrame:
    """Median and mean colour of the first pixels of each group, with hex code and name."""
    w = Window.partitionBy(*keys).orderBy("y", "x", "r", "g", "b")
    top = pixels.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= first)
    med = top.groupBy(*keys).agg(*[F.median(c).alias(c) for c in "rgb"], *[F.avg(c).alias(f"mean_{c}") for c in "rgb"])
    h, s, l = scalar.rgb_to_hsl(F.col("r"), F.col("g"), F.col("b"))  # noqa: E741
    return med.select("*", h.alias("h"), s.alias("s"), l.alias("l"), scalar.hex_color(F.floor("r"), F.floor("g"), F.floor("b")).alias("hex"), scalar.color_name(h, s, l).alias("name"))


# ------------------------------------------------------------ dotted lines


def dotted_density(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels per unit of x, scored 0.9 / 0.6 / 0.3 / 0.1 at 3 / 8 / 15."""
    d = pixels.groupBy(*keys).agg((F.count("*") / F.greatest(F.max("x") - F.min("x"), F.lit(1))).alias("per_x"))
    return d.withColumn("density", F.when(F.col("per_x") < 3, 0.9).when(F.col("per_x") < 8, 0.6).when(F.col("per_x") < 15, 0.3).otherwise(0.1))


def dotted_horizontal(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Height over width, scored 0.9 / 0.6 / 0.3 / 0 at 0.01 / 0.05 / 0.1."""
    d = pixels.groupBy(*keys).agg((F.max("y") - F.min("y")).alias("h"), (F.max("x") - F.min("x")).alias("w"), F.stddev_pop("y").alias("y_std"))
    ratio = F.col("h") / F.greatest(F.col("w"), F.lit(1))
    return d.select(*keys, ratio.alias("ratio"), "y_std", F.when(ratio < 0.01, 0.9).when(ratio < 0.05, 0.6).when(ratio < 0.1, 0.3).otherwise(0.0).alias("horizontal"))


def dotted_periodicity(pixels: DataFrame, keys: list[str], lo: int = 5, hi: int = 30) -> DataFrame:
    """Power of the x histogram at periods of ``lo`` to ``hi`` pixels over the power at 0.

    A discrete Fourier transform as a join of histogram bins with the
    frequencies in question; a curve is at most a panel wide, so bins are few.
    """
    hist = pixels.groupBy(*keys, "x").agg(F.count("*").alias("c"))
    span = hist.groupBy(*keys).agg(F.min("x").alias("x0"), (F.max("x") - F.min("x") + 1).alias("n"), F.sum("c").alias("dc"))
    freq = span.withColumn("k", F.explode(F.sequence(F.greatest(F.lit(1), F.ceil(F.col("n") / hi).cast("int")), F.greatest(F.lit(1), F.floor(F.col("n") / lo).cast("int")))))
    angle = F.lit(2 * pi) * F.col("k") * (F.col("x") - F.col("x0")) / F.col("n")
    power = (
        hist.join(freq, keys).groupBy(*keys, "k", "dc").agg(F.sum(F.col("c") * F.cos(angle)).alias("re"), F.sum(F.col("c") * F.sin(angle)).alias("im"))
        .withColumn("p", (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("dc") * F.col("dc")))
    )
    best = power.groupBy(*keys).agg(F.max("p").alias("power"))
    return best.withColumn("periodicity", F.when(F.col("power") > 0.3, 0.8).when(F.col("power") > 0.15, 0.5).when(F.col("power") > 0.05, 0.2).otherwise(0.0))


def connected_areas(pixels: DataFrame, keys: list[str], rounds: int = 60) -> DataFrame:
    """Connected components after one pixel of dilation: ``keys, component, area``.

    Dilated pixels are joined into runs of a row; runs of neighbouring rows that
    overlap are linked through the pixels they share, so a link costs one row,
    and labels spread by minimum with pointer jumping.
    """
    near = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    wide = pixels.select(*keys, "x", "y", near.alias("d")).select(*keys, (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y")).distinct()
    w = Window.partitionBy(*keys, "y").orderBy("x")
    start = F.when(F.coalesce(F.col("x") - F.lag("x").over(w), F.lit(99)) > 1, F.col("x"))
    runs = written(wide.withColumn("__s", start).withColumn("x0", F.last("__s", ignorenulls=True).over(w)).select(*keys, "x", "y", "x0"))
    below = runs.select(*keys, "x", (F.col("y") - 1).alias("y"), F.struct((F.col("y")).alias("y"), F.col("x0").alias("x0")).alias("v"))
    up = runs.select(*keys, "x", "y", F.struct(F.col("y").alias("y"), F.col("x0").alias("x0")).alias("u"))
    links = up.join(below, [*keys, "x", "y"]).select(*keys, "u", "v").distinct()
    both = written(links.union(links.select(*keys, F.col("v"), F.col("u"))))
    labels = written(runs.select(*keys, F.struct("y", "x0").alias("u")).distinct().withColumn("label", F.col("u")))
    for _ in range(rounds):
        spread = both.join(labels.select(*keys, F.col("u").alias("v"), "label"), [*keys, "v"]).groupBy(*keys, "u").agg(F.min("label").alias("near"))
        step = labels.join(spread, [*keys, "u"], "left").select(*keys, "u", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        jump = step.select(*keys, F.col("u").alias("next"), F.col("next").alias("to"))
        done = written(step.join(jump, [*keys, "next"]).select(*keys, "u", "label", F.least("next", "to").alias("next")))
        changed = done.filter("next <> label").limit(1).count()
        labels = done.select(*keys, "u", F.col("next").alias("label"))
        if not changed:
            break
    else:
        raise RuntimeError(f"areas did not settle in {rounds} rounds")
    size = runs.groupBy(*keys, F.struct("y", "x0").alias("u")).agg(F.count("*").alias("n"))
    return size.join(labels, [*keys, "u"]).groupBy(*keys, F.col("label").alias("component")).agg(F.sum("n").alias("area"))


def dotted_continuity(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """More than 20 / 10 / 5 / 2 components score 0.9 / 0.7 / 0.5 / 0.3, else 0.1; 0.3 times that if one holds over 80 %."""
    c = connected_areas(pixels, keys).groupBy(*keys).agg(F.count("*").alias("components"), (F.max("area") / F.sum("area")).alias("largest"))
    n = F.col("components")
    base = F.when(n > 20, 0.9).when(n > 10, 0.7).when(n > 5, 0.5).when(n > 2, 0.3).otherwise(0.1)
    return c.withColumn("continuity", F.when(F.col("largest") > 0.8, base * 0.3).otherwise(base))


def dotted_score(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """0.3 density + 0.4 continuity + 0.2 horizontal + 0.1 periodicity; dotted above 0.5, never below 50 pixels."""
    parts = pixels.groupBy(*keys).agg(F.count("*").alias("n"))
    for df, c in ((dotted_density(pixels, keys), "density"), (dotted_continuity(pixels, keys), "continuity"), (dotted_horizontal(pixels, keys), "horizontal"), (dotted_periodicity(pixels, keys), "periodicity")):
        parts = parts.join(df.select(*keys, c), keys, "left")
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = 0.3 * part("density") + 0.4 * part("continuity") + 0.2 * part("horizontal") + 0.1 * part("periodicity")
    return parts.withColumn("score", F.when(F.col("n") < 50, F.lit(0.0)).otherwise(score)).withColumn("is_dotted", F.col("score") > 0.5)


def filter_solid(curves: DataFrame, scores: DataFrame, keys: list[str], confidence: float = 0.5) -> DataFrame:
    """Curves that are solid, or dotted with less than ``confidence``."""
    solid = scores.filter(~F.col("is_dotted") | (F.col("score") < confidence)).select(*keys)
    return curves.join(solid, keys, "left_semi")


# ------------------------------------------------------------ neighbours


def knn_reach(pixels: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``keys, x, y, reach``: within ``reach`` of each place lie more than k pixels, or all of its figure.

    A pyramid counts the pixels of grid cells, one pixel wide at the lowest level
    and twice as wide at each level above, and keeps their extent. Where the 3 x 3
    cells around a place hold more than k pixels, their farthest corner is such a
    reach; the least of all levels is taken. The top level sees all of a figure.
    """
    places = pixels.groupBy(*keys, "x", "y").agg(F.count("*").alias("n"))
    extent = pixels.groupBy(*keys).agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("e")).agg(F.max("e")).first()[0] or 0
    top = ceil(log2(extent + 1))
    side = F.pow(F.lit(2.0), F.col("__level"))
    at = lambda c: F.floor(F.col(c) / side).cast("long")
    placed = places.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("cx", at("x")).withColumn("cy", at("y"))
    where = [*keys, "__level", "cx", "cy"]
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    cells = placed.groupBy(*where).agg(F.sum("n").alias("n"), F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"))
    spread = cells.withColumn("o", steps).withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j")})
    around = spread.groupBy(*where).agg(F.sum("n").alias("n"), *[f(c).alias(c) for f, c in ((F.min, "x1"), (F.max, "x2"), (F.min, "y1"), (F.max, "y2"))])
    full = around.filter((F.col("n") > k) | (F.col("__level") == top)).drop("n")
    far = lambda c: F.greatest(F.col(c) - F.col(f"{c}1"), F.col(f"{c}2") - F.col(c)).cast("double")
    reach = F.sqrt(far("x") * far("x") + far("y") * far("y"))
    return placed.join(full, where).groupBy(*keys, "x", "y").agg(F.min(reach).alias("reach"))


def knn_pairs(pixels: DataFrame, keys: list[str], k: int, own: list[str] = []) -> DataFrame:  # noqa: B006
    """Pairs ``id, other, d`` that hold the k nearest other pixels of each pixel, and columns ``own`` of both (``other_`` before those of the other).

    A pixel meets the places in the square of its reach, which holds about k pixels:
    where it is wider than 3 x 3 places, the 3 x 3 cells half as wide hold k at most.
    Of a place only the first k + 1 by id are met; no pixel has more of them among its
    k nearest. So pairs grow with the pixels, however dense these are. Coordinates are
    whole numbers, or about one apart; finer ones are right too, but pairs of a place
    of 1 x 1 are all formed. The input is read once and written to the shared folder.
    """
    pixels = written(pixels.select(*keys, "id", "x", "y", *own))
    first = F.row_number().over(Window.partitionBy(*keys, "x", "y").orderBy("id"))
    held = pixels.withColumn("__n", first).filter(F.col("__n") <= k + 1)
    held = held.select(*keys, F.col("id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"), *[F.col(c).alias(f"other_{c}") for c in own])
    # the margin is for coordinates that are no whole numbers; the exact reach is asked afterwards
    wide = F.col("reach") + 1e-6
    square = {"xmin": F.col("x") - wide, "xmax": F.col("x") + wide, "ymin": F.col("y") - wide, "ymax": F.col("y") + wide}
    squares = written(pixels.join(knn_reach(pixels, keys, k), [*keys, "x", "y"]).withColumns(square))
    dx, dy = (F.col("x") - F.col("x2")).cast("double"), (F.col("y") - F.col("y2")).cast("double")
    d = F.sqrt(dx * dx + dy * dy)
    near = in_boxes(held, squares, keys, "x2", "y2", cell=2.0).filter("id <> other").filter(d <= F.col("reach"))
    return near.select(*keys, "id", "other", d.alias("d"), *own, *[f"other_{c}" for c in own])


def knn_join(pixels: DataFrame, keys: list[str], k: int, own: list[str] = []) -> DataFrame:  # noqa: B006
    """The k nearest other pixels of each pixel, all of them if a figure has fewer: ``id, other, d, rank``, and ``own`` as in ``knn_pairs``."""
    w = Window.partitionBy(*keys, "id").orderBy("d", "other")
    return knn_pairs(pixels, keys, k, own).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_coherence(pixels: DataFrame, keys: list[str], k: int = 20) -> DataFrame:
    """Mean over the k nearest of 1 / max(d, 0.1)^2, positive for the same ``cluster``, negative for another."""
    pull = F.lit(1.0) / F.pow(F.greatest(F.col("d"), F.lit(0.1)), F.lit(2.0))
    signed = F.when(F.col("cluster") == F.col("other_cluster"), pull).otherwise(-pull)
    return knn_join(pixels, keys, k, ["cluster"]).groupBy(*keys, "id").agg((F.sum(signed) / k).alias("coherence"))


def envelope_by_coherence(pixels: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """One y for each x of a group, the most coherent; x gaps filled from the left; y (downward) never falls back up."""
    # pixels are added up by column first, so no window sees those of a whole group
    columns = pixels.groupBy(*keys, "x").agg(F.max_by("y", F.struct(F.col("coherence"), -F.col("y"))).alias("y"), F.count("*").alias("__n"))
    best = columns.withColumn("__n", F.sum("__n").over(Window.partitionBy(*keys))).filter(F.col("__n") >= least).drop("__n")
    span = best.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    grid = span.select(*keys, F.explode(F.sequence("lo", "hi")).alias("x"))
    upto = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(best, [*keys, "x"], "left").withColumn("y", F.last("y", ignorenulls=True).over(upto))
    return filled.withColumn("y", F.max("y").over(upto))


def filter_candidates(points: DataFrame, panel_width: float, top: int, keys: list[str] = ["figure_id", "curve_id"]) -> DataFrame:  # noqa: B006
    """Curves long, wide and smooth enough; the ``top`` longest of each figure."""
    w = Window.partitionBy(*keys).orderBy("x", "y")
    moves = points.withColumn("dx", F.col("x") - F.lag("x").over(w)).withColumn("dy", F.abs(F.col("y") - F.lag("y").over(w)))
    s = moves.groupBy(*keys).agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"), F.max("dx").alias("gap"), F.avg("dy").alias("dy"))
    good = s.filter((F.col("n") >= 100) & (F.col("w") / F.greatest(F.col("h"), F.lit(1)) >= 1.5) & (F.col("w") >= 0.3 * panel_width) & (F.col("gap") <= 100) & (F.col("dy") <= 10))
    best = Window.partitionBy(*keys[:-1]).orderBy(F.desc("n"), keys[-1])
    return good.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def order_curves_by_height(points: DataFrame, keys: list[str]) -> DataFrame:
    """``rank`` of each curve of a figure by its mean y."""
    m = points.groupBy(*keys).agg(F.avg("y").alias("mean_y"))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy(*keys[:-1]).orderBy("mean_y", keys[-1])))


def curve_numbering(points: DataFrame, keys: list[str], style: str) -> DataFrame:
    """Number of each style of a page."""
    return points.withColumn("curve_id", F.dense_rank().over(Window.partitionBy(*keys).orderBy(style)))


def raster_column_split(pixels: DataFrame, keys: list[str], tolerance: int = 5, least: int = 10) -> DataFrame:
    """Runs of y in each pixel column, cut where the gap exceeds ``tolerance``; the run's number is the curve."""
    w = Window.partitionBy(*keys, "x").orderBy("y")
    new = F.coalesce((F.col("y") - F.lag("y").over(w) > tolerance).cast("int"), F.lit(1))
    runs = pixels.select(*keys, "x", "y").distinct().withColumn("__new", new).withColumn("curve_id", F.sum("__new").over(w))
    rows = runs.groupBy(*keys, "curve_id", "x").agg(F.avg("y").alias("y"))
    return rows.withColumn("__n", F.count("*").over(Window.partitionBy(*keys, "curve_id"))).filter(F.col("__n") >= least).drop("__n")


def raster_to_vector_coords(points: DataFrame, dpi: float, svg_dpi: float, xmin: float, ymin: float) -> DataFrame:
    scale = dpi / svg_dpi
    return points.withColumn("svg_x", F.lit(xmin) + F.col("x") / scale).withColumn("svg_y", F.lit(ymin) + F.col("y") / scale)


def unmix_overlaps(points: DataFrame, keys: list[str], width: int = 30, reach: float = 1.5, most: int = 4) -> DataFrame:
    """Curves of one style (``keys``) that run together, told apart bin by bin: adds ``bin, k, label``.

    k is the largest number of y-clusters in a bin of ``width``, at most ``most``;
    a cluster begins at each point, in order of x, that lies over ``reach`` from
    all beginnings before it. Points of a bin take classes 1..k in turn by y; then
    a class takes the label of that class of the bin before whose mean y is
    nearest. Only means travel from bin to bin: at most k a bin.
    """
    at = points.withColumn("bin", F.greatest(F.lit(1), F.ceil((F.col("x") - F.min("x").over(Window.partitionBy(*keys))) / width)).cast("long"))
    # a repeated point begins no cluster
    strips = at.select(*keys, "bin", "x", "y").distinct().groupBy(*keys, "bin").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("__p"))
    begins = F.aggregate(
        "__p",
        F.array().cast("array<double>"),
        lambda a, p: F.when((F.size(a) >= most) | F.exists(a, lambda s: F.abs(s - p["y"]) <= reach), a).otherwise(F.array_append(a, p["y"].cast("double"))),
    )
    k = strips.select(*keys, F.size(begins).alias("k")).groupBy(*keys).agg(F.max("k").alias("k"))
    turn = F.row_number().over(Window.partitionBy(*keys, "bin").orderBy("y", "x")) - 1
    classed = at.join(k, keys).withColumn("__c", turn % F.col("k") + 1)
    means = classed.groupBy(*keys, "bin", "__c").agg(F.sum(F.col("y").cast("double")).alias("s"), F.count("*").alias("n"))
    bins = means.groupBy(*keys, "bin").agg(F.sort_array(F.collect_list(F.struct(F.col("__c").alias("c"), "s", "n"))).alias("cs"))
    curve = bins.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "cs"))).alias("bins"))
    total = lambda m, f, kind: F.aggregate(m, F.lit(0).cast(kind), lambda a, x: a + x[f])

    def carry(a: Column, b: Column) -> Column:
        gap = lambda c: F.array_min(F.transform(a["prev"], lambda p: F.struct(F.abs(c["s"] / c["n"] - p["s"] / p["n"]).alias("d"), p["c"].alias("c"))))["c"]
        named = F.transform(b["cs"], lambda c: F.struct(b["bin"].alias("bin"), c["c"].alias("c"), F.coalesce(gap(c), c["c"]).alias("label"), c["s"].alias("s"), c["n"].alias("n")))

        def after(m: Column) -> Column:
            mine = lambda l: F.filter(m, lambda x: x["label"] == l)  # noqa: E731, E741
            prev = F.transform(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), lambda l: F.struct(l.alias("c"), total(mine(l), "s", "double").alias("s"), total(mine(l), "n", "long").alias("n")))  # noqa: E741
            return F.struct(prev.alias("prev"), F.concat(a["out"], F.transform(m, lambda x: F.struct(x["bin"].alias("bin"), x["c"].alias("__c"), x["label"].alias("label")))).alias("out"))

        return F.get(F.transform(F.array(named), after), F.lit(0))

    start = F.struct(F.array().cast("array<struct<c:int,s:double,n:bigint>>").alias("prev"), F.array().cast("array<struct<bin:bigint,__c:int,label:int>>").alias("out"))
    labels = curve.select(*keys, F.inline(F.aggregate("bins", start, carry, lambda a: a["out"])))
    return classed.join(labels, [*keys, "bin", "__c"]).drop("__c")
