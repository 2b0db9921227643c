"""Vector figures: lines, panels, labels, ticks, paths.

Nearest-neighbour and range joins meet in grid cells first, so candidates are
local; the exact distance or range is checked afterwards.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar

INF = float("inf")


def axis_lines(lines: DataFrame, keys: list[str], least: float = 50.0) -> DataFrame:
    """Horizontal and vertical lines of at least ``least``, ranked by length in each direction."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    kind = F.when(dy < 1, "h").when(dx < 1, "v")
    rows = lines.withColumn("direction", kind).withColumn("length", scalar.line_length(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    rows = rows.filter(F.col("direction").isNotNull() & (F.col("length") >= least))
    w = Window.partitionBy(*keys, "direction").orderBy(F.desc("length"), "line_id")
    return rows.withColumn("rank", F.row_number().over(w))


def build_panels(axes: DataFrame, keys: list[str], top: int = 6, apart: float = 30.0, least_width: float = 50.0) -> DataFrame:
    """Panels from the ``top`` longest horizontals and pairs of verticals at least ``apart``.

    Both sides of the pairing are at most ``top`` lines of a page, so pairs stay
    few; a panel spans the pair in x and from the higher end of the verticals to
    the horizontal in y.
    """
    h = axes.filter((F.col("direction") == "h") & (F.col("rank") <= top)).select(*keys, F.col("y1").alias("hy"), F.least("x1", "x2").alias("hx1"), F.greatest("x1", "x2").alias("hx2"))
    v = axes.filter((F.col("direction") == "v") & (F.col("rank") <= top)).select(*keys, "line_id", F.col("x1").alias("vx"), F.least("y1", "y2").alias("vy"))
    a, b = v.select(*keys, F.col("line_id").alias("i"), F.col("vx").alias("xa"), F.col("vy").alias("ya")), v.select(*keys, F.col("line_id").alias("j"), F.col("vx").alias("xb"), F.col("vy").alias("yb"))
    pair = a.join(b, keys).filter((F.col("xb") - F.col("xa")) >= apart)
    both = pair.join(h, keys).filter((F.col("hy") > F.greatest("ya", "yb")) & (F.col("hx1") <= F.col("xa") + 5) & (F.col("hx2") >= F.col("xb") - 5))
    box = both.select(*keys, F.col("xa").alias("xmin"), F.col("xb").alias("xmax"), F.least("ya", "yb").alias("ymin"), F.col("hy").alias("ymax")).distinct()
    w = Window.partitionBy(*keys).orderBy("xmin", "ymin", "xmax", "ymax")
    return box.filter(F.col("xmax") - F.col("xmin") >= least_width).withColumn("panel_id", F.row_number().over(w))


#: The side of a grid cell at the lowest level; at each level above it is four times as long.
CELL = 32.0
LEVELS = 12
BOX = ("xmin", "xmax", "ymin", "ymax")


def box_pairs(points: DataFrame, boxes: DataFrame, keys: list[str], x: str, y: str, box: tuple[str, str, str, str] = BOX, cell: float = CELL) -> DataFrame:
    """Points with the boxes of their page that share a grid cell with them.

    A box lies in the cells of the level where it is at most two cells wide and
    high, so in nine at most; a point lies in one cell of each level that its
    page's boxes use. A pair meets once. Boxes too large for any level, infinite
    ones too, meet all points of their page. ``cell`` is the side at the lowest level.
    """
    x1, x2, y1, y2 = (F.col(c).cast("double") for c in box)
    span = F.greatest(x2 - x1, y2 - y1)
    level = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(span, F.lit(1e-9)) / (2 * cell)) / log(4.0)).cast("int"))
    large = (span > 2 * cell * 4.0 ** (LEVELS - 1)) | (F.abs(x1) > 1e15) | (F.abs(y1) > 1e15)
    fine = (x1 <= x2) & (y1 <= y2)
    held = boxes.filter(fine).withColumn("__level", F.when(large, F.lit(LEVELS)).otherwise(level))
    side = F.lit(float(cell)) * F.pow(F.lit(4.0), F.col("__level"))
    whole = F.col("__level") == LEVELS
    at = lambda v: F.when(whole, F.lit(0).cast("long")).otherwise(F.floor(v / side).cast("long"))
    cells = held.withColumn("__cx", F.explode(F.sequence(at(x1), at(x2)))).withColumn("__cy", F.explode(F.sequence(at(y1), at(y2))))
    used = held.groupBy(*keys).agg(F.collect_set("__level").alias("__levels"))
    near = points.join(used, keys).withColumn("__level", F.explode("__levels")).drop("__levels")
    near = near.withColumn("__cx", at(F.col(x).cast("double"))).withColumn("__cy", at(F.col(y).cast("double")))
    return near.join(cells, [*keys, "__level", "__cx", "__cy"]).drop("__level", "__cx", "__cy")


def in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], x: str, y: str, box: tuple[str, str, str, str] = BOX, cell: float = CELL) -> DataFrame:
    """Each point with each box of its page that holds it, edges included; other columns of both must differ in name."""
    x1, x2, y1, y2 = (F.col(c) for c in box)
    return box_pairs(points, boxes, keys, x, y, box, cell).filter((F.col(x) >= x1) & (F.col(x) <= x2) & (F.col(y) >= y1) & (F.col(y) <= y2))


def flag_insets(panels: DataFrame, keys: list[str], share: float = 0.25) -> DataFrame:
    """``is_inset``: inside another panel of the page and at most ``share`` of the largest panel's area."""
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    sized = panels.withColumn("area", area).withColumn("__most", F.max(area).over(Window.partitionBy(*keys)))
    outer = panels.select(*keys, *[F.col(c).alias(f"__{c}") for c in (*BOX, "panel_id")])
    corners = in_boxes(panels.select(*keys, *BOX, "panel_id"), outer, keys, "xmin", "ymin", tuple(f"__{c}" for c in BOX))
    inside = corners.filter("panel_id <> __panel_id and xmax <= __xmax and ymax <= __ymax").select(*keys, "panel_id").distinct().withColumn("__in", F.lit(True))
    out = sized.join(inside, [*keys, "panel_id"], "left")
    return out.withColumn("is_inset", F.coalesce(F.col("__in"), F.lit(False)) & (F.col("area") <= share * F.col("__most"))).drop("__in", "__most")


def score_panels(panels: DataFrame, keys: list[str]) -> DataFrame:
    """Rescaled area + rescaled closeness of ``y_max`` to 1 + 0.25 for an at-risk hit; a constant rescales to 0.5."""
    w = Window.partitionBy(*keys)

    def unit(c: Column) -> Column:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi == lo, F.lit(0.5)).otherwise((c - lo) / (hi - lo))

    size = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    scored = panels.withColumn("__a", size).withColumn("__f", -F.abs(F.col("y_max") - 1.0))
    score = unit(F.col("__a")) + unit(F.col("__f")) + F.when(F.col("nar_hit"), F.lit(0.25)).otherwise(F.lit(0.0))
    best = Window.partitionBy(*keys).orderBy(F.desc("panel_score"), "panel_id")
    return scored.withColumn("panel_score", score).withColumn("best", F.row_number().over(best) == 1).drop("__a", "__f")


def choose_panels(scored: DataFrame, keys: list[str], mode: str = "best") -> DataFrame:
    """Of the panels of ``score_panels``: the ``best`` of each page by score, the ``largest`` by area, or ``all``."""
    if mode not in ("best", "largest", "all"):
        raise ValueError(f"no such mode: {mode}")
    size = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(size), "panel_id"))
    if mode == "largest":
        return scored.withColumn("__n", first).filter("__n = 1").drop("__n")
    return scored.filter("best") if mode == "best" else scored


def panel_confidence(boxes: DataFrame) -> DataFrame:
    """Candidate boxes with rectangularity, page share and border darkness that pass, with their confidence."""
    aspect = F.col("w") / F.col("h")
    conf = 0.3 * F.least(F.col("rect") / 0.95, F.lit(1.0)) + 0.3 * F.greatest(F.lit(0.0), 1.0 - F.abs(aspect - 1.3) / 2.0) + 0.4 * F.col("border")
    good = F.col("share").between(0.05, 0.5) & aspect.between(0.5, 2.5) & (F.col("rect") >= 0.7)
    return boxes.withColumn("confidence", conf).filter(good & (F.col("confidence") >= 0.5))


def at_risk_region(panels: DataFrame) -> DataFrame:
    """The box 10 to 210 pixels below each panel, as wide as the panel."""
    return panels.select("*", F.col("xmin").alias("ar_xmin"), F.col("xmax").alias("ar_xmax"), (F.col("ymax") + 10).alias("ar_ymin"), (F.col("ymax") + 210).alias("ar_ymax"))


def _cells(df: DataFrame, x: str, y: str, size: float, around: bool) -> DataFrame:
    steps = (-1, 0, 1) if around else (0,)
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in steps for j in steps]))
    return df.withColumn("__o", near).withColumn("__cx", F.floor(F.col(x) / size) + F.col("__o.i")).withColumn("__cy", F.floor(F.col(y) / size) + F.col("__o.j")).drop("__o")


def place_pairs(left: DataFrame, right: DataFrame, keys: list[str], rxy: tuple[str, str], reach: float) -> DataFrame:
    """Each place ``__l0, __l1`` of ``left`` with the rows of ``right`` within ``reach`` and the distance ``dist``."""
    a = _cells(left, "__l0", "__l1", reach, around=True)
    b = _cells(right, *rxy, reach, around=False)
    dx, dy = F.col("__l0") - F.col(rxy[0]), F.col("__l1") - F.col(rxy[1])
    return a.join(b, [*keys, "__cx", "__cy"]).withColumn("dist", F.sqrt(dx * dx + dy * dy)).filter(F.col("dist") <= reach)


def _places(rows: DataFrame, keys: list[str], xy: tuple[str, str]) -> DataFrame:
    return rows.select(*keys, *[F.col(c).alias(f"__l{i}") for i, c in enumerate(xy)]).distinct()


def _first_by_place(rows: DataFrame, keys: list[str], xy: tuple[str, str], own: list[str]) -> DataFrame:
    """Of the rows in one place the first by ``own``, which may be empty."""
    first = rows.groupBy(*keys, *xy).agg(F.min(F.struct(*own) if own else F.lit(1)).alias("__first"))
    return first.select(*keys, *xy, *[F.col(f"__first.{c}").alias(c) for c in own])


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], lxy: tuple[str, str], rxy: tuple[str, str], reach: float, tie: list[str]) -> DataFrame:
    """Each left row with its nearest right row within ``reach`` and the distance ``dist``; rows without one are dropped.

    Ties go by the right columns ``tie``. Only places meet: of right rows in one
    place the first by ``tie`` stands for all, and a left place is looked up once
    for all of its rows.
    """
    rest = [c for c in right.columns if c not in (*keys, *rxy, *tie)]
    own = [c for c in dict.fromkeys((*tie, *rest)) if c not in (*keys, *rxy)]
    pairs = place_pairs(_places(left, keys, lxy), _first_by_place(right, keys, rxy, own), keys, rxy, reach)
    # where ``tie`` names the place itself, it is the same for all rows of a place
    found = pairs.groupBy(*keys, "__l0", "__l1").agg(F.min(F.struct("dist", *tie, *[c for c in (*rxy, *own) if c not in tie])).alias("__n"))
    given = [*own, *rxy, "dist"]
    found = found.select(*keys, *[F.col(c).alias(f"__k{i}") for i, c in enumerate(("__l0", "__l1"))], *[F.col(f"__n.{c}").alias(c) for c in given])
    return left.withColumns({f"__k{i}": F.col(c) for i, c in enumerate(lxy)}).join(found, [*keys, "__k0", "__k1"]).drop("__k0", "__k1")


def _in_panels(at: DataFrame, panels: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Rows of ``at(mx, my)`` with a panel around them (left_semi), or without one (left_anti); each place is asked once."""
    held = in_boxes(at.select(*keys, "mx", "my").distinct(), panels.select(*keys, *BOX), keys, "mx", "my")
    return at.join(held.select(*keys, "mx", "my").distinct(), [*keys, "mx", "my"], how)


def nearest_label(swatches: DataFrame, texts: DataFrame, keys: list[str], reach: float = 25.0, panels: DataFrame | None = None, longest: float = 40.0) -> DataFrame:
    """For each style the shortest label found nearest to one of its swatch lines.

    Lines of no length, of more than ``longest``, or inside a panel are no swatches.
    """
    mx, my = scalar.line_midpoint(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    length = scalar.line_length(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    at = swatches.filter((length > 0) & (length <= longest)).select(*keys, "style_key", mx.alias("mx"), my.alias("my")).distinct()
    if panels is not None:
        at = _in_panels(at, panels, keys, "left_anti")
    found = nearest_within(at, texts, keys, ("mx", "my"), ("tx", "ty"), reach, ["label"])
    return found.groupBy(*keys, "style_key").agg(F.min_by("label", F.struct(F.char_length("label"), F.col("label"))).alias("label"))


def assign_censor_ticks(lines: DataFrame, points: DataFrame, keys: list[str], reach: float = 4.0, panels: DataFrame | None = None) -> DataFrame:
    """Lines of 2 to 8 pixels, inside a panel, with the curve whose point lies nearest to their middle, within ``reach``."""
    mx, my = scalar.line_midpoint(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    short = lines.withColumn("length", scalar.line_length(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).filter(F.col("length").between(2, 8))
    short = short.withColumn("mx", mx).withColumn("my", my)
    if panels is not None:
        short = _in_panels(short, panels, keys, "left_semi")
    return nearest_within(short, points, keys, ("mx", "my"), ("px", "py"), reach, ["curve_id", "px", "py"])


def attach_legend(curves: DataFrame, legend: DataFrame, keys: list[str]) -> DataFrame:
    return curves.join(legend, [*keys, "style_key"], "left")


def clip_to_panel(points: DataFrame, panels: DataFrame, keys: list[str]) -> DataFrame:
    """Points inside a panel of their page, with its id."""
    return in_boxes(points, panels.select(*keys, "panel_id", *BOX), keys, "px", "py").drop(*BOX)


def text_in_region(words: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """The words whose boxes overlap each region, joined in reading order.

    A region grown by its page's largest word holds the corner of each word that may overlap it.
    """
    most = words.groupBy(*keys).agg(F.max("width").alias("__w"), F.max("height").alias("__h"))
    grown = regions.join(most, keys).select(*regions.columns, (F.col("rx1") - F.col("__w")).alias("__x1"), (F.col("ry1") - F.col("__h")).alias("__y1"))
    near = in_boxes(words, grown, keys, "left", "top", ("__x1", "rx2", "__y1", "ry2"))
    hit = (F.col("left") < F.col("rx2")) & (F.col("left") + F.col("width") > F.col("rx1")) & (F.col("top") < F.col("ry2")) & (F.col("top") + F.col("height") > F.col("ry1"))
    rows = near.filter(hit).groupBy(*keys, "region_id").agg(F.sort_array(F.collect_list(F.struct("top", "left", "text"))).alias("w"))
    return rows.select(*keys, "region_id", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"))


def match_by_position(rows: DataFrame, curves: DataFrame, keys: list[str], row_order: str, curve_order: str) -> DataFrame:
    """The i-th row of an at-risk table with the i-th curve."""
    i = lambda df, by: df.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(by)))
    return i(rows, row_order).join(i(curves, curve_order), [*keys, "__i"]).drop("__i")


# ------------------------------------------------------------ paths

#: Numbers that a drawing command takes.
_ARGS = {"M": 2, "L": 2, "H": 1, "V": 1, "Q": 4, "C": 6, "Z": 0}
_NUMBER = r"([-+]?(?:[0-9]*\.)?[0-9]+(?:[eE][-+]?[0-9]+)?)"


def path_moves(paths: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each move of a path's pen: ``keys, seg, rep, cmd, args``, in order of ``seg, rep``.

    A command with the numbers of several moves gives as many rows; after the
    first point of M (m) they are L (l).
    """
    part = F.posexplode(F.regexp_extract_all("d", F.lit(r"([MLHVQCZmlhvqcz][^MLHVQCZmlhvqcz]*)"), F.lit(1))).alias("seg", "__t")
    split = paths.select(*keys, part).select(*keys, "seg", F.substring("__t", 1, 1).alias("cmd"), F.regexp_extract_all("__t", F.lit(_NUMBER), F.lit(1)).cast("array<double>").alias("n"))
    need = F.element_at(F.create_map(*[F.lit(x) for k, v in _ARGS.items() for x in (k, v)]), F.upper("cmd"))
    count = F.when(need == 0, F.lit(1)).otherwise(F.floor(F.size("n") / need)).cast("int")
    rows = split.withColumn("need", need).withColumn("rep", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))))
    cmd = F.when((F.col("rep") > 0) & (F.col("cmd") == "M"), "L").when((F.col("rep") > 0) & (F.col("cmd") == "m"), "l").otherwise(F.col("cmd"))
    return rows.select(*keys, "seg", "rep", cmd.alias("cmd"), F.slice("n", F.col("rep") * F.col("need") + 1, F.col("need")).alias("args"))


def flatten_path(paths: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, idx, px, py`` of SVG path strings ``d``: M L H V Q C Z, absolute and relative, repeated arguments too.

    ``keys`` name a path. Its moves become rows; where the pen stands is a
    segmented running sum of the relative moves, which an absolute one, a new
    subpath or a Z starts again. All windows have one order, so a path is sorted
    once and costs time in proportion to its length. A curve is sampled at
    ceil(max(3, min(30, chord / 0.25))) parameters.
    """
    up = F.upper("cmd")
    rel, move, close = F.col("cmd") != up, up == "M", up == "Z"
    last = lambda back: F.get("args", F.size("args") - 1 - back)
    zero = F.lit(0.0)
    value = {"x": F.when(up == "H", last(0)).when((up != "V") & ~close, last(1)), "y": F.when((up == "V") | ((up != "H") & ~close), last(0))}
    order = Window.partitionBy(*keys).orderBy("seg", "rep")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = path_moves(paths, keys).withColumns({"at": F.row_number().over(order), **{f"v{c}": v for c, v in value.items()}})

    # inside a piece (from a subpath's start or a Z on): the last absolute value, and the sum of the relative moves
    rows = rows.withColumns({f"sum_{c}": F.sum(F.when(rel & ~move & ~close, F.coalesce(f"v{c}", zero)).otherwise(zero)).over(upto) for c in "xy"} | {"piece": F.last(F.when(move | close, F.col("at")), ignorenulls=True).over(upto)})
    fixed = lambda c: F.struct(F.col("at"), F.col(f"v{c}").alias("v"), F.col(f"sum_{c}").alias("s"))
    rows = rows.withColumns(
        {f"abs_{c}": F.last(F.when(~rel & ~move & ~close & F.col(f"v{c}").isNotNull(), fixed(c)), ignorenulls=True).over(upto) for c in "xy"}
        | {f"from_{c}": F.last(F.when(move | close, F.col(f"sum_{c}")), ignorenulls=True).over(upto) for c in "xy"}
    )
    known = lambda c: F.coalesce(F.col(f"abs_{c}.at") > F.coalesce("piece", F.lit(0)), F.lit(False))
    # else the place is this much from the subpath's start
    rows = rows.withColumns({f"known_{c}": known(c) for c in "xy"} | {f"off_{c}": F.when(known(c), F.col(f"abs_{c}.v") + F.col(f"sum_{c}") - F.col(f"abs_{c}.s")).otherwise(F.col(f"sum_{c}") - F.coalesce(f"from_{c}", zero)) for c in "xy"})

    # starts of subpaths: known, or this much from the one before
    rows = rows.withColumns({f"prior_{c}": F.lag(F.struct(F.col(f"known_{c}").alias("k"), F.col(f"off_{c}").alias("v"))).over(order) for c in "xy"})
    sure = lambda c: ~rel | F.coalesce(F.col(f"prior_{c}.k"), F.lit(False))
    step = lambda c: F.when(rel, F.col(f"v{c}") + F.coalesce(F.col(f"prior_{c}.v"), zero)).otherwise(F.col(f"v{c}"))
    rows = rows.withColumns({f"go_{c}": F.sum(F.when(move & ~sure(c), step(c)).otherwise(zero)).over(upto) for c in "xy"})
    anchor = lambda c: F.last(F.when(move & sure(c), F.struct(step(c).alias("v"), F.col(f"go_{c}").alias("s"))), ignorenulls=True).over(upto)
    rows = rows.withColumns({f"anchor_{c}": anchor(c) for c in "xy"})
    start = lambda c: F.coalesce(F.col(f"anchor_{c}.v"), zero) + F.col(f"go_{c}") - F.coalesce(F.col(f"anchor_{c}.s"), zero)
    rows = rows.withColumns({c: F.when(F.col(f"known_{c}"), F.col(f"off_{c}")).otherwise(start(c) + F.col(f"off_{c}")) for c in "xy"})

    rows = rows.withColumns({f"pen_{c}": F.coalesce(F.lag(c).over(order), zero) for c in "xy"})
    dx, dy = F.col("x") - F.col("pen_x"), F.col("y") - F.col("pen_y")
    n = F.when(up.isin("Q", "C"), F.ceil(F.greatest(F.lit(3.0), F.least(F.lit(30.0), F.sqrt(dx * dx + dy * dy) / 0.25))).cast("int") - 1).otherwise(F.lit(1))
    rows = rows.withColumn("points", n)
    rows = rows.withColumn("first", F.coalesce(F.sum("points").over(before), F.lit(0))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("points"))))
    t = F.col("i") / F.col("points")
    u = 1.0 - t

    def drawn(c: str, k: int) -> Column:
        """The curve's coordinate; its control points have it at every second number from ``k``."""
        base = F.when(rel, F.col(f"pen_{c}")).otherwise(zero)
        a = lambda i: F.get("args", F.lit(i)) + base
        quad = u * u * F.col(f"pen_{c}") + 2.0 * u * t * a(k) + t * t * F.col(c)
        cube = u * u * u * F.col(f"pen_{c}") + 3.0 * u * u * t * a(k) + 3.0 * u * t * t * a(k + 2) + t * t * t * F.col(c)
        return F.when(up == "Q", quad).when(up == "C", cube).otherwise(F.col(c))

    return rows.select(*keys, (F.col("first") + F.col("i") - 1).cast("int").alias("idx"), drawn("x", 0).alias("px"), drawn("y", 1).alias("py"))


def path_candidates(paths: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    """Paths with at least ``least`` straight segments."""
    n = F.regexp_count("d", F.lit("[LHVlhv]"))
    return paths.filter(n >= least)
