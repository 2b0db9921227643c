"""Hand-worked cases, properties, and numpy counterparts of operators that SQL cannot express."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import calibrate, cluster, nma, shape, spatial, survival, validate
from tidemark.plans import adapters, jobs
from tidemark.sources import curves, sinks
from tidemark.streaming.incremental import incremental_curves


def curve(spark, ys, ts=None, key=(0, 0)):
    ts = ts or [float(i) for i in range(len(ys))]
    return spark.createDataFrame([(*key, i, float(t), float(y)) for i, (t, y) in enumerate(zip(ts, ys))], "figure_id int, curve_id int, seq int, time double, survival double")


def values(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy("time", "seq" if "seq" in df.columns else "time").collect()]


def test_kaplan_meier_by_hand(spark):
    ipd = spark.createDataFrame([("s", t, e) for t, e in zip([1.0, 2.0, 2.0, 3.0, 5.0], [1, 1, 0, 0, 1])], "g string, time double, event int")
    rows = survival.km_fit(ipd, ["g"]).orderBy("time").collect()
    assert [r.n_risk for r in rows] == [5, 4, 2, 1]
    assert np.allclose([r.survival for r in rows], [0.8, 0.6, 0.6, 0.0])
    assert all(a.n_risk >= b.n_risk for a, b in zip(rows, rows[1:]))


def test_plateaus_by_hand(spark):
    seg = shape.segment_plateaus(curve(spark, [1, 1, 1, 0.8, 0.8, 0.8, 0.5, 0.5])).orderBy("segment").collect()
    assert [r.level for r in seg] == [1.0, 0.8, 0.5]


def test_folds_of_a_long_curve_keep_every_jump(spark):
    c = curve(spark, [1.0 - 0.5 * (i % 2) for i in range(60_000)])
    assert shape.keep_significant(c).count() == shape.dedupe_consecutive(c, 0.1).count() == 60_000
    assert shape.step_regularize(c, 0.1).count() == 60_000
    assert values(shape.isotonic_min_max(c), "survival")[::30_000] == [1.0, 0.75]


def test_keep_significant_by_hand(spark):
    assert values(shape.keep_significant(curve(spark, [1, 0.997, 0.994, 0.99])), "survival") == [1.0, 0.994]


def test_anchor_and_gap_rows(spark):
    words = spark.createDataFrame([(0, i, float(t), 0.0) for i, t in enumerate([0, 8, 16])], "figure_id int, word_id long, top double, left double")
    assert [r.row_id for r in cluster.cluster_rows_anchor(words, ["figure_id"]).orderBy("word_id").collect()] == [0, 0, 1]
    assert {r.row_id for r in cluster.cluster_rows_gap(words, ["figure_id"]).collect()} == {0}


def test_bin_edge(spark):
    c = curve(spark, [1, 0.9, 0.8], [0.2, 1.0, 2.0])
    assert shape.bin_time(c).count() == 3
    assert shape.bin_time(c, drop_last_edge=True).count() == 2


def test_rank_and_league(spark):
    hr = spark.createDataFrame([("A", 1.0), ("B", 0.5), ("C", 2.0)], "treatment string, hr double")
    assert {r.treatment: r.sucra for r in nma.rank_treatments(hr).collect()} == {"B": 100.0, "A": 50.0, "C": 0.0}
    cell = lambda w: {(r.row, r.col): r.cell for r in nma.league_long(hr, w).collect()}
    assert cell(False)["A", "B"] == "2.00" and cell(False)["B", "A"] == "0.50" and cell(True)["B", "A"] == "2.00"
    assert nma.league_table(hr).columns == ["row", "A", "B", "C"]


def test_isotonic_by_hand_and_both_forms(spark):
    c = curve(spark, [1, 0.6, 0.8, 0.4])
    assert np.allclose(values(shape.isotonic_min_max(c), "survival"), [1, 0.7, 0.7, 0.4])
    rng = np.random.default_rng(1)
    y = np.linspace(1, 0, 60) + rng.normal(0, 0.1, 60)
    want = shape.falling_fit(y, np.ones(60))
    got = values(shape.isotonic_min_max(curve(spark, y)), "survival")
    assert np.allclose(got, want) and all(a >= b - 1e-12 for a, b in zip(got, got[1:]))
    clean = values(shape.isotonic_clean(curve(spark, y), 1, 0.0), "survival")
    assert all(0 <= v <= 1 for v in clean) and clean == sorted(clean, reverse=True)


def test_even_sequence_and_numbers(spark):
    df = spark.createDataFrame([(1, [0.0, 12.0, 24.0, 36.0, 41.0, 48.0, 60.0, 95.0])], "k int, nums array<double>")
    assert calibrate.even_sequence(df, ["k"]).first().seq == [0, 12, 24, 36, 48, 60]
    t = spark.createDataFrame([("0% 50% 1.0",)], "t string")
    assert t.select(scalar.extract_numbers(F.col("t"), "y")).first()[0] == [0, 0.5, 1.0]


@pytest.mark.parametrize(
    "ys, ts, reason",
    [
        ([1, 0.5], [0, 60], "too few points"),
        ([1, 0.9] * 60, None, "survival range too small"),
        (np.linspace(1, 0, 120), list(np.linspace(0, 4, 120)), "time range too small"),
        (np.linspace(1, -0.5, 120), None, "survival below 0"),
        (np.linspace(1.5, 0, 120), None, "survival above 1"),
        (np.linspace(1, 0, 120), list(np.linspace(-5, 60, 120)), "starts before 0"),
        (np.linspace(1, 0, 120), list(np.linspace(60, 0, 120)), "time runs backward"),
        (np.linspace(1, 0, 120), None, None),
    ],
)
def test_rejections(spark, ys, ts, reason):
    assert validate.validate_curve(curve(spark, ys, ts)).first().reason == reason


def test_decimate_keeps_ends(spark):
    got = values(shape.decimate(curve(spark, np.linspace(1, 0, 1000)), 50), "seq")
    assert got[0] == 0 and got[-1] == 999 and len(got) <= 60


def test_round_trip(spark):
    t = np.linspace(0, 60, 400)
    truth = np.exp(-t / 30)
    noisy = np.clip(truth + np.random.default_rng(42).normal(0, 0.02, 400), 0, 1)
    clean = shape.isotonic_clean(curve(spark, noisy, list(t)), 1, 0.0)
    r = validate.curve_agreement(curve(spark, truth, list(t)), clean, 60.0, n=50).first()
    assert r.rmse < 0.02 and r.tau > 0.9


def test_flatten_path(spark):
    paths = spark.createDataFrame([(1, "M10,10 h5 5 v-2 L 30 8 Q 35 8 40 20 c 1 1 2 2 3 3 Z")], "k int, d string")
    pts = [(r.px, r.py) for r in spatial.flatten_path(paths, ["k"]).orderBy("idx").collect()]
    assert pts[:5] == [(10, 10), (15, 10), (20, 10), (20, 8), (30, 8)]
    assert (40.0, 20.0) in pts and (43.0, 23.0) in pts and pts[-1] == (10, 10)


def test_connected_areas_and_dotted(spark):
    px = [(0, x, 0) for x in range(10)] + [(0, x, 9) for x in range(5)] + [(0, 4, y) for y in range(20, 25)]
    a = cluster.connected_areas(spark.createDataFrame(px, "figure_id int, x int, y int"), ["figure_id"]).collect()
    assert sorted(r.area for r in a) == [21, 21, 36]
    dots = [(0, x, 5) for x in range(0, 600) if x % 12 < 4]
    line = [(1, x, 5 + x // 3) for x in range(0, 600)] + [(1, x, 6 + x // 3) for x in range(0, 600)]
    s = {r.figure_id: r for r in cluster.dotted_score(spark.createDataFrame(dots + line, "figure_id int, x int, y int"), ["figure_id"]).collect()}
    assert s[0].is_dotted and not s[1].is_dotted


def test_kmeans_finds_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(0, i, *map(float, rng.normal(c, 0.05, 3))) for i, c in enumerate([0, 1, 2] * 40)]
    df = spark.createDataFrame(rows, "figure_id int, id long, f0 double, f1 double, f2 double")
    got = cluster.kmeans_groups(df, ["figure_id"], 3, rounds=3).collect()
    assert {(r.id % 3, r.cluster) for r in got} == {(0, 0), (1, 1), (2, 2)}
    for method in ("silhouette", "elbow", "combined"):
        assert cluster.auto_k(df, ["figure_id"], most=4, rounds=2, method=method).first().k in (2, 3)


def test_cox_against_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [("s", a, float(t), int(e)) for a, lam in (("A", 0.1), ("B", 0.2)) for t, e in zip(np.ceil(rng.exponential(1 / lam, 150)), rng.random(150) < 0.8)]
    hr = {r.treatment: r for r in nma.cox_hr(spark.createDataFrame(rows, "study_id string, arm string, time double, event int")).collect()}
    x, t, e = np.array([r[1] == "B" for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows])

    def loglik(b):
        out = 0.0
        w = np.exp(b * x)
        for s in np.unique(t[e == 1]):
            die, risk = (t == s) & (e == 1), t >= s
            d = die.sum()
            out += b * x[die].sum() - sum(np.log(w[risk].sum() - k / d * w[die].sum()) for k in range(d))
        return out

    grid = np.linspace(-1, 2, 3001)
    best = grid[np.argmax([loglik(b) for b in grid])]
    assert abs(np.log(hr["B"].hr) - best) < 2e-3 and hr["A"].hr == 1.0 and hr["B"].lower < hr["B"].hr < hr["B"].upper


def test_parametric_fit(spark):
    t = np.linspace(0.5, 60, 80)
    fit = shape.parametric_fit(curve(spark, np.exp(-((t / 25) ** 1.4)), list(t)), rounds=12).first()
    assert abs(fit.lam - 25) < 0.1 and abs(fit.k - 1.4) < 0.01


def test_robust_axis_ignores_a_bad_tick(spark):
    rows = [(0, float(p), 2.0 * p + 1) for p in range(10)] + [(0, 4.5, 60.0)]
    f = calibrate.fit_axis_robust(spark.createDataFrame(rows, "k int, pos double, value double"), ["k"]).first()
    assert abs(f.slope - 2) < 0.05 and abs(f.intercept - 1) < 0.5


def test_files_streams_and_results(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n, ys in ((1, np.linspace(1, 0, 150)), (2, [1, 0.9])):
        (src / f"paper_p2_f3_curve{n}.csv").write_text("time,survival\n" + "\n".join(f"{i * 0.4},{y}" for i, y in enumerate(ys)))
    pts = curves.read_curve_points(spark, str(src))
    assert {(r.doc_id, r.page, r.figure_id, r.curve_id) for r in pts.collect()} == {("paper", 2, 3, 0), ("paper", 2, 3, 1)}
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        incremental_curves(spark, str(src), out, str(tmp_path / "check")).awaitTermination()
    verdicts = spark.read.parquet(f"{out}/verdicts")
    assert verdicts.count() == 2 and verdicts.filter("is_valid").count() == 1
    (tmp_path / "r.json").write_text(json.dumps([{"pdf_name": "a", "figures": [{"figure_id": "f1", "page": 1, "curves": [{"curve_id": 0, "n_points": 9}]}], "errors": []}]))
    assert [r.csv_path for r in sinks.curve_catalog(curves.read_results(spark, str(tmp_path / "r.json"))).collect()] == ["a_p1_f1_curve1.csv"]
    (tmp_path / "f.svg").write_text('<svg><defs><line x1="9"/></defs><line x1="0" y1="1" x2="2" y2="3" stroke="red"/><text x="1" y="2">0.5</text><path d="M0 0H5" stroke="k" fill="none"/><polyline points="1,2 3,4"/></svg>')
    svg = str(tmp_path / "f.svg")
    assert [(r.x1, r.y2, r.stroke) for r in curves.read_svg_lines(spark, svg).collect()] == [(0.0, 3.0, "red")]
    assert [r.text for r in curves.read_svg_texts(spark, svg).collect()] == ["0.5"]
    assert curves.read_svg_paths(spark, svg).count() == 1 and curves.read_svg_polylines(spark, svg).count() == 2


def test_pixels_of_an_image(spark, tmp_path):
    import struct
    import zlib

    rows = [[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (9, 8, 7)]]
    raw = b"".join(b"\0" + bytes(v for px in r for v in px) for r in rows)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    got = {(r.x, r.y): (r.r, r.g, r.b) for r in curves.read_image_pixels(spark, str(tmp_path / "a.png")).collect()}
    assert got == {(x, y): rows[y][x] for y in range(2) for x in range(2)}


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
    assert adapters.points(spark, "/root/testdata/sf0.001").count() > 0


def test_twinless_queries_see_their_whole_tables(spark, tmp_path):
    from tidemark import registry
    from tidemark.plans import figures

    registry.load()
    larger = "/root/testdata/sf0.01"
    points = adapters.points(spark, larger)
    drawn = figures._paths(spark, larger).agg(F.sum(F.regexp_count("d", F.lit("[MV]")))).first()[0]
    assert drawn == points.count() > points.filter("seq < 40").count()
    spark.createDataFrame([(k, 1, "O", "1") for k in range(1, 40) if k % 5], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    assert [r.doc_id for r in registry.QUERIES["fit_axis_robust"](spark, str(tmp_path)).collect()] == [1]


def test_neighbours_across_a_wide_figure(spark):
    rows = [(0, i, 3000 * i, 7) for i in range(4)] + [(1, i, i, 0) for i in range(9)] + [(1, 9, 5000, 5000)]
    near = cluster.knn_join(spark.createDataFrame(rows, "f int, id long, x int, y int"), ["f"], 5)
    counts = {(r.f, r.id): r["count"] for r in near.groupBy("f", "id").count().collect()}
    assert counts == {**{(0, i): 3 for i in range(4)}, **{(1, i): 5 for i in range(10)}}


def test_logrank_of_two_groups_is_the_two_group_test_and_of_three_is_right(spark):
    rows = [("a", g, float(t), int((t + len(g)) % 3 > 0)) for g in ("x", "yy") for t in range(1, 20 + 4 * len(g))]
    ipd = spark.createDataFrame(rows, "study_id string, arm string, time double, event int")
    two, many = survival.logrank(ipd, ["study_id"], "arm").first(), survival.logrank_test(ipd, ["study_id"], "arm").first()
    assert (many.groups, many.df) == (2, 1) and abs(two.chi2 - many.chi2) < 1e-9 and abs(many.p_value - survival.chi2_tail(two.chi2, 1)) < 1e-12
    # three groups by hand: one event a time, risk sets falling by one
    rows = [("s", g, t, 1) for g, t in zip("abcabc", (1.0, 2.0, 3.0, 4.0, 5.0, 6.0))]
    got = survival.logrank_test(spark.createDataFrame(rows, "study_id string, arm string, time double, event int"), ["study_id"], "arm").first()
    gap, cov = np.zeros(3), np.zeros((3, 3))
    for i, (_, g, _, _) in enumerate(rows):
        left = [r[1] for r in rows[i:]]
        share = np.array([left.count(x) for x in "abc"]) / len(left)
        gap += np.array([g == x for x in "abc"]) - share
        cov += np.diag(share) - np.outer(share, share)
    assert abs(got.chi2 - gap[:2] @ np.linalg.solve(cov[:2, :2], gap[:2])) < 1e-9 and got.df == 2


def test_numbers_of_ranges_and_next_to_letters(spark):
    cases = {"0-60": [0, 60], "0.0 - 1.0": [0, 1], "12. and .5": [5, 12], "p5 5p 7": [7], "0.5x": [0], "-3 to 4": [3, 4], "": []}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", scalar.extract_numbers(F.col("t"), "x").alias("x"))
    assert {r.t: r.x for r in df.collect()} == {t: [float(v) for v in x] for t, x in cases.items()}


def test_unmixed_curves_carry_labels_from_bin_to_bin(spark):
    px = [(0, 10), (1, 20), (2, 10), (31, 21), (32, 40), (61, 12), (62, 39)]
    df = spark.createDataFrame([("s", x, y) for x, y in px], "style string, x int, y int")
    got = {(r.x, r.y): (r.bin, r.k, r.label) for r in cluster.unmix_overlaps(df, ["style"]).collect()}
    # classes of bin 1: 10 and 10 in turn, then 20 again the first, so their means are 15 and 10
    assert got[0, 10] == (1, 2, 1) and got[2, 10] == (1, 2, 2) and got[1, 20] == (1, 2, 1)
    # 21 and 40 are both nearest to the mean 15; 12 and 39 then have one curve to follow
    assert got[31, 21] == (2, 2, 1) and got[32, 40] == (2, 2, 1) and got[61, 12] == (3, 2, 1)
    one = spark.createDataFrame([("s", x, 5) for x in range(90)], "style string, x int, y int")
    assert {r.label for r in cluster.unmix_overlaps(one, ["style"]).collect()} == {1}


def test_c_index_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(s, float(t), int(e), int(r)) for s in "ab" for t, e, r in zip(rng.integers(1, 40, 80), rng.random(80) < 0.6, rng.integers(0, 9, 80))] + [("c", 1.0, 1, 2)]
    got = {r.s: r for r in survival.c_index(spark.createDataFrame(rows, "s string, time double, event int, risk int"), ["s"], "risk").collect()}
    assert set(got) == {"a", "b"}
    for s in "ab":
        pairs = [(a[3] > b[3]) + 0.5 * (a[3] == b[3]) for a in rows for b in rows if a[0] == b[0] == s and a[2] == 1 and b[1] > a[1]]
        assert got[s].pairs == len(pairs) and abs(got[s].c_index - sum(pairs) / len(pairs)) < 1e-9


def test_panel_modes_and_fitted_points(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 10.0, 0.0, 10.0, 5.0, False), (1, 2, 0.0, 9.0, 0.0, 10.0, 1.0, True)], "doc_id int, panel_id int, xmin double, xmax double, ymin double, ymax double, y_max double, nar_hit boolean")
    scored = spatial.score_panels(p, ["doc_id"])
    pick = lambda mode: sorted(r.panel_id for r in spatial.choose_panels(scored, ["doc_id"], mode).collect())
    assert (pick("best"), pick("largest"), pick("all")) == ([2], [1], [1, 2])
    with pytest.raises(ValueError):
        spatial.choose_panels(scored, ["doc_id"], "first")
    c = curve(spark, [1, 0.5], [0, 99])
    fit = shape.fitted_curve(c, c.groupBy("figure_id", "curve_id").agg(F.lit(50.0).alias("lam"), F.lit(2.0).alias("k"))).orderBy("seq").collect()
    assert [r.time for r in fit] == [float(i) for i in range(100)] and abs(fit[50].survival - np.exp(-1)) < 1e-12


def test_page_analysis_of_a_drawn_page(spark):
    line = lambda i, *xy: (1, i, *map(float, xy), "black", "", 1.0)
    lines = [line(1, 100, 300, 400, 300), line(2, 100, 100, 100, 300), line(3, 400, 100, 400, 300), (1, 4, 420.0, 50.0, 440.0, 50.0, "red", "", 1.0), line(5, 250, 198, 250, 202)]
    words = [(1, 0, "Treated", 445.0, 50.0), (1, 1, "0", 100.0, 310.0), (1, 2, "60", 400.0, 310.0), (1, 3, "1", 80.0, 100.0), (1, 4, "0", 80.0, 300.0)]
    words += [(1, 10 + k, str(90 - 30 * k), 120.0 + 100 * k, 335.0) for k in range(3)]
    df = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    out = jobs.page_analysis(
        df(lines, "doc_id int, line_id long, x1 double, y1 double, x2 double, y2 double, stroke string, dash string, sw double"),
        df(words, "doc_id int, word_id long, text string, left double, top double"),
        df([(1, 7, "M 100 100 H 250 V 200 H 400", "red", "", 1.0)], "doc_id int, path_id long, d string, stroke string, dash string, sw double"),
    )
    assert out["chosen"].count() == 1 and out["chosen"].first().nar_hit
    assert sorted((r.time, r.survival) for r in out["curves"].collect()) == [(0.0, 1.0), (30.0, 0.5), (30.0, 1.0), (60.0, 0.5)]
    assert {(r.style_key, r.label) for r in out["curves"].collect()} == {("red|solid|1", "Treated")}
    # the two levels of one style are told apart in the bin they share
    assert [(r.line_id, r.length) for r in out["ticks"].collect()] == [(5, 4.0)]
    assert 90.0 in {r.num for r in out["nar"].collect()}
