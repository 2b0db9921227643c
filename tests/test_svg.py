"""SVG read by depth: nested definitions, quotes, groups and spans."""

from tidemark.sources import curves

PAGE = """<?xml version="1.0"?><!DOCTYPE svg><!-- <line x1="99"/> -->
<svg:svg xmlns:svg='x'><defs><g><defs><line x1="91"/></defs><line x1="92"/></g><text>hidden</text><line x1="93"/></defs>
<g transform="translate(1 2)"><line x1='0' y1='1' x2="2" y2='3' stroke='red' note="a > b"/>
 <g><g transform='scale(2)' ><path d='M0 0H5' stroke="k" fill='none' transform="rotate(30)"/></g>
 <path d="M1 1" stroke="k"/></g><polyline points='1,2 3,4'/></g>
<line x1="5" y1="bad"/><text y="7"><tspan x="4">0.5</tspan> &lt;<tspan x="9"> m
onths</tspan></text><text x="1" y="2">S &amp;amp; T</text><text x="3" y="3"> </text><text x="1" y="9"><![CDATA[a<b]]></text></svg:svg>
"""


def test_elements_by_depth(spark, tmp_path):
    (tmp_path / "f.svg").write_text(PAGE)
    (tmp_path / "g.svg").write_text("<svg><g transform='skewX(3)'/><line x1='1'/></svg>")
    path = str(tmp_path)
    lines = sorted((r.doc_id, r.x1, r.y1, r.x2, r.y2, r.stroke, r.transform) for r in curves.read_svg_lines(spark, path).collect())
    assert [x[:5] for x in lines] == [("f.svg", 0.0, 1.0, 2.0, 3.0), ("f.svg", 5.0, 0.0, 0.0, 0.0), ("g.svg", 1.0, 0.0, 0.0, 0.0)]
    assert [x[5:] for x in lines] == [("red", "translate(1 2)"), (None, None), (None, None)]
    texts = [(r.text, r.x, r.y) for r in curves.read_svg_texts(spark, path).orderBy("element_id").collect()]
    assert texts == [("0.5 < m onths", 4.0, 7.0), ("S &amp; T", 1.0, 2.0), ("a<b", 1.0, 9.0)]
    paths = [(r.d, r.transform) for r in curves.read_svg_paths(spark, path).orderBy("path_id").collect()]
    assert paths == [("M0 0H5", "translate(1 2) scale(2) rotate(30)"), ("M1 1", "translate(1 2)")]
    assert [(r.px, r.py) for r in curves.read_svg_polylines(spark, path).orderBy("idx").collect()] == [(1.0, 2.0), (3.0, 4.0)]


def test_long_path_and_many_groups(spark, tmp_path):
    d = "M0 0" + "L1 1" * 200_000
    (tmp_path / "f.svg").write_text("<svg>" + "".join(f"<g transform='t{i}'><line x1='{i}'/></g>" for i in range(3000)) + f"<path d='{d}' stroke='k'/></svg>")
    got = curves.read_svg_lines(spark, str(tmp_path)).collect()
    assert len(got) == 3000 and all(r.transform == f"t{int(r.x1)}" for r in got)
    assert curves.read_svg_paths(spark, str(tmp_path)).first().d == d


def test_a_page_fills_sheets(spark, sf_dir, monkeypatch):
    """However many lines a page has, no file and no row holds more than about a sheet of them."""
    from tidemark.plans import aggregates

    sizes, given = [], curves.read_svg_lines

    def read(session, path):
        sizes.extend(r.n for r in session.read.text(path, wholetext=True).selectExpr("length(value) AS n").collect())
        return given(session, path)

    monkeypatch.setattr(aggregates, "SHEET", 10, raising=False)
    monkeypatch.setattr(curves, "read_svg_lines", read)
    rows = aggregates.read_svg_lines(spark, sf_dir).collect()
    lines = aggregates.adapters.lines(spark, sf_dir).count()
    assert len(rows) == lines == len({r.label for r in rows}) and max(sizes) < 30 * 200 < sum(sizes) / 20
