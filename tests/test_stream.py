"""Ingest that is killed and started again."""

import shutil

import numpy as np
import pytest

from tidemark.streaming import incremental
from tidemark.streaming.incremental import committed, incremental_curves, read_committed


@pytest.fixture()
def folder(tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def add(n, ys):
        (src / f"paper_p2_f3_curve{n}.csv").write_text("time,survival\n" + "\n".join(f"{i * 0.4},{y}" for i, y in enumerate(ys)))

    add(1, np.linspace(1, 0, 150))
    add(2, [1, 0.9])
    return str(src), str(tmp_path / "out"), str(tmp_path / "check"), add


def run(spark, folder):
    incremental_curves(spark, folder[0], folder[1], folder[2]).awaitTermination()


def rows(spark, folder, table):
    return read_committed(spark, folder[1], table).count()


def state(spark, folder):
    catalog = sorted((r.csv_path, r.n_points, r.calibration_valid) for r in read_committed(spark, folder[1], "catalog").collect())
    return catalog, rows(spark, folder, "verdicts"), read_committed(spark, folder[1], "points").select("curve_id").distinct().count()


BOTH = ([("paper_p2_f3_curve1.csv", 150, True), ("paper_p2_f3_curve2.csv", 2, False)], 2, 1)


@pytest.mark.parametrize("where", ["decimate", "curve_file", "_commit"])
def test_killed_between_two_writes(spark, folder, monkeypatch, where):
    owner = incremental.shape if where == "decimate" else incremental

    def die(*_, **__):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(owner, where, die)
        with pytest.raises(Exception, match="killed"):
            run(spark, folder)
    # something was written, nothing of it is seen
    assert (folder[1] and committed(spark, folder[1]).count() == 0) and all(rows(spark, folder, t) == 0 for t in incremental.TABLES)
    run(spark, folder)
    assert state(spark, folder) == BOTH
    run(spark, folder)
    assert state(spark, folder) == BOTH and committed(spark, folder[1]).count() == 1


def test_killed_after_the_log_and_new_files(spark, folder):
    run(spark, folder)
    # the batch ended, but the stream's own checkpoint does not know
    shutil.rmtree(f"{folder[2]}/commits")
    run(spark, folder)
    assert state(spark, folder) == BOTH and committed(spark, folder[1]).count() == 1
    folder[3](3, np.linspace(1, 0.2, 200))
    run(spark, folder)
    catalog, verdicts, curves = state(spark, folder)
    assert len(catalog) == verdicts == 3 and curves == 2 and committed(spark, folder[1]).count() == 2
    with pytest.raises(ValueError):
        read_committed(spark, folder[1], "other")
