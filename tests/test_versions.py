"""The sink with versions: hours change together, by the commit file alone."""

import glob
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from adfunnel import SPEC_A
from adfunnel.sources import versions
from adfunnel.sources.derived import derive_dims, derive_facts
from adfunnel.sources.versions import commit_hours, drop_superseded, read_hours
from adfunnel.streaming.hourly import catch_up, hourly_report, run_hours
from tables_at import SF_CHECK

H = [f"2024-01-01T0{i}" for i in range(5)]


def report(spark, rows):
    return spark.createDataFrame(rows, "dt string, n long")


def content(spark, path, *hours):
    return sorted(tuple(r) for r in read_hours(spark, path, *hours).select("dt", "n").collect())


def test_hours_are_replaced_and_cleared(spark, tmp_path):
    path = str(tmp_path / "sink")
    assert commit_hours(report(spark, [(H[0], 1), (H[1], 2), (H[1], 2)]), path, H[:3]) == 0
    assert commit_hours(report(spark, [(H[1], 5), (H[3], 4)]), path, H[1:4]) == 1
    assert content(spark, path) == [(H[0], 1), (H[1], 5), (H[3], 4)]
    assert content(spark, path, H[1], H[3]) == [(H[1], 5)]
    commit_hours(report(spark, []), path, [H[0]])
    assert content(spark, path) == [(H[1], 5), (H[3], 4)]
    assert read_hours(spark, path, H[4]).columns == ["n", "dt"]


def test_nothing_committed(spark, tmp_path):
    with pytest.raises(ValueError, match="nothing was committed"):
        read_hours(spark, str(tmp_path))
    assert drop_superseded(spark, str(tmp_path)) == 0
    with pytest.raises(ValueError, match="one hour at least"):
        commit_hours(report(spark, []), str(tmp_path), [])


def test_a_run_that_dies_leaves_the_former_hours(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "sink")
    commit_hours(report(spark, [(H[0], 1), (H[1], 2)]), path, H[:2])

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # after the data, before the commit file
        m.setattr(versions, "_commit_files", dies)
        with pytest.raises(RuntimeError, match="lost"):
            commit_hours(report(spark, [(H[0], 7), (H[1], 8)]), path, H[:2])
    assert len(glob.glob(f"{path}/runs/run=*")) == 2
    assert content(spark, path) == [(H[0], 1), (H[1], 2)]
    # a task that fails while writing
    bad = report(spark, [(H[0], 7), (H[1], 8)]).withColumn(
        "n", F.when(F.col("dt") == H[1], F.raise_error(F.lit("task lost")).cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="task lost"):
        commit_hours(bad, path, H[:2])
    # a commit file cut short
    with open(f"{path}/commits/000000000001.json", "w") as f:
        f.write('{"number": 1, "run": "abc", "hours": ["' + H[0])
    assert content(spark, path) == [(H[0], 1), (H[1], 2)]
    assert commit_hours(report(spark, [(H[0], 9)]), path, H[:2]) == 2
    assert content(spark, path) == [(H[0], 9)]


def test_rows_of_other_hours_raise(spark, tmp_path):
    path = str(tmp_path / "sink")
    commit_hours(report(spark, [(H[0], 1)]), path, H[:1])
    with pytest.raises(ValueError, match=H[2]):
        commit_hours(report(spark, [(H[0], 3), (H[2], 4)]), path, H[:1])
    assert content(spark, path) == [(H[0], 1)]


def test_rows_are_written_once(spark, tmp_path):
    path = str(tmp_path / "sink")
    commit_hours(report(spark, [(H[0], 1), (H[1], 2)]), path, H[:2])
    files = glob.glob(f"{path}/**/*.parquet", recursive=True)
    assert len(files) == 2 and all("/runs/run=" in f for f in files)


def test_numbers_are_never_taken_twice(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "sink")
    commit_hours(report(spark, [(H[0], 1)]), path, H[:1])
    monkeypatch.setattr(versions, "_commit_files", lambda *_: [])  # another run was faster
    assert commit_hours(report(spark, [(H[0], 2)]), path, H[:1]) == 1
    assert content(spark, path) == [(H[0], 2)]


def test_superseded_hours_go(spark, tmp_path):
    path = str(tmp_path / "sink")
    commit_hours(report(spark, [(H[0], 1), (H[1], 2)]), path, H[:2])
    commit_hours(report(spark, [(H[0], 3)]), path, H[:1])
    os.makedirs(f"{path}/runs/run=unfinished/dt={H[0]}")
    before = content(spark, path)
    assert drop_superseded(spark, path) == 1  # the first run's H[0]; the unfinished run is young
    assert drop_superseded(spark, path, unfinished_after_hours=0) == 1
    assert drop_superseded(spark, path, unfinished_after_hours=0) == 0
    assert content(spark, path) == before == [(H[0], 3), (H[1], 2)]


def test_columns_of_the_last_commit(spark, tmp_path):
    path = str(tmp_path / "sink")
    commit_hours(report(spark, [(H[0], 1)]), path, H[:1])
    commit_hours(report(spark, [(H[1], 2)]).withColumn("more", F.lit("x")), path, H[1:2])
    got = sorted(map(tuple, read_hours(spark, path).select("dt", "n", "more").collect()))
    assert got == [(H[0], 1, None), (H[1], 2, "x")]


def test_hourly_runs_into_versions(spark, tmp_path):
    facts, dims, sink = derive_facts(spark, SF_CHECK), derive_dims(spark, SF_CHECK), str(tmp_path / "sink")
    start, end = "2024-01-02T05", "2024-01-02T11"
    want = hourly_report(facts, dims, SPEC_A, start, end)
    run_hours(facts, dims, SPEC_A, start, end, sink, commit_hours)
    assert want.count() > 0
    got = read_hours(spark, sink).select(*want.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert catch_up(spark, facts, dims, SPEC_A, start, end, sink, write=commit_hours)
    assert catch_up(spark, facts, dims, SPEC_A, start, end, sink, write=commit_hours) == []
    fewer = replace(facts, impressions=facts.impressions.where("dt <> '2024-01-02T07'"))
    assert catch_up(spark, fewer, dims, SPEC_A, start, end, sink, write=commit_hours) == ["2024-01-02T07"]
    again = hourly_report(fewer, dims, SPEC_A, start, end)
    got = read_hours(spark, sink).select(*again.columns)
    assert got.exceptAll(again).count() == again.exceptAll(got).count() == 0
