"""Report files: round trip, and nothing left of a write that fails."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sheetwise.sources import reports

ROWS = [("A", '{"meta":{"n":1},"defects":[]}'), ("B/ü x", '{"meta":{"n":null,"t":"Ø"},"defects":[{"id":"D-001"}]}'), ("C", "{}")]


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if not f.endswith(".crc"))


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame(ROWS, reports.REPORT).repartition(3)
    reports.write_reports(df, path)
    assert files(path) == ["A/report.json", "B%2F%C3%BC x/report.json", "C/report.json"]
    assert open(f"{path}/A/report.json").read() == json.dumps(json.loads(ROWS[0][1]), indent=2)
    assert sorted(map(tuple, reports.read_reports(spark, path).collect())) == sorted(ROWS)
    reports.write_reports(df.where("pair_id <> 'C'").withColumn("json", F.lit('{"x": 2}')), path)
    assert {r["pair_id"]: r["json"] for r in reports.read_reports(spark, path).collect()} == {"A": '{"x":2}', "B/ü x": '{"x":2}'}
    assert not [d for d in os.listdir(path) if d.startswith("_")]
    assert reports.read_reports(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("bad", [[("D", "{not json")], [(None, "{}")], [("A", "{}")]])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    path = str(tmp_path / "out")
    df = spark.createDataFrame(ROWS, reports.REPORT).repartition(3)
    reports.write_reports(df, path)
    before = {f: open(os.path.join(path, f)).read() for f in files(path)}
    with pytest.raises(Exception, match="."):
        reports.write_reports(df.withColumn("json", F.lit('{"x": 2}')).unionAll(spark.createDataFrame(bad, reports.REPORT)), path)
    assert {f: open(os.path.join(path, f)).read() for f in files(path)} == before and not [d for d in os.listdir(path) if d.startswith("_")]
