"""The whole comparison settles what it reads more than once."""

from sheetwise.operators import defects
from sheetwise.plans import compare as plan
from sheetwise.plans import queries


def test_findings_tables_and_zones_are_worked_out_once(spark, monkeypatch):
    kept = []

    def keep(df):
        kept.append(df.columns)
        return spark.createDataFrame([], df.schema)

    monkeypatch.setattr(plan, "keep", keep)
    queries.compare_pages(spark, "/root/testdata/sf0.001")
    assert sum(set(c) == set(defects.FINDING) for c in kept) == 2  # before the missing zones, and with them
    assert sum("table_id" in c for c in kept) >= 5 and sum("signature" in c for c in kept) == 2
