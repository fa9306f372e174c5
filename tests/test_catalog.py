"""Each query of the library against its SQL in DuckDB, on the smallest tables; some whose rare branches need more rows on larger ones too."""

import duckdb
import pytest

from cloakwork.plans import catalog

SF = "/root/testdata/sf0.001"
LARGER = ("guard_texts", "suspect_reasons", "project_policies", "redact_logs", "uncovered_lines")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(str).replace({"None": "nan", "<NA>": "nan", "NaN": "nan"})
    return sorted(map(tuple, frame.to_numpy().tolist()))


@pytest.mark.parametrize("name,sf", [(n, SF) for n in sorted(catalog.ORACLES)] + [(n, "/root/testdata/sf0.01") for n in LARGER])
def test_same_as_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("customer", "supplier", "events", "documents", "part", "orders"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) and rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
