"""Jobs whose work must not grow faster than their tables, nor stay in one task."""

from cloakwork.operators import health as H
from cloakwork.operators import report as P
from cloakwork.operators import veil as W
from cloakwork.plans import catalog
from cloakwork.sources import derived as D

SF = "/root/testdata/sf0.001"


def test_entries_are_measured_in_many_tasks(spark):
    """The table is one file, so one split; histograms are the kernel's, which compares no byte with each other one."""
    measured = catalog.shape_profile(spark, SF)
    assert measured.rdd.getNumPartitions() >= 16
    assert "lambdafunction" not in measured._jdf.queryExecution().executedPlan().toString()


def test_health_reads_each_setting_once(spark, monkeypatch):
    """A setting that stands in many files is classified once, and each of its places is named."""
    seen = []
    decide = H.decide
    monkeypatch.setattr(H, "decide", lambda entries: seen.append(entries.count()) or decide(entries))
    files = spark.createDataFrame([("r", f"m{i}/.env", "MEMO=Xy7abcdef012345\nMODE=a\n", False) for i in range(5)] + [("r", ".env", "MEMO=Xy7abcdef012345\nOTHER=\n", False)], "repo string, path string, content string, is_link boolean")
    vault = spark.createDataFrame([("r", "a", "no such value")], "repo string, ref string, value string")
    callers = spark.createDataFrame([("r", "human", "said so")], "repo string, caller string, reason string")
    found = H.health(files, vault, callers).where(f"check_no = {H.CHECKS.index('unrecognised')}").first()
    assert found.n == 6 and found.level == H.WARN and found.places[0] == ".env MEMO mixed-case-digits"
    assert seen == [3]


def test_projects_in_many_tasks(spark):
    assert D.projects(spark, SF).rdd.getNumPartitions() >= 16


def test_plan_report_measures_nothing_again(spark):
    """An Arrow function on top of the plan of `veil` is copied through it: planning ended neither in minutes nor in memory."""
    rows = [("DB_PASSWORD", "ab" * 8, None), ("LEVEL", None, 1.0), ("MEMO", "Xy7abcdef012345", 1.0), ("CLOUD", "AK" + "IA" + "A1B2" * 4, 1.0)]
    entries = spark.createDataFrame([("r", ".env", i, *x) for i, x in enumerate(rows)], "repo string, path string, record_no int, key string, value string, mine double")
    report = P.plan_report(W.veil(entries))
    assert "evenness" not in report._jdf.queryExecution().analyzed().toString().splitlines()[0]
    assert [(r.shape, r.prefix) for r in report.orderBy("record_no").collect()] == [("16 chars, hex, entropy 1.0", ""), ("", ""), ("<- read this one", ""), ("20 chars, alnum, entropy 2.3", "AK" + "IA")]
