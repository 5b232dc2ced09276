"""Every registered query of the core against its SQL, at the smallest size."""

import pytest

from lintel import plans
from oracle import connect, spark_rows, sql_rows


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sf, con, name):
    got = spark_rows(plans.queries()[name](spark, sf))
    assert got[1]
    if name in plans.oracle_sql():
        assert got == sql_rows(con, plans.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as e

    rows = {r["lang"]: r for r in e.entry(spark).collect()}
    assert rows and all(r["residual"] == 0 and r["removed"] > 0 for r in rows.values())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scan_is_pruned(spark, sf):
    plan = plans.queries()["job_latest"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "partial_max" in plan


def test_text_queries_do_not_shuffle(spark, sf):
    for name in ("text_strip", "text_inspect", "text_clean_report", "removed_merge", "admission_gate"):
        plan = plans.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == (name == "admission_gate")


def test_the_whole_job_is_one_scan(spark, tmp_path):
    from lintel.operators import process

    rows = [(1, "a.txt", "x​".encode()), (2, "b.docx", b"no"), (3, "c.pdf", b"p"), (4, "d.txt", None)]
    spark.createDataFrame([(i, n, None if c is None else bytearray(c)) for i, n, c in rows], "job_id long, name string, content binary").write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files").selectExpr("*", "cast(null as string) as content_type")
    asked = process.process_files(files, lambda data, name: (200, '{"cleaned": "Qg==", "kind": "pdf", "report": {"removedCount": 1}}'))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    got = {r["job_id"]: (r["status"], r["cleaned"] and bytes(r["cleaned"]), r["error"]) for r in asked.collect()}
    assert got[1] == ("done", b"x", None) and got[2][0] == "error" and got[2][2].startswith("not_docx: ") and got[3] == ("done", b"B", None) and got[4] == ("error", None, "original object missing")
