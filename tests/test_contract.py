import __spark_entry__ as entry

from conftest import SF001


def test_catalogue_and_oracles_line_up():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert len(qs) >= 50
    assert set(sql) <= set(qs)
    from feedloom.plans.registry import QUERIES
    extra = set(qs) - set(QUERIES)
    assert all(name.startswith("op") or name == "pipeline" for name in extra)


def test_entry_runs_on_smallest_scale(spark):
    df = entry.entry(spark)
    assert df.columns == ["feed_url", "title", "n_items", "n_valid", "n_rejected", "valid_seconds", "n_explicit"]
    rows = df.collect()
    assert rows and all(r.n_items == r.n_valid + r.n_rejected for r in rows)


def test_flagship_plan_prunes_columns(spark):
    plan = entry.queries()["feed_catalog"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string,n_chars:bigint>" in plan
