import __spark_entry__ as E

from conftest import SF_SMALL


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["tag", "n_chunks", "n_files"]


def test_every_query_runs_at_smallest_scale(spark):
    qs = E.queries()
    assert set(E.oracle_sql()) <= set(qs)
    for name, fn in qs.items():
        df = fn(spark, SF_SMALL)
        df.limit(5).collect()
        assert len(df.columns) == len(set(df.columns)), name
