"""Every registered query against its SQL oracle on the smallest tables."""


def test_all_queries_match_oracle(spark, sf_small):
    from tools.oracle_check import check
    res = check(spark, sf_small, verbose=False)
    bad = {k: v for k, v in res.items() if not (v.startswith("ok") or v.startswith("rows-only"))}
    assert not bad, bad

def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert set(df.columns) == {"feed", "change", "n"} and df.count() > 0
