"""The driver contract."""

import __spark_entry__ as entry


def test_flagship(spark):
    assert entry.entry(spark).count() >= 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_match_their_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name in ("mule_accounts", "circular_transfers", "window_features", "clock_jumps", "custody_audit"):
        got = entry.queries()[name](spark, sf_dir).toPandas()
        want = con.execute(entry.oracle_sql()[name]).df()[list(got.columns)]
        as_rows = lambda p: sorted(tuple(map(str, r)) for r in p.itertuples(index=False))
        assert as_rows(got) == as_rows(want), name
