import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["series_id", "date", "PM25", "PM10", "temp", "hum", "pres", "wind", "winddir", "CAT",
                          "CAT_24h", "CAT_48h", "CAT_72h"]


def test_every_oracle_has_a_query():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 60
