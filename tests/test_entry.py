import __spark_entry__ as entry


def test_entry_gives_the_region_values(spark):
    rows = entry.entry(spark).collect()
    assert [r["player"] for r in sorted(rows, key=lambda r: r["player"])] == [0, 1, 2, 3, 4]


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
