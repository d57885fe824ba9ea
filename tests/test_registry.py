import re

import __spark_entry__ as entry


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs_on_the_smallest_tables(spark):
    out = entry.entry(spark)
    assert out.columns == ["horizon", "ticker", "n", "always_up", "momentum"] and out.count() > 0


def test_query_names_are_plain():
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", n) for n in entry.queries())
