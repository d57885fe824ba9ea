import datetime as dt

from strandline.operators import repair as ry

D = dt.date


def test_verified_exchange_and_quote_replace_proposed_ones_with_a_log_row_each(spark):
    facts = spark.createDataFrame([(1, "KOSPI", 10.0, D(2026, 1, 1), "p", "x"), (2, "KOSDAQ", 10.0, D(2026, 1, 1), "p", "x"), (3, None, None, None, None, "x"),
                                   (4, "KOSPI", 5.0, D(2026, 1, 1), "p", "x"), (5, "KOSPI", 5.0, D(2026, 1, 1), "p", "x")],
                                  "ds_id int, exchange string, price double, price_as_of date, price_source string, source string")
    verified = spark.createDataFrame([(1, "KOSPI", 10.0, D(2026, 1, 1), "v"), (2, "KOSPI", 10.0, D(2026, 1, 2), "v"), (3, "KOSPI", 7.0, D(2026, 1, 2), "v"),
                                      (4, None, None, None, None)], "ds_id int, exchange string, close double, traded_on date, source string")
    out, log = ry.replace_verified(facts, verified)
    assert out.columns == facts.columns
    assert {r.ds_id: tuple(r)[1:5] for r in out.collect()} == {
        1: ("KOSPI", 10.0, D(2026, 1, 1), "p"), 2: ("KOSPI", 10.0, D(2026, 1, 2), "v"), 3: ("KOSPI", 7.0, D(2026, 1, 2), "v"),
        4: ("KOSPI", 5.0, D(2026, 1, 1), "p"), 5: ("KOSPI", 5.0, D(2026, 1, 1), "p")}
    assert sorted((r.ds_id, r.code, r.old, r.new) for r in log.collect() if r.ds_id == 2) == [
        (2, "DATASET_EXCHANGE_REPLACED", "KOSDAQ", "KOSPI"), (2, "DATASET_QUOTE_REPLACED", "10.0 @ 2026-01-01", "10.0 @ 2026-01-02")]
    assert {(r.ds_id, r.code) for r in log.collect()} == {(i, c) for i in (2, 3) for c in ("DATASET_EXCHANGE_REPLACED", "DATASET_QUOTE_REPLACED")}
