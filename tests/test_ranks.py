import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions.ranks import first_sums, ranked
from strandline.operators.backtest import confident_hits


def test_ranks_equal_a_window_with_a_hot_group_nulls_and_ties(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", None]), rnd.choice([None, 0.1, 0.5, 0.5, 0.9]), i, "x") for i in range(900)]
    frame = spark.createDataFrame(rows, "exchange string, p double, id long, rank_ string").repartition(5)
    order = [F.desc("p"), F.asc("id")]
    want = frame.withColumn("rank", F.row_number().over(Window.partitionBy("exchange").orderBy(*order)))
    got = ranked(frame, ["exchange"], order)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert ranked(frame.limit(0), ["exchange"], order).count() == 0


def test_cuts_equal_sorted_prefixes(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("abc"), rnd.randrange(3), rnd.randrange(4), rnd.randrange(3), float(rnd.randrange(2))) for _ in range(400)]
    frame = spark.createDataFrame(rows, "g string, x int, y int, z int, v double")
    for need in (1, 37, 10_000):
        got = first_sums(frame, ["g"], frame.groupBy("g").agg(F.lit(need).alias("need")), [[("x", True)], [("y", False)], [("z", False)]], "v")
        for r in got.collect():
            first = sorted((q for q in rows if q[0] == r.g), key=lambda q: (-q[1], q[2], q[3], -q[4]))[:need]
            assert (r["sum"], r["n"]) == (sum(q[4] for q in first), len(first))


def test_confident_hits_with_one_probability_for_all(spark):
    rows = [(1, f"t{t}", d, 0.9, 1.0 if d < 3 else -1.0) for t in range(10) for d in range(10)]
    oos = spark.createDataFrame(rows, "horizon int, ticker string, date int, p double, actual double")
    got = {r.ticker: (r.confident_accuracy, r.confident_n) for r in confident_hits(oos).collect()}
    assert got["ALL"] == (1.0, 30) and got["t3"] == (1.0, 3) and len(got) == 11
