"""Point-in-time features, cross-sectional features, labels. Each feature at a row reads rows up to that row only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import tdiv
from strandline.operators.panel import MIN_HISTORY

HORIZONS = (1, 2, 3)

# Feature names in their model order.
FEATURES = (
    "ret1", "ret2", "ret3", "ret5", "ret10", "ret20", "ret60",
    "vol5", "vol20", "volRatio", "z1", "z5", "ma5Gap", "ma20Gap", "ma60Gap", "rsi14",
    "range1", "closeLoc", "gap1", "volume1", "volume5",
    "idxRet1", "idxRet5", "idxVol20", "excess1", "excess5", "beta60",
    "high120Gap", "low120Gap", "downStreak", "upStreak", "idxRet20", "idxRet60", "idxMa60Gap",
    "fxRet1", "fxRet5", "fxRet20", "foreign1", "foreign5", "organ1", "organ5",
)
CROSS_FEATURES = ("peerRet1", "peerRet5", "relRet1", "relRet5", "peerUpShare",
                  "monday", "friday", "monthEnd", "monthStart")
ALL_FEATURES = FEATURES + CROSS_FEATURES

# Minimum counts behind windowed statistics and the streak cap.
MIN_VOLUME_20, MIN_VOLUME_5, MIN_BETA, MIN_INDEX_60, STREAK_CAP, MIN_PEERS = 10, 3, 30, 50, 10, 3
SCALE_FLOOR, SCALE_DEFAULT = 0.003, 0.02


def features(bars: DataFrame) -> DataFrame:
    """`bars` with ret, idx, idx_ret, fx and flow columns -> + `row` and the 41 features.

    All frames share one partitioning and ordering, so the whole block costs one shuffle and one sort."""
    order = Window.partitionBy("ticker").orderBy("date")

    def w(n: int):
        return order.rowsBetween(-(n - 1), 0)

    def back(column: str, n: int):
        then = F.lag(column, n).over(order)
        return F.when((F.col(column) > 0) & (then > 0), F.ln(tdiv(column, then)))

    def up_to(n: int, value):
        return F.when(F.col("row") >= n, value)

    positive_volume = F.when(F.col("volume") > 0, F.col("volume"))
    both = F.col("ret").isNotNull() & F.col("idx_ret").isNotNull()
    y, x = F.when(both, F.col("ret")), F.when(both, F.col("idx_ret"))
    positive_idx = F.when(F.col("idx") > 0, F.col("idx"))

    first = (bars
             .withColumn("row", F.row_number().over(order))
             .withColumn("vol5", F.stddev_samp("ret").over(w(5)))
             .withColumn("vol20", F.stddev_samp("ret").over(w(20)))
             .withColumn("idxVol20", F.stddev_samp("idx_ret").over(w(20)))
             .withColumn("_avgvol", F.when(F.count(positive_volume).over(w(20)) >= MIN_VOLUME_20,
                                           F.avg(positive_volume).over(w(20))))
             .withColumn("_avgvol5", F.when(F.count(positive_volume).over(w(5)) >= MIN_VOLUME_5,
                                            F.avg(positive_volume).over(w(5))))
             .withColumn("_gain", F.sum(F.greatest("ret", F.lit(0.0))).over(w(14)))
             .withColumn("_loss", F.sum(F.greatest(-F.col("ret"), F.lit(0.0))).over(w(14)))
             .withColumn("beta60", F.when(F.regr_count(y, x).over(w(60)) >= MIN_BETA,
                                          F.regr_slope(y, x).over(w(60))))
             .withColumn("_hi", F.max(F.coalesce("high", "close")).over(w(120)))
             .withColumn("_lo", F.min(F.coalesce("low", "close")).over(w(120)))
             .withColumn("_last_not_down", F.last(F.when(~F.coalesce(F.col("ret") < 0, F.lit(False)), F.col("row")),
                                                  ignorenulls=True).over(order))
             .withColumn("_last_not_up", F.last(F.when(~F.coalesce(F.col("ret") > 0, F.lit(False)), F.col("row")),
                                                ignorenulls=True).over(order)))
    values = {}
    for n in (1, 2, 3, 5, 10, 20, 60):
        values[f"ret{n}"] = back("close", n)
    for n in (5, 20, 60):
        values[f"ma{n}Gap"] = up_to(n, F.col("close") / F.avg("close").over(w(n)) - 1)
    for n in (1, 5, 20, 60):
        values[f"idxRet{n}"] = back("idx", n)
    for n in (1, 5, 20):
        values[f"fxRet{n}"] = back("fx", n)
    values["rsi14"] = up_to(15, F.coalesce(tdiv("_gain", F.col("_gain") + F.col("_loss")) - 0.5, F.lit(0.0)))
    values["range1"] = (F.col("high") - F.col("low")) / F.col("close")
    values["closeLoc"] = F.when(F.col("high") > F.col("low"), (2 * F.col("close") - F.col("low") - F.col("high"))
                                / (F.col("high") - F.col("low")))
    values["gap1"] = F.ln(tdiv("open", F.lag("close").over(order)))
    values["volume1"] = F.ln(tdiv(positive_volume, F.col("_avgvol")))
    values["volume5"] = F.ln(tdiv("_avgvol5", "_avgvol"))
    values["high120Gap"] = F.ln(F.col("close") / F.col("_hi"))
    values["low120Gap"] = F.ln(F.col("close") / F.col("_lo"))
    values["downStreak"] = F.least(F.col("row") - F.col("_last_not_down"), F.lit(STREAK_CAP)).cast("double")
    values["upStreak"] = F.least(F.col("row") - F.col("_last_not_up"), F.lit(STREAK_CAP)).cast("double")
    values["idxMa60Gap"] = up_to(60, F.when(F.count(positive_idx).over(w(60)) >= MIN_INDEX_60,
                                            positive_idx / F.avg(positive_idx).over(w(60)) - 1))
    for who in ("foreign", "organ"):
        for n in (1, 5):
            total = F.when(F.count(f"{who}_flow").over(w(n)) == n, F.sum(f"{who}_flow").over(w(n)))
            values[f"{who}{n}"] = tdiv(total, F.col("_avgvol") * n)
    second = first.withColumns(values)
    third = second.withColumns({
        "volRatio": tdiv("vol5", "vol20"),
        "z1": tdiv("ret1", "vol20"),
        "z5": tdiv("ret5", F.col("vol20") * math.sqrt(5.0)),
        "excess1": F.col("ret1") - F.coalesce("beta60", F.lit(1.0)) * F.col("idxRet1"),
        "excess5": F.col("ret5") - F.coalesce("beta60", F.lit(1.0)) * F.col("idxRet5"),
    })
    return third.select(*bars.columns, "row", *FEATURES)


def labels(bars: DataFrame) -> DataFrame:
    """Forward log return and closing date of each horizon; NULL while unknown."""
    order = Window.partitionBy("ticker").orderBy("date")
    out = bars
    for h in HORIZONS:
        out = (out.withColumn(f"fwd{h}", F.ln(tdiv(F.lead("close", h).over(order), "close")))
               .withColumn(f"end{h}", F.lead("date", h).over(order)))
    return out


def peer_statistics(rows: DataFrame) -> DataFrame:
    """Per date: mean ret1 and ret5 and the share of rising tickers, over at least three tickers."""
    usable = rows.where(F.col("ret1").isNotNull() & F.col("ret5").isNotNull())
    return (usable.groupBy("date").agg(
        F.avg("ret1").alias("peerRet1"), F.avg("ret5").alias("peerRet5"),
        F.avg(F.when(F.col("ret1") > 0, 1.0).otherwise(0.0)).alias("peerUpShare"), F.count("*").alias("n_peers"))
        .where(F.col("n_peers") >= MIN_PEERS))


def cross_section(rows: DataFrame) -> DataFrame:
    """Add the nine cross-sectional and calendar features. The statistics are those of `peer_statistics`, taken over the rows of
    a date in place: a join would plan and compute the rows a second time."""
    def flag(condition):
        return F.when(condition, 1.0).otherwise(0.0)

    day, peers = F.dayofmonth("date"), Window.partitionBy("date")
    usable = F.col("ret1").isNotNull() & F.col("ret5").isNotNull()
    enough = F.count(F.when(usable, 1)).over(peers) >= MIN_PEERS
    values = {"peerRet1": F.col("ret1"), "peerRet5": F.col("ret5"), "peerUpShare": flag(F.col("ret1") > 0)}
    return (rows.withColumns({name: F.when(enough, F.avg(F.when(usable, value)).over(peers)) for name, value in values.items()})
            .withColumns({
                "relRet1": F.col("ret1") - F.col("peerRet1"), "relRet5": F.col("ret5") - F.col("peerRet5"),
                "monday": flag(F.dayofweek("date") == 2), "friday": flag(F.dayofweek("date") == 6),
                "monthEnd": flag(day >= 26), "monthStart": flag(day <= 3)}))


def samples(bars_ready: DataFrame) -> DataFrame:
    """Feature rows with labels from the minimum-history row on."""
    rows = features(labels(bars_ready)).where(F.col("row") >= MIN_HISTORY)
    return cross_section(rows).select("ticker", "date", "close", *ALL_FEATURES,
                                      *[f"fwd{h}" for h in HORIZONS], *[f"end{h}" for h in HORIZONS])


def volatility_scale(h: int | object):
    """Volatility unit of an h-session return."""
    root = F.lit(math.sqrt(h)) if isinstance(h, int) else F.sqrt(h)
    return F.coalesce(F.greatest(F.col("vol20"), F.when(F.col("vol20").isNotNull(), F.lit(SCALE_FLOOR))),
                      F.lit(SCALE_DEFAULT)) * root
