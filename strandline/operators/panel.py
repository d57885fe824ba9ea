"""Panel preparation: deduplication, corporate actions, as-of alignment, returns, universe choices.

Every per-ticker window holds at most one row per calendar date, so its size is bounded by the calendar however many
raw rows a ticker has; raw rows are folded to (ticker, date) by a map-side combined aggregate first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import tdiv
from strandline.operators.rules import union_all
from strandline.session import spread

# Daily price limit with tolerance, split ratios and how near a jump must be to one.
JUMP_UP, JUMP_DOWN = 1.31, 0.69
SPLIT_FACTORS = (2, 3, 4, 5, 8, 10, 20, 25, 50, 100)
SPLIT_TOLERANCE = 0.08
# The session is final at 15:40 in Korea; features start at row 61.
SESSION_FINAL_MINUTE = 15 * 60 + 40
MIN_HISTORY = 61


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in `order`. An aggregate with map-side combine, so a key holding a large share of
    the rows is reduced before the shuffle; a window would sort the whole group in one task."""
    others = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
            .select(*keys, "_row.*"))


def last_arrival(bars: DataFrame, keys=("ticker", "date"), seq: str = "ingest_seq") -> DataFrame:
    """One bar per (ticker, date); the last arrival wins."""
    return latest_by(bars, list(keys), [F.col(seq)])


def drop_unfinished_session(bars: DataFrame, now: Column) -> DataFrame:
    """Drop bars dated today in Korea while the session is not final yet."""
    local = F.from_utc_timestamp(now, "Asia/Seoul")
    open_session = (F.col("date") == F.to_date(local)) & (F.hour(local) * 60 + F.minute(local) < SESSION_FINAL_MINUTE)
    return bars.where(~F.coalesce(open_session, F.lit(False)))


def jump_kind(ratio: Column) -> Column:
    """NULL for an ordinary move, 'split' near a split factor, 'reset' for any other move beyond the price limit."""
    size = F.when(ratio < 1, 1 / ratio).otherwise(ratio)
    near = F.lit(False)
    for factor in SPLIT_FACTORS:
        near = near | (F.abs(size / factor - 1) <= SPLIT_TOLERANCE)
    return F.when((ratio > JUMP_UP) | (ratio < JUMP_DOWN), F.when(near, F.lit("split")).otherwise(F.lit("reset")))


def adjust_corporate_actions(bars: DataFrame) -> DataFrame:
    """Fold splits into earlier bars; drop history before the last jump that is no split.

    Adds `split_ratio` on the split's own bar and `truncated_before` on every kept bar."""
    by_date = Window.partitionBy("ticker").orderBy("date")
    whole = Window.partitionBy("ticker")
    ratio = tdiv("close", F.lag("close").over(by_date))
    marked = (bars.withColumn("_ratio", ratio)
              .withColumn("_kind", jump_kind(F.col("_ratio")))
              .withColumn("truncated_before", F.max(F.when(F.col("_kind") == "reset", F.col("date"))).over(whole)))
    kept = (marked.where(F.col("truncated_before").isNull() | (F.col("date") >= F.col("truncated_before")))
            .withColumn("split_ratio", F.when((F.col("_kind") == "split"), F.col("_ratio"))))
    later = by_date.rowsBetween(1, Window.unboundedFollowing)
    factor = F.coalesce(F.product(F.coalesce("split_ratio", F.lit(1.0))).over(later), F.lit(1.0))
    adjusted = kept.withColumn("_factor", factor)
    for column in ("open", "high", "low", "close"):
        adjusted = adjusted.withColumn(column, F.col(column) * F.col("_factor"))
    return adjusted.withColumn("volume", F.col("volume") / F.col("_factor")).drop("_ratio", "_kind", "_factor")


def asof_join(left: DataFrame, right: DataFrame, value: str, on: str = "date", by: list[str] | None = None,
              strict: bool = False, out: str | None = None) -> DataFrame:
    """Latest `right.value` on or before (strict: before) each left row, as one sorted union instead of a range join.

    With `by` the series are matched per key. The rows of one key are bounded by the calendar when both sides hold one
    row per key and date, which is the contract here."""
    by = by or []
    out = out or value
    side_first = 1 if strict else 0
    left_cols = left.columns
    probes = left.select(*left_cols, F.lit(None).cast(right.schema[value].dataType).alias("_v"),
                         F.lit(1 - side_first).alias("_side"), F.lit(True).alias("_left"))
    facts = right.select(*[F.col(c) if c in [on, *by] else F.lit(None).cast(left.schema[c].dataType).alias(c)
                           for c in left_cols],
                         F.col(value).alias("_v"), F.lit(side_first).alias("_side"), F.lit(False).alias("_left"))
    order = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return (probes.unionByName(facts)
            .withColumn(out, F.last("_v", ignorenulls=True).over(order))
            .where("_left").select(*left_cols, out))


def align_calendar(bars: DataFrame, series: list[tuple[DataFrame, str, bool]], by: str = "index_name") -> DataFrame:
    """Attach market-wide series (index, FX), each given as (series, name of the new column, strict): the latest close on or
    before (strict: before) each bar's date.

    All series and the bars' distinct dates are one tagged union under one sort, so any number of series costs one shuffle. It
    runs on the calendar, which is small and the same for all tickers; bars then meet it by equality."""
    names = [out for _, out, _ in series]
    dates = bars.select(by, "date").distinct()
    # On one day the facts that may be seen come before the probe, the others after it.
    parts = [dates.select(by, "date", F.lit(1).alias("_side"), *[F.lit(None).cast("double").alias(n) for n in names])]
    parts += [frame.select(by, "date", F.lit(2 if strict else 0).alias("_side"),
                           *[(F.col("close") if n == out else F.lit(None)).cast("double").alias(n) for n in names])
              for frame, out, strict in series]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    upto = Window.partitionBy(by).orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    known = union.select(by, "date", "_side", *[F.last(n, ignorenulls=True).over(upto).alias(n) for n in names]).where("_side = 1")
    return bars.join(known.drop("_side"), [by, "date"], "left")


def align_series(bars: DataFrame, series: DataFrame, out: str, strict: bool = False, by: str = "index_name") -> DataFrame:
    """One series of `align_calendar`."""
    return align_calendar(bars, [(series, out, strict)], by)


def join_flows(bars: DataFrame, flows: DataFrame) -> DataFrame:
    return bars.join(flows.select("ticker", "date", F.col("foreign").alias("foreign_flow"),
                                  F.col("organ").alias("organ_flow")), ["ticker", "date"], "left")


def log_returns(bars: DataFrame) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date")
    prev_idx = F.lag("idx").over(w)
    return (bars.withColumn("ret", F.ln(tdiv("close", F.lag("close").over(w))))
            .withColumn("idx_ret", F.when((F.col("idx") > 0) & (prev_idx > 0), F.ln(tdiv("idx", prev_idx)))))


def enough_history(bars: DataFrame) -> DataFrame:
    """Per ticker: session count and whether it can be forecast."""
    return (bars.groupBy("ticker").agg(F.count("*").alias("sessions"))
            .withColumn("enough", F.col("sessions") > MIN_HISTORY))


def peer_pool(universe: DataFrame, targets: DataFrame, count: int) -> DataFrame:
    """Largest other listings on each target's exchange; a target that comes several times shares its ranks among its copies.

    Only the count+1 largest of an exchange can be anyone's peers: they go to the targets as one broadcast row per exchange. Peers of
    a target on one exchange are a slice of that list; only targets on several exchanges have their peers sorted."""
    by_size = Window.partitionBy("exchange").orderBy(F.desc("market_cap"), "ticker")
    top = (universe.withColumn("_rank", F.row_number().over(by_size)).where(F.col("_rank") <= count + 1)
           .groupBy("exchange").agg(F.array_sort(F.collect_list(F.struct("_rank", F.col("ticker").alias("peer"), "market_cap"))).alias("_top")))
    homes = (spread(targets.where("ticker IS NOT NULL AND exchange IS NOT NULL").select("ticker", "exchange"), "ticker")
             .groupBy("ticker", "exchange").agg(F.count("*").alias("_copies"))
             .withColumn("_homes", F.count("*").over(Window.partitionBy("ticker"))).join(F.broadcast(top), "exchange"))
    others = F.filter("_top", lambda x: x["peer"] != F.col("ticker"))
    copies = F.least("_copies", F.lit(count)).cast("int")
    listed = F.slice(F.flatten(F.transform(others, lambda x: F.array_repeat(x, copies))), 1, count)
    one = (homes.where("_homes = 1").select("ticker", "exchange", F.posexplode(listed).alias("_at", "p"))
           .withColumn("peer_rank", F.col("_at") + 1))
    order = Window.partitionBy("ticker").orderBy("p._rank")
    several = (homes.where("_homes > 1").select("ticker", "exchange", F.explode(listed).alias("p"))
               .withColumn("peer_rank", F.row_number().over(order)).where(F.col("peer_rank") <= count))
    return union_all([df.select("ticker", "exchange", "p.peer", "peer_rank", "p.market_cap") for df in (one, several)])


def fill_profile(bars: DataFrame, flow_columns=("foreign_flow", "organ_flow")) -> DataFrame:
    """Per ticker: rows and how many carry each optional field, first and last date."""
    optional = ["open", "high", "low", "volume", *flow_columns]
    return bars.groupBy("ticker").agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        *[F.count(c).alias(f"n_{c}") for c in optional])
