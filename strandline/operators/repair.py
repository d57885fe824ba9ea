"""Deterministic repairs of proposed datasets, each leaving a log row."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import clamp, quarter_end
from strandline.operators import valuation as va
from strandline.operators.rules import union_all

# Observations a series keeps at least when unfinished quarters are dropped; margin bounds of a residual.
MIN_KEPT = {"market_id": 4, "product_id": 1, "competitor_id": 0}
MARGIN_LOW, MARGIN_HIGH = -0.5, 0.6


def fix_series(series: DataFrame, key: str, as_of) -> tuple[DataFrame, DataFrame]:
    """Sort by quarter with the later duplicate winning, then drop unfinished quarters where enough remain."""
    entity = Window.partitionBy("ds_id", key)
    last = F.row_number().over(Window.partitionBy("ds_id", key, "q").orderBy(F.desc("j"))) == 1
    disorder = F.coalesce(F.col("q") <= F.lag("q").over(entity.orderBy("j")), F.lit(False))
    marked = series.withColumns({"_last": last, "_disorder": disorder}).withColumn("_sorted", F.max("_disorder").over(entity))
    kept = marked.where("_last").withColumn("_ended", quarter_end("q") <= as_of)
    counted = kept.withColumns({"_n_ended": F.count(F.when(F.col("_ended"), 1)).over(entity), "_n": F.count("*").over(entity)})
    drop = (F.col("_n_ended") != F.col("_n")) & (F.col("_n_ended") >= MIN_KEPT[key])
    cut = counted.withColumn("_drop", drop)
    log = cut.groupBy("ds_id", F.col(key).alias("id")).agg(F.max("_sorted").alias("s"), F.max("_drop").alias("d"),
                                                           F.max(F.col("_n") - F.col("_n_ended")).alias("n"))
    repairs = union_all([
        log.where("s").select("ds_id", F.lit("SERIES_SORTED").alias("code"), "id", F.lit(0).cast("long").alias("n")),
        log.where("d").select("ds_id", F.lit("UNFINISHED_QUARTERS_DROPPED").alias("code"), "id", "n")])
    out = cut.where(~F.col("_drop") | F.col("_ended")).withColumn("j", F.row_number().over(entity.orderBy("q")) - 1)
    return out.select(*series.columns), repairs


def widen_bounds(t: va.Tables) -> tuple[DataFrame, DataFrame]:
    """Share bounds extended to contain the observed share (never beyond one)."""
    anchor = va.share_anchor(va.lift_markets(t)).select("ds_id", "product_id", "share")
    joined = t.product.join(anchor, ["ds_id", "product_id"], "left")
    outside = F.coalesce((F.col("share") <= 1) & ((F.col("share") < F.col("share_min")) | (F.col("share") > F.col("share_max"))), F.lit(False))
    marked = joined.withColumn("_o", outside)
    product = marked.withColumns({"share_min": F.when(F.col("_o"), F.least("share_min", "share")).otherwise(F.col("share_min")),
                                  "share_max": F.when(F.col("_o"), F.greatest("share_max", "share")).otherwise(F.col("share_max"))})
    log = marked.where("_o").select("ds_id", F.lit("SHARE_BOUNDS_WIDENED").alias("code"), F.col("product_id").alias("id"), F.lit(0).cast("long").alias("n"))
    return product.select(*t.product.columns), log


def assume_residual(t: va.Tables) -> tuple[DataFrame, DataFrame]:
    """Flat residual at the products' revenue-weighted margin where products leave revenue unexplained."""
    open_ds = (va.coverage(t).join(t.residual_tri.select("ds_id").distinct(), "ds_id", "left_anti")
               .where(~F.col("missing") & (F.col("covered") > 0) & (F.col("residual") > F.col("total") * va.ROUNDING_TOLERANCE)))
    rows = va.with_fx(t.product_rev.join(t.financials.select("ds_id", "q"), ["ds_id", "q"], "left_semi"), t)
    weighted = (rows.join(open_ds.select("ds_id"), "ds_id", "left_semi").withColumn("w", F.col("revenue") * F.col("fx"))
                .join(t.product_tri.select("ds_id", "product_id", "scenario", "margin"), ["ds_id", "product_id"])
                .groupBy("ds_id", "scenario").agg((F.sum(F.col("w") * F.col("margin")) / F.sum("w")).alias("margin")))
    assumed = weighted.select("ds_id", "scenario", F.lit(0.0).alias("annual_growth"), clamp("margin", MARGIN_LOW, MARGIN_HIGH).alias("margin"))
    log = open_ds.select("ds_id", F.lit("RESIDUAL_ASSUMED").alias("code"), F.lit("residual").alias("id"), F.lit(0).cast("long").alias("n"))
    return t.residual_tri.unionByName(assumed), log


def relax(t: va.Tables, as_of) -> tuple[va.Tables, DataFrame]:
    """All repairs in order; returns the repaired tables and the log (ds_id, code, id, n)."""
    obs, r1 = fix_series(t.market_obs, "market_id", as_of)
    prod, r2 = fix_series(t.product_rev, "product_id", as_of)
    comp, r3 = fix_series(t.competitor_rev, "competitor_id", as_of)
    kept = t.competitor.join(comp.select("ds_id", "competitor_id").distinct(), ["ds_id", "competitor_id"], "left_semi")
    gone = t.competitor.join(comp.select("ds_id", "competitor_id").distinct(), ["ds_id", "competitor_id"], "left_anti")
    r4 = gone.select("ds_id", F.lit("COMPETITOR_DROPPED").alias("code"), F.col("competitor_id").alias("id"), F.lit(1).cast("long").alias("n"))
    step = replace(t, market_obs=obs, product_rev=prod, competitor_rev=comp, competitor=kept)
    product, r5 = widen_bounds(step)
    step = replace(step, product=product)
    residual, r6 = assume_residual(step)
    return replace(step, residual_tri=residual), union_all([r1, r2, r3, r4, r5, r6])


def replace_verified(facts: DataFrame, verified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts (ds_id, exchange, price, price_as_of, price_source, ...) with exchange and quote replaced by verified ones (ds_id, exchange,
    close, traded_on, source; one row a dataset), and the log (ds_id, code, old, new).

    A null verified exchange or close replaces nothing. Price and date go together with their source; a null fact differs from any
    verified one."""
    known = verified.select("ds_id", F.col("exchange").alias("_exchange"), F.col("close").alias("_close"), F.col("traded_on").alias("_on"),
                            F.col("source").alias("_source"))
    joined = facts.join(known, "ds_id", "left")
    moved = F.col("_exchange").isNotNull() & ~F.col("exchange").eqNullSafe(F.col("_exchange"))
    quoted = F.col("_close").isNotNull() & ~(F.col("price").eqNullSafe(F.col("_close")) & F.col("price_as_of").eqNullSafe(F.col("_on")))
    marked = joined.withColumns({"_moved": moved, "_quoted": quoted})
    new = {"exchange": ("_moved", "_exchange"), "price": ("_quoted", "_close"), "price_as_of": ("_quoted", "_on"), "price_source": ("_quoted", "_source")}
    out = marked.select(*[F.when(F.col(new[c][0]), F.col(new[c][1])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in facts.columns])
    quote = lambda price, on: F.concat_ws(" @ ", F.col(price).cast("string"), F.col(on).cast("string"))
    entries = F.array(F.when(F.col("_moved"), F.struct(F.lit("DATASET_EXCHANGE_REPLACED").alias("code"), F.col("exchange").alias("old"), F.col("_exchange").alias("new"))),
                      F.when(F.col("_quoted"), F.struct(F.lit("DATASET_QUOTE_REPLACED").alias("code"), quote("price", "price_as_of").alias("old"),
                                                        quote("_close", "_on").alias("new"))))
    log = marked.select("ds_id", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("_e")).select("ds_id", "_e.*")
    return out, log
