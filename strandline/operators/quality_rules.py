"""Data-quality rules over the normal form: each yields (ds_id, code, path). Run after estimated markets are lifted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import quarter_end, quarter_index, title_key
from strandline.operators import valuation as va
from strandline.operators.rules import union_all

# Evidence limits.
MAX_JUMP, SEASON_TOLERANCE, MIN_COVERAGE, MIN_OBSERVATIONS = 3, 0.02, 0.5, 4
MAX_SOURCE_DAYS, MAX_QUOTE_DAYS, MAX_SHARES_DAYS, MAX_FX_DAYS = 730, 14, 200, 30


def _hit(df: DataFrame, condition, code: str, path) -> DataFrame:
    path = F.lit(path) if isinstance(path, str) else path
    return df.where(F.coalesce(condition, F.lit(False))).select("ds_id", F.lit(code).alias("code"), path.alias("path"))


def _at(fmt: str, *cols):
    return F.format_string(fmt, *cols)


def series_rules(t: va.Tables) -> DataFrame:
    """Basis, publication before period end, gaps and jumps, for markets, products and competitors of known markets."""
    known = t.market.select("ds_id", "market_id").distinct()
    linked = union_all([t.product.select("ds_id", F.lit("product").alias("kind"), F.col("product_id").alias("id"), "market_id"),
                        t.competitor.select("ds_id", F.lit("competitor").alias("kind"), F.col("competitor_id").alias("id"), "market_id"),
                        t.market.select("ds_id", F.lit("market").alias("kind"), F.col("market_id").alias("id"), "market_id")])
    usable = linked.join(known, ["ds_id", "market_id"], "left_semi").select("ds_id", "kind", "id").distinct()
    order = Window.partitionBy("ds_id", "kind", "pos").orderBy("j")
    rows = va.all_series(t).join(usable, ["ds_id", "kind", "id"], "left_semi").withColumns(
        {"prev_q": F.lag("q").over(order), "ratio": F.col("revenue") / F.lag("revenue").over(order)})
    p = F.col("path")
    return union_all([
        _hit(rows, F.col("basis") != "quarterly", "ANNUAL_QUARTERLY_CONFUSION", F.concat(p, F.lit(".basis"))),
        _hit(rows, F.col("published_at") < quarter_end("q"), "SOURCE_BEFORE_PERIOD_END", F.concat(p, F.lit(".source.publishedAt"))),
        _hit(rows, F.col("q") - F.col("prev_q") != 1, "NON_CONSECUTIVE_OBSERVATIONS", F.concat(p, F.lit(".quarter"))),
        _hit(rows, (F.col("ratio") > MAX_JUMP) | (F.col("ratio") < 1 / MAX_JUMP), "ANNUAL_QUARTERLY_CONFUSION", F.concat(p, F.lit(".revenue")))])


def duplicates(df: DataFrame, keys: list, code: str, path) -> DataFrame:
    """Rows whose any key was seen at an earlier position."""
    seen = F.lit(False)
    for key in keys:
        seen = seen | (F.row_number().over(Window.partitionBy("ds_id", key).orderBy("pos")) > 1)
    return _hit(df.withColumn("_seen", seen), F.col("_seen"), code, path)


def static_rules(t: va.Tables) -> DataFrame:
    """Everything that does not depend on the analysis date."""
    m, p, c, fx = t.market, t.product, t.competitor, t.fx
    market_ids = m.select("ds_id", "market_id").distinct()
    rates = va.fx_rates(t)
    mean = (F.col("s1") + F.col("s2") + F.col("s3") + F.col("s4")) / 4
    mpath, ppath, cpath = _at("markets[%d]", "pos"), _at("products[%d]", "pos"), _at("competitors[%d]", "pos")
    with_market = lambda e: e.join(m.select("ds_id", "market_id", F.col("currency").alias("mc")), ["ds_id", "market_id"])
    prev = F.row_number().over(Window.partitionBy("ds_id", "market_id").orderBy("pos"))
    prows = t.product_rev.join(with_market(p), ["ds_id", "product_id"])
    crows = t.competitor_rev.join(with_market(c), ["ds_id", "competitor_id"])
    missing_rate = lambda df: df.where(F.col("currency") != "KRW").join(rates, ["ds_id", "currency"], "left_anti")
    anchor = va.share_anchor(t)
    common = va.common_quarters(t, t.product_rev, p, "product_id", same_currency=False).join(p.select("ds_id", "product_id", "pos"), ["ds_id", "product_id"])
    invalid = common.where(F.col("revenue") > F.col("market_revenue"))
    sums = va.player_sums(t).select("ds_id", "market_id", "q", "total")
    reported = t.market_obs.where(F.col("method").isNull()).join(m.select("ds_id", "market_id", "pos"), ["ds_id", "market_id"]).join(sums, ["ds_id", "market_id", "q"])
    fin = t.financials.select("ds_id", "q", "published_at")
    uncovered = p.join(t.product_rev.join(fin.select("ds_id", "q"), ["ds_id", "q"], "left_semi").select("ds_id", "product_id"), ["ds_id", "product_id"], "left_anti")
    late = lambda df, date, path: _hit(df, F.col("published_at") < date, "SOURCE_BEFORE_PERIOD_END", path)
    found = union_all([
        series_rules(t),
        late(fin, quarter_end("q"), "financials.source.publishedAt"), late(t.quote, F.col("as_of"), "quote.source.publishedAt"),
        late(t.shares, F.col("as_of"), "shares.source.publishedAt"), late(fx, F.col("as_of"), _at("fx[%d].source.publishedAt", "pos")),
        duplicates(m.withColumns({"nk": title_key("name"), "sk": title_key("scope")}), ["market_id", "nk", "sk"], "DUPLICATE_MARKET", mpath),
        _hit(m.join(p.select("ds_id", "market_id").distinct(), ["ds_id", "market_id"], "left_anti"), F.lit(True), "UNUSED_MARKET", mpath),
        _hit(missing_rate(m), F.lit(True), "MISSING_FX", _at("markets[%d].currency", "pos")),
        _hit(m, F.abs(mean - 1) > SEASON_TOLERANCE, "SEASONALITY_NOT_NORMALISED", _at("markets[%d].seasonality", "pos")),
        _hit(fx, F.col("currency") == "KRW", "INVALID_FX", _at("fx[%d]", "pos")),
        duplicates(fx, ["currency"], "DUPLICATE_FX", _at("fx[%d]", "pos")),
        duplicates(p.withColumn("nk", title_key("name")), ["product_id", "nk"], "DUPLICATE_PRODUCT", ppath),
        _hit(p.withColumn("_n", prev), F.col("_n") > 1, "OVERLAPPING_PRODUCT_MARKET", _at("products[%d].marketId", "pos")),
        _hit(p.join(market_ids, ["ds_id", "market_id"], "left_anti"), F.lit(True), "MISSING_MARKET", _at("products[%d].marketId", "pos")),
        _hit(prows, F.col("currency") != F.col("mc"), "CURRENCY_MISMATCH", _at("products[%d].revenue[%d].currency", "pos", "j")),
        _hit(missing_rate(prows), F.lit(True), "MISSING_FX", _at("products[%d].revenue[%d].currency", "pos", "j")),
        _hit(p.join(market_ids, ["ds_id", "market_id"], "left_semi").join(anchor.select("ds_id", "product_id"), ["ds_id", "product_id"], "left_anti"),
             F.lit(True), "MISSING_COVERAGE", _at("products[%d].revenue", "pos")),
        _hit(invalid, F.lit(True), "INVALID_SHARE", _at("products[%d].revenue", "pos")),
        _hit(anchor.join(p.select("ds_id", "product_id", "pos", "share_min", "share_max"), ["ds_id", "product_id"])
             .join(invalid.select("ds_id", "product_id").distinct(), ["ds_id", "product_id"], "left_anti"),
             (F.col("share") < F.col("share_min")) | (F.col("share") > F.col("share_max")), "SHARE_OUT_OF_BOUNDS", _at("products[%d].shareBounds", "pos")),
        duplicates(c, ["competitor_id"], "DUPLICATE_COMPETITOR", cpath),
        _hit(c.join(market_ids, ["ds_id", "market_id"], "left_anti"), F.lit(True), "COMPETITOR_MARKET_UNKNOWN", _at("competitors[%d].marketId", "pos")),
        _hit(crows, F.col("currency") != F.col("mc"), "CURRENCY_MISMATCH", _at("competitors[%d].revenue[%d].currency", "pos", "j")),
        _hit(reported, F.col("total") > F.col("revenue") * (1 + va.ROUNDING_TOLERANCE), "PLAYERS_EXCEED_MARKET", _at("markets[%d].observations[%d].revenue", "pos", "j")),
        _hit(uncovered, F.lit(True), "MISSING_COVERAGE", F.concat(F.lit("products."), "product_id", F.lit(".revenue"))),
    ])
    blocked = union_all([found.where(F.col("code").isin("MISSING_FX", "CURRENCY_MISMATCH")).select("ds_id"), uncovered.select("ds_id")]).distinct()
    cov = (va.coverage(t).join(blocked, "ds_id", "left_anti")
           .join(t.residual_tri.select("ds_id").distinct().withColumn("_r", F.lit(True)), "ds_id", "left"))
    verdict = (F.when(F.col("covered") > F.col("total") * (1 + va.ROUNDING_TOLERANCE), F.struct(F.lit("COVERAGE_EXCEEDS_TOTAL").alias("code"), F.lit("financials.totalRevenueKRW").alias("path")))
               .when(F.col("ratio") < MIN_COVERAGE, F.struct(F.lit("COVERAGE_INSUFFICIENT").alias("code"), F.lit("products").alias("path")))
               .when((F.col("residual") > F.col("total") * va.ROUNDING_TOLERANCE) & F.col("_r").isNull(), F.struct(F.lit("RESIDUAL_REQUIRED").alias("code"), F.lit("residual").alias("path"))))
    chain = cov.withColumn("_v", verdict).where(F.col("_v").isNotNull()).select("ds_id", "_v.code", "_v.path")
    return found.unionByName(chain)


def dated_rules(t: va.Tables, as_of) -> DataFrame:
    """Look-ahead and staleness relative to the analysis date."""
    current = quarter_index(as_of)

    def dated(df, date, limit, future_path, stale_path=None):
        d = F.col(date)
        return union_all([_hit(df, d > as_of, "FUTURE_EVIDENCE", future_path),
                          _hit(df, (d <= as_of) & (F.datediff(as_of, d) > limit), "STALE_EVIDENCE", stale_path or future_path)])

    def period(df, q, path):
        return union_all([_hit(df, quarter_end(q) > as_of, "FUTURE_EVIDENCE", path),
                          _hit(df, (quarter_end(q) <= as_of) & (current - F.col(q) > va.MAX_QUARTERS_BEFORE_AS_OF), "STALE_EVIDENCE", path)])

    pub = F.concat("path", F.lit(".publishedAt"))
    rows = va.all_series(t)
    latest = va.latest_observation(t).join(t.market.select("ds_id", "market_id", "pos"), ["ds_id", "market_id"])
    anchor = va.share_anchor(t).join(t.product.select("ds_id", "product_id", "pos"), ["ds_id", "product_id"])
    return union_all([
        dated(va.sources(t), "published_at", MAX_SOURCE_DAYS, pub),
        dated(t.quote, "as_of", MAX_QUOTE_DAYS, F.lit("quote.asOf")), dated(t.shares, "as_of", MAX_SHARES_DAYS, F.lit("shares.asOf")),
        dated(t.fx, "as_of", MAX_FX_DAYS, _at("fx[%d].asOf", "pos")), period(t.financials, "q", F.lit("financials.quarter")),
        _hit(rows, quarter_end("q") > as_of, "FUTURE_EVIDENCE", F.concat("path", F.lit(".quarter"))),
        period(latest, "latest_q", _at("markets[%d].observations", "pos")), period(anchor, "anchor_q", _at("products[%d].revenue", "pos"))])


def structure_rules(t: va.Tables) -> DataFrame:
    """Domain checks: amounts, bounds, ordered scenarios, identifiers, enough observations."""
    def ordered(df, keys, value):
        tri = df.groupBy("ds_id", *keys).agg(*[F.max(F.when(F.col("scenario") == s, F.col(value))).alias(s) for s in va.SCENARIOS])
        path = F.concat_ws(".", *keys, F.lit(value)) if keys else F.lit(value)
        return _hit(tri, ~((F.col("bear") <= F.col("base")) & (F.col("base") <= F.col("bull"))), "SCENARIOS_NOT_ORDERED", path)

    rows = va.all_series(t)
    few = t.market.join(t.market_obs.groupBy("ds_id", "market_id").agg(F.count("*").alias("_n")), ["ds_id", "market_id"], "left")
    season = F.least("s1", "s2", "s3", "s4") < 0.7
    return union_all([
        _hit(rows, ~((F.col("revenue") > 0) & (F.col("revenue") <= 1e18)), "AMOUNT_OUT_OF_RANGE", F.concat("path", F.lit(".revenue"))),
        _hit(few, F.coalesce("_n", F.lit(0)) < MIN_OBSERVATIONS, "TOO_FEW_OBSERVATIONS", _at("markets[%d].observations", "pos")),
        _hit(t.market, season | (F.greatest("s1", "s2", "s3", "s4") > 1.3), "SEASONALITY_OUT_OF_RANGE", _at("markets[%d].seasonality", "pos")),
        _hit(t.market, ~F.col("market_id").rlike("^[a-z0-9][a-z0-9-]{0,39}$"), "INVALID_ID", _at("markets[%d].id", "pos")),
        _hit(t.product, ~((F.col("share_min") >= 0) & (F.col("share_min") <= F.col("share_max")) & (F.col("share_max") <= 1)), "INVALID_BOUNDS", _at("products[%d].shareBounds", "pos")),
        _hit(t.bridge, ~(F.col("tax_rate").between(0, 0.5) & F.col("noncontrolling_share").between(0, 1) & (F.col("preferred_claims") >= 0)), "BRIDGE_OUT_OF_RANGE", "earningsBridge"),
        ordered(t.market_tri, ["market_id"], "annual_growth"), ordered(t.market_tri, ["market_id"], "cyclical"),
        ordered(t.product_tri, ["product_id"], "share_delta"), ordered(t.product_tri, ["product_id"], "margin"), ordered(t.pe_tri, [], "pe")])


# Issues that make a valuation wrong by construction.
HARD_CODES = ("FUTURE_EVIDENCE", "MISSING_MARKET", "MISSING_FX", "INVALID_FX", "DUPLICATE_FX", "INVALID_SHARE", "MISSING_COVERAGE",
              "COVERAGE_EXCEEDS_TOTAL", "OVERLAPPING_PRODUCT_MARKET", "RESIDUAL_REQUIRED")


def classify(found: DataFrame) -> DataFrame:
    """Add `severity`: an annual basis and a product currency mismatch are hard, jumps and competitor mismatches soft."""
    hard = (F.col("code").isin(*HARD_CODES) | ((F.col("code") == "ANNUAL_QUARTERLY_CONFUSION") & F.col("path").endswith(".basis"))
            | ((F.col("code") == "CURRENCY_MISMATCH") & ~F.col("path").startswith("competitors")))
    return found.withColumn("severity", F.when(hard, "hard").otherwise("soft"))
