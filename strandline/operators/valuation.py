"""Product-market valuation over many datasets at once; the scenario is a column.

`Tables` holds the normal form. Series tables carry `j`, the position in their array; entity tables carry `pos`."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import clamp, format_quarter, quarter_index, quarterly_rate, tdiv
from strandline.operators.rules import union_all

SCENARIOS = ("bear", "base", "bull")
# Oldest usable observation, rounding tolerance, grounding grades.
MAX_QUARTERS_BEFORE_AS_OF, ROUNDING_TOLERANCE = 3, 1e-4
SCALE_NOISE = 1e-12
HIGH_GROUNDING, MEDIUM_GROUNDING, SWING_PCT, EXTRAPOLATION_QUARTERS = 0.8, 0.5, 30, 3


@dataclass(frozen=True)
class Tables:
    quote: DataFrame            # ds_id, price, as_of, published_at
    shares: DataFrame           # ds_id, diluted, as_of, published_at
    fx: DataFrame               # ds_id, pos, currency, krw_per_unit, as_of, published_at
    financials: DataFrame       # ds_id, q, total_revenue, published_at
    market: DataFrame           # ds_id, pos, market_id, name, scope, currency, s1..s4
    market_obs: DataFrame       # ds_id, market_id, j, q, revenue, basis, method, published_at
    market_tri: DataFrame       # ds_id, market_id, scenario, annual_growth, cyclical
    product: DataFrame          # ds_id, pos, product_id, name, market_id, share_min, share_max
    product_rev: DataFrame      # ds_id, product_id, j, q, revenue, currency, basis, method, published_at
    product_tri: DataFrame      # ds_id, product_id, scenario, share_delta, margin
    competitor: DataFrame       # ds_id, pos, competitor_id, name, market_id
    competitor_rev: DataFrame   # ds_id, competitor_id, j, q, revenue, currency, basis, method, published_at
    competitor_tri: DataFrame   # ds_id, competitor_id, scenario, share_delta
    residual_tri: DataFrame     # ds_id, scenario, annual_growth, margin
    bridge: DataFrame           # ds_id, net_interest, tax_rate, noncontrolling_share, preferred_claims
    pe_tri: DataFrame           # ds_id, scenario, pe


def scenarios(values: dict[str, tuple[float, float, float]]):
    """Exploded array turning (bear, base, bull) literals into scenario rows."""
    return F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), *[F.lit(v[i]).cast("double").alias(k) for k, v in values.items()])
                               for i, s in enumerate(SCENARIOS)]))


def fx_rates(t: Tables) -> DataFrame:
    return t.fx.groupBy("ds_id", "currency").agg(F.min_by("krw_per_unit", "pos").alias("krw_per_unit"))


def with_fx(df: DataFrame, t: Tables, out: str = "fx") -> DataFrame:
    """Rate of the row's currency; KRW is one, an unlisted currency is NULL."""
    joined = df.join(fx_rates(t), ["ds_id", "currency"], "left")
    return joined.withColumn(out, F.when(F.col("currency") == "KRW", F.lit(1.0)).otherwise(F.col("krw_per_unit"))).drop("krw_per_unit")


def series_by_quarter(rev: DataFrame, entity: str) -> DataFrame:
    """First entry per quarter and currency, as a lookup by quarter finds it."""
    return rev.groupBy("ds_id", entity, "q", "currency").agg(F.min_by(F.struct("revenue", "method"), "j").alias("_v")).select(
        "ds_id", entity, "q", "currency", "_v.revenue", "_v.method")


def players(t: Tables) -> DataFrame:
    """(ds_id, market_id, q, kind, id, name, revenue, estimated) in the market's currency."""
    market = t.market.select("ds_id", "market_id", "currency")

    def rows(entity, rev, key, kind):
        return (series_by_quarter(rev, key).join(entity.select("ds_id", key, "name", "market_id"), ["ds_id", key])
                .join(market, ["ds_id", "market_id", "currency"])
                .select("ds_id", "market_id", "q", F.lit(kind).alias("kind"), F.col(key).alias("id"), "name", "revenue",
                        F.col("method").isNotNull().alias("estimated")))

    return (rows(t.product, t.product_rev, "product_id", "company")
            .unionByName(rows(t.competitor, t.competitor_rev, "competitor_id", "competitor")))


def player_sums(t: Tables) -> DataFrame:
    own = F.when(F.col("kind") == "company", F.col("revenue")).otherwise(0.0)
    return players(t).groupBy("ds_id", "market_id", "q").agg(
        F.sum(own).alias("company"), (F.sum("revenue") - F.sum(own)).alias("competitors"), F.sum("revenue").alias("total"))


def lift_markets(t: Tables) -> Tables:
    """Raise estimated market totals to the sum of the named players. Idempotent; keeps the old value as `lifted_from`."""
    floor = player_sums(t).select("ds_id", "market_id", "q", F.col("total").alias("_floor"))
    obs = t.market_obs.join(floor, ["ds_id", "market_id", "q"], "left")
    below = F.col("method").isNotNull() & (F.col("revenue") < F.coalesce("_floor", F.lit(0.0)))
    lifted = obs.withColumn("lifted_from", F.when(below, F.col("revenue"))).withColumn(
        "revenue", F.when(below, F.col("_floor")).otherwise(F.col("revenue"))).drop("_floor")
    return replace(t, market_obs=lifted)


def adjustments(lifted: Tables) -> DataFrame:
    return lifted.market_obs.where(F.col("lifted_from").isNotNull()).select(
        "ds_id", F.lit("ESTIMATED_MARKET_LIFTED_TO_PLAYER_SUM").alias("code"), "market_id", "q",
        F.col("lifted_from").alias("from_value"), F.col("revenue").alias("to_value"))


def latest_observation(t: Tables) -> DataFrame:
    """Last entry of each market series."""
    return t.market_obs.groupBy("ds_id", "market_id").agg(F.max_by(F.struct("q", "revenue", "method"), "j").alias("_l")).select(
        "ds_id", "market_id", F.col("_l.q").alias("latest_q"), F.col("_l.revenue").alias("latest_revenue"), F.col("_l.method").alias("latest_method"))


def target_quarter(t: Tables, as_of) -> DataFrame:
    """First quarter not reported yet, within the quarter just ended and the one in progress, after every observation."""
    current = quarter_index(as_of)
    observed = latest_observation(t).groupBy("ds_id").agg(F.max("latest_q").alias("_o"))
    return t.financials.join(observed, "ds_id").select(
        "ds_id", F.least(current, F.greatest(current - 1, F.col("q") + 1, F.col("_o") + 1)).alias("target_q"), F.col("q").alias("reported_q"))


def observed_growth(t: Tables) -> DataFrame:
    """Quarter-on-quarter and, with five observations, year-on-year growth at the last observation."""
    order = Window.partitionBy("ds_id", "market_id").orderBy("j")

    def growth(n):
        return (tdiv("revenue", F.lag("revenue", n).over(order)) - 1) * 100

    rows = t.market_obs.withColumns({"qoq_pct": growth(1), "yoy_pct": growth(4), "qoq_from": F.lag("q", 1).over(order),
                                     "yoy_from": F.lag("q", 4).over(order)})
    last = rows.groupBy("ds_id", "market_id").agg(F.max_by(F.struct("q", "revenue", "qoq_pct", "qoq_from", "yoy_pct", "yoy_from"), "j").alias("_l"))
    return last.select("ds_id", "market_id", "_l.*")


def common_quarters(t: Tables, rev: DataFrame, entity: DataFrame, key: str, same_currency: bool) -> DataFrame:
    obs = t.market_obs.groupBy("ds_id", "market_id", "q").agg(F.max_by("revenue", "j").alias("market_revenue"))
    rows = (rev.join(entity.select("ds_id", key, "market_id"), ["ds_id", key])
            .join(t.market.select("ds_id", "market_id", F.col("currency").alias("market_currency")), ["ds_id", "market_id"])
            .join(obs, ["ds_id", "market_id", "q"]))
    return rows.where(F.col("currency") == F.col("market_currency")) if same_currency else rows


def share_anchor(t: Tables) -> DataFrame:
    """Product revenue over market revenue at the latest quarter in both series."""
    rows = common_quarters(t, t.product_rev, t.product, "product_id", same_currency=False)
    best = rows.groupBy("ds_id", "product_id", "market_id").agg(
        F.max_by(F.struct("q", "revenue", "market_revenue"), F.struct("q", -F.col("j"))).alias("_a"))
    return best.select("ds_id", "product_id", "market_id", F.col("_a.q").alias("anchor_q"), F.col("_a.revenue").alias("product_revenue"),
                       F.col("_a.market_revenue").alias("market_revenue"), (F.col("_a.revenue") / F.col("_a.market_revenue")).alias("share"))


def competitor_anchor(t: Tables, as_of) -> DataFrame:
    """Latest shared quarter per competitor; `status` says why one is left out of the market structure."""
    rows = common_quarters(t, t.competitor_rev, t.competitor, "competitor_id", same_currency=True)
    best = rows.groupBy("ds_id", "competitor_id").agg(
        F.max_by(F.struct("q", "revenue", "market_revenue", "method"), F.struct("q", -F.col("j"))).alias("_a"))
    known = t.competitor.join(t.market.select("ds_id", "market_id"), ["ds_id", "market_id"], "left_semi")
    joined = known.join(best, ["ds_id", "competitor_id"], "left")
    old = quarter_index(as_of) - F.col("_a.q") > MAX_QUARTERS_BEFORE_AS_OF
    return joined.select("ds_id", "competitor_id", "market_id", "name", F.col("_a.q").alias("anchor_q"),
                         (F.col("_a.revenue") / F.col("_a.market_revenue")).alias("share0"), F.col("_a.method").isNotNull().alias("estimated"),
                         F.when(F.col("_a").isNull(), "no_common_quarter").when(old, "too_old").otherwise("used").alias("status"))


def projected_markets(t: Tables, as_of) -> DataFrame:
    """Market revenue at the target quarter: deseasonalise, compound, reseasonalise, cyclical multiplier."""
    season = F.array("s1", "s2", "s3", "s4")

    def slot(q):
        return F.element_at(season, (F.pmod(q, F.lit(4)) + 1).cast("int"))

    year_ago = t.market_obs.select("ds_id", "market_id", F.col("q").alias("_yq"), F.col("revenue").alias("_year_ago"))
    rows = (t.market.join(latest_observation(t), ["ds_id", "market_id"]).join(target_quarter(t, as_of), "ds_id")
            .join(t.market_tri, ["ds_id", "market_id"])
            .withColumn("_yq", F.col("target_q") - 4).join(year_ago, ["ds_id", "market_id", "_yq"], "left"))
    n = F.col("target_q") - F.col("latest_q")
    value = (F.col("latest_revenue") / slot(F.col("latest_q")) * F.pow(1 + quarterly_rate("annual_growth"), n)
             * slot(F.col("target_q")) * F.col("cyclical"))
    return with_fx(rows.withColumn("projected", value), t).select(
        "ds_id", "market_id", "scenario", "currency", "fx", "target_q", "reported_q", "latest_q", "latest_revenue", "projected",
        ((F.col("projected") / F.col("latest_revenue") - 1) * 100).alias("vs_latest_pct"),
        ((F.col("projected") / F.col("_year_ago") - 1) * 100).alias("yoy_pct"))


def product_scenarios(t: Tables, as_of) -> DataFrame:
    """Share, attributable revenue and operating profit of every product and scenario."""
    rows = (share_anchor(t).select("ds_id", "product_id", "market_id", F.col("share").alias("anchor_share"))
            .join(t.product.select("ds_id", "product_id", "share_min", "share_max"), ["ds_id", "product_id"])
            .join(t.product_tri, ["ds_id", "product_id"])
            .join(projected_markets(t, as_of), ["ds_id", "market_id", "scenario"]))
    return (rows.withColumn("share", clamp(F.col("anchor_share") + F.col("share_delta"), F.col("share_min"), F.col("share_max")))
            .withColumn("revenue_krw", F.col("projected") * F.col("share") * F.col("fx"))
            .withColumn("operating_profit_krw", F.col("revenue_krw") * F.col("margin")))


def competitor_scenarios(products: DataFrame, t: Tables, as_of) -> DataFrame:
    """Competitor shares beside each product, scaled down together when they exceed the room left."""
    used = (competitor_anchor(t, as_of).where(F.col("status") == "used")
            .withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in SCENARIOS])))
            .join(t.competitor_tri.select("ds_id", "competitor_id", "scenario", F.col("share_delta").alias("_d")),
                  ["ds_id", "competitor_id", "scenario"], "left"))
    room = F.greatest(F.lit(0.0), 1 - F.col("company_share"))
    rows = used.join(products.select("ds_id", "product_id", "market_id", "scenario", "projected", "fx", F.col("share").alias("company_share")),
                     ["ds_id", "market_id", "scenario"])
    raw = rows.withColumn("raw_share", clamp(F.col("share0") + F.coalesce("_d", F.lit(0.0)), 0.0, 1.0))
    total = F.sum("raw_share").over(Window.partitionBy("ds_id", "product_id", "scenario"))
    return (raw.withColumn("raw_sum", total)
            .withColumn("scale", F.when((F.col("raw_sum") > room) & (F.col("raw_sum") > 0), room / F.col("raw_sum")).otherwise(1.0))
            .withColumn("share", F.col("raw_share") * F.col("scale"))
            .withColumn("market_revenue", F.col("projected") * F.col("share"))
            .withColumn("revenue_krw", F.col("market_revenue") * F.col("fx")).drop("_d"))


def market_structure(products: DataFrame, competitors: DataFrame) -> DataFrame:
    """Company, competitors and others of each projected market; the parts add up to the market."""
    rivals = competitors.groupBy("ds_id", "product_id", "scenario").agg(
        F.sum("share").alias("competitor_share"), F.max("raw_sum").alias("_raw"), (F.min("scale") < 1 - SCALE_NOISE).alias("_scaled"))
    joined = products.join(rivals, ["ds_id", "product_id", "scenario"], "left").withColumns({
        "competitor_share": F.coalesce("competitor_share", F.lit(0.0)), "competitors_scaled": F.coalesce("_scaled", F.lit(False))})
    known = F.col("share") + F.col("competitor_share")
    others = F.greatest(F.lit(0.0), 1 - known)
    return joined.select(
        "ds_id", "product_id", "market_id", "scenario", "projected", F.col("share").alias("company_share"), "competitor_share",
        others.alias("others_share"), known.alias("identified_share"), "competitors_scaled",
        ((F.col("share") + F.coalesce("_raw", F.lit(0.0))) * 100).alias("bottom_up_pct"),
        (F.col("projected") * (known + others)).alias("parts_sum"))


def coverage(t: Tables) -> DataFrame:
    """Company revenue of the reported quarter explained by the products."""
    first = t.product_rev.join(t.financials.select("ds_id", "q"), ["ds_id", "q"]).groupBy("ds_id", "product_id").agg(
        F.min_by(F.struct("revenue", "currency"), "j").alias("_r")).select("ds_id", "product_id", "_r.*")
    rows = with_fx(t.product.select("ds_id", "product_id").join(first, ["ds_id", "product_id"], "left"), t)
    sums = rows.groupBy("ds_id").agg(F.coalesce(F.sum(F.col("revenue") * F.col("fx")), F.lit(0.0)).alias("covered"),
                                     F.max(F.col("revenue").isNull() | F.col("fx").isNull()).alias("missing"))
    return t.financials.join(sums, "ds_id").select(
        "ds_id", "q", F.col("total_revenue").alias("total"), "covered", F.greatest(F.lit(0.0), F.col("total_revenue") - F.col("covered")).alias("residual"),
        (F.col("covered") / F.col("total_revenue")).alias("ratio"), "missing")


def valuation(t: Tables, as_of, reported_eps: DataFrame) -> DataFrame:
    """Totals, bridge and P/E valuation of every (ds_id, scenario). reported_eps(ds_id, q, eps)."""
    products = product_scenarios(t, as_of)
    base = products.groupBy("ds_id", "scenario").agg(F.sum("revenue_krw").alias("_rev"), F.sum("operating_profit_krw").alias("_op"),
                                                     F.max("target_q").alias("target_q"), F.max("reported_q").alias("reported_q"))
    rows = (base.join(coverage(t).select("ds_id", F.col("residual").alias("_residual")), "ds_id")
            .join(t.residual_tri, ["ds_id", "scenario"], "left").join(t.bridge, "ds_id").join(t.pe_tri, ["ds_id", "scenario"])
            .join(t.quote.select("ds_id", "price"), "ds_id").join(t.shares.select("ds_id", "diluted"), "ds_id"))
    grown = F.col("_residual") * F.pow(1 + quarterly_rate("annual_growth"), F.col("target_q") - F.col("reported_q"))
    out = (rows.withColumn("residual_revenue", F.coalesce(grown, F.lit(0.0)))
           .withColumn("revenue", F.col("_rev") + F.col("residual_revenue"))
           .withColumn("operating_profit", F.col("_op") + F.col("residual_revenue") * F.coalesce("margin", F.lit(0.0)))
           .withColumn("pretax", F.col("operating_profit") + F.col("net_interest"))
           .withColumn("tax", F.greatest(F.lit(0.0), F.col("pretax")) * F.col("tax_rate"))
           .withColumn("net_income", F.col("pretax") - F.col("tax"))
           .withColumn("noncontrolling", F.col("net_income") * F.col("noncontrolling_share"))
           .withColumn("common", F.col("net_income") - F.col("noncontrolling") - F.col("preferred_claims"))
           .withColumn("quarter_eps", F.col("common") / F.col("diluted")))
    prior = (target_quarter(t, as_of).join(reported_eps.select("ds_id", F.col("q").alias("_q"), "eps"), "ds_id")
             .where(F.col("_q").between(F.col("target_q") - 3, F.col("target_q") - 1))
             .groupBy("ds_id").agg(F.sum("eps").alias("_prior"), F.countDistinct("_q").alias("_n")))
    joined = out.join(prior, "ds_id", "left")
    ttm = F.coalesce(F.col("_n") == 3, F.lit(False))
    annual = F.when(ttm, F.col("_prior") + F.col("quarter_eps")).otherwise(F.col("quarter_eps") * 4)
    available = (F.col("common") > 0) & (F.col("annual_eps") > 0)
    return joined.withColumn("annual_eps", annual).withColumns({
        "status": F.when(available, "available").otherwise("unavailable"),
        "eps_basis": F.when(available, F.when(ttm, "ttm_actual_plus_forecast").otherwise("quarter_x4")),
        "missing_quarters": F.lit(3) - F.coalesce("_n", F.lit(0)),
        "target_price": F.when(available, F.col("annual_eps") * F.col("pe")),
        "upside_pct": F.when(available, (F.col("annual_eps") * F.col("pe") / F.col("price") - 1) * 100),
    }).drop("_rev", "_op", "_residual", "_prior", "_n")


def contribution(t: Tables) -> DataFrame:
    """Products of the reported quarter by revenue in KRW."""
    rows = with_fx(t.product_rev.join(t.financials.select("ds_id", "q", "total_revenue"), ["ds_id", "q"]), t)
    order = Window.partitionBy("ds_id").orderBy(F.desc("revenue_krw"), "product_id")
    return (rows.withColumn("revenue_krw", F.col("revenue") * F.col("fx")).withColumn("rank", F.row_number().over(order))
            .select("ds_id", "rank", "product_id", "q", "revenue_krw", (F.col("revenue_krw") / F.col("total_revenue")).alias("share_of_company")))


def observed_structure(t: Tables) -> DataFrame:
    """Company, competitors and others at each market's latest observed quarter."""
    newest = t.market_obs.groupBy("ds_id", "market_id").agg(F.max_by(F.struct("q", "revenue", "method"), "q").alias("_l")).select(
        "ds_id", "market_id", "_l.q", F.col("_l.revenue").alias("market_revenue"), F.col("_l.method").isNotNull().alias("market_estimated"))
    sums = player_sums(t)
    n = players(t).where(F.col("kind") == "competitor").groupBy("ds_id", "market_id", "q").agg(F.count("*").alias("n_competitors"))
    rows = newest.join(sums, ["ds_id", "market_id", "q"], "left").join(n, ["ds_id", "market_id", "q"], "left").na.fill(0.0, ["company", "competitors", "total"])
    total = F.col("market_revenue")
    return rows.select("ds_id", "market_id", "q", "market_revenue", "market_estimated", F.col("company").alias("company_revenue"),
                       (F.col("company") / total).alias("company_share"), F.col("competitors").alias("competitor_revenue"),
                       F.coalesce("n_competitors", F.lit(0)).alias("n_competitors"),
                       F.greatest(F.lit(0.0), total - F.col("total")).alias("others_revenue"),
                       F.least(F.lit(1.0), F.col("total") / total).alias("identified_coverage"))


def all_series(t: Tables) -> DataFrame:
    """Every revenue figure with its path: (ds_id, kind, id, pos, j, q, revenue, currency, basis, method, published_at, path)."""
    def rows(kind, group, field, series, entity, key):
        joined = series.join(entity.select("ds_id", key, "pos", *(["currency"] if kind == "market" else [])), ["ds_id", key])
        return joined.select("ds_id", F.lit(kind).alias("kind"), F.col(key).alias("id"), "pos", "j", "q", "revenue", "currency", "basis",
                             "method", "published_at", F.format_string(f"{group}[%d].{field}[%d]", "pos", "j").alias("path"))

    return union_all([rows("market", "markets", "observations", t.market_obs, t.market, "market_id"),
                      rows("product", "products", "revenue", t.product_rev, t.product, "product_id"),
                      rows("competitor", "competitors", "revenue", t.competitor_rev, t.competitor, "competitor_id")])


def estimates(t: Tables) -> DataFrame:
    return all_series(t).where(F.col("method").isNotNull()).select(
        "ds_id", F.concat("path", F.lit(".revenue")).alias("path"), "kind", "q", "revenue", "currency", "method")


def groundedness(t: Tables) -> DataFrame:
    """Revenue figures, how many are estimates, grade of the data grounding."""
    rows = all_series(t).groupBy("ds_id").agg(F.count("*").alias("total"), F.count("method").alias("estimated"),
                                              F.count(F.when(F.col("method") == "model_knowledge", 1)).alias("knowledge_only"))
    ratio = (F.col("total") - F.col("estimated")) / F.col("total")
    return rows.withColumn("grounded_ratio", ratio).withColumn(
        "grade", F.when((ratio >= HIGH_GROUNDING) & (F.col("knowledge_only") == 0), "high")
        .when(ratio >= MEDIUM_GROUNDING, "medium").otherwise("low"))


def sources(t: Tables) -> DataFrame:
    """Every dated source of a dataset with its path."""
    def one(df, path):
        return df.select("ds_id", F.lit(path).alias("path"), "published_at")

    series = all_series(t).select("ds_id", F.concat("path", F.lit(".source")).alias("path"), "published_at")
    return union_all([one(t.quote, "quote.source"), one(t.shares, "shares.source"), one(t.financials, "financials.source"),
                      t.fx.select("ds_id", F.format_string("fx[%d].source", "pos").alias("path"), "published_at"), series])


def provenance(t: Tables) -> DataFrame:
    """Distinct sources of a dataset: the facts published on one date come from one document per kind."""
    return (sources(t).select("ds_id", F.regexp_extract("path", r"^([a-z]+)", 1).alias("title"), "published_at").dropDuplicates())


def warnings(t: Tables, as_of, values: DataFrame) -> DataFrame:
    """(ds_id, code, subject) of everything a reader of the valuation should know."""
    cov = coverage(t)
    n = target_quarter(t, as_of).join(latest_observation(t), "ds_id")
    by_ds = values.groupBy("ds_id").agg(F.max(F.col("status") == "unavailable").alias("_u"), F.max(F.col("eps_basis") == "quarter_x4").alias("_x4"))

    def flag(df, code, subject=F.lit("")):
        return df.select("ds_id", F.lit(code).alias("code"), subject.alias("subject"))

    return union_all([
        flag(cov.where(F.col("residual") > F.col("total") * ROUNDING_TOLERANCE), "RESIDUAL_ASSUMPTIONS"),
        flag(n.where(F.col("target_q") - F.col("latest_q") >= EXTRAPOLATION_QUARTERS), "MARKET_EXTRAPOLATED", F.col("market_id")),
        flag(by_ds.where("_u"), "SCENARIO_UNAVAILABLE"), flag(by_ds.where("_x4"), "EPS_QUARTER_X4"),
        flag(groundedness(t).where(F.col("estimated") > 0), "ESTIMATED_INPUTS"),
        flag(adjustments(t), "MARKET_LIFTED", F.concat_ws(":", "market_id", format_quarter("q"))),
        flag(competitor_anchor(t, as_of).where(F.col("status") != "used"), "COMPETITOR_LEFT_OUT", F.col("competitor_id"))])


def non_finite(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, column) of numbers that are NaN or infinite."""
    numeric = [f.name for f in values.schema if f.dataType.typeName() == "double"]
    bad = F.array_compact(F.array(*[F.when(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")), F.lit(c)) for c in numeric]))
    return values.select(*keys, F.explode(bad).alias("column"))


def report(t: Tables, as_of) -> DataFrame:
    """Per market: latest against projected, reconciliation gap, scaled competitors, implausible estimated swing."""
    products = product_scenarios(t, as_of)
    structure = market_structure(products, competitor_scenarios(products, t, as_of))
    proj = structure.groupBy("ds_id", "market_id").agg(
        *[F.max(F.when(F.col("scenario") == s, F.col("projected"))).alias(f"projected_{s}") for s in SCENARIOS],
        F.max(F.abs(F.col("parts_sum") / F.col("projected") - 1) * 100).alias("max_gap_pct"),
        F.count(F.when(F.col("competitors_scaled"), 1)).alias("scaled_scenarios"))
    growth = observed_growth(t).select("ds_id", "market_id", "q", "revenue", "qoq_pct", "yoy_pct")
    estimated = t.market_obs.groupBy("ds_id", "market_id").agg(F.count("method").alias("estimated_quarters"))
    last = latest_observation(t).select("ds_id", "market_id", F.col("latest_method").isNotNull().alias("latest_estimated"))
    return (growth.join(proj, ["ds_id", "market_id"]).join(estimated, ["ds_id", "market_id"]).join(last, ["ds_id", "market_id"])
            .withColumn("implausible_swing", F.coalesce(F.col("latest_estimated") & (F.abs("qoq_pct") > SWING_PCT), F.lit(False))))
