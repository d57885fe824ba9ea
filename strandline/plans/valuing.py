"""Valuation, rule and repair queries. A dataset is a supplier nation, its markets the part types sold in its region,
its competitors the other nations of the region; quarters are ship quarters."""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import quarter_end, quarter_index
from strandline.operators import quality_rules as qr
from strandline.operators import repair as ry
from strandline.operators import valuation as va
from strandline.plans.registry import ctes, query, rounded, sql_rnd, stable, staged, table

FIRST_Q, LAST_Q, AS_OF = 7980, 8007, "2002-05-15"


def as_of():
    return F.to_date(F.lit(AS_OF))


def sales(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", quarter_index(F.to_date("l_shipdate")).alias("q"),
                                                F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    parts = table(spark, sf, "part").select("p_partkey", "p_type")
    suppliers = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return (lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy("nation", "p_type", "q").agg(F.sum("cents").cast("double").alias("cents")))


def build_tables(spark, sf) -> va.Tables:
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    types = table(spark, sf, "part").select("p_type").distinct().withColumn("pos", F.row_number().over(Window.orderBy("p_type")) - 1)
    sold = staged(spark, sf, "sales", lambda: sales(spark, sf)).where(F.col("q").between(FIRST_Q, LAST_Q)).join(types, "p_type").join(nations, "nation")
    ds = nations.select(F.col("nation").alias("ds_id"), "region")
    slug = F.lower(F.col("p_type"))
    currency = F.when(F.col("pos") % 2 == 0, "USD").otherwise("KRW")
    published = F.date_add(quarter_end("q"), 20)
    entity = ds.join(sold.select("region", "p_type", "pos").distinct(), "region").select("ds_id", "pos", F.concat(F.lit("m-"), slug).alias("market_id"), F.concat(F.lit("p-"), slug).alias("product_id"), "p_type", "region")
    regional = sold.groupBy("region", "p_type", "pos", "q").agg((F.sum("cents") * 1.25).alias("gross"))
    is_est = (F.col("q") + F.col("pos")) % 5 == 0
    j = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy("q")) - 1
    obs = (entity.join(regional, ["region", "p_type", "pos"])
           .withColumn("method", F.when(is_est, "share_implied"))
           .withColumn("revenue", F.when(is_est, F.col("gross") * 0.75).otherwise(F.col("gross")))
           .select("ds_id", "market_id", j("ds_id", "market_id").alias("j"), "q", "revenue", F.lit("quarterly").alias("basis"), "method", published.alias("published_at")))
    own = (entity.join(sold.select(F.col("nation").alias("ds_id"), "p_type", "q", "cents"), ["ds_id", "p_type"]).where(F.col("q") >= 7980)
           .select("ds_id", "product_id", j("ds_id", "product_id").alias("j"), "q", F.col("cents").alias("revenue"), currency.alias("currency"),
                   F.lit("quarterly").alias("basis"), F.when(F.col("q") == 8001, "article_synthesis").alias("method"), published.alias("published_at")))
    rivals = (entity.join(nations.select(F.col("nation").alias("rival"), "region"), "region").where(F.col("rival") != F.col("ds_id"))
              .withColumn("competitor_id", F.concat(F.lit("c-"), F.col("rival").cast("string"), F.lit("-"), slug))
              .withColumn("cpos", F.row_number().over(Window.partitionBy("ds_id").orderBy("pos", "rival")) - 1))
    crev = (rivals.join(sold.select(F.col("nation").alias("rival"), "p_type", "q", "cents"), ["rival", "p_type"])
            .where(~((F.col("rival") % 7 == 0) & (F.col("q") > 8003)))
            .select("ds_id", "competitor_id", j("ds_id", "competitor_id").alias("j"), "q", F.col("cents").alias("revenue"),
                    F.when(F.col("rival") % 5 == 1, "JPY").otherwise(currency).alias("currency"), F.lit("quarterly").alias("basis"),
                    F.when((F.col("rival") + F.col("q")) % 11 == 0, "model_knowledge").alias("method"), published.alias("published_at")))
    n = F.col("ds_id")
    fx_rate = (1000 + 10 * n).cast("double")
    krw = own.where(F.col("q") == LAST_Q).groupBy("ds_id").agg(F.sum(F.col("revenue") * F.when(F.col("currency") == "USD", fx_rate).otherwise(1.0)).alias("k"))
    fin = krw.select("ds_id", F.lit(LAST_Q).alias("q"), (F.col("k") * 1.25).alias("total_revenue"), F.to_date(F.lit("2002-02-10")).alias("published_at"))
    growth = va.scenarios({"annual_growth": (0.0, 0.05, 0.1), "cyclical": (0.95, 1.0, 1.05)})
    tri = lambda df, keys, values: df.select(*keys, va.scenarios(values).alias("_s")).select(*keys, "_s.*")
    return va.Tables(
        quote=ds.select("ds_id", (50000 + 1000 * n).cast("double").alias("price"), F.to_date(F.lit("2002-05-12")).alias("as_of"), F.to_date(F.lit("2002-05-12")).alias("published_at")),
        shares=ds.select("ds_id", (1000000 + 1000 * n).cast("double").alias("diluted"), F.to_date(F.lit("2001-12-31")).alias("as_of"), F.to_date(F.lit("2002-02-10")).alias("published_at")),
        fx=ds.select("ds_id", F.lit(0).alias("pos"), F.lit("USD").alias("currency"), fx_rate.alias("krw_per_unit"), F.to_date(F.lit("2002-05-01")).alias("as_of"), F.to_date(F.lit("2002-05-01")).alias("published_at")),
        financials=fin,
        market=entity.select("ds_id", "pos", "market_id", F.concat(F.lit("Market "), "p_type").alias("name"), F.concat(F.lit("All "), "p_type").alias("scope"), currency.alias("currency"),
                             F.lit(1.05).alias("s1"), F.lit(0.95).alias("s2"), F.lit(0.975).alias("s3"), F.lit(1.025).alias("s4")),
        market_obs=obs, market_tri=entity.select("ds_id", "market_id", growth.alias("_s")).select("ds_id", "market_id", "_s.*"),
        product=entity.select("ds_id", "pos", "product_id", F.concat(F.lit("Product "), "p_type").alias("name"), "market_id", F.lit(0.125).alias("share_min"), F.lit(0.5).alias("share_max")),
        product_rev=own, product_tri=tri(entity, ["ds_id", "product_id"], {"share_delta": (-0.02, 0.0, 0.02), "margin": (0.05, 0.1, 0.15)}),
        competitor=rivals.select("ds_id", F.col("cpos").alias("pos"), "competitor_id", F.concat(F.lit("Nation "), F.col("rival").cast("string")).alias("name"), "market_id"),
        competitor_rev=crev, competitor_tri=tri(rivals, ["ds_id", "competitor_id"], {"share_delta": (-0.01, 0.0, 0.1)}),
        residual_tri=tri(ds.where(n % 3 != 0), ["ds_id"], {"annual_growth": (0.0, 0.02, 0.04), "margin": (0.02, 0.04, 0.06)}),
        bridge=fin.select("ds_id", (F.col("total_revenue") * -0.01).alias("net_interest"), F.lit(0.25).alias("tax_rate"), F.lit(0.05).alias("noncontrolling_share"), F.lit(1000.0).alias("preferred_claims")),
        pe_tri=tri(ds, ["ds_id"], {"pe": (8.0, 10.0, 12.0)}))


def tables(spark, sf) -> va.Tables:
    built = build_tables(spark, sf)
    return va.Tables(**{f.name: staged(spark, sf, f"val-{f.name}", lambda f=f: getattr(built, f.name)) for f in fields(va.Tables)})


def lifted(spark, sf) -> va.Tables:
    t = va.lift_markets(tables(spark, sf))
    return replace(t, market_obs=staged(spark, sf, "val-lifted", lambda: t.market_obs))


def reported_eps(t: va.Tables) -> DataFrame:
    rows = t.quote.select("ds_id", F.explode(F.array(F.lit(8005), F.lit(8006), F.lit(8007))).alias("q"))
    return rows.where((F.col("ds_id") % 4 != 0) | (F.col("q") != 8006)).withColumn("eps", (100 + F.col("ds_id")).cast("double"))


SQL_VAL = f"""
types AS (SELECT p_type, lower(p_type) AS slug, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INTEGER) AS pos FROM (SELECT DISTINCT p_type FROM part)),
nat AS (SELECT n_nationkey AS nation, n_regionkey AS region FROM nation),
sold AS (SELECT s_nationkey AS nation, region, l.p_type, pos, slug, q, cents FROM (SELECT s_nationkey, p_type, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS q, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS cents
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3) l JOIN types t ON l.p_type = t.p_type JOIN nat ON nat.nation = s_nationkey WHERE q BETWEEN {FIRST_Q} AND {LAST_Q}),
ent AS (SELECT nation AS ds_id, region, pos, slug, 'm-' || slug AS market_id, 'p-' || slug AS product_id, CASE WHEN pos % 2 = 0 THEN 'USD' ELSE 'KRW' END AS currency, CASE WHEN pos % 2 = 0 THEN CAST(1000 + 10 * nation AS DOUBLE) ELSE 1.0 END AS fx FROM nat, types),
gross AS (SELECT region, pos, q, sum(cents) * 1.25 AS gross FROM sold GROUP BY 1, 2, 3),
obs0 AS (SELECT ds_id, e.pos, market_id, currency, fx, q, CASE WHEN (q + e.pos) % 5 = 0 THEN 'share_implied' END AS method, CASE WHEN (q + e.pos) % 5 = 0 THEN gross * 0.75 ELSE gross END AS raw_revenue FROM ent e JOIN gross g ON e.region = g.region AND e.pos = g.pos),
own AS (SELECT e.ds_id, e.pos, product_id, market_id, currency, fx, q, cents AS revenue, CASE WHEN q = 8001 THEN 'article_synthesis' END AS method FROM ent e JOIN sold s ON s.nation = e.ds_id AND s.pos = e.pos WHERE q >= 7980),
crev AS (SELECT e.ds_id, e.pos, market_id, 'c-' || s.nation || '-' || e.slug AS competitor_id, s.nation AS rival, s.q, s.cents AS revenue, CASE WHEN s.nation % 5 = 1 THEN 'JPY' ELSE e.currency END AS ccy, e.currency, CASE WHEN (s.nation + s.q) % 11 = 0 THEN 'model_knowledge' END AS method
  FROM ent e JOIN sold s ON s.region = e.region AND s.pos = e.pos AND s.nation <> e.ds_id WHERE NOT (s.nation % 7 = 0 AND s.q > 8003)),
riv AS (SELECT e.ds_id, e.pos, e.market_id, n.nation AS rival, 'c-' || n.nation || '-' || e.slug AS competitor_id FROM ent e JOIN nat n ON n.region = e.region AND n.nation <> e.ds_id),
psum AS (SELECT ds_id, market_id, q, sum(c) AS company, sum(r) AS competitors, sum(c) + sum(r) AS total, count(rk) AS nr FROM (SELECT ds_id, market_id, q, revenue AS c, 0.0 AS r, NULL AS rk FROM own UNION ALL SELECT ds_id, market_id, q, 0.0, revenue, 1 FROM crev WHERE ccy = currency) GROUP BY 1, 2, 3),
obs AS (SELECT o.*, CASE WHEN method IS NOT NULL AND raw_revenue < coalesce(total, 0.0) THEN raw_revenue END AS lifted_from, CASE WHEN method IS NOT NULL AND raw_revenue < coalesce(total, 0.0) THEN total ELSE raw_revenue END AS revenue FROM obs0 o LEFT JOIN psum p USING (ds_id, market_id, q)),
fin AS (SELECT ds_id, {LAST_Q} AS q, sum(revenue * fx) * 1.25 AS total_revenue, sum(revenue * fx) AS covered FROM own WHERE q = {LAST_Q} GROUP BY 1),
sc AS (SELECT * FROM (VALUES ('bear', 0.0, 0.95, -0.02, 0.05, -0.01, 0.0, 0.02, 8.0), ('base', 0.05, 1.0, 0.0, 0.1, 0.0, 0.02, 0.04, 10.0), ('bull', 0.1, 1.05, 0.02, 0.15, 0.1, 0.04, 0.06, 12.0)) v(scenario, growth, cyc, sdelta, margin, cdelta, rgrowth, rmargin, pe)),
tgt AS (SELECT f.ds_id, least(8009, greatest(8008, f.q + 1, max(o.q) + 1)) AS target_q FROM fin f JOIN obs o ON o.ds_id = f.ds_id GROUP BY f.ds_id, f.q),
lat AS (SELECT ds_id, market_id, max(q) AS latest_q, max_by(revenue, q) AS latest_revenue, max_by(coalesce(method, ''), q) AS latest_method FROM obs GROUP BY 1, 2),
proj AS (SELECT e.ds_id, e.market_id, e.product_id, e.pos, e.fx, scenario, sdelta, margin, cdelta, target_q, latest_q, latest_revenue,
  latest_revenue / [1.05, 0.95, 0.975, 1.025][latest_q % 4 + 1] * pow(1 + (pow(1 + growth, 0.25) - 1), target_q - latest_q) * [1.05, 0.95, 0.975, 1.025][target_q % 4 + 1] * cyc AS projected
  FROM ent e JOIN lat l ON l.ds_id = e.ds_id AND l.market_id = e.market_id JOIN tgt t ON t.ds_id = e.ds_id, sc),
anch AS (SELECT w.ds_id, w.product_id, w.market_id, max(w.q) AS anchor_q, max_by(w.revenue, w.q) AS product_revenue, max_by(o.revenue, w.q) AS market_revenue, max_by(w.revenue / o.revenue, w.q) AS share FROM own w JOIN obs o ON o.ds_id = w.ds_id AND o.market_id = w.market_id AND o.q = w.q GROUP BY 1, 2, 3),
ps AS (SELECT p.*, least(0.5, greatest(0.125, a.share + sdelta)) AS share, projected * least(0.5, greatest(0.125, a.share + sdelta)) * fx AS revenue_krw FROM proj p JOIN anch a ON a.ds_id = p.ds_id AND a.product_id = p.product_id),
canc AS (SELECT r.ds_id, r.competitor_id, r.market_id, max(c.q) AS anchor_q, max_by(c.revenue / o.revenue, c.q) AS share0 FROM riv r LEFT JOIN (crev c JOIN obs o ON o.ds_id = c.ds_id AND o.market_id = c.market_id AND o.q = c.q AND c.ccy = c.currency) ON c.ds_id = r.ds_id AND c.competitor_id = r.competitor_id GROUP BY 1, 2, 3),
cst AS (SELECT *, CASE WHEN anchor_q IS NULL THEN 'no_common_quarter' WHEN 8009 - anchor_q > 3 THEN 'too_old' ELSE 'used' END AS status FROM canc),
cs AS (SELECT c.ds_id, c.competitor_id, p.product_id, p.scenario, p.projected, p.fx, p.share AS company_share, least(1.0, greatest(0.0, share0 + cdelta)) AS raw_share FROM cst c JOIN ps p ON p.ds_id = c.ds_id AND p.market_id = c.market_id WHERE status = 'used'),
cs2 AS (SELECT *, sum(raw_share) OVER (PARTITION BY ds_id, product_id, scenario) AS raw_sum FROM cs),
cs3 AS (SELECT *, CASE WHEN raw_sum > greatest(0.0, 1 - company_share) AND raw_sum > 0 THEN greatest(0.0, 1 - company_share) / raw_sum ELSE 1.0 END AS scale FROM cs2),
st AS (SELECT p.ds_id, p.product_id, p.market_id, p.scenario, p.projected, p.share AS company_share, coalesce(sum(c.raw_share * c.scale), 0.0) AS competitor_share, coalesce(max(c.raw_sum), 0.0) AS raw_sum, coalesce(min(c.scale) < 1 - 1e-12, false) AS competitors_scaled
  FROM ps p LEFT JOIN cs3 c ON c.ds_id = p.ds_id AND c.product_id = p.product_id AND c.scenario = p.scenario GROUP BY ALL),
cov AS (SELECT ds_id, q, total_revenue AS total, covered, greatest(0.0, total_revenue - covered) AS residual, covered / total_revenue AS ratio FROM fin),
tot AS (SELECT p.ds_id, p.scenario, any_value(target_q) AS target_q, sum(revenue_krw) AS rev, sum(revenue_krw * p.margin) AS op FROM ps p GROUP BY 1, 2),
v1 AS (SELECT t.ds_id, t.scenario, t.target_q, s.pe, CAST(50000 + 1000 * t.ds_id AS DOUBLE) AS price, CAST(1000000 + 1000 * t.ds_id AS DOUBLE) AS diluted, c.total,
  CASE WHEN t.ds_id % 3 <> 0 THEN c.residual * pow(1 + (pow(1 + s.rgrowth, 0.25) - 1), target_q - c.q) ELSE 0.0 END AS rr, s.rmargin, rev, op FROM tot t JOIN sc s ON s.scenario = t.scenario JOIN cov c ON c.ds_id = t.ds_id),
v2 AS (SELECT *, rev + rr AS revenue, op + rr * rmargin AS operating_profit, op + rr * rmargin + total * -0.01 AS pretax FROM v1),
v3 AS (SELECT *, greatest(0.0, pretax) * 0.25 AS tax, (pretax - greatest(0.0, pretax) * 0.25) * (1 - 0.05) - 1000.0 AS common FROM v2),
v4 AS (SELECT *, common / diluted AS quarter_eps, CASE WHEN ds_id % 4 <> 0 THEN 3 * (100.0 + ds_id) + common / diluted ELSE common / diluted * 4 END AS annual_eps FROM v3),
val AS (SELECT *, common > 0 AND annual_eps > 0 AS ok FROM v4)
"""


@query("market_lift", ctes(SQL_VAL) + f"SELECT ds_id, market_id, q, {sql_rnd('lifted_from', 2)} AS from_value, {sql_rnd('revenue', 2)} AS to_value FROM obs WHERE lifted_from IS NOT NULL")
def market_lift(spark, sf):
    return rounded(va.adjustments(lifted(spark, sf)), ["ds_id", "market_id", "q"], ["from_value", "to_value"], 2)


@query("player_sums", ctes(SQL_VAL) + f"SELECT ds_id, market_id, q, {sql_rnd('company', 2)} AS company, {sql_rnd('competitors', 2)} AS competitors, {sql_rnd('total', 2)} AS total FROM psum")
def player_sums(spark, sf):
    return rounded(va.player_sums(tables(spark, sf)), ["ds_id", "market_id", "q"], ["company", "competitors", "total"], 2)


@query("target_quarter", ctes(SQL_VAL) + "SELECT ds_id, target_q FROM tgt")
def target_quarter(spark, sf):
    return va.target_quarter(lifted(spark, sf), as_of()).select("ds_id", "target_q")


@query("observed_growth", ctes(SQL_VAL) + f""", g AS (SELECT ds_id, market_id, q, revenue, (revenue / lag(revenue, 1) OVER w - 1) * 100 AS qoq_pct, (revenue / lag(revenue, 4) OVER w - 1) * 100 AS yoy_pct, row_number() OVER (PARTITION BY ds_id, market_id ORDER BY q DESC) AS rn FROM obs WINDOW w AS (PARTITION BY ds_id, market_id ORDER BY q))
SELECT ds_id, market_id, q, {sql_rnd('qoq_pct')} AS qoq_pct, {sql_rnd('yoy_pct')} AS yoy_pct FROM g WHERE rn = 1""")
def observed_growth(spark, sf):
    return rounded(va.observed_growth(lifted(spark, sf)), ["ds_id", "market_id", "q"], ["qoq_pct", "yoy_pct"])


@query("share_anchor", ctes(SQL_VAL) + f"SELECT ds_id, product_id, anchor_q, {sql_rnd('share', 9)} AS share FROM anch")
def share_anchor(spark, sf):
    return rounded(va.share_anchor(lifted(spark, sf)), ["ds_id", "product_id", "anchor_q"], ["share"], 9)


@query("competitor_anchor", ctes(SQL_VAL) + f"SELECT ds_id, competitor_id, market_id, anchor_q, status, {sql_rnd('share0', 9)} AS share0 FROM cst")
def competitor_anchor(spark, sf):
    return rounded(va.competitor_anchor(lifted(spark, sf), as_of()), ["ds_id", "competitor_id", "market_id", "anchor_q", "status"], ["share0"], 9)


@query("product_scenarios", ctes(SQL_VAL) + f"SELECT ds_id, product_id, scenario, target_q, {sql_rnd('projected', 1)} AS projected, {sql_rnd('share', 9)} AS share, {sql_rnd('revenue_krw / 1e6', 3)} AS revenue_mn, {sql_rnd('revenue_krw * margin / 1e6', 3)} AS profit_mn FROM ps")
def product_scenarios(spark, sf):
    p = va.product_scenarios(lifted(spark, sf), as_of())
    return p.select("ds_id", "product_id", "scenario", "target_q", stable("projected", 1).alias("projected"), stable("share", 9).alias("share"),
                    stable(F.col("revenue_krw") / 1e6, 3).alias("revenue_mn"), stable(F.col("operating_profit_krw") / 1e6, 3).alias("profit_mn"))


@query("competitor_scenarios", ctes(SQL_VAL) + f"SELECT ds_id, competitor_id, product_id, scenario, {sql_rnd('raw_share', 9)} AS raw_share, {sql_rnd('scale', 9)} AS scale, {sql_rnd('projected * (raw_share * scale) * fx / 1e6', 3)} AS revenue_mn FROM cs3")
def competitor_scenarios(spark, sf):
    t = lifted(spark, sf)
    c = va.competitor_scenarios(va.product_scenarios(t, as_of()), t, as_of())
    return c.select("ds_id", "competitor_id", "product_id", "scenario", stable("raw_share", 9).alias("raw_share"), stable("scale", 9).alias("scale"),
                    stable(F.col("revenue_krw") / 1e6, 3).alias("revenue_mn"))


@query("market_structure", ctes(SQL_VAL) + f"""SELECT ds_id, product_id, scenario, competitors_scaled, {sql_rnd('company_share', 9)} AS company_share, {sql_rnd('competitor_share', 9)} AS competitor_share, {sql_rnd('greatest(0.0, 1 - (company_share + competitor_share))', 9)} AS others_share,
  {sql_rnd('(company_share + raw_sum) * 100', 6)} AS bottom_up_pct, {sql_rnd('(company_share + competitor_share + greatest(0.0, 1 - (company_share + competitor_share)) - 1) * 100', 6)} AS gap_pct FROM st""")
def market_structure(spark, sf):
    t = lifted(spark, sf)
    p = va.product_scenarios(t, as_of())
    s = va.market_structure(p, va.competitor_scenarios(p, t, as_of())).withColumn("gap_pct", (F.col("parts_sum") / F.col("projected") - 1) * 100)
    keys = ["ds_id", "product_id", "scenario", "competitors_scaled"]
    return s.select(*keys, *[stable(c, 9).alias(c) for c in ("company_share", "competitor_share", "others_share")], stable("bottom_up_pct").alias("bottom_up_pct"), stable("gap_pct").alias("gap_pct"))


@query("revenue_coverage", ctes(SQL_VAL) + f"SELECT ds_id, q, {sql_rnd('total / 1e6', 3)} AS total, {sql_rnd('covered / 1e6', 3)} AS covered, {sql_rnd('residual / 1e6', 3)} AS residual, {sql_rnd('ratio')} AS ratio, (SELECT count(*) FROM own o WHERE o.ds_id = cov.ds_id AND o.q = cov.q) < (SELECT count(*) FROM types) AS missing FROM cov")
def revenue_coverage(spark, sf):
    c = va.coverage(lifted(spark, sf))
    return c.select("ds_id", "q", *[stable(F.col(x) / 1e6, 3).alias(x) for x in ("total", "covered", "residual")], stable("ratio").alias("ratio"), "missing")


_VAL = ["revenue", "operating_profit", "pretax", "tax", "common"]


@query("scenario_valuation", ctes(SQL_VAL) + f"""SELECT ds_id, scenario, target_q, CASE WHEN ok THEN 'available' ELSE 'unavailable' END AS status, CASE WHEN ok THEN CASE WHEN ds_id % 4 <> 0 THEN 'ttm_actual_plus_forecast' ELSE 'quarter_x4' END END AS eps_basis,
  {", ".join(f"{sql_rnd(c + ' / 1e6', 3)} AS {c}" for c in _VAL)}, {sql_rnd('annual_eps', 4)} AS annual_eps, {sql_rnd('CASE WHEN ok THEN annual_eps * pe END', 3)} AS target_price, {sql_rnd('CASE WHEN ok THEN (annual_eps * pe / price - 1) * 100 END', 4)} AS upside_pct FROM val""")
def scenario_valuation(spark, sf):
    t = lifted(spark, sf)
    v = va.valuation(t, as_of(), reported_eps(t))
    return v.select("ds_id", "scenario", "target_q", "status", "eps_basis", *[stable(F.col(c) / 1e6, 3).alias(c) for c in _VAL],
                    stable("annual_eps", 4).alias("annual_eps"), stable("target_price", 3).alias("target_price"), stable("upside_pct", 4).alias("upside_pct"))


@query("product_contribution", ctes(SQL_VAL) + f"SELECT o.ds_id, CAST(row_number() OVER (PARTITION BY o.ds_id ORDER BY revenue * fx DESC, product_id) AS INTEGER) AS rank, product_id, {sql_rnd('revenue * fx / total_revenue')} AS share_of_company FROM own o JOIN fin f ON f.ds_id = o.ds_id AND f.q = o.q")
def product_contribution(spark, sf):
    return rounded(va.contribution(lifted(spark, sf)), ["ds_id", "rank", "product_id"], ["share_of_company"])


@query("observed_structure", ctes(SQL_VAL) + f"""SELECT l.ds_id, l.market_id, l.latest_q AS q, l.latest_method <> '' AS market_estimated, {sql_rnd('p.company / latest_revenue', 9)} AS company_share, p.nr AS n_competitors,
  {sql_rnd('greatest(0.0, latest_revenue - p.total)', 2)} AS others_revenue, {sql_rnd('least(1.0, p.total / latest_revenue)', 9)} AS identified_coverage FROM lat l JOIN psum p ON p.ds_id = l.ds_id AND p.market_id = l.market_id AND p.q = l.latest_q""")
def observed_structure(spark, sf):
    s = va.observed_structure(lifted(spark, sf))
    return s.select("ds_id", "market_id", "q", "market_estimated", stable("company_share", 9).alias("company_share"), "n_competitors", stable("others_revenue", 2).alias("others_revenue"),
                    stable("identified_coverage", 9).alias("identified_coverage"))


SQL_SERIES = SQL_VAL.strip() + """,
ser AS (SELECT ds_id, 'market' AS kind, market_id AS id, 'markets[' || pos || '].observations[' || (row_number() OVER (PARTITION BY ds_id, market_id ORDER BY q) - 1) || ']' AS path, q, revenue, currency, method FROM obs
  UNION ALL SELECT ds_id, 'product', product_id, 'products[' || pos || '].revenue[' || (row_number() OVER (PARTITION BY ds_id, product_id ORDER BY q) - 1) || ']', q, revenue, currency, method FROM own
  UNION ALL SELECT c.ds_id, 'competitor', c.competitor_id, 'competitors[' || r.cpos || '].revenue[' || (row_number() OVER (PARTITION BY c.ds_id, c.competitor_id ORDER BY q) - 1) || ']', q, revenue, ccy, method FROM crev c
   JOIN (SELECT ds_id, competitor_id, row_number() OVER (PARTITION BY ds_id ORDER BY pos, rival) - 1 AS cpos FROM riv) r ON r.ds_id = c.ds_id AND r.competitor_id = c.competitor_id)
"""


@query("estimate_inventory", ctes(SQL_SERIES) + f"SELECT ds_id, path || '.revenue' AS path, kind, q, {sql_rnd('revenue', 2)} AS revenue, currency, method FROM ser WHERE method IS NOT NULL")
def estimate_inventory(spark, sf):
    return va.estimates(lifted(spark, sf)).select("ds_id", "path", "kind", "q", stable("revenue", 2).alias("revenue"), "currency", "method")


@query("groundedness", ctes(SQL_SERIES) + f""", g AS (SELECT ds_id, count(*) AS total, count(method) AS estimated, count(CASE WHEN method = 'model_knowledge' THEN 1 END) AS knowledge_only FROM ser GROUP BY 1)
SELECT *, {sql_rnd('(total - estimated) / total')} AS grounded_ratio, CASE WHEN (total - estimated) / total >= 0.8 AND knowledge_only = 0 THEN 'high' WHEN (total - estimated) / total >= 0.5 THEN 'medium' ELSE 'low' END AS grade FROM g""")
def groundedness(spark, sf):
    return rounded(va.groundedness(lifted(spark, sf)), ["ds_id", "total", "estimated", "knowledge_only", "grade"], ["grounded_ratio"])


@query("provenance", ctes(SQL_SERIES) + """SELECT DISTINCT ds_id, CASE kind WHEN 'market' THEN 'markets' WHEN 'product' THEN 'products' ELSE 'competitors' END AS title, CAST(last_day(make_date(CAST(q // 4 AS INTEGER), CAST(q % 4 * 3 + 3 AS INTEGER), 1)) AS DATE) + 20 AS published_at FROM ser
 UNION SELECT nation, 'quote', DATE '2002-05-12' FROM nat UNION SELECT nation, 'shares', DATE '2002-02-10' FROM nat UNION SELECT ds_id, 'financials', DATE '2002-02-10' FROM fin UNION SELECT nation, 'fx', DATE '2002-05-01' FROM nat""")
def provenance(spark, sf):
    return va.provenance(lifted(spark, sf))


@query("valuation_warnings", ctes(SQL_SERIES) + """SELECT ds_id, 'RESIDUAL_ASSUMPTIONS' AS code, '' AS subject FROM cov WHERE residual > total * 1e-4
 UNION ALL SELECT ds_id, 'SCENARIO_UNAVAILABLE', '' FROM val GROUP BY 1 HAVING bool_or(NOT ok) UNION ALL SELECT ds_id, 'EPS_QUARTER_X4', '' FROM val GROUP BY 1 HAVING bool_or(ok AND ds_id % 4 = 0)
 UNION ALL SELECT ds_id, 'ESTIMATED_INPUTS', '' FROM ser GROUP BY 1 HAVING count(method) > 0 UNION ALL SELECT ds_id, 'MARKET_LIFTED', market_id || ':' || (q // 4) || 'Q' || (q % 4 + 1) FROM obs WHERE lifted_from IS NOT NULL
 UNION ALL SELECT ds_id, 'COMPETITOR_LEFT_OUT', competitor_id FROM cst WHERE status <> 'used'""")
def valuation_warnings(spark, sf):
    t = lifted(spark, sf)
    return va.warnings(t, as_of(), va.valuation(t, as_of(), reported_eps(t)))


@query("non_finite_outputs", ctes(SQL_VAL) + "SELECT ds_id, scenario, 'overflow' AS \"column\" FROM val WHERE ds_id >= 8")
def non_finite_outputs(spark, sf):
    t = lifted(spark, sf)
    values = va.valuation(t, as_of(), reported_eps(t)).withColumn("overflow", F.exp(F.col("ds_id") * 100.0))
    return va.non_finite(values, ["ds_id", "scenario"])


@query("valuation_report", ctes(SQL_VAL) + f""", g AS (SELECT ds_id, market_id, q, (revenue / lag(revenue, 1) OVER w - 1) * 100 AS qoq_pct, method, row_number() OVER (PARTITION BY ds_id, market_id ORDER BY q DESC) AS rn, count(method) OVER (PARTITION BY ds_id, market_id) AS estimated_quarters FROM obs WINDOW w AS (PARTITION BY ds_id, market_id ORDER BY q)),
pr AS (SELECT ds_id, market_id, max(CASE WHEN scenario = 'bear' THEN projected END) AS projected_bear, max(CASE WHEN scenario = 'bull' THEN projected END) AS projected_bull, count(CASE WHEN competitors_scaled THEN 1 END) AS scaled_scenarios FROM st GROUP BY 1, 2)
SELECT g.ds_id, g.market_id, g.q, estimated_quarters, method IS NOT NULL AS latest_estimated, coalesce(method IS NOT NULL AND abs(qoq_pct) > 30, false) AS implausible_swing, scaled_scenarios, {sql_rnd('projected_bear', 1)} AS projected_bear, {sql_rnd('projected_bull', 1)} AS projected_bull FROM g JOIN pr ON pr.ds_id = g.ds_id AND pr.market_id = g.market_id WHERE rn = 1""")
def valuation_report(spark, sf):
    r = va.report(lifted(spark, sf), as_of())
    return rounded(r, ["ds_id", "market_id", "q", "estimated_quarters", "latest_estimated", "implausible_swing", "scaled_scenarios"], ["projected_bear", "projected_bull"], 1)


# ---- rules and repairs on spoiled copies of the datasets ------------------------------------------------------------


def spoiled(spark, sf) -> va.Tables:
    """The same datasets with faults planted by dataset number."""
    t, n = tables(spark, sf), F.col("ds_id")
    early = lambda df: df.withColumn("published_at", F.when((n % 10 == 6) & (F.col("j") == 1), F.date_sub("published_at", 60)).otherwise(F.col("published_at")))
    gap = t.product_rev.where(~((n % 6 == 5) & (F.col("j") == 4))).withColumn("j", F.row_number().over(Window.partitionBy("ds_id", "product_id").orderBy("q")) - 1)
    product_rev = gap.withColumns({"basis": F.when((n % 6 == 1) & (F.col("j") == 2), "annual").otherwise(F.col("basis")),
                                   "currency": F.when((n % 6 == 3) & (F.col("j") == 1), "EUR").otherwise(F.col("currency"))})
    market = t.market.withColumns({"name": F.when((n % 5 == 2) & (F.col("pos") == 1), "MARKET x").when((n % 5 == 2) & (F.col("pos") == 0), "market-X").otherwise(F.col("name")),
                                   "s1": F.when(n % 7 == 3, 1.25).otherwise(F.col("s1"))})
    product = t.product.withColumn("market_id", F.when((n % 4 == 3) & (F.col("pos") == 5), "m-none").when((n % 8 == 1) & (F.col("pos") == 4), F.first("market_id").over(Window.partitionBy("ds_id").orderBy("pos"))).otherwise(F.col("market_id")))
    extra = t.fx.where(n % 8 == 5)
    fx = (t.fx.where(n % 9 != 4).unionByName(extra.withColumn("pos", F.lit(1)))
          .unionByName(extra.withColumns({"pos": F.lit(2), "currency": F.lit("KRW")})))
    financials = t.financials.withColumn("total_revenue", F.when(n % 11 == 2, F.col("total_revenue") * 0.5).when(n % 11 == 3, F.col("total_revenue") * 4).otherwise(F.col("total_revenue")))
    quote = t.quote.withColumn("as_of", F.when(n % 12 == 7, F.date_sub("as_of", 30)).when(n % 12 == 8, F.date_add("as_of", 10)).otherwise(F.col("as_of")))
    obs = t.market_obs.withColumn("revenue", F.when((n % 13 == 4) & (F.col("j") == 3), F.col("revenue") * 4).otherwise(F.col("revenue")))
    out = replace(t, product_rev=early(product_rev), market=market, product=product, fx=fx, financials=financials, quote=quote, market_obs=early(obs))
    changed = ("product_rev", "market", "product", "fx", "financials", "quote", "market_obs")
    return replace(out, **{c: staged(spark, sf, f"bad-{c}", lambda c=c: getattr(out, c)) for c in changed})


def spoiled_lifted(spark, sf) -> va.Tables:
    t = va.lift_markets(spoiled(spark, sf))
    return replace(t, market_obs=staged(spark, sf, "bad-lifted", lambda: t.market_obs))


_QE = "CAST(last_day(make_date(CAST(q // 4 AS INTEGER), CAST(q % 4 * 3 + 3 AS INTEGER), 1)) AS DATE)"
SQL_BAD = SQL_VAL.strip() + f""",
bo0 AS (SELECT *, row_number() OVER (PARTITION BY ds_id, market_id ORDER BY q) - 1 AS j FROM obs0),
bo1 AS (SELECT ds_id, pos, market_id, j, q, CASE WHEN ds_id % 13 = 4 AND j = 3 THEN raw_revenue * 4 ELSE raw_revenue END AS raw_revenue, method, 'quarterly' AS basis, {_QE} + 20 - CASE WHEN ds_id % 10 = 6 AND j = 1 THEN 60 ELSE 0 END AS published_at FROM bo0),
bp AS (SELECT ds_id, pos, product_id, CASE WHEN ds_id % 4 = 3 AND pos = 5 THEN 'm-none' WHEN ds_id % 8 = 1 AND pos = 4 THEN first_value(market_id) OVER (PARTITION BY ds_id ORDER BY pos) ELSE market_id END AS market_id FROM ent),
bw0 AS (SELECT *, row_number() OVER (PARTITION BY ds_id, product_id ORDER BY q) - 1 AS j0 FROM own),
bw1 AS (SELECT ds_id, pos, product_id, q, revenue, currency AS c0, method, row_number() OVER (PARTITION BY ds_id, product_id ORDER BY q) - 1 AS j FROM bw0 WHERE NOT (ds_id % 6 = 5 AND j0 = 4)),
bw AS (SELECT ds_id, pos, product_id, j, q, revenue, CASE WHEN ds_id % 6 = 3 AND j = 1 THEN 'EUR' ELSE c0 END AS currency, CASE WHEN ds_id % 6 = 1 AND j = 2 THEN 'annual' ELSE 'quarterly' END AS basis, method, {_QE} + 20 - CASE WHEN ds_id % 10 = 6 AND j = 1 THEN 60 ELSE 0 END AS published_at FROM bw1),
bc AS (SELECT c.*, r.cpos, row_number() OVER (PARTITION BY c.ds_id, c.competitor_id ORDER BY q) - 1 AS j, 'quarterly' AS basis, {_QE} + 20 AS published_at FROM crev c JOIN (SELECT ds_id, competitor_id, row_number() OVER (PARTITION BY ds_id ORDER BY pos, rival) - 1 AS cpos FROM riv) r ON r.ds_id = c.ds_id AND r.competitor_id = c.competitor_id),
bm AS (SELECT ds_id, pos, market_id, currency FROM ent),
bsum AS (SELECT ds_id, market_id, q, sum(revenue) AS total FROM (SELECT w.ds_id, p.market_id, w.q, w.revenue FROM bw w JOIN bp p ON p.ds_id = w.ds_id AND p.product_id = w.product_id JOIN bm m ON m.ds_id = p.ds_id AND m.market_id = p.market_id AND m.currency = w.currency UNION ALL SELECT ds_id, market_id, q, revenue FROM bc WHERE ccy = currency) GROUP BY 1, 2, 3),
bo AS (SELECT o.*, CASE WHEN method IS NOT NULL AND raw_revenue < coalesce(total, 0.0) THEN total ELSE raw_revenue END AS revenue FROM bo1 o LEFT JOIN bsum s ON s.ds_id = o.ds_id AND s.market_id = o.market_id AND s.q = o.q),
bf AS (SELECT nation AS ds_id, 0 AS pos, 'USD' AS currency FROM nat WHERE nation % 9 <> 4 UNION ALL SELECT nation, 1, 'USD' FROM nat WHERE nation % 8 = 5 UNION ALL SELECT nation, 2, 'KRW' FROM nat WHERE nation % 8 = 5),
bfin AS (SELECT ds_id, q, total_revenue * CASE WHEN ds_id % 11 = 2 THEN 0.5 WHEN ds_id % 11 = 3 THEN 4 ELSE 1 END AS total FROM fin),
bser AS (SELECT ds_id, 'markets[' || pos || '].observations[' || j || ']' AS path, 'm' || pos AS k, j, q, revenue, basis, method, published_at, true AS known FROM bo
  UNION ALL SELECT w.ds_id, 'products[' || w.pos || '].revenue[' || j || ']', 'p' || w.pos, j, q, revenue, basis, method, published_at, p.market_id <> 'm-none' FROM bw w JOIN bp p ON p.ds_id = w.ds_id AND p.product_id = w.product_id
  UNION ALL SELECT ds_id, 'competitors[' || cpos || '].revenue[' || j || ']', 'c' || cpos, j, q, revenue, basis, method, published_at, true FROM bc),
bprev AS (SELECT *, lag(q) OVER (PARTITION BY ds_id, k ORDER BY j) AS pq, revenue / lag(revenue) OVER (PARTITION BY ds_id, k ORDER BY j) AS ratio FROM bser WHERE known),
bcommon AS (SELECT w.ds_id, w.pos, w.product_id, w.q, w.revenue, o.revenue AS mrev, w.revenue / o.revenue AS share FROM bw w JOIN bp p ON p.ds_id = w.ds_id AND p.product_id = w.product_id JOIN bo o ON o.ds_id = p.ds_id AND o.market_id = p.market_id AND o.q = w.q),
banch AS (SELECT ds_id, pos, product_id, max(q) AS anchor_q, max_by(share, q) AS share FROM bcommon GROUP BY 1, 2, 3),
bmiss AS (SELECT w.ds_id, w.pos, w.j, m.currency AS mc, w.currency FROM bw w JOIN bp p ON p.ds_id = w.ds_id AND p.product_id = w.product_id JOIN bm m ON m.ds_id = p.ds_id AND m.market_id = p.market_id),
found0 AS (
  SELECT ds_id, 'ANNUAL_QUARTERLY_CONFUSION' AS code, path || '.basis' AS path FROM bprev WHERE basis <> 'quarterly'
  UNION ALL SELECT ds_id, 'SOURCE_BEFORE_PERIOD_END', path || '.source.publishedAt' FROM bprev WHERE published_at < {_QE}
  UNION ALL SELECT ds_id, 'NON_CONSECUTIVE_OBSERVATIONS', path || '.quarter' FROM bprev WHERE q - pq <> 1
  UNION ALL SELECT ds_id, 'ANNUAL_QUARTERLY_CONFUSION', path || '.revenue' FROM bprev WHERE ratio > 3 OR ratio < 1.0 / 3
  UNION ALL SELECT nation, 'SOURCE_BEFORE_PERIOD_END', 'quote.source.publishedAt' FROM nat WHERE nation % 12 = 8
  UNION ALL SELECT ds_id, 'DUPLICATE_MARKET', 'markets[1]' FROM ent WHERE ds_id % 5 = 2 AND pos = 1
  UNION ALL SELECT m.ds_id, 'UNUSED_MARKET', 'markets[' || m.pos || ']' FROM bm m WHERE NOT EXISTS (SELECT 1 FROM bp p WHERE p.ds_id = m.ds_id AND p.market_id = m.market_id)
  UNION ALL SELECT ds_id, 'MISSING_FX', 'markets[' || pos || '].currency' FROM bm m WHERE currency = 'USD' AND NOT EXISTS (SELECT 1 FROM bf f WHERE f.ds_id = m.ds_id AND f.currency = m.currency)
  UNION ALL SELECT nation, 'SEASONALITY_NOT_NORMALISED', 'markets[' || pos || '].seasonality' FROM nat, types WHERE nation % 7 = 3
  UNION ALL SELECT ds_id, 'INVALID_FX', 'fx[' || pos || ']' FROM bf WHERE currency = 'KRW'
  UNION ALL SELECT ds_id, 'DUPLICATE_FX', 'fx[' || pos || ']' FROM (SELECT *, row_number() OVER (PARTITION BY ds_id, currency ORDER BY pos) AS rn FROM bf) WHERE rn > 1
  UNION ALL SELECT ds_id, 'OVERLAPPING_PRODUCT_MARKET', 'products[' || pos || '].marketId' FROM (SELECT *, row_number() OVER (PARTITION BY ds_id, market_id ORDER BY pos) AS rn FROM bp) WHERE rn > 1
  UNION ALL SELECT ds_id, 'MISSING_MARKET', 'products[' || pos || '].marketId' FROM bp WHERE market_id = 'm-none'
  UNION ALL SELECT ds_id, 'CURRENCY_MISMATCH', 'products[' || pos || '].revenue[' || j || '].currency' FROM bmiss WHERE currency <> mc
  UNION ALL SELECT b.ds_id, 'MISSING_FX', 'products[' || pos || '].revenue[' || j || '].currency' FROM bmiss b WHERE currency <> 'KRW' AND NOT EXISTS (SELECT 1 FROM bf f WHERE f.ds_id = b.ds_id AND f.currency = b.currency)
  UNION ALL SELECT ds_id, 'INVALID_SHARE', 'products[' || pos || '].revenue' FROM bcommon WHERE revenue > mrev
  UNION ALL SELECT a.ds_id, 'SHARE_OUT_OF_BOUNDS', 'products[' || pos || '].shareBounds' FROM banch a WHERE (share < 0.125 OR share > 0.5) AND NOT EXISTS (SELECT 1 FROM bcommon c WHERE c.ds_id = a.ds_id AND c.product_id = a.product_id AND c.revenue > c.mrev)
  UNION ALL SELECT ds_id, 'CURRENCY_MISMATCH', 'competitors[' || cpos || '].revenue[' || j || '].currency' FROM bc WHERE ccy <> currency
  UNION ALL SELECT o.ds_id, 'PLAYERS_EXCEED_MARKET', 'markets[' || o.pos || '].observations[' || o.j || '].revenue' FROM bo o JOIN bsum s ON s.ds_id = o.ds_id AND s.market_id = o.market_id AND s.q = o.q WHERE o.method IS NULL AND s.total > o.revenue * (1 + 1e-4)
  UNION ALL SELECT p.ds_id, 'MISSING_COVERAGE', 'products.' || p.product_id || '.revenue' FROM bp p WHERE NOT EXISTS (SELECT 1 FROM bw w WHERE w.ds_id = p.ds_id AND w.product_id = p.product_id AND w.q = {LAST_Q})),
bcov AS (SELECT f.ds_id, f.total, sum(w.revenue * CASE WHEN w.currency = 'KRW' THEN 1.0 ELSE 1000 + 10 * f.ds_id END) AS covered FROM bfin f JOIN bw w ON w.ds_id = f.ds_id AND w.q = f.q GROUP BY 1, 2),
found AS (SELECT * FROM found0 UNION ALL SELECT * FROM (SELECT ds_id, CASE WHEN covered > total * (1 + 1e-4) THEN 'COVERAGE_EXCEEDS_TOTAL' WHEN covered / total < 0.5 THEN 'COVERAGE_INSUFFICIENT' WHEN total - covered > total * 1e-4 AND ds_id % 3 = 0 THEN 'RESIDUAL_REQUIRED' END AS code,
  CASE WHEN covered > total * (1 + 1e-4) THEN 'financials.totalRevenueKRW' WHEN covered / total < 0.5 THEN 'products' ELSE 'residual' END AS path FROM bcov WHERE ds_id NOT IN (SELECT ds_id FROM found0 WHERE code IN ('MISSING_FX', 'CURRENCY_MISMATCH') OR path LIKE 'products.%')) WHERE code IS NOT NULL)
"""


@query("static_rules", ctes(SQL_BAD) + "SELECT *, CASE WHEN code IN (" + ", ".join(f"'{c}'" for c in qr.HARD_CODES) + """) OR (code = 'ANNUAL_QUARTERLY_CONFUSION' AND path LIKE '%.basis') OR (code = 'CURRENCY_MISMATCH' AND path NOT LIKE 'competitors%') THEN 'hard' ELSE 'soft' END AS severity FROM found""")
def static_rules(spark, sf):
    return qr.classify(qr.static_rules(spoiled_lifted(spark, sf)))


@query("dated_rules", ctes(SQL_BAD) + f""", src AS (SELECT ds_id, path || '.source.publishedAt' AS path, published_at FROM bser)
SELECT ds_id, CASE WHEN published_at > DATE '{AS_OF}' THEN 'FUTURE_EVIDENCE' ELSE 'STALE_EVIDENCE' END AS code, path FROM src WHERE published_at > DATE '{AS_OF}' OR DATE '{AS_OF}' - published_at > 730
UNION ALL SELECT nation, 'STALE_EVIDENCE', 'quote.asOf' FROM nat WHERE nation % 12 = 7 UNION ALL SELECT nation, 'FUTURE_EVIDENCE', 'quote.asOf' FROM nat WHERE nation % 12 = 8
UNION ALL SELECT ds_id, 'FUTURE_EVIDENCE', path || '.quarter' FROM bser WHERE {_QE} > DATE '{AS_OF}'
UNION ALL SELECT ds_id, 'STALE_EVIDENCE', 'products[' || pos || '].revenue' FROM banch WHERE 8009 - anchor_q > 3""")
def dated_rules(spark, sf):
    return qr.dated_rules(spoiled_lifted(spark, sf), as_of())


@query("structure_rules", ctes(SQL_BAD) + """SELECT ds_id, 'AMOUNT_OUT_OF_RANGE' AS code, path || '.revenue' AS path FROM bser WHERE NOT (revenue > 0 AND revenue <= 1e18)
 UNION ALL SELECT nation, 'BRIDGE_OUT_OF_RANGE', 'earningsBridge' FROM nat JOIN fin ON fin.ds_id = nation WHERE nation % 5 = 0 UNION ALL SELECT ds_id, 'INVALID_BOUNDS', 'products[' || pos || '].shareBounds' FROM bp WHERE ds_id % 7 = 0
 UNION ALL SELECT ds_id, 'SCENARIOS_NOT_ORDERED', market_id || '.annual_growth' FROM ent WHERE ds_id % 6 = 0""")
def structure_rules(spark, sf):
    t, n = spoiled_lifted(spark, sf), F.col("ds_id")
    t = replace(t, bridge=t.bridge.withColumn("tax_rate", F.when(n % 5 == 0, 0.6).otherwise(F.col("tax_rate"))),
                product=t.product.withColumn("share_min", F.when(n % 7 == 0, 0.6).otherwise(F.col("share_min"))),
                market_tri=t.market_tri.withColumn("annual_growth", F.when((n % 6 == 0) & (F.col("scenario") == "bear"), 0.2).otherwise(F.col("annual_growth"))))
    return qr.structure_rules(t)


def disordered(spark, sf) -> va.Tables:
    """Series in reverse order with a duplicate quarter, and an as-of before the last quarters."""
    t = tables(spark, sf)
    flip = lambda df: df.withColumn("j", 40 - F.col("j"))
    twice = lambda df: df.unionByName(df.where(F.col("q") == 8002).withColumns({"revenue": F.col("revenue") * 2, "j": F.lit(99)}))
    return replace(t, product_rev=twice(flip(t.product_rev)), market_obs=twice(t.market_obs), product=t.product.withColumn("share_max", F.lit(0.15)))


REPAIR_AS_OF = "2001-11-15"


@query("repair_log", ctes(SQL_VAL) + f""", rs AS (SELECT ds_id, market_id AS id, q FROM obs0 UNION ALL SELECT ds_id, product_id, q FROM own UNION ALL SELECT ds_id, competitor_id, q FROM crev),
rn AS (SELECT ds_id, id, count(*) AS n, count(CASE WHEN {_QE} <= DATE '{REPAIR_AS_OF}' THEN 1 END) AS e FROM rs GROUP BY 1, 2),
dw AS (SELECT ds_id, product_id, pos, market_id, currency, fx, q, CASE WHEN q = 8002 THEN revenue * 2 ELSE revenue END AS revenue FROM own WHERE {_QE} <= DATE '{REPAIR_AS_OF}' AND true),
dc AS (SELECT * FROM crev WHERE {_QE} <= DATE '{REPAIR_AS_OF}'),
dob AS (SELECT ds_id, market_id, q, method, CASE WHEN q = 8002 THEN raw_revenue * 2 ELSE raw_revenue END AS raw FROM obs0 WHERE {_QE} <= DATE '{REPAIR_AS_OF}'),
dsum AS (SELECT ds_id, market_id, q, sum(revenue) AS total FROM (SELECT ds_id, market_id, q, revenue FROM dw UNION ALL SELECT ds_id, market_id, q, revenue FROM dc WHERE ccy = currency) GROUP BY 1, 2, 3),
dlift AS (SELECT o.ds_id, o.market_id, o.q, CASE WHEN method IS NOT NULL AND raw < coalesce(total, 0.0) THEN total ELSE raw END AS revenue FROM dob o LEFT JOIN dsum s ON s.ds_id = o.ds_id AND s.market_id = o.market_id AND s.q = o.q),
da AS (SELECT w.ds_id, w.product_id, max_by(w.revenue / l.revenue, w.q) AS share FROM dw w JOIN dlift l ON l.ds_id = w.ds_id AND l.market_id = w.market_id AND l.q = w.q GROUP BY 1, 2)
SELECT ds_id, 'SERIES_SORTED' AS code, id, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT ds_id, market_id AS id FROM obs0 WHERE q = 8002 UNION SELECT DISTINCT ds_id, product_id FROM own) UNION ALL SELECT ds_id, 'UNFINISHED_QUARTERS_DROPPED', id, n - e FROM rn WHERE n <> e AND (e >= 4 OR id NOT LIKE 'm-%') AND (e >= 1 OR id NOT LIKE 'p-%')
UNION ALL SELECT ds_id, 'SHARE_BOUNDS_WIDENED', product_id, CAST(0 AS BIGINT) FROM da WHERE share <= 1 AND (share < 0.125 OR share > 0.15)""")
def repair_log(spark, sf):
    return ry.relax(disordered(spark, sf), F.to_date(F.lit(REPAIR_AS_OF)))[1]


@query("assumed_residual", ctes(SQL_VAL) + f""", w AS (SELECT o.ds_id, s.scenario, sum(o.revenue * fx * s.margin) / sum(o.revenue * fx) AS margin FROM own o, sc s WHERE o.q = {LAST_Q} AND o.ds_id % 3 = 0
  AND NOT EXISTS (SELECT 1 FROM ent e WHERE e.ds_id = o.ds_id AND NOT EXISTS (SELECT 1 FROM own x WHERE x.ds_id = e.ds_id AND x.product_id = e.product_id AND x.q = {LAST_Q})) GROUP BY 1, 2)
SELECT ds_id, scenario, 0.0 AS annual_growth, {sql_rnd('least(0.6, greatest(-0.5, margin))')} AS margin FROM w UNION ALL SELECT nation, scenario, {sql_rnd('rgrowth')}, {sql_rnd('rmargin')} FROM nat, sc WHERE nation % 3 <> 0""")
def assumed_residual(spark, sf):
    out, _ = ry.relax(tables(spark, sf), as_of())
    return rounded(out.residual_tri, ["ds_id", "scenario"], ["annual_growth", "margin"])


def proposed_and_verified(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Per customer the first order as the proposed quote and the last one as the collected quote; every third has no listing."""
    when = F.struct(F.to_date("o_orderdate").alias("on"), "o_orderkey")
    quotes = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("ds_id")).agg(
        F.min(F.struct(when.alias("w"), F.col("o_totalprice").alias("p"))).alias("first"), F.max(F.struct(when.alias("w"), F.col("o_totalprice").alias("p"))).alias("last"))
    side = F.when(F.col("ds_id") % 2 == 0, "KOSPI").otherwise("KOSDAQ")
    facts = quotes.select("ds_id", side.alias("exchange"), F.col("first.p").alias("price"), F.col("first.w.on").alias("price_as_of"), F.lit("proposed").alias("price_source"))
    return facts, quotes.select("ds_id", F.when(F.col("ds_id") % 3 > 0, "KOSPI").alias("exchange"), F.col("last.p").alias("close"), F.col("last.w.on").alias("traded_on"), F.lit("collected").alias("source"))


SQL_VERIFIED = """
vq AS (SELECT o_custkey AS ds_id, CASE WHEN o_custkey % 2 = 0 THEN 'KOSPI' ELSE 'KOSDAQ' END AS exchange, arg_min(o_totalprice, (CAST(o_orderdate AS DATE), o_orderkey)) AS p0, min(CAST(o_orderdate AS DATE)) AS d0,
  arg_max(o_totalprice, (CAST(o_orderdate AS DATE), o_orderkey)) AS p1, max(CAST(o_orderdate AS DATE)) AS d1 FROM orders GROUP BY 1, 2)
"""


@query("verified_facts", ctes(SQL_VERIFIED) + "SELECT ds_id, CASE WHEN ds_id % 3 > 0 THEN 'KOSPI' ELSE exchange END AS exchange, p1 AS price, d1 AS price_as_of, CASE WHEN p0 = p1 AND d0 = d1 THEN 'proposed' ELSE 'collected' END AS price_source FROM vq")
def verified_facts(spark, sf):
    return ry.replace_verified(*proposed_and_verified(spark, sf))[0]


@query("replacement_log", ctes(SQL_VERIFIED) + "SELECT ds_id, 'DATASET_EXCHANGE_REPLACED' AS code, exchange AS old, 'KOSPI' AS new FROM vq WHERE ds_id % 3 > 0 AND exchange <> 'KOSPI' UNION ALL SELECT ds_id, 'DATASET_QUOTE_REPLACED', CAST(d0 AS VARCHAR), CAST(d1 AS VARCHAR) FROM vq WHERE p0 <> p1 OR d0 <> d1")
def replacement_log(spark, sf):
    """The log; a quote is shown by its date."""
    log = ry.replace_verified(*proposed_and_verified(spark, sf))[1]
    return log.select("ds_id", "code", *[F.element_at(F.split(c, " @ "), -1).alias(c) for c in ("old", "new")])
