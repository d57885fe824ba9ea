"""Walk-forward machinery: fold schedules, training windows, fold fits and out-of-sample scoring.

A schedule is computed relationally from counts per date, so it costs one pass over (date, end date) counts. Training
windows are cut to the last `max_train` rows before they reach a Python worker, and scoring rows are split over
`buckets`, so no task grows with the size of the universe.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import clamp, logit, sigmoid
from strandline.operators import fold_maps as fm
from strandline.operators import learners
from strandline.operators.features import ALL_FEATURES, HORIZONS, volatility_scale
from strandline.session import spread, stage


@dataclass(frozen=True)
class FoldOptions:
    """Refit every 20 dates, first fit at 250 known rows, last 6000 rows kept, 120-date half-life."""
    step: int = 20
    min_train: int = 250
    max_train: int = 6000
    lambda_grid: tuple[float, ...] = (1.0,)
    half_life: float = 120.0
    gbm: bool = True
    meta_min_rows: int = 300
    calibration_min_rows: int = 100
    buckets: int = 4
    features: tuple[str, ...] = field(default=ALL_FEATURES)


# Effective sample size kept by the recency weights and their per-half-life sum.
MIN_EFFECTIVE_ROWS, HALF_LIFE_SUM = 1500, 2.885


def long_samples(samples: DataFrame) -> DataFrame:
    """One row per (sample, horizon) with its label, volatility unit and past move of the same length."""
    per_horizon = F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"fwd{h}").alias("fwd"), F.col(f"end{h}").alias("end_date"),
                 F.col(f"ret{h}").alias("past")) for h in HORIZONS])).alias("_h")
    keep = [c for c in samples.columns if not c.startswith(("fwd", "end"))]
    rows = samples.select(*keep, per_horizon).select(*keep, "_h.*")
    return rows.withColumn("scale", volatility_scale(F.col("horizon")))


def fold_schedule(rows: DataFrame, min_known: int, step: int, strict: bool = False) -> DataFrame:
    """(horizon, date, known, fold, fold_date): per date the rows whose outcome was known and the fold in force.

    known counts `end_date <= date` (strict: `<`). The first fold starts at the first date with `min_known` known
    rows, then every `step` dates; dates before it have no fold. Known counts never fall, so a refit that was possible
    once stays possible and both reset rules of the walk-forward loops give the same schedule."""
    dates = rows.groupBy("horizon", "date").agg(F.lit(0).cast("long").alias("n"))
    ends = (rows.where(F.col("end_date").isNotNull()).groupBy("horizon", F.col("end_date").alias("date"))
            .agg(F.count("*").alias("n")))
    order = Window.partitionBy("horizon").orderBy("date")
    merged = (dates.select("horizon", "date", "n", F.lit(True).alias("_is_date"))
              .unionByName(ends.select("horizon", "date", "n", F.lit(False).alias("_is_date")))
              .groupBy("horizon", "date").agg(F.sum("n").alias("n"), F.max("_is_date").alias("_is_date")))
    frame = order.rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    counted = (merged.withColumn("known", F.coalesce(F.sum("n").over(frame), F.lit(0))).where("_is_date")
               .withColumn("i", F.row_number().over(order)))
    whole = Window.partitionBy("horizon")
    first = F.min(F.when(F.col("known") >= min_known, F.col("i"))).over(whole)
    placed = counted.withColumn("fold", F.when(F.col("i") >= first, F.floor((F.col("i") - first) / step)).cast("int"))
    per_fold = Window.partitionBy("horizon", "fold")
    return (placed.where(F.col("fold").isNotNull())
            .withColumn("fold_date", F.min("date").over(per_fold))
            .select("horizon", "date", "known", "fold", "fold_date"))


def fold_table(schedule: DataFrame) -> DataFrame:
    return (schedule.where(F.col("date") == F.col("fold_date"))
            .select("horizon", "fold", "fold_date", "known"))


def training_windows(rows: DataFrame, folds: DataFrame, max_rows: int | None) -> DataFrame:
    """Rows known at each fold (`end_date <= fold_date`), the last `max_rows` of them by (date, ticker).

    Prefix counts by date bound each window's first date, so a fold joins to samples by equality on its own dates."""
    labelled = rows.where(F.col("end_date").isNotNull())
    per_date = labelled.groupBy("horizon", "date").agg(F.count("*").alias("n"))
    prefix = per_date.withColumn("upto", F.sum("n").over(
        Window.partitionBy("horizon").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    reach = F.lit(True) if max_rows is None else F.col("upto") > F.col("known") - max_rows
    fold_dates = (folds.join(prefix, "horizon").where(reach & (F.col("date") <= F.col("fold_date")))
                  .select("horizon", "date", "fold", "fold_date"))
    known = labelled.join(fold_dates, ["horizon", "date"]).where(F.col("end_date") <= F.col("fold_date"))
    if max_rows is None:
        return known
    newest = Window.partitionBy("horizon", "fold").orderBy(F.desc("date"), F.desc("ticker"))
    return known.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= max_rows).drop("_rank")


def recency_weights(windows: DataFrame, half_life: float, keys=("horizon", "fold")) -> DataFrame:
    """Add `weight`: half-life decay by trading date, stretched for small pools, mean 1 per window."""
    group = Window.partitionBy(*keys)
    newest = group.orderBy(F.desc("date"))
    dated = (windows.withColumn("_age", F.dense_rank().over(newest) - 1)
             .withColumn("_dates", F.max("_age").over(group) + 1)
             .withColumn("_rows", F.count("*").over(group)))
    life = F.greatest(F.lit(float(half_life)),
                      F.lit(float(MIN_EFFECTIVE_ROWS)) / (F.lit(HALF_LIFE_SUM) * F.col("_rows") / F.col("_dates")))
    raw = dated.withColumn("_raw", F.pow(F.lit(0.5), F.col("_age") / life))
    return (raw.withColumn("weight", F.col("_raw") / F.avg("_raw").over(group))
            .drop("_age", "_dates", "_rows", "_raw"))


MODEL_SCHEMA = ("horizon int, fold int, n int, base_rate double, center array<double>, scale_ array<double>, "
                "logit_w array<double>, ridge_w array<double>, gbm array<double>, edges array<double>")


def fit_folds(windows: DataFrame, o: FoldOptions) -> DataFrame:
    """One model row per (horizon, fold). A window holds at most `max_train` rows."""
    weighted = recency_weights(windows.where((F.col("fwd") != 0)), o.half_life)
    names = list(o.features)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["date", "ticker"], kind="stable")
        if len(pdf) < min(o.min_train, 60):
            return pd.DataFrame()
        model = learners.fit_models(pdf[names].to_numpy(float), pdf["fwd"].to_numpy(float),
                                    pdf["scale"].to_numpy(float), pdf["weight"].to_numpy(float), o.lambda_grid, o.gbm)
        return pd.DataFrame([{"horizon": key[0], "fold": key[1], "n": len(pdf), **model}])

    rows = weighted.select("horizon", "fold", "ticker", "date", "fwd", "scale", "weight", *names)
    return (spread(rows, "horizon", "fold")
            .groupBy("horizon", "fold").applyInPandas(fit, MODEL_SCHEMA))


SCORE_COLUMNS = ["horizon", "fold", "ticker", "date", "end_date", "scale", "actual", "past", "ret1"]
SCORE_SCHEMA = ("horizon int, fold int, ticker string, date date, end_date date, scale double, actual double, "
                "past double, ret1 double, base_rate double, p double, pg double, r double")


def score_folds(rows: DataFrame, models: DataFrame, o: FoldOptions) -> DataFrame:
    """Score rows (carrying `fold`) with their fold's model; rows of a fold are spread over `buckets` groups."""
    names = list(o.features)
    bucketed = (rows.withColumn("actual", F.col("fwd"))
                .select(*SCORE_COLUMNS, *[c for c in names if c not in SCORE_COLUMNS],
                        F.pmod(F.hash("ticker"), F.lit(o.buckets)).alias("bucket")))
    copies = models.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(o.buckets - 1))))

    def score(pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or model.empty:
            return pd.DataFrame()
        m = model.iloc[0]
        p, pg, r = learners.predict(m, pdf[names].to_numpy(float))
        out = pdf[SCORE_COLUMNS].copy()
        out["base_rate"], out["p"], out["pg"], out["r"] = m["base_rate"], p, pg, r * out["scale"]
        return out

    return (spread(bucketed, "horizon", "fold", "bucket").groupBy("horizon", "fold", "bucket")
            .cogroup(spread(copies, "horizon", "fold", "bucket").groupBy("horizon", "fold", "bucket")).applyInPandas(score, SCORE_SCHEMA))


def walk_forward(rows: DataFrame, o: FoldOptions = FoldOptions()) -> DataFrame:
    """Out-of-sample predictions: each date scored by the newest fold on or before it, known outcomes only."""
    schedule = fold_schedule(rows, o.min_train, o.step)
    models = fit_folds(training_windows(rows, fold_table(schedule), o.max_train), o)
    to_score = rows.where(F.col("fwd").isNotNull()).join(schedule.select("horizon", "date", "fold"), ["horizon", "date"])
    return score_folds(to_score, models, o).drop("fold")


FINAL_FOLD, FINAL_DATE = 1_000_000, "9999-12-31"


def final_fold(rows: DataFrame) -> DataFrame:
    """One more fold per horizon that knows every labelled row: the model used for the next sessions."""
    return (rows.where(F.col("end_date").isNotNull()).groupBy("horizon").agg(F.count("*").alias("known"))
            .select("horizon", F.lit(FINAL_FOLD).alias("fold"), F.to_date(F.lit(FINAL_DATE)).alias("fold_date"), "known"))


# ---- second stage ----------------------------------------------------------------------------------------------


def meta_inputs(oos: DataFrame) -> DataFrame:
    """Log-odds of the averaged probability, signs of the past moves, expected return and past move."""
    def sign(c):
        return F.coalesce(F.signum(c), F.lit(0.0))

    return oos.withColumns({"m_logit": logit((F.col("p") + F.col("pg")) / 2), "m_past": sign("past"),
                            "m_last": sign("ret1"), "m_move": F.coalesce("past", F.lit(0.0)),
                            "up": F.when(F.col("actual") > 0, 1.0).otherwise(0.0)})


def fold_date_weights(rows: DataFrame, folds: DataFrame, half_life: float) -> DataFrame:
    """Recency weight of every (horizon, fold, date): all rows of a date weigh the same, so weights come from counts."""
    cells = rows.groupBy("horizon", "date", "end_date").agg(F.count("*").alias("n"))
    dated = (cells.join(folds.select("horizon", "fold", "fold_date"), "horizon")
             .where(F.col("end_date") <= F.col("fold_date"))
             .groupBy("horizon", "fold", "fold_date", "date").agg(F.sum("n").alias("n")))
    group = Window.partitionBy("horizon", "fold")
    counted = (dated.withColumn("_age", F.row_number().over(group.orderBy(F.desc("date"))) - 1)
               .withColumn("_rows", F.sum("n").over(group)).withColumn("_dates", F.count("*").over(group)))
    life = F.greatest(F.lit(float(half_life)),
                      F.lit(float(MIN_EFFECTIVE_ROWS)) / (F.lit(HALF_LIFE_SUM) * F.col("_rows") / F.col("_dates")))
    raw = counted.withColumn("_raw", F.pow(F.lit(0.5), F.col("_age") / life))
    mean = F.sum(F.col("_raw") * F.col("n")).over(group) / F.col("_rows")
    return raw.withColumn("weight", F.col("_raw") / mean).select("horizon", "fold", "fold_date", "date", "weight")


def _moments(rows: DataFrame, days: dict, weights) -> dict[int, dict[str, np.ndarray]]:
    """Sums per fold of counts, weights, ups and the products of the return regression: moments per (date, end date), a calendar's
    worth, weighted by what each fold gives the date."""
    terms = [F.col("r"), F.col("m_move"), F.lit(1.0)]
    sums = {f"h{i}_{j}": terms[i] * terms[j] for i in range(3) for j in range(i + 1)} | {f"c{i}": F.col("actual") * t for i, t in enumerate(terms)}
    cells = (rows.where("end_day IS NOT NULL").groupBy("horizon", "day", "end_day")
             .agg(F.count("*").cast("double").alias("n"), F.sum("up").alias("up"), *[F.sum(v).alias(k) for k, v in sums.items()]).toPandas())
    out = {}
    for h, (folds, fold_day) in days.items():
        part = {c: v.to_numpy() for c, v in cells[cells["horizon"] == h].items()}
        known = part["end_day"][:, None] <= fold_day[None, :]
        w = weights(h, part, known)
        out[h] = {"n": known.T @ part["n"], "w": w.T @ part["n"], **{k: w.T @ part[k].astype(float) for k in ("up", *sums)}}
    return out


def _coarse(rows: DataFrame, span: int = 40) -> dict[int, dict[str, np.ndarray]]:
    """Predictions in cells of their inputs: stretches of days, eight classes of log-odds, both signs. A cell has its number of
    rows, its ups, its mean log-odds and one of its days."""
    inputs = rows.where("end_day IS NOT NULL").withColumn("_class", F.floor(F.greatest(F.least(F.col("m_logit") * 8, F.lit(3.0)), F.lit(-4.0))))
    cells = (inputs.groupBy("horizon", F.floor(F.col("day") / span), F.floor(F.col("end_day") / span), "_class", "m_past", "m_last")
             .agg(F.count("*").cast("double").alias("n"), F.sum("up").alias("up"), F.avg("m_logit").alias("m_logit"),
                  F.max("day").alias("day"), F.max("end_day").alias("end_day"), F.avg("r").alias("r")).toPandas())
    return {h: {c: v.to_numpy() for c, v in part.items()} for h, part in cells.groupby("horizon")}


def fit_meta(oos: DataFrame, folds: DataFrame, o: FoldOptions) -> DataFrame:
    """Stage-two coefficients per (horizon, fold) on all rows known at the fold: a ridge on the clipped return and Newton steps of a
    logistic regression. The regression comes from moments per date, with rows beyond the clipping limits put right one by one; the
    Newton steps begin near the end, so few passes hold rows against folds."""
    folds = stage(folds.select("horizon", "fold", "fold_date"), "meta-folds")
    days = fm.fold_days(folds)
    inputs = meta_inputs(oos).withColumns({"day": F.unix_date("date"), "end_day": F.unix_date("end_date")})
    rows = stage(inputs.select("horizon", "day", "end_day", "m_logit", "m_past", "m_last", "r", "m_move", "up", "actual"), "meta-rows")
    dated = fold_date_weights(oos, folds, o.half_life).select("horizon", "fold", F.unix_date("date").alias("day"), "weight").toPandas()
    calendar = {}
    for h, part in dated.groupby("horizon"):
        fold_at = {f: i for i, f in enumerate(days[h][0])}
        dates = np.unique(part["day"])
        table = np.zeros((len(dates) + 1, len(fold_at)))  # the last row: a date without weight
        table[np.searchsorted(dates, part["day"]), part["fold"].map(fold_at)] = part["weight"]
        calendar[h] = dates, table

    def weights(h, c, known):
        dates, table = calendar[h]
        at = np.minimum(np.searchsorted(dates, c["day"]), len(dates) - 1)
        return table[np.where(dates[at] == c["day"], at, len(dates))] * known

    limits = fm.prefix_quantiles(rows, days, "actual", {"lo": 0.01, "hi": 0.99})
    reg_terms = lambda c: np.column_stack([c["r"], c["m_move"], np.ones(len(c["r"]))])
    cls_terms = lambda c: np.column_stack([c["m_logit"], c["m_past"], c["m_last"], np.ones(len(c["r"]))])

    def products(w, x):
        return {f"h{i}_{j}": w.T @ (x[:, i] * x[:, j]) for i in range(x.shape[1]) for j in range(i + 1)}

    def tail_sums(h, c, known):
        """What clipping takes from or adds to the sums of a row beyond a fold's limits."""
        y = c["actual"][:, None]
        moved = np.clip(y, limits[h]["lo"][None, :], limits[h]["hi"][None, :]) - y
        rhs = (weights(h, c, known) * np.where(known, moved, 0)).T @ reg_terms(c)
        return {f"c{i}": rhs[:, i] for i in range(3)}

    names = lambda k: [f"h{i}_{j}" for i in range(k) for j in range(i + 1)]
    matrix = lambda s, k: np.stack([np.stack([s[f"h{max(i, j)}_{min(i, j)}"] for j in range(k)], -1) for i in range(k)], -2)
    base = _moments(rows, days, weights)
    beyond = F.lit(False)
    for h, part in limits.items():
        if np.isfinite(part["lo"]).any():
            beyond = beyond | ((F.col("horizon") == int(h)) & ((F.col("actual") < float(np.nanmax(part["lo"]))) | (F.col("actual") > float(np.nanmin(part["hi"])))))
    for h, tails in fm.fold_sums(rows.where(beyond), days, tail_sums, ["c0", "c1", "c2"]).items():
        for name, values in tails.items():
            base[h][name] = base[h][name] + values
    used = {h: s["n"] >= max(1, o.meta_min_rows) for h, s in base.items()}
    reg, cls = {}, {}
    for h, s in base.items():
        penalty = 1e-6 * s["n"][:, None, None] * np.diag([1.0, 1.0, 0.0]) + ~used[h][:, None, None] * np.eye(3)
        reg[h] = np.linalg.solve(matrix(s, 3) + penalty, np.stack([s["c0"], s["c1"], s["c2"]], -1)[..., None])[..., 0]
        rate = np.divide(s["up"], s["w"], out=np.full(len(s["w"]), 0.5), where=s["w"] > 0)
        cls[h] = np.zeros((len(rate), 4))
        cls[h][:, 3] = [learners.log_odds(r) for r in rate]

    def newton(h, sums, start, live):
        penalty = 1e-3 * base[h]["n"][:, None] * np.array([1.0, 1.0, 1.0, 0.0])
        curve = matrix(sums, 4) + penalty[:, :, None] * np.eye(4) + ~live[:, None, None] * np.eye(4)
        move = np.linalg.solve(curve, (np.stack([sums[f"g{i}"] for i in range(4)], -1) + penalty * start)[..., None])[..., 0]
        move[~live] = 0
        return move

    def slopes(w, x, times, up, coef):
        """Curvature and slope sums of rows that stand for `times` rows with `up` ups."""
        p = 1 / (1 + np.exp(-np.clip(x @ coef.T, -700, 700)))
        slope = ((p * times[:, None] - up[:, None]) * w).T @ x
        return {**products(np.maximum(1e-6, p * (1 - p)) * times[:, None] * w, x), **{f"g{i}": slope[:, i] for i in range(4)}}

    # Coarse cells of the calendar and the inputs bring the coefficients near; the passes over the rows then are few. Folds of
    # which the cells tell too little, or whose steps do not settle, start from the base rate.
    for h, c in _coarse(rows).items():
        if h in cls:
            near = weights(h, c, c["end_day"][:, None] <= days[h][1][None, :])
            live = used[h] & ((near > 0).T @ c["n"] >= 0.7 * base[h]["n"])
            coef, move = cls[h], np.ones_like(cls[h])
            for _ in range(12):
                move = newton(h, slopes(near, cls_terms(c), c["n"], c["up"], coef), coef, live)
                coef = coef - move
                live = live & (np.abs(coef).max(1) < 20)
            settled = live & (np.abs(move).max(1) < 1e-3)
            cls[h] = np.where(settled[:, None], coef, cls[h])

    def newton_sums(h, c, known):
        return slopes(weights(h, c, known), cls_terms(c), np.ones(len(c["up"])), c["up"], cls[h])

    for _ in range(30):
        sums, largest = fm.fold_sums(rows, days, newton_sums, [*names(4), "g0", "g1", "g2", "g3"]), 0.0
        for h, s in sums.items():
            move = newton(h, s, cls[h], used[h])
            cls[h] = cls[h] - move
            largest = max(largest, float(np.abs(move).max()) if move.size else 0.0)
        if largest < 1e-8:
            break
    fitted = [(int(h), int(fold), int(s["n"][i]), [float(v) for v in cls[h][i]], [float(v) for v in reg[h][i]])
              for h, s in base.items() for i, fold in enumerate(days[h][0]) if used[h][i]]
    return oos.sparkSession.createDataFrame(fitted, "horizon int, fold int, n long, cls array<double>, reg array<double>")


def apply_meta(rows: DataFrame) -> DataFrame:
    """Replace p and r by the second stage where a model (`cls`, `reg`) is attached, else average the two stages."""
    inputs = meta_inputs(rows.withColumn("actual", F.col("actual")) if "actual" in rows.columns
                         else rows.withColumn("actual", F.lit(None).cast("double")))
    z = (F.col("cls")[0] * F.col("m_logit") + F.col("cls")[1] * F.col("m_past")
         + F.col("cls")[2] * F.col("m_last") + F.col("cls")[3])
    fitted = F.col("reg")[0] * F.col("r") + F.col("reg")[1] * F.col("m_move") + F.col("reg")[2]
    return (inputs.withColumn("p", F.when(F.col("cls").isNotNull(), sigmoid(z)).otherwise((F.col("p") + F.col("pg")) / 2))
            .withColumn("r", F.when(F.col("cls").isNotNull(), fitted).otherwise(F.col("r")))
            .drop("m_logit", "m_past", "m_last", "m_move", "up", "cls", "reg"))


def stack(oos: DataFrame, o: FoldOptions = FoldOptions()) -> DataFrame:
    """Second-stage walk-forward: refit every `step` dates on rows whose outcome was known."""
    schedule = fold_schedule(oos, o.meta_min_rows, o.step)
    meta = fit_meta(oos, fold_table(schedule), o)
    placed = oos.join(schedule.select("horizon", "date", "fold"), ["horizon", "date"], "left")
    return apply_meta(placed.join(meta.drop("n"), ["horizon", "fold"], "left")).drop("fold")
