"""Sums and quantiles per walk-forward fold over one row per prediction.

A prediction belongs to every later fold. What does not depend on the fold is summed or counted once per block (the rows that one
fold is the first to know) and added up along the folds: `prefix_sums`, `prefix_quantiles`; work grows with rows plus folds. What
depends on the fold's own fit needs rows by folds: a task holds a stretch of its batch as a matrix (numpy), reduces it, and passes
on one small row per fold: `fold_sums`, `fold_quantiles`. The folds, a few numbers each, are a calendar's worth and travel with
the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 256  # cells of a bracket per pass
FEW = 2000  # values of a bracket that are collected and ranked
CHUNK = 20_000  # rows of a batch that are spread over folds at a time


def fold_days(folds: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per horizon: fold numbers and their days (since the epoch), in order."""
    rows = folds.select("horizon", "fold", F.unix_date("fold_date").alias("day")).distinct().toPandas().sort_values(["horizon", "fold"])
    return {h: (g["fold"].to_numpy(), g["day"].to_numpy()) for h, g in rows.groupby("horizon")}


def blocked(rows: DataFrame, days: dict, strict: bool = False) -> DataFrame:
    """Add `block`: the place of the first fold that knows the row (by horizon and end_day); rows known to no fold go. The table
    of days is a calendar's worth."""
    table, before = [], {}
    for h, (_, day) in days.items():
        span = np.arange(day[0] - 1, day[-1] + 1)
        at = np.searchsorted(day, span, side="right" if strict else "left")
        table += [(int(h), int(d), int(i)) for d, i in zip(span, at) if i < len(day)]
        before[int(h)] = int(day[0]) - 1
    lookup = rows.sparkSession.createDataFrame(table, "horizon int, _day int, block int")
    earliest = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    day = F.greatest(F.col("end_day"), F.try_element_at(earliest, F.col("horizon").cast("int"))).cast("int")
    keyed = rows.where("end_day IS NOT NULL").withColumn("_day", day)
    return keyed.join(F.broadcast(lookup), ["horizon", "_day"]).drop("_day")


def prefix_sums(rows: DataFrame, days: dict, values: dict[str, Column], strict: bool = False) -> dict[int, dict[str, np.ndarray]]:
    """Per horizon and name: the sum of a value over the rows known at each fold; nulls count for nothing."""
    if not days:
        return {}
    per_block = blocked(rows, days, strict).groupBy("horizon", "block").agg(*[F.sum(v.cast("double")).alias(n) for n, v in values.items()]).toPandas()
    out = {h: {n: np.zeros(len(f)) for n in values} for h, (f, _) in days.items()}
    for h, part in per_block.groupby("horizon"):
        for n in values:
            out[h][n][part["block"].to_numpy()] = np.nan_to_num(part[n].to_numpy(float))
    return {h: {n: v.cumsum() for n, v in sums.items()} for h, sums in out.items()}


def prefix_quantiles(rows: DataFrame, days: dict, value: str, probs: dict[str, float], strict: bool = False) -> dict[int, dict[str, np.ndarray]]:
    """Exact interpolated quantiles of a column over the rows known at each fold; NaN for a fold that knows none.

    Values fall into cells; blocks count them, and the counts added along the folds say in which cells the order statistics of
    each fold lie. Only those cells are cut finer, until their values are few enough to be ranked (equal ones as one)."""
    if not days:
        return {}
    column = F.col(value).cast("double")
    kept = blocked(rows, days, strict).select("horizon", "block", column.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = {r["horizon"]: (r["lo"], r["hi"]) for r in kept.groupBy("horizon").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    edges = {h: np.unique(np.linspace(lo, hi, BINS)) for h, (lo, hi) in ends.items()}  # a cell reaches from its edge up to the next
    ps, out = np.array(list(probs.values())), {h: {n: np.full(len(f), np.nan) for n in probs} for h, (f, _) in days.items()}

    def counts() -> dict[int, np.ndarray]:
        def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for h, part in batch.groupby("horizon"):
                    cell = np.searchsorted(edges[h], part["v"], side="right") - 1
                    key, n = np.unique(part["block"].to_numpy(np.int64) * len(edges[h]) + cell, return_counts=True)
                    yield pd.DataFrame({"horizon": h, "block": key // len(edges[h]), "cell": key % len(edges[h]), "n": n})

        got = kept.mapInPandas(histogram, "horizon int, block int, cell int, n long").groupBy("horizon", "block", "cell").agg(F.sum("n").alias("n")).toPandas()
        tables = {h: np.zeros((len(days[h][0]), len(edges[h])), np.int64) for h in edges}
        for h, part in got.groupby("horizon"):
            tables[h][part["block"], part["cell"]] = part["n"]
        return {h: t.cumsum(0) for h, t in tables.items()}

    for last in (False, False, False, False, False, True):
        table, needed = counts(), {}
        for h, t in table.items():
            upto, place = t.cumsum(1), ps[:, None] * np.maximum(t.sum(1) - 1, 0)[None, :]
            ranks = np.stack([np.floor(place), np.ceil(place)])
            at = np.stack([[[np.searchsorted(upto[i], r, side="right") for i, r in enumerate(of)] for of in rank] for rank in ranks])
            at = at[..., t.sum(1) > 0]
            needed[h] = np.unique(at)
        cut = {h: [c for c in cells if table[h][-1, c] > FEW and c + 1 < len(edges[h])] for h, cells in needed.items()}
        if last or not any(cut.values()):
            break
        finer = {h: np.unique(np.concatenate([edges[h], *[np.linspace(edges[h][c], edges[h][c + 1], BINS + 1) for c in cut[h]]])) for h in edges}
        if all(len(finer[h]) == len(edges[h]) for h in edges):
            break
        edges = finer

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for h, part in batch.groupby("horizon"):
                cell = np.searchsorted(edges[h], part["v"], side="right") - 1
                yield part.assign(cell=cell)[np.isin(cell, needed[h])]

    few = kept.mapInPandas(members, "horizon int, block int, v double, cell int").groupBy("horizon", "cell", "v", "block").agg(F.count("*").alias("n")).toPandas()
    for h, part in few.groupby("horizon"):
        t = table[h]
        under, inside = t.cumsum(1) - t, {c: g.sort_values("v") for c, g in part.groupby("cell")}
        for i in np.flatnonzero(t.sum(1)):
            def ranked(k: float) -> float:
                c = np.searchsorted(under[i] + t[i], k, side="right")
                g = inside[c][inside[c]["block"] <= i]
                return g["v"].to_numpy()[np.searchsorted(under[i, c] + g["n"].cumsum().to_numpy(), k, side="right")]

            for name, p in probs.items():
                place = p * (t[i].sum() - 1)
                low, high = ranked(np.floor(place)), ranked(np.ceil(place))
                out[h][name][i] = low + (high - low) * (place - np.floor(place))
    return out


def fold_sums(rows: DataFrame, days: dict, kernel: Callable[[int, dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]],
              names: list[str], strict: bool = False) -> dict[int, dict[str, np.ndarray]]:
    """Per horizon an array over its folds for each name: what the kernel gives for a batch, added up.

    rows: horizon, day, end_day and numbers. kernel(horizon, columns, known) sees which row's outcome each fold knows: ended by the
    fold's day (strict: before it)."""
    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, dict[str, np.ndarray]] = {}
        for batch in batches:
            for h, part in batch.groupby("horizon"):
                if h not in days:
                    continue
                for at in range(0, len(part), CHUNK):
                    columns = {c: part[c].to_numpy()[at:at + CHUNK] for c in part.columns}
                    known = _known(columns, days[h][1], strict)
                    got = kernel(h, columns, known)
                    held = total.setdefault(h, {n: np.zeros(len(days[h][0])) for n in names})
                    for n in names:
                        held[n] += got[n]
        for h, sums in total.items():
            yield pd.DataFrame({"horizon": h, "i": np.arange(len(days[h][0])), **sums})

    if not days:
        return {}
    parts = rows.mapInPandas(reduce, "horizon int, i int, " + ", ".join(f"{n} double" for n in names))
    sums = parts.groupBy("horizon", "i").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = {h: {n: np.zeros(len(f)) for n in names} for h, (f, _) in days.items()}
    for h, part in sums.groupby("horizon"):
        for n in names:
            out[h][n][part["i"].to_numpy()] = part[n].to_numpy()
    return out


def _known(columns: dict[str, np.ndarray], fold_day: np.ndarray, strict: bool) -> np.ndarray:
    ended = columns["end_day"].astype(float)[:, None]  # a null end is NaN: known to no fold
    return ended < fold_day[None, :] if strict else ended <= fold_day[None, :]


def fold_quantiles(rows: DataFrame, days: dict, value: Callable[[int, dict[str, np.ndarray]], np.ndarray], probs: dict[str, float],
                   strict: bool = False) -> dict[int, dict[str, np.ndarray]]:
    """Exact interpolated quantiles per fold of value(horizon, columns), a matrix of rows by folds or one column of it.

    Each pass counts the values in BINS cells of every bracket and narrows it to the cells that hold the two order statistics; the
    values of the last brackets are collected and ranked. NaN for a fold that knows no row."""
    def spread_out(h, columns, known):
        v = np.broadcast_to(value(h, columns), known.shape)
        return v, known & ~np.isnan(v)

    def first(h, columns, known):
        v, ok = spread_out(h, columns, known)
        return {"n": ok.sum(0)}

    def ends(batches):
        for batch in batches:
            for h, part in batch.groupby("horizon"):
                if h in days:
                    columns = {c: part[c].to_numpy() for c in part.columns}
                    v, ok = spread_out(h, columns, _known(columns, days[h][1], strict))
                    yield pd.DataFrame({"horizon": h, "i": np.arange(v.shape[1]), "lo": np.where(ok, v, np.inf).min(0),
                                        "hi": np.where(ok, v, -np.inf).max(0)})

    if not days:
        return {}
    count = {h: s["n"].astype(np.int64) for h, s in fold_sums(rows, days, first, ["n"], strict).items()}
    limits = rows.mapInPandas(ends, "horizon int, i int, lo double, hi double").groupBy("horizon", "i").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas()
    # bracket[h]: quantile, fold -> (low, high, values below low, values within).
    ps = np.array(list(probs.values()))
    bracket = {}
    for h, (folds, _) in days.items():
        low, high = np.zeros(len(folds)), np.zeros(len(folds))
        part = limits[limits["horizon"] == h]
        low[part["i"].to_numpy()], high[part["i"].to_numpy()] = part["lo"].to_numpy(), part["hi"].to_numpy()
        shape = (len(ps), len(folds))
        bracket[h] = [np.broadcast_to(x, shape).copy() for x in (low, high, np.zeros(len(folds)), count[h].astype(float))]
    place = {h: ps[:, None] * np.maximum(count[h] - 1, 0)[None, :] for h in days}

    def cells(h, v, ok, q):
        low, high = bracket[h][0][q], bracket[h][1][q]
        inside = ok & (v >= low) & (v <= high)
        width = np.where(high > low, (high - low) / BINS, 1.0)
        return inside, np.clip(((v - low) / width), 0, BINS - 1).astype(np.int64)

    for _ in range(8):
        if all((b[3] <= FEW).all() or ((b[1] <= b[0]) | (b[3] <= FEW)).all() for b in bracket.values()):
            break

        def histogram(batches):
            total = {h: np.zeros((len(ps), len(days[h][0]), BINS)) for h in days}
            for batch in batches:
                for h, part in batch.groupby("horizon"):
                    if h not in days:
                        continue
                    columns = {c: part[c].to_numpy() for c in part.columns}
                    v, ok = spread_out(h, columns, _known(columns, days[h][1], strict))
                    fold = np.broadcast_to(np.arange(v.shape[1]), v.shape)
                    for q in range(len(ps)):
                        inside, cell = cells(h, v, ok, q)
                        total[h][q] += np.bincount(fold[inside] * BINS + cell[inside], minlength=v.shape[1] * BINS).reshape(v.shape[1], BINS)
            for h, t in total.items():
                q, i, c = np.nonzero(t)
                if len(q):
                    yield pd.DataFrame({"horizon": h, "q": q, "i": i, "c": c, "n": t[q, i, c]})

        got = rows.mapInPandas(histogram, "horizon int, q int, i int, c int, n double").groupBy("horizon", "q", "i", "c").agg(
            F.sum("n").alias("n")).toPandas()
        for h, part in got.groupby("horizon"):
            table = np.zeros((len(ps), len(days[h][0]), BINS))
            table[part["q"], part["i"], part["c"]] = part["n"]
            low, high, below, within = bracket[h]
            upto = below[:, :, None] + table.cumsum(2)
            a = (upto > np.floor(place[h])[:, :, None]).argmax(2)
            b = (upto > np.ceil(place[h])[:, :, None]).argmax(2)
            width = (high - low) / BINS
            pick = lambda t, k: np.take_along_axis(t, k[:, :, None], 2)[:, :, 0]
            narrow = (within > FEW) & (high > low)
            # A hair wider than the cells: their edges are rounded.
            slack = 1e-9 * np.maximum(np.abs(low), np.abs(high)) + 1e-300
            new_low, new_high = low + a * width - slack, low + (b + 1) * width + slack
            new_below = below + np.where(a > 0, pick(table.cumsum(2), np.maximum(a - 1, 0)), 0)
            bracket[h] = [np.where(narrow, np.maximum(new_low, low), low), np.where(narrow, np.minimum(new_high, high), high),
                          np.where(narrow, new_below, below), np.where(narrow, pick(upto, b) - new_below, within)]

    def inside_values(batches):
        for batch in batches:
            for h, part in batch.groupby("horizon"):
                if h in days:
                    columns = {c: part[c].to_numpy() for c in part.columns}
                    v, ok = spread_out(h, columns, _known(columns, days[h][1], strict))
                    for q in range(len(ps)):
                        low, high = bracket[h][0][q], bracket[h][1][q]
                        r, i = np.nonzero(ok & (v >= low) & (v <= high))
                        yield pd.DataFrame({"horizon": h, "q": q, "i": i, "v": v[r, i], "under": 0})
                        under = (ok & (v < low)).sum(0)
                        yield pd.DataFrame({"horizon": h, "q": q, "i": np.flatnonzero(under), "v": np.nan, "under": under[under > 0]})

    # Equal values are one row with their number, so a bracket of ties stays small.
    kept = rows.mapInPandas(inside_values, "horizon int, q int, i int, v double, under long").groupBy("horizon", "q", "i", "v").agg(
        F.count("*").alias("n"), F.sum("under").alias("under")).toPandas()
    out = {h: {name: np.full(len(f), np.nan) for name in probs} for h, (f, _) in days.items()}
    for (h, q, i), part in kept.groupby(["horizon", "q", "i"]):
        under = part["under"].sum()
        values = part[part["v"].notna()].sort_values("v")
        upto = under + values["n"].cumsum().to_numpy()
        at = place[h][q, i]
        low, high = (values["v"].to_numpy()[np.searchsorted(upto, k, side="right")] for k in (np.floor(at), np.ceil(at)))
        out[h][list(probs)[q]][i] = low + (high - low) * (at - np.floor(at))
    return out
