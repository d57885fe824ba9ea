"""Numeric kernels for one bounded training window (a few thousand rows of 50 features), vectorised with numpy."""

from __future__ import annotations

import numpy as np

# Clip of standardised features, boosting shape and shrinkage, histogram bins.
CLIP = 5.0
ROUNDS, RATE, BINS, LEAF_LAMBDA, MIN_LEAF, MIN_LEAF_SHARE = 60, 0.05, 16, 5.0, 30, 0.02
NEWTON_STEPS, EPS = 12, 1e-6
TREE_WIDTH = 10  # feature/threshold of three splits, then four leaf values


def sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def log_odds(p: float) -> float:
    return float(np.log(max(EPS, p) / max(EPS, 1 - p)))


def robust_scale(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median and IQR/1.349 by lower order statistics; standard deviation, then 1, where the IQR is zero."""
    center, scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
    for j, column in enumerate(x.T):
        values = np.sort(column[np.isfinite(column)])
        if not values.size:
            continue
        q1, center[j], q3 = values[np.floor(np.array([0.25, 0.5, 0.75]) * (values.size - 1)).astype(int)]
        spread = (q3 - q1) / 1.349
        if not spread > 1e-12:
            spread = values.std(ddof=1) if values.size > 1 else 1.0
        if spread > 1e-12:
            scale[j] = spread
    return center, scale


def standardise(x: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - center) / scale, -CLIP, CLIP)
    return np.where(np.isfinite(x), z, 0.0)


def logistic(x: np.ndarray, y: np.ndarray, lam: float, w: np.ndarray, steps: int = NEWTON_STEPS) -> np.ndarray:
    """Weighted L2 logistic regression by Newton steps; the intercept (last) is not penalised."""
    design = np.column_stack([x, np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1], lam), 0.0)
    beta = np.append(np.zeros(x.shape[1]), log_odds(np.average(y, weights=w)))
    for _ in range(steps):
        p = sigmoid(design @ beta)
        gradient = design.T @ ((p - y) * w) + penalty * beta
        curvature = np.maximum(EPS, p * (1 - p)) * w
        move = np.linalg.solve((design * curvature[:, None]).T @ design + np.diag(penalty), gradient)
        beta = beta - move
        if np.abs(move).max() < 1e-8:
            break
    return beta


def ridge(x: np.ndarray, y: np.ndarray, lam: float, w: np.ndarray) -> np.ndarray:
    """Weighted ridge with a free intercept (last)."""
    mean_x, mean_y = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    centred = x - mean_x
    slope = np.linalg.solve((centred * w[:, None]).T @ centred + lam * np.eye(x.shape[1]), (centred * w[:, None]).T @ (y - mean_y))
    return np.append(slope, mean_y - mean_x @ slope)


def bin_edges(x: np.ndarray) -> np.ndarray:
    """Strictly increasing cut points per feature at the sixteenths, padded with +inf."""
    n, d = x.shape
    edges = np.full((d, BINS - 1), np.inf)
    at = np.floor(np.arange(1, BINS) / BINS * (n - 1)).astype(int)
    for j in range(d):
        cuts = np.unique(np.sort(x[:, j])[at])
        edges[j, : cuts.size] = cuts
    return edges


def bins_of(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(len(edges))])


def best_splits(bins: np.ndarray, node: np.ndarray, nodes: int, g, h, min_leaf: int, widths: np.ndarray):
    """Per node: (feature, threshold bin, gain) of the best histogram split, feature -1 when none gains."""
    width = BINS + 1
    hist = np.empty((3, len(bins), nodes, width))
    offset = node * width
    for j, column in enumerate(bins):
        code = column + offset
        hist[0, j] = np.bincount(code, weights=g, minlength=nodes * width).reshape(nodes, width)
        hist[1, j] = np.bincount(code, weights=h, minlength=nodes * width).reshape(nodes, width)
        hist[2, j] = np.bincount(code, minlength=nodes * width).reshape(nodes, width)
    total = hist[:, 0].sum(axis=-1)
    left = hist.cumsum(axis=-1)[..., :-1]
    right = total[:, None, :, None] - left
    gain = (left[0] ** 2 / (left[1] + LEAF_LAMBDA) + right[0] ** 2 / (right[1] + LEAF_LAMBDA)
            - (total[0] ** 2 / (total[1] + LEAF_LAMBDA))[None, :, None])
    allowed = (left[2] >= min_leaf) & (right[2] >= min_leaf) & (np.arange(width - 1) < widths[:, None] - 1)[:, None, :]
    gain = np.where(allowed, gain, -np.inf)
    out = []
    for k in range(nodes):
        flat = int(np.argmax(gain[:, k]))
        f, t = divmod(flat, width - 1)
        out.append((f, t, gain[f, k, t]) if gain[f, k, t] > 0 else (-1, 0, 0.0))
    return out, -total[0] / (total[1] + LEAF_LAMBDA)


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[list[float], np.ndarray]:
    """Depth-two boosted trees on log loss with Newton leaves, as [base, tree, tree, ...]."""
    edges = bin_edges(x)
    bins = bins_of(x, edges)
    widths = np.isfinite(edges).sum(axis=1) + 1
    min_leaf = max(MIN_LEAF, int(len(y) * MIN_LEAF_SHARE))
    base = log_odds(y.mean())
    score = np.full(len(y), base)
    model = [base]
    for _ in range(ROUNDS):
        p = sigmoid(score)
        g, h = (p - y) * w, np.maximum(EPS, p * (1 - p)) * w
        (root,), _ = best_splits(bins, np.zeros(len(y), int), 1, g, h, min_leaf, widths)
        if root[0] < 0:
            break
        side = (bins[root[0]] > root[1]).astype(int)
        children, child_leaf = best_splits(bins, side, 2, g, h, min_leaf, widths)
        leaf_id = 2 * side
        for k, (f, t, _gain) in enumerate(children):
            if f >= 0:
                leaf_id = np.where((side == k) & (bins[f] > t), 2 * k + 1, leaf_id)
        leaves = -np.bincount(leaf_id, weights=g, minlength=4) / (np.bincount(leaf_id, weights=h, minlength=4) + LEAF_LAMBDA)
        for k, (f, _t, _gain) in enumerate(children):
            if f < 0:
                leaves[2 * k] = leaves[2 * k + 1] = child_leaf[k]
        tree = [*root[:2], *children[0][:2], *children[1][:2], *leaves]
        model.extend(float(v) for v in tree)
        score = score + RATE * leaves[leaf_id]
    return model, edges


def boosted_probability(model: np.ndarray, edges: np.ndarray, z: np.ndarray) -> np.ndarray:
    bins = bins_of(z, edges)
    score = np.full(len(z), model[0])
    for tree in model[1:].reshape(-1, TREE_WIDTH):
        feature, threshold, leaves = tree[0:6:2].astype(int), tree[1:6:2], tree[6:]
        side = (bins[feature[0]] > threshold[0]).astype(int)
        leaf = 2 * side
        for k in (0, 1):
            if feature[1 + k] >= 0:
                leaf = np.where((side == k) & (bins[feature[1 + k]] > threshold[1 + k]), 2 * k + 1, leaf)
        score = score + RATE * leaves[leaf]
    return sigmoid(score)


def choose_lambda(grid, x, y, target, w) -> tuple[float, float]:
    """Strength per row for the classifier and the ridge: fit the oldest 80%, judge on the latest 20%."""
    cut = int(len(y) * 0.8)
    if len(grid) == 1:
        return grid[0], grid[0]
    if len(y) - cut < 30:
        return grid[-1], grid[-1]

    def log_loss(lam):
        beta = logistic(x[:cut], y[:cut], lam * cut, w[:cut])
        p = np.clip(sigmoid(x[cut:] @ beta[:-1] + beta[-1]), EPS, 1 - EPS)
        return -np.sum(np.where(y[cut:] > 0, np.log(p), np.log(1 - p)))

    def squared(lam):
        beta = ridge(x[:cut], target[:cut], lam * cut, w[:cut])
        return np.sum((x[cut:] @ beta[:-1] + beta[-1] - target[cut:]) ** 2)

    return min(grid, key=log_loss), min(grid, key=squared)


def fit_models(x: np.ndarray, fwd: np.ndarray, scale: np.ndarray, w: np.ndarray, grid, gbm: bool = True) -> dict:
    """Classifier, ridge on winsorised volatility-unit returns, and boosted trees of one window (rows oldest first)."""
    center, spread = robust_scale(x)
    z = standardise(x, center, spread)
    y = (fwd > 0).astype(float)
    unit = fwd / scale
    target = np.clip(unit, *np.quantile(unit, [0.01, 0.99]))
    lam_c, lam_r = choose_lambda(grid, z, y, target, w)
    trees, edges = boost(z, y, w) if gbm else ([], np.empty((0, 0)))
    return {"base_rate": float(y.mean()), "center": center.tolist(), "scale_": spread.tolist(),
            "logit_w": logistic(z, y, lam_c * len(y), w).tolist(),
            "ridge_w": ridge(z, target, lam_r * len(y), w).tolist(),
            "gbm": trees, "edges": edges.ravel().tolist()}


def predict(model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classifier probability, boosted probability, return in volatility units) of feature rows."""
    z = standardise(x, np.asarray(model["center"]), np.asarray(model["scale_"]))
    logit_w, ridge_w = np.asarray(model["logit_w"]), np.asarray(model["ridge_w"])
    p = sigmoid(z @ logit_w[:-1] + logit_w[-1])
    trees = np.asarray(model["gbm"])
    boosted = boosted_probability(trees, np.asarray(model["edges"]).reshape(x.shape[1], -1), z) if trees.size else p
    return p, boosted, z @ ridge_w[:-1] + ridge_w[-1]
