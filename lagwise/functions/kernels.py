"""Numeric kernels on numpy arrays: dependence, unit roots, causality and out-of-sample gain. No Spark here."""

from __future__ import annotations

import math

import numpy as np

EULER = 0.5772156649015329


def digamma_table(n: int) -> np.ndarray:
    """psi(0..n) at integers by harmonic sums; entry 0 is unused."""
    return np.concatenate([[0.0], np.cumsum(np.concatenate([[0.0], 1.0 / np.arange(1, max(n, 1))])) - EULER])


def ksg(x: np.ndarray, y: np.ndarray, k: int = 7) -> float:
    """Mutual information in nats by k nearest neighbours (Kraskov 2004, first estimator), at least 0."""
    n = len(x)
    if n != len(y) or n < 20:
        raise ValueError("two series of one length, 20 points at least")
    noise = np.random.default_rng(0)
    x, y = ((v - v.mean()) / max(v.std(), 1e-12) + 1e-10 * noise.standard_normal(n) for v in (np.asarray(x, float), np.asarray(y, float)))
    dx, dy = np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :])
    reach = np.maximum(dx, dy)
    np.fill_diagonal(reach, np.inf)
    radius = np.partition(reach, k - 1, axis=1)[:, k - 1 : k]
    nx, ny = (dx < radius).sum(1) - 1, (dy < radius).sum(1) - 1
    psi = digamma_table(n + 1)
    return max(0.0, float(psi[n] + psi[k] - np.mean(psi[nx + 1] + psi[ny + 1])))


def permutation_p(x: np.ndarray, y: np.ndarray, n_perm: int = 200, k: int = 7, threshold: float = 0.05, seed: int = 42) -> tuple[float, float]:
    """(mi, p): y shuffled n_perm times; from the tenth on it stops once p can't fall below threshold."""
    observed, rng, above = ksg(x, y, k), np.random.default_rng(seed), 0
    for done in range(1, n_perm + 1):
        above += ksg(x, rng.permutation(y), k) >= observed
        if done >= 10 and (above + 1) / (n_perm + 1) >= threshold:
            return observed, (above + 1) / (done + 1)
    return observed, (above + 1) / (n_perm + 1)


def lag_profile(x: np.ndarray, y: np.ndarray, max_lag: int = 12, k: int = 7) -> list[float]:
    """Information of x on y 1, 2, ... places later."""
    return [ksg(x[: len(x) - lag], y[lag:], k) for lag in range(1, min(max_lag, len(x) - 21) + 1)]


def direction(x: np.ndarray, y: np.ndarray, max_lag: int = 12, n_perm: int = 100, k: int = 7, threshold: float = 0.05) -> tuple[str, int, float]:
    """(direction, lag, p): which of the two leads, by permutation tests at the best lag each way."""
    best = []
    for a, b in ((x, y), (y, x)):
        lag, _ = best_lag(a, b, max_lag, k)
        best.append((lag, permutation_p(a[: len(a) - lag], b[lag:], n_perm, k, threshold)[1]))
    (forward, pf), (backward, pb) = best
    if pf < threshold and pb < threshold:
        return "bidirectional", forward, min(pf, pb)
    if pf < threshold:
        return "x->y", forward, pf
    return ("y->x", backward, pb) if pb < threshold else ("none", forward, min(pf, pb))


def least_squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    return beta, float(((b - a @ beta) ** 2).sum())


def _adf_statistic(v: np.ndarray, lags: int, start: int, constant: bool = True) -> tuple[float, float]:
    """(t of the level, AIC) of a Dickey-Fuller regression, with constant or not, on rows from `start`."""
    d = np.diff(v)
    rows = np.arange(start, len(d))
    a = np.column_stack([v[rows], *[d[rows - j] for j in range(1, lags + 1)], *[np.ones(len(rows))] * constant])
    beta, rss = least_squares(a, d[rows])
    free = len(rows) - a.shape[1]
    cov = np.linalg.pinv(a.T @ a)[0, 0] * rss / max(free, 1)
    aic = len(rows) * math.log(max(rss, 1e-300) / len(rows)) + 2 * a.shape[1]
    return float(beta[0] / math.sqrt(max(cov, 1e-300))), aic


def adf_statistic(v: np.ndarray, constant: bool = True) -> float:
    """The Dickey-Fuller t with lag order by AIC on a common sample."""
    n = len(v)
    most = max(0, min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 1 - constant))
    lags = min(range(most + 1), key=lambda p: _adf_statistic(v, p, most, constant)[1])
    return _adf_statistic(v, lags, lags, constant)[0]


#: MacKinnon's (1994) response surface with a constant, for 1 and 2 series: where it is 0 and 1, where its halves meet, coefficients of each half.
MACKINNON = {
    1: (-18.83, 2.74, -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    2: (-18.86, 0.92, -2.62, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
}
#: KPSS (1992) level table.
KPSS_TABLE = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def unit_root_p(t: float, series: int = 1) -> float:
    """The asymptotic p-value of a unit-root (1 series) or cointegration (2 series) t."""
    low, high, meet, lower, upper = MACKINNON[series]
    if t <= low or t >= high:
        return float(t >= high)
    z = sum(c * t**k for k, c in enumerate(lower if t <= meet else upper))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def adf_p(v: np.ndarray) -> float:
    """Unit-root p-value; 1 for series that are too short or constant."""
    return 1.0 if len(v) < 12 or np.ptp(v) == 0 else unit_root_p(adf_statistic(v))


def cointegration(x: np.ndarray, y: np.ndarray, alpha: float = 0.05) -> tuple[bool, float]:
    """(cointegrated, p) by Engle and Granger's two steps: the residual of x on y and a constant has no unit root."""
    if len(x) != len(y) or len(x) < 12 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return False, 1.0
    a = np.column_stack([y, np.ones(len(y))])
    beta, rss = least_squares(a, x)
    if rss <= 100 * math.sqrt(np.finfo(float).eps) * float(((x - x.mean()) ** 2).sum()):
        return True, 0.0  # one is a multiple of the other
    p = unit_root_p(adf_statistic(x - a @ beta, constant=False), 2)
    return p < alpha, p


def kpss_p(v: np.ndarray) -> float:
    """Level-stationarity p-value, automatic bandwidth, from the published table (0.01 to 0.10)."""
    n = len(v)
    e = v - v.mean()
    if n < 4 or (e**2).sum() == 0:
        return 0.0
    covariance = lambda j: float((e[j:] * e[: n - j]).sum()) / n
    reach = int(n ** (2 / 9))
    s0 = covariance(0) + 2 * sum(covariance(j) for j in range(1, reach + 1))
    s1 = 2 * sum(j * covariance(j) for j in range(1, reach + 1))
    bandwidth = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1) if s0 else 0
    long_run = covariance(0) + 2 * sum((1 - j / (bandwidth + 1)) * covariance(j) for j in range(1, bandwidth + 1))
    statistic = float((np.cumsum(e) ** 2).sum()) / (n * n * max(long_run, 1e-300))
    return float(np.interp(statistic, [c for c, _ in KPSS_TABLE], [p for _, p in KPSS_TABLE]))


def make_stationary(v: np.ndarray, alpha: float = 0.05, max_differences: int = 2) -> tuple[np.ndarray, bool, list[str]]:
    """(series, stationary, steps): differenced or detrended until both unit-root tests agree."""
    steps: list[str] = []
    for _ in range(max_differences + 1):
        root_rejected, level_rejected = adf_p(v) < alpha, kpss_p(v) < alpha
        if root_rejected and not level_rejected:
            return v, True, steps
        if root_rejected and level_rejected:
            i = np.arange(len(v))
            return v - np.polyval(np.polyfit(i, v, 1), i), True, [*steps, "detrended"]
        v = np.diff(v)
        steps.append(f"differenced_{len(steps) + 1}")
    return v, adf_p(v) < alpha, steps


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + term * d, 1 + term / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    if f <= 0 or d1 <= 0 or d2 <= 0:
        return 1.0
    a, b, x = d2 / 2, d1 / 2, d2 / (d2 + d1 * f)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def lag_matrix(v: np.ndarray, lag: int) -> np.ndarray:
    """Columns v[t-1], ..., v[t-lag] for t from lag."""
    return np.column_stack([v[lag - j : len(v) - j] for j in range(1, lag + 1)])


def granger_p(x: np.ndarray, y: np.ndarray, lag: int) -> float:
    """Does x's past help to predict y beyond y's own? p of the F-test."""
    target = y[lag:]
    own = np.column_stack([lag_matrix(y, lag), np.ones(len(target))])
    both = np.column_stack([own, lag_matrix(x, lag)])
    free = len(target) - both.shape[1]
    if free <= 0:
        return 1.0
    _, r = least_squares(own, target)
    _, u = least_squares(both, target)
    return f_tail((r - u) / lag / max(u / free, 1e-300), lag, free)


def bic_lag(x: np.ndarray, y: np.ndarray, max_lag: int = 12) -> int:
    """Order of the two-variable autoregression with the least BIC on a common sample."""
    most, v = max(1, min(max_lag, len(x) // 5)), np.column_stack([x, y])

    def bic(p: int) -> float:
        n = len(v) - most
        a = np.column_stack([*[v[most - j : len(v) - j] for j in range(1, p + 1)], np.ones(n)])
        e = v[most:] - a @ np.linalg.lstsq(a, v[most:], rcond=None)[0]
        return float(np.linalg.slogdet(e.T @ e / n)[1]) + a.shape[1] * 2 * math.log(n) / n

    return min(range(1, most + 1), key=bic)


def direction_name(p_xy: float, p_yx: float, threshold: float = 0.05) -> str:
    """Which way is significant."""
    both = (p_xy < threshold, p_yx < threshold)
    return {(True, True): "bidirectional", (True, False): "x->y", (False, True): "y->x", (False, False): "none"}[both]


def granger(x: np.ndarray, y: np.ndarray, max_lag: int = 12, threshold: float = 0.05, levels: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[str, int, float, bool]:
    """(direction, lag, least p, cointegrated). Where the levels, if given, are cointegrated, they are tested instead."""
    if len(x) != len(y) or len(x) < 30:
        raise ValueError("two series of one length, 30 points at least")
    together = levels is not None and len(levels[0]) == len(levels[1]) and cointegration(*levels)[0]
    if together:
        x, y = levels
    lag = bic_lag(x, y, max_lag)
    pf, pb = granger_p(x, y, lag), granger_p(y, x, lag)
    return direction_name(pf, pb, threshold), lag, min(pf, pb), bool(together)


def per_equation_bic_lag(x: np.ndarray, y: np.ndarray, max_lag: int = 12) -> int:
    """Lag with the least sum of both equations' BIC, each lag on its own sample: a cross-check of bic_lag."""
    best = (math.inf, 1)
    for lag in range(1, max(1, min(max_lag, len(x) // 5)) + 1):
        n = len(y) - lag
        if n <= 2 * lag + 1:
            continue
        past = np.column_stack([lag_matrix(y, lag), lag_matrix(x, lag), np.ones(n)])
        spread = [least_squares(past, v[lag:])[1] / n for v in (x, y)]
        if min(spread) > 0:
            best = min(best, (n * sum(map(math.log, spread)) + 2 * (2 * lag + 1) * math.log(n), lag))
    return best[1]


def granger_cross_check(x: np.ndarray, y: np.ndarray, max_lag: int = 12, threshold: float = 0.05) -> tuple[str, int, float, float]:
    """(direction, lag, p of x to y, p of y to x) with the lag by per_equation_bic_lag."""
    lag = per_equation_bic_lag(x, y, max_lag)
    pf, pb = granger_p(x, y, lag), granger_p(y, x, lag)
    return direction_name(pf, pb, threshold), lag, pf, pb


def histogram_mi(x: np.ndarray, y: np.ndarray, bins: int = 20) -> float:
    """Plug-in mutual information in nats on a bins * bins grid, at least 0."""
    c = np.histogram2d(x, y, bins)[0] / len(x)
    free = c.sum(1, keepdims=True) * c.sum(0, keepdims=True)
    return max(0.0, float((c[c > 0] * np.log(c[c > 0] / free[c > 0])).sum()))


def histogram_permutation_p(x: np.ndarray, y: np.ndarray, n_perm: int = 200, bins: int = 20, threshold: float = 0.05, seed: int = 42) -> tuple[float, float]:
    """(mi, p) as permutation_p, by histogram; a run that stops early still divides by all n_perm."""
    observed, rng, above = histogram_mi(x, y, bins), np.random.default_rng(seed), 0
    for done in range(1, n_perm + 1):
        above += histogram_mi(x, rng.permutation(y), bins) >= observed
        if done >= 10 and (above + 1) / (n_perm + 1) >= threshold:
            break
    return observed, (above + 1) / (n_perm + 1)


def best_lag(x: np.ndarray, y: np.ndarray, max_lag: int = 12, k: int = 7) -> tuple[int, list[float]]:
    """(lag of the greatest information, profile); the first of equal ones; lag 1 and [0] where no lag fits."""
    profile = lag_profile(x, y, max_lag, k) or [0.0]
    return 1 + int(np.argmax(profile)), profile


def ridge(a: np.ndarray, b: np.ndarray, test: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    m, level = a.mean(0), b.mean()
    beta = np.linalg.solve((a - m).T @ (a - m) + alpha * np.eye(a.shape[1]), (a - m).T @ (b - level))
    return level + (test - m) @ beta


def _tree(a: np.ndarray, b: np.ndarray, depth: int, leaf: int):
    """A regression tree as nested (column, cut, left, right) or a mean."""
    best = None
    if depth and len(b) >= 2 * leaf:
        for c in range(a.shape[1]):
            order = np.argsort(a[:, c], kind="stable")
            s, left = np.cumsum(b[order])[:-1], np.arange(1, len(b))
            gain = s**2 / left + (b.sum() - s) ** 2 / (len(b) - left)
            gain[(left < leaf) | (len(b) - left < leaf) | (np.diff(a[order, c]) <= 0)] = -np.inf
            k = int(gain.argmax())
            if np.isfinite(gain[k]) and (best is None or gain[k] > best[0]):
                best = (gain[k], c, (a[order[k], c] + a[order[k + 1], c]) / 2)
    if best is None or best[0] <= b.sum() ** 2 / len(b) + 1e-12:
        return float(b.mean())
    low = a[:, best[1]] <= best[2]
    return best[1], best[2], _tree(a[low], b[low], depth - 1, leaf), _tree(a[~low], b[~low], depth - 1, leaf)


def _grow(node, a: np.ndarray) -> np.ndarray:
    if isinstance(node, float):
        return np.full(len(a), node)
    low = a[:, node[0]] <= node[1]
    out = np.empty(len(a))
    out[low], out[~low] = _grow(node[2], a[low]), _grow(node[3], a[~low])
    return out


def forest(a: np.ndarray, b: np.ndarray, test: np.ndarray, seed: int = 42) -> np.ndarray:
    """Mean of bootstrapped trees; their number and depth follow the sample size."""
    n = len(b)
    trees, depth, leaf = (30, 3, max(5, n // 10)) if n < 100 else (50, 4, max(5, n // 15)) if n < 200 else (50, 5, 10)
    rng, total = np.random.default_rng(seed), np.zeros(len(test))
    for _ in range(trees):
        pick = rng.integers(0, n, n)
        total += _grow(_tree(a[pick], b[pick], depth, leaf), test)
    return total / trees


def best_model(a: np.ndarray, b: np.ndarray, test: np.ndarray) -> np.ndarray:
    """Ridge, or the forest where it beats ridge by a tenth on the last fifth of the training rows."""
    n = len(b)
    if n >= 60 and n >= 3 * a.shape[1]:
        held = max(n // 5, 10)
        mse = lambda f: float(((f(a[:-held], b[:-held], a[-held:]) - b[-held:]) ** 2).mean())
        if mse(forest) < 0.9 * mse(ridge):
            return forest(a, b, test)
    return ridge(a, b, test)


def out_of_sample(x: np.ndarray, y: np.ndarray, lag: int, ratio: float = 0.7) -> float:
    """Share of the autoregression's test error that x's lags take away; 0 where the series is too short."""
    n, split = len(y), int(len(y) * ratio)
    if n <= lag + 10 or split <= lag + 5 or n - split <= lag + 5:
        return 0.0
    lag = min(lag, max((n - split) // 4, 1))
    x, y = ((v - v[:split].mean()) / max(v[:split].std(), 1e-10) for v in (x, y))
    own_train, own_test = lag_matrix(y[:split], lag), lag_matrix(y[split:], lag)
    both_train = np.column_stack([own_train, lag_matrix(x[:split], lag)])
    both_test = np.column_stack([own_test, lag_matrix(x[split:], lag)])
    beta, _ = least_squares(own_train, y[lag:split])
    target = y[split + lag :]
    base = float(((target - own_test @ beta) ** 2).mean())
    return 1 - float(((target - best_model(both_train, y[lag:split], both_test)) ** 2).mean()) / base if base >= 1e-15 else 0.0


def walk_forward(x: np.ndarray, y: np.ndarray, lag: int, train: int = 60, test: int = 24, step: int = 12, least: float = 0.6, gain: float = 0.01, broken: float = -2.0, steady: int = 3) -> tuple[list[float], float, bool, int, float, bool]:
    """(gains of moving windows, pass ratio, robust, regime breaks, pass ratio without those, robust without those).

    A window breaks the regime where its gain lies under `broken`; with fewer than `steady` others the second ratio is 0.
    """
    size = train + test + lag
    starts = range(0, len(x) - size + 1, step) if test >= lag + 10 else ()
    gains = [out_of_sample(x[s : s + train + test], y[s : s + train + test], lag, train / (train + test)) for s in starts]
    share = lambda r2: sum(r > gain for r in r2) / len(r2) if r2 else 0.0
    others = [r for r in gains if r >= broken]
    ratio, adjusted = share(gains), share(others) if len(others) >= steady else 0.0
    return gains, ratio, bool(gains) and ratio >= least, len(gains) - len(others), adjusted, len(others) >= steady and adjusted >= least


def both_halves(x: np.ndarray, y: np.ndarray, lag: int, at: float = 0.5, gain: float = 0.01) -> tuple[float, float, bool]:
    """(gain in the first part, in the second, both over `gain`); a part of lag + 20 points or fewer has gain 0."""
    mid = int(len(x) * at)
    first, second = (out_of_sample(a, b, lag) if len(a) > lag + 20 else 0.0 for a, b in ((x[:mid], y[:mid]), (x[mid:], y[mid:])))
    return first, second, first > gain and second > gain


def sharpe(returns: np.ndarray, periods: int = 12) -> float:
    spread = returns.std()
    return 0.0 if len(returns) < 2 or spread < 1e-10 else float(returns.mean() / spread * math.sqrt(periods))


def random_sharpes(returns: np.ndarray, draws: int = 1000, seed: int = 42) -> tuple[float, float]:
    """(mean, deviation) of the Sharpe ratios of random long or short positions."""
    rng = np.random.default_rng(seed)
    found = np.array([sharpe(rng.choice([-1.0, 1.0], size=len(returns)) * returns) for _ in range(draws)])
    return float(found.mean()), float(found.std())


def backtest(x: np.ndarray, y: np.ndarray, lag: int, ratio: float = 0.6, draws: int = 1000) -> tuple:
    """(train, test, slope, sharpe, yearly return, drawdown, win rate, the same three of holding, random mean and deviation).

    y is traded long or short by the sign of a ridge prediction from x `lag` places earlier.
    """
    if len(x) < lag + 40:
        raise ValueError(f"{len(x)} common points are too few for lag {lag}")
    past, now = x[: len(x) - lag], y[lag:]
    cut = int(len(past) * ratio)
    if len(past) - cut < 10:
        raise ValueError(f"{len(past) - cut} test points are too few")
    a, b = past[:cut] - past[:cut].mean(), now[:cut]
    slope = float(a @ (b - b.mean()) / (a @ a + 1.0))
    held = now[cut:]
    trades = np.where(b.mean() + slope * (past[cut:] - past[:cut].mean()) > 0, 1.0, -1.0) * held

    def drawdown(returns: np.ndarray) -> float:
        worth = 100 + np.cumsum(returns)
        peak = np.maximum.accumulate(worth)
        return float(((worth - peak) / peak).min())

    return cut, len(held), slope, sharpe(trades), float(trades.mean() * 12), drawdown(trades), float((trades > 0).mean()), sharpe(held), float(held.mean() * 12), drawdown(held), *random_sharpes(held, draws)
