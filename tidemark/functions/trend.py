"""Per-series numerics of the trend + seasonality model, used inside Spark tasks.

``design`` builds the feature matrix of a batch of rows, ``normal_parts`` the weighted sums that one
reweighting step needs and ``solve`` the small system. The sums are additive over rows, so a series
can be fitted in one task or from partial sums of many tasks.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np

DAY_US = 86_400_000_000
# Fixed values of the model: periods in days and hours, share of the range with change points.
WEEK_DAYS, DAY_HOURS, CHANGE_RANGE = 7.0, 24.0, 0.8
MAX_ORDER, MAX_CHANGEPOINTS = 6, 10
ROLES = ("point", "upper", "lower")


@dataclass(frozen=True)
class Seasonality:
    """An additional Fourier seasonality; the period is in days."""

    name: str
    period: float
    order: int
    prior_scale: float | None = None


@dataclass(frozen=True)
class Options:
    """Model options; ``None`` means chosen from the data of each series."""

    weekly_order: int | None = None
    daily_order: int | None = None
    n_changepoints: int | None = None
    lambda_reg: float = 0.001
    interval_width: float = 0.95
    changepoints: tuple[str, ...] = ()
    changepoint_range: float = CHANGE_RANGE
    yearly_order: int = 0
    seasonalities: tuple[Seasonality, ...] = ()
    standardize: bool = True
    extra_prior: tuple[float | None, ...] = ()
    cap: float | None = None
    floor: float | None = None
    passes: int = 60

    def __post_init__(self):
        if not 0 < self.interval_width < 1:
            raise ValueError("interval_width must lie between 0 and 1")
        if self.yearly_order and not any(s.name == "yearly" for s in self.seasonalities):
            object.__setattr__(self, "seasonalities", (*self.seasonalities, Seasonality("yearly", 365.25, self.yearly_order)))

    @classmethod
    def from_dict(cls, conf: dict) -> "Options":
        conf = dict(conf)
        custom = []
        for item in conf.pop("seasonalities", ()):
            missing = {"name", "period", "order"} - set(item)
            if missing:
                raise ValueError(f"seasonality {item} lacks {sorted(missing)}")
            custom.append(Seasonality(**item))
        for name in ("changepoints", "extra_prior"):
            if name in conf:
                conf[name] = tuple(conf[name])
        return cls(seasonalities=tuple(custom), **conf)

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass
class Shape:
    """What fixes the features of one series: range, orders, change points, scaling."""

    first: int
    last: int
    n: int
    y_scale: float
    weekly: int
    daily: int
    changepoints: np.ndarray
    lam: float
    extra_mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    extra_std: np.ndarray = field(default_factory=lambda: np.ones(0))

    def role(self, role: str) -> "Shape":
        """Interval models use half the Fourier orders and ten times the regularization."""
        if role == "point":
            return self
        return Shape(self.first, self.last, self.n, self.y_scale, self.weekly // 2, self.daily // 2, self.changepoints,
                     self.lam * 10, self.extra_mean, self.extra_std)


def auto_shape(first: int, last: int, n: int, y_scale: float, opt: Options, extra_mean=(), extra_std=()) -> Shape:
    span = last - first
    order = int(np.clip(n // 60, 1, MAX_ORDER))
    weekly = opt.weekly_order if opt.weekly_order is not None else (0 if span < 14 * DAY_US else order)
    daily = opt.daily_order if opt.daily_order is not None else (0 if span < 2 * DAY_US else order)
    k = opt.n_changepoints if opt.n_changepoints is not None else min(n // 30, MAX_CHANGEPOINTS)
    if n < 2 * k:
        k = 0
    points = opt.changepoint_range * np.arange(k + 1) / (k + 1)
    if opt.changepoints:
        at = np.array(list(opt.changepoints), dtype="datetime64[us]").astype(np.int64)
        points = np.r_[0.0, np.sort((at - first) / max(span, 1))]
    scale = y_scale if abs(y_scale) >= 1e-6 else 1.0
    return Shape(first, last, n, scale, int(weekly), int(daily), points, opt.lambda_reg,
                 np.asarray(extra_mean, float), np.asarray(extra_std, float))


def _fourier(x: np.ndarray, period: float, order: int) -> np.ndarray:
    angle = (2 * np.pi / period) * x[:, None] * np.arange(1, order + 1)
    return np.hstack([np.cos(angle), np.sin(angle)])


def design(ts: np.ndarray, extras: np.ndarray | None, shape: Shape, opt: Options) -> np.ndarray:
    """Features of timestamps in microseconds: intercept, slopes, weekly, daily, custom, extras."""
    span = max(shape.last - shape.first, 1)
    x = (ts - shape.first) / span
    hinge = np.maximum(x[:, None] - shape.changepoints[None, 1:], 0.0)
    minute = ts // 60_000_000
    hours = (minute % 1440) / 60.0
    days = (minute // 1440 + 3) % 7 + hours / 24.0  # Monday is 0
    parts = [np.ones((len(ts), 1)), x[:, None], hinge, _fourier(days, WEEK_DAYS, shape.weekly), _fourier(hours, DAY_HOURS, shape.daily)]
    for s in opt.seasonalities:
        parts.append(_fourier(ts / DAY_US, s.period, s.order))
    if extras is not None and extras.shape[1]:
        parts.append((extras - shape.extra_mean) / shape.extra_std)
    return np.hstack(parts)


def ridge(shape: Shape, opt: Options, n_extra: int) -> np.ndarray:
    """Diagonal of the penalty, in units of the mean loss."""
    k, lam = len(shape.changepoints), shape.lam
    parts = [np.zeros(1), np.full(k, lam / k), np.full(2 * shape.weekly, lam / max(shape.weekly, 1)),
             np.full(2 * shape.daily, lam / max(shape.daily, 1))]
    for s in opt.seasonalities:
        weight = lam / s.order if s.prior_scale is None else 1.0 / (shape.n * s.prior_scale**2)
        parts.append(np.full(2 * s.order, weight))
    priors = list(opt.extra_prior) + [None] * (n_extra - len(opt.extra_prior))
    parts.append(np.array([0.0 if p is None else 1.0 / (shape.n * p**2) for p in priors[:n_extra]]))
    return np.concatenate(parts)


def quantile_of(role: str, width: float) -> float | None:
    return {"point": None, "upper": 0.5 + width / 2, "lower": 0.5 - width / 2}[role]


def smoothing(step: int) -> float:
    """Smoothing of the absolute value at a pass of the quantile fit: 0.1 falling to 1e-4."""
    return max(1e-1 * 0.75**step, 1e-4)


def normal_parts(x: np.ndarray, y: np.ndarray, beta: np.ndarray | None, q: float | None, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """``X'WX`` and right side for one pass: Huber weights, or quantile majorisation for ``q``."""
    if beta is None:
        w = np.ones(len(y))
    else:
        r = np.abs(y - x @ beta)
        w = 1.0 / np.maximum(r, 1.0) if q is None else 1.0 / (eps + r)
    xw = x * np.sqrt(w)[:, None]  # one matrix times itself takes half the products
    rhs = x.T @ (w * y)
    if q is not None and beta is not None:
        rhs = rhs + (2 * q - 1) * x.sum(axis=0)
    return xw.T @ xw, rhs


def solve(gram: np.ndarray, rhs: np.ndarray, penalty: np.ndarray, n: int, q: float | None) -> np.ndarray:
    """The coefficients of one system or a stack of them. A small weight keeps dependent columns solvable; a step of
    refinement takes its pull out again."""
    factor = n if q is None else 2 * n
    system, at, rhs = gram.copy(), np.arange(gram.shape[-1]), rhs[..., None]
    guard = 1e-9 * np.maximum(gram[..., at, at].mean(axis=-1, keepdims=True), 1e-12)
    system[..., at, at] += penalty * factor + guard
    if not (np.isfinite(system).all() and np.isfinite(rhs).all()):
        raise FloatingPointError("normal equations overflow")
    try:
        beta = np.linalg.solve(system, rhs)
        return (beta + np.linalg.solve(system, rhs - system @ beta + guard[..., None] * beta))[..., 0]
    except np.linalg.LinAlgError:
        if system.ndim > 2:
            return np.stack([np.linalg.lstsq(a, b, rcond=None)[0][:, 0] for a, b in zip(system, rhs)])
        return np.linalg.lstsq(system, rhs, rcond=None)[0][:, 0]


def settled(new: np.ndarray, beta: np.ndarray, q: float | None, eps: float) -> bool:
    """No further pass is needed."""
    return bool(np.max(np.abs(new - beta)) < 1e-7 and (q is None or eps <= 1e-4))


BLOCK_ROWS = 100_000


def fit_local(x: np.ndarray, y: np.ndarray, penalty: np.ndarray, q: float | None, passes: int) -> tuple[np.ndarray, int]:
    """All passes on rows held by one task."""
    return _passes(lambda beta, eps: normal_parts(x, y, beta, q, eps), penalty, len(y), q, passes)


def fit_roles(ts: np.ndarray, y: np.ndarray, extras: np.ndarray, shape: Shape, opt: Options) -> dict[str, tuple[np.ndarray, int]]:
    """``fit_rows`` for all roles: both bounds have the same features, which are made once, and pass side by side."""
    if len(y) > BLOCK_ROWS or not opt.passes:
        return {role: fit_rows(ts, y, extras, shape, opt, role) for role in ROLES}
    out, part = {"point": fit_rows(ts, y, extras, shape, opt, "point")}, shape.role("upper")
    x, scaled, penalty = design(ts, extras, part, opt), y / shape.y_scale, ridge(part, opt, extras.shape[1])
    gram, rhs = normal_parts(x, scaled, None, None, 0.0)
    roles = [r for r in ROLES if r != "point"]
    beta = np.stack([solve(gram, rhs, penalty, len(y), None)] * len(roles))
    sums, xt = x.sum(axis=0), np.ascontiguousarray(x.T)
    for step in range(1, opt.passes):
        eps, q = smoothing(step), np.array([quantile_of(r, opt.interval_width) for r in roles])
        w = 1.0 / (eps + np.abs(scaled - beta @ xt))
        grams = np.stack([(xw := xt * half) @ xw.T for half in np.sqrt(w)])
        new = solve(grams, (w * scaled) @ x + (2 * q - 1)[:, None] * sums, penalty, len(y), 0.5)
        done = [settled(a, b, 0.5, eps) for a, b in zip(new, beta)]
        for role, at, end in zip(roles, new, done):
            if end:
                out[role] = at, step + 1
        roles, beta = [r for r, end in zip(roles, done) if not end], new[~np.array(done)]
        if not roles:
            break
    return out | {role: (at, opt.passes) for role, at in zip(roles, beta)}


def fit_rows(ts: np.ndarray, y: np.ndarray, extras: np.ndarray, shape: Shape, opt: Options, role: str) -> tuple[np.ndarray, int]:
    """Fit one model of a series. Features of long series are made block by block in every pass."""
    part = shape.role(role)
    penalty, q, scaled = ridge(part, opt, extras.shape[1]), quantile_of(role, opt.interval_width), y / shape.y_scale
    if len(y) <= BLOCK_ROWS:
        return fit_local(design(ts, extras, part, opt), scaled, penalty, q, opt.passes)

    def sums(beta, eps):
        gram = rhs = 0.0
        for at in range(0, len(y), BLOCK_ROWS):
            rows = slice(at, at + BLOCK_ROWS)
            g, b = normal_parts(design(ts[rows], extras[rows], part, opt), scaled[rows], beta, q, eps)
            gram, rhs = gram + g, rhs + b
        return gram, rhs

    return _passes(sums, penalty, len(y), q, opt.passes)


def _passes(sums, penalty: np.ndarray, n: int, q: float | None, passes: int) -> tuple[np.ndarray, int]:
    beta = None
    for step in range(passes):
        eps = smoothing(step)
        gram, rhs = sums(beta, eps)
        new = solve(gram, rhs, penalty, n, None if beta is None else q)
        done = beta is not None and settled(new, beta, q, eps)
        beta = new
        if done:
            break
    return beta, step + 1
