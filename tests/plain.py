"""Plain NumPy forms that the operators are held to."""

import numpy as np

from lockstep.operators.dense import least_on_plateau


def ridge(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Coefficients of y on x with a squared penalty."""
    return np.linalg.solve(x.T @ x + penalty * np.eye(x.shape[1]), x.T @ y)


def condition(x: np.ndarray) -> float:
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    return float(s[0] / s[-1]) if s[-1] > 0 else float("inf")


def alpha_errors(y: np.ndarray, x: np.ndarray, folds: np.ndarray, alphas: list[float]) -> np.ndarray | None:
    """The mean squared error of x from y for each alpha, over the folds; None if no fold can be used.

    The penalty of a fold is alpha times the mean sum of squares of its training channels. Folds with fewer training rows than channels are left out.
    """
    errors = np.zeros(len(alphas))
    used = 0
    for f in np.unique(folds):
        train, test = folds != f, folds == f
        if train.sum() < y.shape[1]:
            continue
        center_y, center_x = y[train].mean(axis=0), x[train].mean(axis=0)
        u, s, vt = np.linalg.svd(y[train] - center_y, full_matrices=False)
        scale, seen, target = float((s**2).sum()) / y.shape[1], (y[test] - center_y) @ vt.T, u.T @ (x[train] - center_x)
        for k, a in enumerate(alphas):
            guess = (seen * (s / (s**2 + a * scale))) @ target
            errors[k] += float(((x[test] - center_x - guess) ** 2).mean())
        used += 1
    return errors / used if used else None


def tuned_alpha(y: np.ndarray, x: np.ndarray, folds: np.ndarray, alphas: list[float]) -> tuple[float, float]:
    """The smallest alpha on the plateau of the least error, and its error; NaN if no fold can be used."""
    errors = alpha_errors(y, x, folds, alphas)
    if errors is None:
        return float("nan"), float("nan")
    best = least_on_plateau(errors)
    return alphas[best], float(errors[best])


def back_to_back(y1: np.ndarray, x1: np.ndarray, y2: np.ndarray, x2: np.ndarray, alpha: float, most_condition: float = 85.0) -> tuple[np.ndarray, bool]:
    """One direction: features decoded from channels on one half, then explained by themselves on the other.

    Returns the diagonal of the second regression and whether it is valid: rows enough and well conditioned.
    """
    cy, cx = y1.mean(axis=0), x1.mean(axis=0)
    u, s, vt = np.linalg.svd(y1 - cy, full_matrices=False)
    penalty = alpha * float((s**2).sum()) / y1.shape[1]
    decoder = (vt.T * (s / (s**2 + penalty))) @ (u.T @ (x1 - cx))
    guess = (y2 - cy) @ decoder
    guess -= guess.mean(axis=0)
    centered = x2 - x2.mean(axis=0)
    valid = len(x2) >= x2.shape[1] and condition(x2) <= most_condition
    h, *_ = np.linalg.lstsq(centered, guess, rcond=None)
    return np.diag(h), bool(valid)


def drift_basis(n: int, bumps: int = 40) -> np.ndarray:
    """A constant and Gaussian bumps along n positions."""
    at, centers = np.linspace(0, 1, n)[:, None], np.linspace(0, 1, bumps)[None]
    width = 1 / max(1, bumps - 1)
    return np.hstack([np.ones((n, 1)), np.exp(-0.5 * ((at - centers) / width) ** 2)])


def residual(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """x less what ``basis`` explains of it."""
    return x - basis @ np.linalg.lstsq(basis, x, rcond=None)[0]


def bandpass(x: np.ndarray, rate: float, low: float, high: float, order: int = 4) -> np.ndarray:
    """Zero-phase filter along the first axis with the squared gain of a Butterworth band-pass, on a mirrored signal."""
    n = len(x)
    mirrored = np.concatenate([x[::-1], x, x[::-1]])
    f = np.fft.rfftfreq(3 * n, 1 / rate)
    with np.errstate(divide="ignore"):
        w = np.where(f > 0, (f**2 - low * high) / (f * (high - low) + 1e-300), np.inf)
    gain = 1 / (1 + w ** (2 * order))
    gain = gain.reshape(-1, *[1] * (x.ndim - 1))
    return np.fft.irfft(np.fft.rfft(mirrored, axis=0) * gain, 3 * n, axis=0)[n : 2 * n]


def evoked_components(epochs: np.ndarray, n: int, floor: float = 1e-6) -> np.ndarray:
    """Spatial filters (channels x n) that favour what repeats over epochs (epochs x channels x times): whitening, then the mean's components."""
    flat = epochs.transpose(1, 0, 2).reshape(epochs.shape[1], -1)
    flat = flat - flat.mean(axis=1, keepdims=True)
    values, vectors = np.linalg.eigh(flat @ flat.T / flat.shape[1])
    whiten = vectors / np.sqrt(np.maximum(values, floor * values.max()))
    mean = whiten.T @ (epochs.mean(axis=0) - epochs.mean(axis=(0, 2))[:, None])
    power, turn = np.linalg.eigh(mean @ mean.T)
    found = whiten @ turn[:, np.argsort(power)[::-1][:n]]
    return found / np.linalg.norm(found, axis=0)


def freedman_lane(x: np.ndarray, nuisance: np.ndarray, shift: int) -> np.ndarray:
    """x whose part beyond the nuisance is shifted around, while the explained part stays."""
    rest = residual(x, nuisance)
    return x - rest + np.roll(rest, shift, axis=0)


def standardised_components(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the first k components of standardised columns, whitened, and the loadings; signs make the largest loading positive."""
    z = (x - x.mean(axis=0)) / np.where((sd := x.std(axis=0, ddof=1)) > 0, sd, 1)
    _, _, vt = np.linalg.svd(z, full_matrices=False)
    load = vt[:k].T * np.sign(vt[:k][np.arange(k), np.abs(vt[:k]).argmax(axis=1)])
    scores = z @ load
    return scores / scores.std(axis=0, ddof=1), load


def legendre_fit(y: np.ndarray, degree: int = 2) -> np.ndarray:
    """Least-squares Legendre coefficients of y on [-1, 1], over its finite points; NaN if they are too few."""
    at = np.linspace(-1, 1, len(y))
    ok = np.isfinite(y)
    return np.polynomial.legendre.legfit(at[ok], y[ok], degree) if ok.sum() > degree else np.full(degree + 1, np.nan)


def helmert(k: int) -> np.ndarray:
    """Orthonormal contrasts of k levels (k x k-1)."""
    h = np.zeros((k, k - 1))
    for j in range(1, k):
        h[:j, j - 1], h[j, j - 1] = 1, -j
    return h / np.linalg.norm(h, axis=0)
