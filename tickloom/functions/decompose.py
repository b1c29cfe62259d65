"""Empirical mode decomposition and the analytic signal, in numpy. Built for one series at a time."""

from __future__ import annotations

import numpy as np


def local_peaks(x: np.ndarray) -> np.ndarray:
    """Indices of strict local maxima; a plateau counts at the floor of its middle, the ends never."""
    if len(x) < 3:
        return np.zeros(0, int)
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    ends = np.concatenate([starts[1:] - 1, [len(x) - 1]])
    v = x[starts]
    inner = np.arange(1, len(v) - 1)
    top = inner[(v[inner] > v[inner - 1]) & (v[inner] > v[inner + 1])]
    return (starts[top] + ends[top]) // 2


def spline(xs: np.ndarray, ys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through the knots; straight for two of them, constant for one."""
    n = len(xs)
    if n == 1:
        return np.full(len(at), ys[0])
    h = np.diff(xs).astype(float)
    m = np.zeros(n)
    if n > 2:
        # tridiagonal system of second derivatives, by elimination
        lower, diag, upper = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
        rhs = 6 * (np.diff(ys)[1:] / h[1:] - np.diff(ys)[:-1] / h[:-1])
        for i in range(1, n - 2):
            f = lower[i] / diag[i - 1]
            diag[i] -= f * upper[i - 1]
            rhs[i] -= f * rhs[i - 1]
        m[n - 2] = rhs[-1] / diag[-1]
        for i in range(n - 4, -1, -1):
            m[i + 1] = (rhs[i] - upper[i] * m[i + 2]) / diag[i]
    k = np.clip(np.searchsorted(xs, at, "right") - 1, 0, n - 2)
    a, b = (xs[k + 1] - at) / h[k], (at - xs[k]) / h[k]
    return a * ys[k] + b * ys[k + 1] + ((a**3 - a) * m[k] + (b**3 - b) * m[k + 1]) * h[k] ** 2 / 6


def _envelope(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Spline through extremes, with two mirrored at each end."""
    n = len(x)
    left, right = -at[:2][::-1], 2 * (n - 1) - at[-2:][::-1]
    xs = np.concatenate([left, at, right])
    ys = np.concatenate([x[at[:2]][::-1], x[at], x[at[-2:]][::-1]])
    xs, keep = np.unique(xs, return_index=True)
    return spline(xs, ys[keep], np.arange(n))


def sift(x: np.ndarray, rounds: int = 50, tolerance: float = 0.05) -> np.ndarray | None:
    """The fastest mode of a series, or None if it has too few extremes."""
    h = x.astype(float)
    for k in range(rounds):
        up, down = local_peaks(h), local_peaks(-h)
        if len(up) < 2 or len(down) < 2:
            return h if k else None
        mean = (_envelope(h, up) + _envelope(h, down)) / 2
        new = h - mean
        if np.sum(mean**2) < tolerance**2 * np.sum(h**2):
            return new
        h = new
    return h


def emd(x: np.ndarray, most: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(modes, residue); modes and residue add up to the series."""
    rest, modes = x.astype(float), []
    while len(modes) < most and np.ptp(rest) > 1e-12 * max(1.0, np.abs(x).max(initial=0)):
        mode = sift(rest)
        if mode is None:
            break
        modes.append(mode)
        rest = rest - mode
    return np.asarray(modes).reshape(len(modes), len(x)), rest


def ceemdan(x: np.ndarray, trials: int = 100, noise: float = 0.2, seed: int = 1337, most: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Complete ensemble EMD with adaptive noise: at each stage the mean first mode over noisy copies, the
    noise being that stage's mode of white noise scaled to the rest. Same seed, same result; modes and
    residue add up to the series."""
    rng = np.random.default_rng(seed)
    scale = np.std(x)
    if scale == 0 or len(x) < 8:
        return np.zeros((0, len(x))), x.astype(float)
    noises = [emd(rng.standard_normal(len(x)), most)[0] for _ in range(trials)]
    rest, modes = x / scale, []
    while len(modes) < most:
        stage, firsts = len(modes), []
        if sift(rest) is None:
            break
        for own in noises:
            added = own[stage] if stage < len(own) else 0.0
            size = np.std(added)
            mode = sift(rest + noise * np.std(rest) * added / size if size else rest)
            firsts.append(mode if mode is not None else np.zeros(len(x)))
        modes.append(np.mean(firsts, axis=0))
        rest = rest - modes[-1]
    return np.asarray(modes).reshape(len(modes), len(x)) * scale, rest * scale


def analytic(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(amplitude, unwrapped phase, period): the last period is repeated, standing phase is an infinite one."""
    n = len(x)
    f = np.fft.fft(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    z = np.fft.ifft(f * gain)
    phase = np.unwrap(np.angle(z))
    step = np.abs(np.diff(phase))
    period = np.where(step > 0, 2 * np.pi / np.where(step > 0, step, 1), np.inf)
    return np.abs(z), phase, np.concatenate([period, period[-1:]])


def circular_variance(angle: np.ndarray) -> float:
    return float(1 - np.abs(np.mean(np.exp(1j * angle)))) if len(angle) else float("nan")


def theil_sen(y: np.ndarray, pairs: int = 20_000, seed: int = 0) -> tuple[float, float]:
    """(slope, intercept) by medians over pairs of points, all of them if few enough."""
    n = len(y)
    if n * (n - 1) // 2 <= pairs:
        i, j = np.triu_indices(n, 1)
    else:
        rng = np.random.default_rng(seed)
        i, j = rng.integers(0, n, pairs), rng.integers(0, n, pairs)
        i, j = i[i != j], j[i != j]
    slope = float(np.median((y[j] - y[i]) / (j - i))) if len(i) else 0.0
    return slope, float(np.median(y - slope * np.arange(n)))


def detrend(y: np.ndarray, passes: int = 3, c: float = 4.685) -> np.ndarray:
    """The series less a robust line: Theil-Sen, then weighted least squares with biweights of the residues."""
    t = np.arange(len(y), dtype=float)
    slope, level = theil_sen(y)
    for _ in range(passes):
        rest = y - slope * t - level
        spread = 1.4826 * np.median(np.abs(rest - np.median(rest)))
        if spread == 0:
            break
        u = rest / (c * spread)
        w = np.where(np.abs(u) < 1, (1 - u**2) ** 2, 0.0)
        if w.sum() == 0:
            break
        mt, my = np.average(t, weights=w), np.average(y, weights=w)
        var = np.sum(w * (t - mt) ** 2)
        if var == 0:
            break
        slope = np.sum(w * (t - mt) * (y - my)) / var
        level = my - slope * mt
    return y - slope * t - level


def brackets(mode: np.ndarray) -> list[tuple[int, int, int]]:
    """Alternating triples of extremes of the mode smoothed by medians of three (0 beyond its ends)."""
    padded = np.concatenate([[0.0], mode, [0.0]])
    smooth = np.median(np.stack([padded[:-2], padded[1:-1], padded[2:]]), axis=0)
    marks = sorted([(int(i), 1) for i in local_peaks(smooth)] + [(int(i), -1) for i in local_peaks(-smooth)])
    return [(a[0], b[0], c[0]) for a, b, c in zip(marks, marks[1:], marks[2:]) if a[1] == -b[1] == c[1]]


def mode_features(mode: np.ndarray, original: np.ndarray, least_period: float = 3, most_share: float = 2 / 3, least_depth: float = 2.0) -> tuple[dict, np.ndarray, int] | None:
    """Features of a mode, its amplitude and the guard at both ends; None if it does not pass.

    It passes with a median period between ``least_period`` and ``most_share`` of its length, and a cycle
    at least ``least_depth`` percent deep in the original series inside the guards."""
    amplitude, phase, period = analytic(mode)
    finite = period[np.isfinite(period)]
    middle = float(np.median(finite)) if len(finite) else float("nan")
    if not np.isfinite(middle) or middle < least_period or middle > most_share * len(mode):
        return None
    guard = max(1, round(0.25 * middle))
    if len(mode) - 2 * guard < 2 * least_period:
        return None
    inside = slice(guard, len(mode) - guard)
    good = [b for b in brackets(mode) if b[0] >= guard and b[2] <= len(mode) - guard]

    def depth(i: int, j: int) -> float:
        level = (original[i] + original[j]) / 2
        return abs(original[i] - original[j]) / abs(level) * 100 if level else 0.0

    depths = [d for a, b, c in good if (d := max(depth(a, b), depth(b, c))) >= least_depth]
    if not depths:
        return None
    within = period[inside]
    within = within[np.isfinite(within)]
    made = {"period_bars": float(np.median(within)) if len(within) else middle, "amp_pct": float(np.median(depths)), "phase_var": circular_variance(phase[inside]), "cycles_count": len(good), "pct_cycles_ge_2pct": 100 * len(depths) / len(good), "energy": float(np.var(mode))}
    return made, amplitude, guard


def pair_modes(price: list[tuple[dict, np.ndarray, int]], volume: list[tuple[dict, np.ndarray, int]], nearest: int = 3) -> list[tuple[int, float] | None]:
    """For each price mode the volume mode, of the nearest in period, whose amplitude follows it most."""
    out: list[tuple[int, float] | None] = []
    for info, amp, guard in price:
        near = sorted(range(len(volume)), key=lambda k: (abs(volume[k][0]["period_bars"] - info["period_bars"]), k))[:nearest]
        best = None
        for k in near:
            g = max(guard, volume[k][2])
            a, b = amp[g : len(amp) - g], volume[k][1][g : len(amp) - g]
            if len(a) > 2 and np.std(a) > 0 and np.std(b) > 0 and (best is None or np.corrcoef(a, b)[0, 1] > best[1]):
                best = (k, float(np.corrcoef(a, b)[0, 1]))
        out.append(best)
    return out
