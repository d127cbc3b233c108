"""One-to-one matchings of two sorted sets of times, and the beat metrics (published definitions)."""

from __future__ import annotations

import numpy as np


def greedy_match(a: np.ndarray, b: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """Pairs by growing distance, each element once; ties by the smaller indices."""
    i, j = np.nonzero(np.abs(a[:, None] - b[None, :]) <= tolerance) if len(a) and len(b) else (np.empty(0, int), np.empty(0, int))
    used_a, used_b, out = set(), set(), []
    for k in np.lexsort((j, i, np.abs(a[i] - b[j]))):
        if i[k] not in used_a and j[k] not in used_b:
            used_a.add(i[k])
            used_b.add(j[k])
            out.append((int(i[k]), int(j[k])))
    return sorted(out)


def maximum_match(a: np.ndarray, b: np.ndarray, tolerance: float) -> int:
    """Size of a maximum matching: on sorted points with one tolerance, the sweep that matches early finds one."""
    i = j = n = 0
    while i < len(a) and j < len(b):
        d = a[i] - b[j]
        if abs(d) <= tolerance:
            i, j, n = i + 1, j + 1, n + 1
        elif d < 0:
            i += 1
        else:
            j += 1
    return n


def f_measure(reference: np.ndarray, estimate: np.ndarray, tolerance: float = 0.07) -> float:
    if not len(reference) or not len(estimate):
        return 0.0
    return 2.0 * maximum_match(reference, estimate, tolerance) / (len(reference) + len(estimate))


def nearest_index(points: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of the nearest of sorted points, the earlier of two equally near."""
    k = np.clip(np.searchsorted(points, x), 1, max(len(points) - 1, 1))
    return np.where((len(points) > 1) & (x - points[k - 1] > points[np.minimum(k, len(points) - 1)] - x), k, k - 1)


def levels(beats: np.ndarray) -> list[np.ndarray]:
    """The beats, their off-beats, double time, and half time from either beat."""
    mid = (beats[:-1] + beats[1:]) / 2
    return [beats, mid, np.sort(np.concatenate([beats, mid])), beats[::2], beats[1::2]]


def cemgil(reference: np.ndarray, estimate: np.ndarray, sigma: float = 0.04) -> tuple[float, float]:
    """Gaussian accuracy, and the best of it over metrical levels."""
    if not len(reference) or not len(estimate):
        return 0.0, 0.0

    def one(r: np.ndarray) -> float:
        if not len(r):
            return 0.0
        d = r - estimate[nearest_index(estimate, r)]
        return float(np.exp(-(d**2) / (2 * sigma**2)).sum() / (0.5 * (len(estimate) + len(r))))

    each = [one(r) for r in levels(reference)]
    return each[0], max(each)


def goto(reference: np.ndarray, estimate: np.ndarray, threshold: float = 0.35, mu: float = 0.2, sigma: float = 0.2) -> float:
    """1 if a run of at least a quarter of the piece is tracked closely and evenly."""
    if len(reference) < 2 or not len(estimate):
        return 0.0
    error, paired = np.ones(len(reference)), np.zeros(len(reference))
    for n in range(1, len(reference) - 1):
        before, after = (reference[n] - reference[n - 1]) / 2, (reference[n + 1] - reference[n]) / 2
        inside = estimate[(estimate >= reference[n] - before) & (estimate < reference[n] + after)]
        if len(inside) == 1:
            paired[n] = 1
            off = inside[0] - reference[n]
            error[n] = off / (before if off < 0 else after)
    wrong = np.nonzero(np.abs(error) > threshold)[0]
    if len(wrong) < 3:
        run = error[wrong[0] + 1 : wrong[-1] - 1] if len(wrong) else error
        good = len(run) > 0
    else:
        span = np.diff(wrong)
        k = int(np.argmax(span))
        good = span[k] - 1 > 0.25 * (len(reference) - 2)
        run = error[wrong[k] : wrong[k + 1] + 1]
    if not good or len(run) == 0:
        return 0.0
    inner = run[1:-1] if len(wrong) >= 3 else run
    return float(len(inner) > 0 and np.abs(inner.mean()) < mu and inner.std(ddof=1 if len(inner) > 1 else 0) < sigma)


def p_score(reference: np.ndarray, estimate: np.ndarray, share: float = 0.2, rate: int = 100) -> float:
    """Cross-correlation of the two trains within a fifth of the median interval."""
    if len(reference) < 2 or len(estimate) < 2:
        return 0.0
    start = min(reference[0], estimate[0])
    r, e = (np.round((x - start) * rate).astype(int) for x in (reference, estimate))
    size = max(r[-1], e[-1]) + 1
    a, b = np.zeros(size), np.zeros(size)
    a[r], b[e] = 1, 1
    window = int(np.round(share * np.median(np.diff(np.nonzero(a)[0]))))
    total = sum(a[max(0, -k) : size - max(0, k)] @ b[max(0, k) : size - max(0, -k)] for k in range(-window, window + 1))
    return float(total / max(len(reference), len(estimate)))


def continuity(reference: np.ndarray, estimate: np.ndarray, phase: float = 0.175, period: float = 0.175) -> tuple[float, float, float, float]:
    """CMLc, CMLt, AMLc, AMLt."""
    if len(reference) < 2 or len(estimate) < 2:
        return 0.0, 0.0, 0.0, 0.0

    def one(r: np.ndarray) -> tuple[float, float]:
        if len(r) < 2:
            return 0.0, 0.0
        right = np.zeros(len(estimate), bool)
        used = np.zeros(len(r), bool)
        for m, t in enumerate(estimate):
            n = int(np.argmin(np.abs(r - t)))
            if used[n]:
                continue
            own = r[n] - r[n - 1] if n else r[1] - r[0]
            gap = estimate[m] - estimate[m - 1] if m else (estimate[1] - estimate[0])
            if m == 0 or n == 0:
                own = r[n + 1] - r[n] if n + 1 < len(r) else own
                gap = estimate[m + 1] - estimate[m] if m + 1 < len(estimate) else gap
            if abs(t - r[n]) < phase * own and abs(1 - gap / own) < period:
                right[m] = used[n] = True
        edge = np.nonzero(~np.concatenate([[False], right, [False]]))[0]
        size = max(len(r), len(estimate))
        return float((np.diff(edge) - 1).max() / size), float(right.sum() / size)

    each = [one(r) for r in levels(reference)]
    return each[0][0], each[0][1], max(x[0] for x in each), max(x[1] for x in each)


def information_gain(reference: np.ndarray, estimate: np.ndarray, bins: int = 41) -> float:
    """How far the beat error histogram is from uniform, the worse of both directions, in [0, 1]."""
    if len(reference) < 2 or len(estimate) < 2:
        return 0.0

    def entropy(a: np.ndarray, b: np.ndarray) -> float:
        """Errors of b against a's intervals."""
        n = nearest_index(a, b)
        d = b - a[n]
        before, after = np.maximum(n - 1, 0), np.minimum(n + 1, len(a) - 1)
        gap = np.where(d < 0, a[n] - a[before], a[after] - a[n])
        gap = np.where(gap > 0, gap, np.where(d < 0, a[after] - a[n], a[n] - a[before]))
        e = np.mod(d / gap + 0.5, 1.0) - 0.5
        edges = np.concatenate([[-0.5], np.linspace(-0.5 + 0.5 / (bins - 1), 0.5 - 0.5 / (bins - 1), bins - 1), [0.5]])
        h = np.histogram(e, edges)[0].astype(float)
        h[0] += h[-1]
        p = h[:-1] / h[:-1].sum()
        p = p[p > 0]
        return float(-(p * np.log2(p)).sum())

    top = np.log2(bins - 1)
    return float((top - max(entropy(reference, estimate), entropy(estimate, reference))) / top)


def all_metrics(reference: np.ndarray, estimate: np.ndarray) -> dict[str, float]:
    c, best = cemgil(reference, estimate)
    cmlc, cmlt, amlc, amlt = continuity(reference, estimate)
    return {
        "F-measure": f_measure(reference, estimate),
        "Cemgil": c,
        "Cemgil Best Metric Level": best,
        "Goto": goto(reference, estimate),
        "P-score": p_score(reference, estimate),
        "Correct Metric Level Continuous": cmlc,
        "Correct Metric Level Total": cmlt,
        "Any Metric Level Continuous": amlc,
        "Any Metric Level Total": amlt,
        "Information gain": information_gain(reference, estimate),
    }
