"""Densities and peaks of one group."""

from __future__ import annotations

import numpy as np

from .matching import greedy_match


def gaussian_density(events: np.ndarray, grid: np.ndarray, width: float) -> np.ndarray:
    """Sum of unit Gaussians (density) of the events on the grid."""
    if not len(events):
        return np.zeros(len(grid))
    z = (grid[:, None] - events[None, :]) / width
    return np.exp(-0.5 * z * z).sum(axis=1) / (width * np.sqrt(2 * np.pi))


def participant_density(seconds: np.ndarray, who: np.ndarray, weight: np.ndarray, n_bins: int = 6000, step: float = 0.005, sigma_bins: float = 16.0) -> np.ndarray:
    """Weighted mean over participants of their normalised histograms, under a Gaussian cut at four sigmas; nothing beyond the ends.

    who: participant number of each tap.  Participants without a tap in range count for nothing.
    """
    at = np.floor(seconds / step + 1e-9).astype(int)
    at = np.where(np.isclose(seconds, n_bins * step), n_bins - 1, at)  # the last bin is closed
    use = (at >= 0) & (at < n_bins)
    at, who = at[use], who[use]
    own = np.bincount(who, minlength=len(weight))
    total = weight[own > 0].sum()
    h = np.bincount(at, (weight / np.maximum(own, 1))[who], n_bins) / total if total else np.zeros(n_bins)
    r = int(4 * sigma_bins + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma_bins) ** 2)
    return np.convolve(h, k / k.sum(), mode="same")


def compared(reference: np.ndarray, estimate: np.ndarray, start: float, stop: float, step: float = 0.005, tolerance: float = 0.07) -> tuple[float, float, float]:
    """Correlation of two densities within a window, F of their peaks there, and the median distance of matched ones in ms."""
    t = (np.arange(len(reference)) + 0.5) * step
    inside = (t >= start) & (t <= stop)
    a, b = reference[inside], estimate[inside]
    r = float(np.corrcoef(a, b)[0, 1]) if a.std() > 0 and b.std() > 0 else float("nan")
    p, q = (x[(x >= start) & (x <= stop)] for x in (t[pick_peaks(y)] for y in (reference, estimate)))
    off = [abs(float(q[j] - p[i])) for i, j in greedy_match(p, q, tolerance)]
    f = 2 * len(off) / (len(p) + len(q)) if off else 0.0
    return r, f, float(np.median(off)) * 1000 if off else float("nan")


def local_peaks(y: np.ndarray) -> np.ndarray:
    """Indices of maxima; a plateau counts at its middle, and the ends never."""
    if len(y) < 3:
        return np.empty(0, int)
    start = np.concatenate([[0], np.nonzero(np.diff(y))[0] + 1])
    stop = np.concatenate([start[1:], [len(y)]]) - 1
    v = y[start]
    top = np.zeros(len(v), bool)
    top[1:-1] = (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])
    return (start[top] + stop[top]) // 2


def apart(peaks: np.ndarray, height: np.ndarray, distance: float) -> np.ndarray:
    """Keep the highest peaks so that no two are closer than ``distance``; of equals the later goes first."""
    keep = np.ones(len(peaks), bool)
    for i in np.argsort(height, kind="stable")[::-1]:
        if keep[i]:
            keep[(np.abs(peaks - peaks[i]) < distance) & (np.arange(len(peaks)) != i)] = False
    return keep


def prominence(y: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height over the higher of the two lowest points on the way to higher ground."""
    out = np.empty(len(peaks))
    for j, p in enumerate(peaks):
        higher = np.nonzero(y > y[p])[0]
        lo = higher[higher < p].max(initial=-1) + 1
        hi = higher[higher > p].min(initial=len(y))
        out[j] = y[p] - max(y[lo : p + 1].min(), y[p:hi].min())
    return out


def widths(y: np.ndarray, peaks: np.ndarray, prominences: np.ndarray) -> np.ndarray:
    """Samples between the points, interpolated, at which a peak's flanks fall to half its prominence; an end of the curve ends a flank."""
    out = np.empty(len(peaks))
    for j, (p, height) in enumerate(zip(peaks, y[peaks] - prominences / 2, strict=True)):
        below = np.nonzero(y <= height)[0]
        i, k = below[below < p].max(initial=-1), below[below > p].min(initial=len(y))
        left = i + (height - y[i]) / (y[i + 1] - y[i]) if i >= 0 else 0.0
        right = k - (height - y[k]) / (y[k - 1] - y[k]) if k < len(y) else len(y) - 1.0
        out[j] = right - left
    return out


def pick_peaks(y: np.ndarray, distance: int = 30, least_prominence: float = 0.10, least_width: float = 0.0) -> np.ndarray:
    """Peaks of a curve scaled to 1: apart by ``distance`` samples, then prominent, then ``least_width`` samples wide at half their prominence."""
    if len(y) < 4 or not y.max() > 0:
        return np.empty(0, int)
    y = y / y.max()
    p = local_peaks(y)
    p = p[apart(p, y[p], distance)]
    own = prominence(y, p)
    p, own = p[own >= least_prominence], own[own >= least_prominence]
    return p[widths(y, p, own) >= least_width] if least_width > 0 else p
