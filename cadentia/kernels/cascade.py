"""A near-isochronous grid for one group's peaks, by a deterministic cascade.

All (period, phase) grids of the search are scored as arrays: the density at
grid points by interpolation, the peaks' distances by rounding to the nearest
grid index.  Ties go to the first period, then the first phase.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

Density = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Params:
    """Limits of the search and of the decisions (fixed values)."""

    start: float = 0.0
    stop: float = 30.0
    ioi_min: float = 0.28
    ioi_max: float = 1.25
    periods: int = 120
    phases: int = 240
    width: float = 0.08
    step: float = 0.005
    peak_weight: float = 0.5
    refine_share: float = 0.15
    snap_reach: float = 0.12
    snap_share: float = 0.45
    high_cv: float = 0.15
    balanced_cv: float = 0.06
    bimodal: float = 0.10
    split_share: float = 0.8
    least_group: int = 4
    extension_share: float = 0.95
    region_beats: int = 6
    region_cv: float = 0.15
    steady_cv: float = 0.03
    fit_error: float = 0.035
    coverage_share: float = 0.75


@dataclass
class Fit:
    beats: np.ndarray
    period: float
    phase: float = float("nan")
    label: str = "std"
    path: list[str] = field(default_factory=list)
    scores: dict[str, float] = field(default_factory=dict)


def inside(x: np.ndarray, p: Params) -> np.ndarray:
    return x[(x >= p.start) & (x <= p.stop)]


def curve(peaks: np.ndarray, p: Params) -> Density:
    """Sum of Gaussians over the peaks, scaled to 1."""
    at = np.arange(int(round((p.stop - p.start) / p.step)) + 1) * p.step + p.start
    y = np.exp(-0.5 * ((at[:, None] - peaks[None, :]) / p.width) ** 2).sum(axis=1)
    return at, y / (y.max() + 1e-12)


def density_at(x: np.ndarray, density: Density) -> np.ndarray:
    return np.interp(x, *density, left=0.0, right=0.0)


def index_range(period: float, phases: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """First and last k with phase + k * period within the window."""
    lo, hi = np.ceil((p.start - phases) / period), np.floor((p.stop - phases) / period)
    return lo + (phases + lo * period < p.start), hi - (phases + hi * period > p.stop)


def grid(period: float, phase: float, p: Params) -> np.ndarray:
    lo, hi = index_range(period, np.array([phase]), p)
    return phase + np.arange(lo[0], hi[0] + 1) * period


def middle_interval(beats: np.ndarray) -> float:
    return float(np.median(np.diff(beats))) if len(beats) > 1 else float("nan")


def cv(beats: np.ndarray) -> float:
    d = np.diff(beats)
    return float(d.std() / (d.mean() + 1e-12)) if len(d) else float("nan")


def coverage(beats: np.ndarray, peaks: np.ndarray, tolerance: float) -> float:
    """Share of the peaks with a beat within the tolerance; beats ascend."""
    if not len(beats) or not len(peaks):
        return 0.0
    k = np.clip(np.searchsorted(beats, peaks), 1, max(1, len(beats) - 1))
    d = np.minimum(np.abs(peaks - beats[k - 1]), np.abs(peaks - beats[np.minimum(k, len(beats) - 1)]))
    return float((d <= tolerance).mean())


def phase_scores(period: float, phases: np.ndarray, peaks: np.ndarray, density: Density, p: Params) -> np.ndarray:
    """Mean density on the grid and half the share of peaks near it, for many phases of one period; -1 below two points."""
    lo, hi = index_range(period, phases, p)
    count = hi - lo + 1
    k = lo[:, None] + np.arange(int(count.max(initial=1)))[None, :]
    points = phases[:, None] + k * period
    d = (density_at(points, density) * (k <= hi[:, None])).sum(axis=1) / np.maximum(count, 1)
    at = np.clip(np.rint((peaks[None, :] - phases[:, None]) / period), lo[:, None], hi[:, None])
    near = np.abs(peaks[None, :] - (phases[:, None] + at * period)) <= 0.12 * period + 0.02
    return np.where(count >= 2, d + p.peak_weight * near.mean(axis=1), -1.0)


def line_through(k: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of t over k."""
    slope, base = np.linalg.lstsq(np.stack([k, np.ones(len(k))], axis=1), t, rcond=None)[0]
    return float(slope), float(base)


def least_squares(peaks: np.ndarray, period: float, phase: float, share: float, rounds: int = 3) -> tuple[float, float]:
    """Period and phase refitted to the peaks within ``share`` of a period of the grid."""
    for _ in range(rounds):
        k = np.rint((peaks - phase) / period)
        use = np.abs(peaks - (phase + k * period)) <= share * period
        if use.sum() < 3:
            break
        period, phase = line_through(k[use], peaks[use])
        if period < 0.1:
            break
    return period, phase


def search(peaks: np.ndarray, density: Density, p: Params) -> tuple[float, float]:
    """Period and phase of the best grid, refitted, with the best of 80 phases around."""
    best, period, phase = -1.0, float(np.median(np.diff(peaks))), p.start
    for t in np.linspace(p.ioi_min, p.ioi_max, p.periods):
        phases = p.start + np.arange(p.phases) * (t / p.phases)
        s = phase_scores(t, phases, peaks, density, p)
        i = int(np.argmax(s))
        if s[i] > best:
            best, period, phase = float(s[i]), float(t), float(phases[i])
    new = least_squares(peaks, period, phase, p.refine_share)
    if p.ioi_min <= new[0] <= p.ioi_max:
        period, phase = new
    fine = phase + np.linspace(-0.1 * period, 0.1 * period, 80)
    fine = fine[(fine >= p.start) & (fine < p.start + period)]
    return period, float(fine[np.argmax(phase_scores(period, fine, peaks, density, p))]) if len(fine) else phase


def snapped(beats: np.ndarray, peaks: np.ndarray, period: float, p: Params) -> np.ndarray:
    """Beats moved part of the way to a near peak; a beat whose interval before it is then odd goes back."""
    near = peaks[np.abs(beats[:, None] - peaks[None, :]).argmin(axis=1)]
    moved = np.where(np.abs(near - beats) <= p.snap_reach * period, beats + p.snap_share * (near - beats), beats)
    d = np.diff(moved)
    mid = np.median(d)
    odd = np.abs(d - mid) / (mid + 1e-9) > 2 * p.snap_reach
    return np.sort(np.where(np.concatenate([[False], odd]), beats, moved))


def without_doublets(f: Fit, density: Density) -> Fit:
    """Of neighbours closer than 0.6 of the median interval the one in lower density goes; what is left is smoothed."""
    beats = f.beats
    if len(beats) < 3:
        return f
    close, weight = np.diff(beats) < 0.60 * middle_interval(beats), density_at(beats, density)
    out = np.zeros(len(beats), bool)
    for i in np.flatnonzero(close):
        if not out[i]:
            out[i + 1 if weight[i] >= weight[i + 1] else i] = True
    if not out.any():
        return f
    beats = beats[~out]
    for _ in range(5 if len(beats) >= 3 else 0):
        new = beats.copy()
        for j in range(1, len(new) - 1):  # each step sees the one before it
            new[j] = 0.7 * new[j] + 0.15 * (new[j - 1] + new[j + 1])
        if np.abs(new - beats).max() < 1e-4:
            break
        beats = np.sort(new)
    return replace(f, beats=beats, period=middle_interval(beats) if len(beats) > 1 else f.period)


def to_edges(beats: np.ndarray, period: float, p: Params) -> np.ndarray:
    """More beats, a period apart, up to both ends of the window."""
    n_before, n_after = (max(0, int(x / period) + 1) for x in (beats[0] - p.start, p.stop - beats[-1]))
    before, after = beats[0] - period * np.arange(n_before, 0, -1), beats[-1] + period * np.arange(1, n_after + 1)
    return np.concatenate([before[before >= p.start], beats, after[after <= p.stop]])


def filled(f: Fit, p: Params) -> Fit:
    """Beats put evenly into gaps of over 1.4 median intervals, if they stay 0.75 of one apart; then up to the edges."""
    beats = f.beats
    if len(beats) < 3:
        return f
    gap, period = np.diff(beats), middle_interval(beats)
    n = np.maximum(1, np.rint(gap / period) - 1)
    n = np.where((gap > 1.4 * period) & (gap / (n + 1) >= 0.75 * period), n, 0).astype(int)
    own = np.repeat(np.arange(len(gap)), n)
    place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + 1
    new = to_edges(np.sort(np.concatenate([beats, beats[own] + place * (gap / (n + 1))[own]])), period, p)
    return f if len(new) == len(beats) else replace(f, beats=new, period=middle_interval(new))


def equalised(beats: np.ndarray, density: Density, p: Params) -> np.ndarray:
    """Inner beats drawn towards the middle of their neighbours, less where the density is high."""
    if len(beats) < 3:
        return beats
    weight = density_at(beats, density)
    pull = 0.3 * (1.0 - 0.5 * np.clip(weight / (weight.max() + 1e-12), 0, 1))[1:-1]
    for _ in range(10):
        new = beats.copy()
        new[1:-1] += pull * ((beats[:-2] + beats[2:]) / 2 - beats[1:-1])
        new = np.sort(np.clip(new, p.start, p.stop))
        if np.abs(new - beats).max() < 1e-4:
            break
        beats = new
    return beats


def subdivided(f: Fit, peaks: np.ndarray, density: Density, p: Params) -> Fit:
    """Twice the beats, equalised, where most midpoints carry peaks and density of their own."""
    beats = f.beats
    if len(beats) < 4 or len(peaks) < 4:
        return f
    period, mid = middle_interval(beats), (beats[:-1] + beats[1:]) / 2
    if period / 2 < p.ioi_min:
        return f
    hits = (np.abs(mid[:, None] - peaks[None, :]).min(axis=1) <= 0.18 * period).mean()
    ratio = density_at(mid, density).mean() / (density_at(beats, density).mean() + 1e-12)
    if not (hits > 0.55 and ratio > 0.40):
        return f
    new = to_edges(np.sort(np.concatenate([beats, mid])), period / 2, p)
    return replace(f, beats=equalised(new, density, p), period=period / 2)


def fit(peaks: np.ndarray, p: Params) -> Fit | None:
    """Search, snap, and repair: doublets, half time, doublets, gaps.  None below three peaks or beats."""
    peaks = inside(peaks, p)
    if len(peaks) < 3:
        return None
    density, peaks = curve(peaks, p), np.unique(peaks)
    if len(peaks) < 3:
        return None
    period, phase = search(peaks, density, p)
    beats = grid(period, phase, p)
    if len(beats) < 3:
        return Fit(peaks, period, phase)
    f = Fit(snapped(beats, peaks, period, p), period, phase)
    f = without_doublets(f, density)
    f = without_doublets(subdivided(f, peaks, density, p), density)
    f = filled(f, p)
    return f if len(f.beats) >= 3 else None


def candidate_score(f: Fit | None, peaks: np.ndarray, density: Density, p: Params) -> float:
    """2 C + max(0, 1 - CV) + D / 2 within the window."""
    beats = inside(np.sort(f.beats), p) if f else np.empty(0)
    if len(beats) < 3:
        return -1e6
    return 2 * coverage(beats, peaks, 0.12 * f.period + 0.03) + max(0.0, 1 - cv(beats)) + 0.5 * float(density_at(beats, density).mean())


def largest_jump(peaks: np.ndarray, period: float) -> tuple[float, float]:
    """Largest gap between sorted intervals under 0.9 T over T, and its midpoint; 0 below eight peaks or three such intervals."""
    d = np.diff(peaks)
    d = np.sort(d[d < 0.9 * period])
    if len(peaks) < 8 or len(d) < 3 or not period > 0:
        return 0.0, float("nan")
    gap = np.diff(d)
    i = int(np.argmax(gap))
    return float(gap[i]) / period, 0.5 * float(d[i] + d[i + 1])


def phase_split(peaks: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """In each run of short intervals every other one, from the first, ends in the second group."""
    short = np.diff(peaks) <= threshold
    at = np.arange(len(short))
    since = at - np.maximum.accumulate(np.where(short, -1, at)) - 1  # place in the run of short ones
    second = np.zeros(len(peaks), bool)
    second[1:] = short & (since % 2 == 0)
    return peaks[~second], peaks[second]


def steady_region(beats: np.ndarray, p: Params) -> tuple[int, int, float] | None:
    """First and last beat of the run with the highest n * exp(-cv / 0.05) among those steady enough, and its variation."""
    d = np.diff(beats)
    best, out = -1.0, None
    for n in range(p.region_beats, len(beats) + 1):
        w = np.lib.stride_tricks.sliding_window_view(d, n - 1)
        v = w.std(axis=1) / (w.mean(axis=1) + 1e-12)
        s = np.where(v <= p.region_cv, n * np.exp(-v / 0.05), -1.0)
        i = int(np.argmax(s))
        if s[i] > best:
            best, out = float(s[i]), (i, i + n - 1, float(v[i]))
    return out


def region_grid(region: np.ndarray, p: Params, shortest: float = 0.25, longest: float = 1.5) -> tuple[float, float, np.ndarray] | None:
    """Period, phase and whole-window grid fitted to a steady run."""
    period, phase = middle_interval(region), float(region[0])
    if len(region) < 4 or not shortest <= period <= longest:
        return None
    for _ in range(5):
        k = np.rint((region - phase) / period)
        if len(np.unique(k)) < 0.8 * len(k):
            break
        new = line_through(k, region)
        if not shortest <= new[0] <= longest:
            break
        settled = abs(new[0] - period) < 1e-6 and abs(new[1] - phase) < 1e-6
        period, phase = new
        if settled:
            break
    beats = grid(period, phase, p)
    return (period, phase, beats) if len(beats) >= 3 else None


def extension(f: Fit, peaks: np.ndarray, p: Params) -> tuple[Fit | None, str]:
    """A strict grid fitted on the steadiest run and laid over the window, or the gate that stopped it (names are fixed values)."""
    beats = np.sort(f.beats)
    if len(beats) < p.region_beats:
        return None, "insufficient_beats"
    overall = cv(beats)
    if overall <= p.steady_cv:
        return None, "already_isochronous"
    region = steady_region(beats, p)
    if region is None:
        return None, "no_confident_region"
    i, j, v = region
    if v >= overall * (0.75 if overall <= 0.10 else 0.85):
        return None, "region_not_meaningfully_better"
    run = beats[i : j + 1]
    strict = region_grid(run, p)
    if strict is None:
        return None, "fit_failed"
    period, phase, new = strict
    off = run - (phase + np.rint((run - phase) / period) * period)
    if float(np.sqrt(np.mean(off**2))) > p.fit_error:
        return None, "fit_quality_too_low"
    tolerance = 0.12 * period + 0.030
    if len(peaks) and coverage(new, peaks, tolerance) < p.coverage_share * coverage(beats, peaks, tolerance):
        return None, "grid_coverage_too_low"
    return replace(f, beats=new, period=period, phase=phase), "activated"


def cascade(peaks: np.ndarray, p: Params = Params()) -> Fit:
    """Standard fit; one phase group where it is bimodal or uneven and scores better; a strict grid where that scores nearly as well.

    The refit for uneven grids repeats the same search, as its weights play no
    part in a grid search: it stands in the path only.  The names in the path
    and among the scores are fixed values.
    """
    peaks = np.sort(peaks)
    best = fit(peaks, p)
    if best is None:
        return Fit(np.empty(0), float("nan"), path=["FAIL:no_std_result"])
    near = inside(peaks, p)
    density = curve(near, p)
    score = lambda f: candidate_score(f, near, density, p)
    path, scores, uneven = [], {}, cv(best.beats) > p.high_cv
    jump, threshold = largest_jump(peaks, middle_interval(best.beats))
    if jump >= p.bimodal or uneven:
        path.append("bimodal" if jump >= p.bimodal else "bimodal_fallback")
        groups = phase_split(peaks, threshold) if np.isfinite(threshold) and jump >= p.split_share * p.bimodal else ()
        if groups and min(map(len, groups)) >= p.least_group:
            found = {"monoA": fit(groups[0], p), "monoB": fit(groups[1], p)}
            scores = {k: score(f) for k, f in found.items() if f} | {"std": score(best)}
            top = max((k for k in found if found[k]), key=scores.__getitem__, default=None)
            if top and scores[top] > scores["std"]:
                best = replace(found[top], label=top)
                path.append(f"chose_{top}")
            else:
                path.append("bimodal_no_improvement")
    if cv(best.beats) > p.balanced_cv:
        path.append("high_cv_balanced_lambdas")
        scores["balanced"] = scores.get("std", score(best))
    strict, why = extension(best, near, p)
    if strict is None:
        path.append(f"GE_not_activated:{why}")
    else:
        scores |= {"pre_ge": score(best), "post_ge": score(strict)}
        accepted = scores["post_ge"] >= p.extension_share * scores["pre_ge"]
        path.append("GE_applied" if accepted else "GE_rejected_worse")
        if accepted:
            best = replace(strict, label=best.label + "+GE")
    return replace(best, beats=np.sort(best.beats), path=path, scores=scores)
