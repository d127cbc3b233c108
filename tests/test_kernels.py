"""Kernels against literal brute force on generated inputs."""

import itertools

import numpy as np
import pytest

from cadentia.kernels import cascade, matching, signal
from cadentia.operators.timing import clean_array


def brute_match(a, b, tol):
    best = 0
    for k in range(min(len(a), len(b)), 0, -1):
        for s in itertools.combinations(range(len(a)), k):
            for t in itertools.combinations(range(len(b)), k):
                if all(abs(a[i] - b[j]) <= tol for i, j in zip(s, t)):
                    return k
    return best


def test_matchings_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.sort(rng.integers(0, 30, rng.integers(0, 5)) / 10.0) for _ in range(2))
        m = matching.maximum_match(a, b, 0.3)
        assert m == brute_match(a, b, 0.3)
        g = matching.greedy_match(a, b, 0.3)
        assert len(g) <= m and len({i for i, _ in g}) == len(g) == len({j for _, j in g})


def test_greedy_takes_the_closest_pair_first():
    assert matching.greedy_match(np.array([0.0, 0.10]), np.array([0.09]), 0.2) == [(1, 0)]


def test_identical_beats_score_full():
    t = np.arange(5, 25, 0.5)
    m = matching.all_metrics(t, t)
    for k in ("F-measure", "Cemgil", "Goto", "P-score", "Correct Metric Level Continuous", "Correct Metric Level Total", "Any Metric Level Continuous"):
        assert m[k] == pytest.approx(1.0), k
    assert m["Information gain"] > 0.99


def test_double_time_is_right_at_another_level():
    t = np.arange(5, 25, 0.5)
    double = np.arange(5, 24.6, 0.25)
    c = matching.continuity(t, double)
    assert c[1] < 0.6 and c[3] > 0.9
    assert matching.all_metrics(t, np.array([]))["F-measure"] == 0.0


def test_peaks_against_literal_rules():
    rng = np.random.default_rng(2)
    for _ in range(50):
        y = rng.integers(0, 6, 40).astype(float)
        found = signal.local_peaks(y)
        want = []
        i = 1
        while i < len(y) - 1:
            j = i
            while j < len(y) - 1 and y[j + 1] == y[i]:
                j += 1
            if j < len(y) - 1 and y[i - 1] < y[i] > y[j + 1]:
                want.append((i + j) // 2)
            i = j + 1
        assert found.tolist() == want
        if len(found):
            keep = found[signal.apart(found, y[found], 5)]
            assert all(abs(p - q) >= 5 for p, q in itertools.combinations(keep, 2))
            for p, v in zip(found, signal.prominence(y, found)):
                lo = p
                while lo > 0 and y[lo - 1] <= y[p]:
                    lo -= 1
                hi = p
                while hi < len(y) - 1 and y[hi + 1] <= y[p]:
                    hi += 1
                assert v == y[p] - max(y[lo : p + 1].min(), y[p : hi + 1].min())


@pytest.mark.parametrize("period,phase", [(0.5, 0.1), (0.62, 0.3), (0.41, 0.0)])
def test_cascade_recovers_planted_grid(period, phase):
    rng = np.random.default_rng(3)
    beats = np.arange(phase, 30, period)
    f = cascade.cascade(np.sort(beats + rng.normal(0, 0.008, len(beats))))
    assert f.period == pytest.approx(period, rel=0.02)
    assert matching.f_measure(beats, f.beats, 0.07) > 0.95
    assert (f.beats >= 0).all() and (f.beats <= 30).all()


def test_cascade_with_few_peaks():
    for n in range(3):
        assert cascade.cascade(np.arange(n) / 2.0).path == ["FAIL:no_std_result"]


def test_cleaning_keeps_ends_and_settles():
    t = np.concatenate([np.arange(0, 10_000_000, 500_000), [10_900_000, 11_400_000, 11_900_000]])
    assert len(clean_array(t)) == len(t)  # no spread: nothing is judged
    t = t + np.random.default_rng(4).integers(-9000, 9000, len(t))
    c = clean_array(t)
    assert c[0] == t[0] and c[-1] == t[-1] and len(c) < len(t)
    assert (clean_array(np.array([1, 2, 3])) == [1, 2, 3]).all()


def test_peak_widths():
    """Triangles: half the height is met half way down, and an edge ends a flank."""
    y = np.concatenate([np.arange(0, 10), np.arange(10, -1, -1), np.arange(1, 4), np.arange(4, -1, -1)]).astype(float)
    p = signal.local_peaks(y)
    assert p.tolist() == [10, 24]
    assert signal.widths(y, p, signal.prominence(y, p)).tolist() == [10.0, 4.0]
    assert signal.widths(np.array([4.0, 5.0, 0.0, 0.0]), np.array([1]), np.array([5.0])).tolist() == [1.5]
    assert signal.pick_peaks(y, 1, 0.1, 5.0).tolist() == [10] and signal.pick_peaks(y, 1, 0.1).tolist() == [10, 24]
