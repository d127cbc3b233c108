"""Permutation tests against plain loops over the same labels."""

import math
import statistics

import numpy as np
import pytest

from cadentia.operators import permutation as P


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (3, 2), (10, 0, 7), (40, 60, 23)])
def test_labels_are_permutations(sizes, monkeypatch):
    n = sum(sizes)
    lab = P.Labels(sizes, 7)
    moved = lab.moved(np.arange(n), np.arange(200))
    assert (moved[:, 0] == np.arange(n)).all()
    assert (np.sort(moved, axis=0) == np.arange(n)[:, None]).all()
    counts = np.stack([np.bincount(c, minlength=len(sizes)) for c in lab.of(np.arange(n), np.arange(50)).T])
    assert (counts == np.array(sizes)).all()
    own = lab.of(np.arange(n), np.arange(50))
    monkeypatch.setattr(P, "TABLE", 0)
    assert (lab.of(np.arange(n), np.arange(50)) == own).all()


def test_labels_are_even():
    """Every place goes everywhere, and neighbours part."""
    moved = P.Labels((5, 6), 3).moved(np.arange(11), np.arange(1, 20_001))
    counts = np.stack([np.bincount(r, minlength=11) for r in moved])
    assert abs(counts / 20_000 - 1 / 11).max() < 0.008
    pairs = np.bincount(moved[0] * 11 + moved[1], minlength=121).reshape(11, 11)
    assert pairs.diagonal().sum() == 0 and abs(pairs[~np.eye(11, dtype=bool)] / 20_000 - 1 / 110).max() < 0.003


def between(vectors, labels):
    names = sorted(set(labels))
    grand = np.mean(vectors, axis=0)
    return sum(sum(x == c for x in labels) * float(((np.mean([v for v, x in zip(vectors, labels, strict=True) if x == c], axis=0) - grand) ** 2).sum()) for c in names)


def test_one_way_and_pairs(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 30)
    rng = np.random.default_rng(0)
    rows = [(i, "abc"[i % 3], float(rng.normal(i % 3 == 0, 1)), float(rng.normal())) for i in range(40)]
    v = spark.createDataFrame(rows, "participant long, panel string, x double, y double").repartition(3)
    units, names, sizes = P.placed(v, "participant", "panel")
    place = {r.participant: r.place for r in units.collect()}
    assert names == ["a", "b", "c"] and sizes == (14, 13, 13) and sorted(place.values()) == list(range(40))
    lab = P.Labels(sizes, 5).of(np.array([place[r[0]] for r in rows]), np.arange(100))
    values = [between([r[2:] for r in rows], lab[:, d].tolist()) for d in range(100)]
    got = P.permutation_test(v, "panel", ["x", "y"], 99, 5).first()
    assert got.observed == pytest.approx(values[0]) == pytest.approx(between([r[2:] for r in rows], [r[1] for r in rows]))
    assert got.permutations == 99 and got.p == pytest.approx((sum(x >= values[0] - 1e-12 for x in values[1:]) + 1) / 100)
    got = P.pairwise_tests(v, "panel", ["x", "y"], 99, 5).collect()
    assert len(got) == 3
    ps = sorted(r.p for r in got)
    for r in got:
        mine = [x for x in rows if x[1] in (r.panel_a, r.panel_b)]
        assert (r.n_a, r.n_b) == tuple(sum(x[1] == c for x in mine) for c in (r.panel_a, r.panel_b))
        assert r.observed == pytest.approx(between([x[2:] for x in mine], [x[1] for x in mine]))
        diff = np.mean([x[2:] for x in mine if x[1] == r.panel_a], axis=0) - np.mean([x[2:] for x in mine if x[1] == r.panel_b], axis=0)
        assert (r.x_a_minus_b, r.y_a_minus_b) == (pytest.approx(diff[0]), pytest.approx(diff[1]))
        assert r.q == pytest.approx(min(1, min(p * 3 / (i + 1) for i, p in enumerate(ps) if i >= ps.index(r.p))))


def test_p_is_near_that_of_another_generator(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, float(rng.normal(0.5 * (i % 2)))) for i in range(30)]
    own = P.permutation_test(spark.createDataFrame(rows, "participant long, panel int, x double"), "panel", ["x"], 4_000, 9).first()
    x, g = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    stat = lambda g: (x[g == 1].mean() - x[g == 0].mean()) ** 2
    p = np.mean([stat(rng.permutation(g)) >= stat(g) - 1e-12 for _ in range(4_000)])
    assert own.p == pytest.approx(p, abs=0.04)


def test_no_rows(spark):
    v = spark.createDataFrame([], "participant long, panel int, x double")
    assert P.permutation_test(v, "panel", ["x"], 9, 1).count() == P.pairwise_tests(v, "panel", ["x"], 9, 1).count() == 0
    t = spark.createDataFrame([], "stem_id string, participant long, panel int, period_us double, taps_us array<long>")
    assert P.rebuilt_permutation(t, 9, 1).count() == 0


def test_other_middles():
    rng = np.random.default_rng(2)
    x = np.round(rng.uniform(1, 3, (200, 6)), 1)
    x[rng.random(x.shape) < 0.3] = np.nan
    got = P.other_middles(x)
    for row, out in zip(x, got, strict=True):
        for c in range(6):
            rest = [v for j, v in enumerate(row) if j != c and math.isfinite(v)]
            want = statistics.median(rest) if len(rest) >= 3 else math.nan
            assert out[c] == want or (math.isnan(out[c]) and math.isnan(want))


def kind(ratio):
    if not math.isfinite(ratio) or ratio <= 0:
        return 4
    return next((i for i, (a, b) in enumerate([(0.35, 0.65), (0.8, 1.25), (1.75, 2.25)]) if a <= ratio <= b), 3)


def rebuilt_by_loops(trials, panel_of):
    """Both statistics of trials (stem, who, period, taps) with the given panels."""
    stems, panels = sorted({t[0] for t in trials}), sorted(set(panel_of.values()))
    ref = {}
    for s in stems:
        med = {}
        for c in panels:
            own = [t[2] for t in trials if t[0] == s and panel_of[t[1]] == c and t[2] is not None]
            if own:
                med[c] = statistics.median(own)
        for c in panels:
            rest = [v for k, v in med.items() if k != c]
            ref[s, c] = statistics.median(rest) if len(rest) >= 3 else math.nan
    kinds = [kind(t[2] / ref[t[0], panel_of[t[1]]]) if t[2] is not None else 4 for t in trials]

    def value(items):
        """items: (stem, who, vector)."""
        mean = {s: np.mean([v for x, _, v in items if x == s], axis=0) for s in {x for x, *_ in items}}
        people = sorted({w for _, w, _ in items})
        own = [np.mean([v - mean[s] for s, w, v in items if w == p], axis=0) for p in people]
        return between(own, [panel_of[p] for p in people]) if items else 0.0

    first = value([(t[0], t[1], np.eye(5)[k]) for t, k in zip(trials, kinds, strict=True)])
    direction = lambda taps, r: sum((complex(math.cos(2 * math.pi * x / r), math.sin(2 * math.pi * x / r)) for x in taps), 0j)
    items = []
    for t, k in zip(trials, kinds, strict=True):
        s, c = t[0], panel_of[t[1]]
        if k != 1 or not t[3]:
            continue
        units = []
        for other in panels:
            pooled = [x for u in trials if u[0] == s and panel_of[u[1]] == other for x in u[3]]
            if other != c and pooled:
                z = direction(pooled, ref[s, c])
                units.append(z / abs(z))
        a = np.angle(direction(t[3], ref[s, c])) - np.angle(sum(units))
        items.append((s, t[1], np.array([math.sin(a), math.cos(a)])))
    return first, value(items)


@pytest.mark.parametrize("block,shard", [(4, 5), (2_000, 1_000)])
def test_rebuilt_statistics(spark, monkeypatch, block, shard):
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "SHARD", shard)
    rng = np.random.default_rng(4)
    trials = []
    for s in "uvw":
        for w in range(26):
            if rng.random() < 0.85:
                step = float(rng.choice([480_000, 500_000, 520_000, 250_000, 1_000_000, 700_000], p=[0.2, 0.3, 0.2, 0.1, 0.1, 0.1]))
                taps = [] if rng.random() < 0.05 else sorted(int(x) for x in rng.uniform(0, 400_000) + step * np.arange(12) + rng.normal(0, 20_000, 12))
                trials.append((s, w, None if rng.random() < 0.08 else step + float(rng.integers(-5, 5)), taps))
    trials.append(("lone", 3, None, [1, 2]))
    panel = {w: w % 5 for w in range(26)}
    df = spark.createDataFrame([(s, w, panel[w], p, t) for s, w, p, t in trials], "stem_id string, participant long, panel int, period_us double, taps_us array<long>")
    people, names, sizes = P.placed(df, "participant", "panel")
    place = {r.participant: r.place for r in people.collect()}
    labels = P.Labels(sizes, 11)
    lab = {w: labels.of(np.array([p]), np.arange(8))[0] for w, p in place.items()}
    rows = df.join(people.select("participant", "place"), "participant").join(df.groupBy("participant").agg((1.0 / P.F.count("*")).alias("weight")), "participant").withColumnRenamed("taps_us", "taps")
    refs = P.reference_periods(rows, labels, 7)
    first = {r.draw: r.statistic for r in P.metrical_statistics(rows.drop("taps"), refs, labels, 7).collect()}
    second = {r.draw: r.statistic for r in P.phase_statistics(P.phase_vectors(rows, refs, labels, 7), labels).collect()}
    assert sorted(first) == sorted(second) == list(range(8))
    for d in range(8):
        want = rebuilt_by_loops(trials, {w: int(x[d]) for w, x in lab.items()})
        assert first[d] == pytest.approx(want[0]) and second[d] == pytest.approx(want[1])


def test_rebuilt_query_sees_the_observed_values(spark):
    from cadentia.plans import panel_queries as Q

    sf = "/root/testdata/sf0.001"
    got = {r.outcome: r.observed for r in P.rebuilt_permutation(Q.trials_with_taps(spark, sf), 3, 1).collect()}
    assert got["metrical_choice"] == pytest.approx(Q.between_group_stat(spark, sf).first().statistic, abs=1e-6)
    assert got["circular_phase"] == pytest.approx(Q.phase_group_stat(spark, sf).first().statistic, abs=1e-6)


def test_pairs_take_the_vectors_once(spark):
    """What gives the vectors runs once, and their rows are dealt over the cores, however few bytes they have."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    v = spark.range(0, 60, numPartitions=1).selectExpr("id as participant", "cast(id % 4 as int) as panel", "cast(id % 7 as double) as x")
    got = P.pairwise_tests(v.mapInArrow(counted, v.schema), "panel", ["x"], 19, 3).collect()
    assert len(got) == 6 and seen.value == 60
    assert P.spread(v.withColumnRenamed("participant", "place")).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_labels_of_many_places():
    """Halves over 16 bits of hash and places over 32 bits: still one place each, and all of them used."""
    for n in (1 << 25, (1 << 32) + 7):
        lab = P.Labels((n // 3, n - n // 3), 2)
        place = np.unique(np.random.default_rng(3).integers(0, n, 20_000))
        moved = lab.moved(place, np.arange(4))
        assert (moved[:, 0] == place).all() and moved.min() >= 0 and moved.max() < n
        for column in moved[:, 1:].T:
            assert len(np.unique(column)) == len(place)
            assert abs(np.bincount(column * 16 // n, minlength=16) / len(place) - 1 / 16).max() < 0.01


@pytest.mark.parametrize("spread", [0.0, 1e-6, 0.02, 0.6])
def test_turns_are_sums_of_unit_vectors(spread):
    """Narrow and wide bands of periods, with periods that are missing, equal, and on a node; trials without taps."""
    rng = np.random.default_rng(6)
    taps = [rng.uniform(0, 3e7, n) for n in (12, 0, 1, 40)]
    periods = 700_000 * (1 + spread * rng.uniform(-1, 1, (300, 4)))
    periods[3, 1], periods[4] = np.nan, periods[5]
    t = P.Turns(periods, taps)
    assert spread == 0 or len(t.nodes) < 1_000
    periods[0, 0] = 1 / t.nodes[-1]
    t = P.Turns(periods, taps)
    x, m = t.at_nodes(taps), len(t.nodes)
    got = (x[:, :m] @ t.weights.T + 1j * (x[:, m:] @ t.weights.T)).reshape(4, 300, 4) * t.carrier
    for z, own in zip(got, taps, strict=True):
        want = np.nan_to_num(np.exp(2j * np.pi * own[:, None, None] / periods).sum(axis=0))
        assert abs(z - want).max() < 1e-11 * max(1, len(own))


def test_phases_by_parts_of_participants(spark, monkeypatch):
    """Many draws, so that sums are interpolated, in parts of few participants, give what one part gives; no row of a participant and draw is shuffled."""
    rng = np.random.default_rng(8)
    rows = [(s, w, float(500_000 + rng.integers(-9_000, 9_000)), 0.5, sorted(int(x) for x in 500_000 * np.arange(12) + rng.normal(0, 30_000, 12))) for s in "uv" for w in range(40) if (s, w) != ("v", 7)]
    t = spark.createDataFrame(rows, "stem_id string, place long, period_us double, weight double, taps array<long>")
    labels = P.Labels((10, 10, 10, 10), 3)
    refs = P.durable(P.reference_periods(t, labels, 60))
    whole = {r.draw: r.statistic for r in P.phase_statistics(P.phase_vectors(t, refs, labels, 60), labels).collect()}
    monkeypatch.setattr(P, "PEOPLE", 9)
    monkeypatch.setattr(P, "STEP", 4)
    people = P.phase_vectors(t, refs, labels, 60)
    assert "place" not in people.columns
    parts = {r.draw: r.statistic for r in P.phase_statistics(people, labels).collect()}
    assert sorted(whole) == list(range(61)) and parts == pytest.approx(whole, rel=1e-9)
    label = labels.of(np.arange(40), np.arange(61))
    for d in (0, 37, 60):
        want = rebuilt_by_loops([(s, w, p, x) for s, w, p, _, x in rows], {w: int(label[w, d]) for w in range(40)})[1]
        assert whole[d] == pytest.approx(want, rel=1e-9)
