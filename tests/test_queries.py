"""Every registered query of the reference's operators against its SQL in DuckDB, and edge cases of expressions."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from cadentia.functions import expressions as X
from cadentia.operators import timing as T
from cadentia.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.load()
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(frame):
    out = []
    for r in frame.itertuples(index=False, name=None):
        out.append(tuple("" if v is None or v != v or str(v) == "<NA>" else f"{float(v):.9g}" if isinstance(v, float) else str(v) for v in r))
    return sorted(out)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in [*TABLES, "documents", "pages", "labels"]:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = db.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got[columns]) == rows(want[columns])


def test_cleaning_forms_agree(spark):
    from cadentia.plans.mapping import taps

    t = taps(spark, SF).select("stem_id", "participant", "tap_us")
    a = {tuple(r) for r in T.cleaned(t).collect()}
    b = {tuple(r) for r in T.cleaned_fast(t).collect()}
    assert a == b and a


def test_flags_and_filters(spark):
    d = spark.createDataFrame([(None,), ("",), (" FALSE ",), ("1.0",), ("nan",), ("True",), ("x",)], "f string")
    got = [(r.a, r.b) for r in d.select(X.is_falsey(F.col("f")).alias("a"), X.is_truthy(F.col("f")).alias("b")).collect()]
    assert got == [(True, False), (True, False), (True, False), (False, True), (True, False), (False, True), (False, False)]
    with pytest.raises(ValueError):
        X.row_filter("pos<3", F.col("f"))
    v = spark.createDataFrame([("[1, \"2.5\", null, \"x\", NaN]",), (None,), ("oops",)], "s string").select(X.number_list(F.col("s")).alias("v")).collect()
    assert v[1].v == [] and v[2].v == []


def test_rounding_and_wrap(spark):
    r = spark.range(1).select(X.half_even(F.lit(2.5), 0).alias("a"), X.wrap_cycles(F.lit(0.5)).alias("b"), X.wrap_cycles(F.lit(-0.75)).alias("c")).first()
    assert r.a == 2.0 and r.b == -0.5 and math.isclose(r.c, 0.25)


def test_resampling_is_the_whole_job(spark, monkeypatch):
    """Seven participants in 500 draws, null where there are fewer; 9,999 permutations; 2,000 draws."""
    from cadentia.plans import panel_queries as Q

    full = [("a", 1, u, 1_000_000 * s + 37_000 * u * (s % 3)) for u in range(7) for s in range(20)]
    few = [("a", 2, u, 500_000 * s) for u in range(6) for s in range(9)] + [("a", 2, 6, 5)]  # the seventh has one tap
    more = [("b", 1, u, 1_000_000 * s + 90_000 * (u % 4)) for u in range(12) for s in range(30)]
    taps = spark.createDataFrame([*full, *few, *more], "stem_id string, panel int, participant long, tap_us long").cache()
    monkeypatch.setattr(Q, "taps", lambda spark, sf_dir: taps)
    got = {(r.stem_id, r.panel): (r.istc, r.draws) for r in Q.subsample_istc(spark, "").collect()}
    whole = T.coherence(taps.where("stem_id = 'a' and panel = 1")).first().istc
    assert got["a", 1] == (pytest.approx(whole), 500) and got["a", 2] == (None, 0)
    all_of_b = T.coherence(taps.where("stem_id = 'b'")).first().istc
    assert got["b", 1][1] == 500 and 2 < got["b", 1][0] < all_of_b and len(got) == 3
    monkeypatch.undo()
    assert Q.permutation_p(spark, SF).first().permutations == 9_999
    assert all(1_990 <= r.draws <= 2_000 for r in Q.bootstrap_ci(spark, SF).collect())  # ten rows: a draw is empty with a chance of 1 in 22,000


def test_bootstrap_of_a_small_group(spark):
    """Draws without a row have no mean, and are no error."""
    from cadentia.operators import grouped

    r = grouped.bootstrap_mean(spark.createDataFrame([("a", 3.0)], "k string, v double"), ["k"], "v", 200, 1).first()
    assert r.lo == r.hi == 3.0 and 80 < r.draws < 200


def test_nudges_and_curves_by_hand(spark):
    import statistics

    from cadentia.operators import grid as G

    sets = {"even": [0, 520, 1000, 1510, 2000], "short": [0, 500, 900], "close": [0, 500, 600, 1000, 1500, 2000], "late": [29_000_000, 29_510_000, 29_980_000, 30_500_000]}
    beats = spark.createDataFrame([(s, x if s == "late" else x * 1000) for s, v in sets.items() for x in v], "stem_id string, beat_us long")
    got = {}
    for r in G.nudged(beats).orderBy("stem_id", "i").collect():
        got.setdefault(r.stem_id, []).append((r.nudged_us, r.cv))
    for s, v in sets.items():
        x = [float(y if s == "late" else y * 1000) for y in v]
        gaps = [b - a for a, b in zip(x, x[1:], strict=False)]
        period = statistics.median(gaps)
        new = sorted(min(30e6, max(0.0, y if k in (0, len(x) - 1) else y + max(-0.05 * period, min(0.05 * period, (x[k - 1] + x[k + 1]) / 2 - y)))) for k, y in enumerate(x))
        after = [b - a for a, b in zip(new, new[1:], strict=False)]
        ok = len(x) >= 4 and min(after) >= 0.5 * period
        assert [y for y, _ in got[s]] == pytest.approx(new if ok else x)
        assert all(cv == pytest.approx(statistics.pstdev(after) / statistics.mean(after)) if ok else cv is None for _, cv in got[s])
    assert got["close"][0][1] is None and got["even"][0][1] is not None

    curve = spark.createDataFrame([("a", g, float(y)) for g, y in enumerate([0, 4, 2])] + [("z", 0, 0.0)], "stem_id string, g long, y double")
    points = spark.createDataFrame([("a", t) for t in (-5, 0, 5, 10, 15, 20, 21, 99)] + [("z", 0), ("none", 3)], "stem_id string, t_us long")
    value = {(r.stem_id, r.t_us): r.y for r in G.interpolated(points, curve, 10).collect()}
    want = {-5: 0, 0: 0, 5: 0.5, 10: 1, 15: 0.75, 20: 0.5, 21: 0, 99: 0}
    assert value == pytest.approx({("a", t): y for t, y in want.items()} | {("z", 0): 0, ("none", 3): 0})

    one = spark.createDataFrame([("a", 0, 0.0, 1.0, None), ("b", 0, 10.0, 0.5, 1_000_000), ("b", 500_000, 400_000.0, 1.0, 0)], "stem_id string, t_us long, target_us double, density double, off_us long")
    cost = {r.stem_id: r.cost for r in G.placement_cost(one, (1.0, 2.0, 3.0)).collect()}
    assert cost == pytest.approx({"a": 1e6, "b": 0.01 - 1.5 + 1.5})


def test_pseudonyms_of_many_and_of_none(spark, tmp_path):
    """More ids than four digits tell, and an event of nobody, against the SQL."""
    spark.range(10_050).selectExpr("if(id = 7, null, id * 3) as user_id").write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in QUERIES["pseudonym_keys"](spark, str(tmp_path)).select("participant", "pseudonym").collect()}
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = set(con.sql(ORACLES["pseudonym_keys"]).project("participant, pseudonym").fetchall())
    assert got == want and len(got) == 10_050
