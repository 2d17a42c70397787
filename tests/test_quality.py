import numpy as np
from pyspark.sql import functions as F

from vigil.operators import quality as Q
from vigil.operators.cumulative import quantiles_exact, running_totals


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s, n in [(1, 101), (2, 7), (3, 2), (4, 1)]:
        vals = np.round(rng.normal(50, 20, n), 1)
        vals[: n // 3] = vals[0]  # ties
        rows += [(s, float(v)) for v in vals]
    df = spark.createDataFrame(rows, "s int, v double")
    got = {r.s: (r.q_low, r.q_high) for r in Q.quantile_bounds(df, ["s"], "v").collect()}
    got2 = {r.s: (r.a, r.b) for r in quantiles_exact(df, ["s"], "v", [0.01, 0.99], ["a", "b"]).collect()}
    for s in (1, 2, 3, 4):
        v = np.array([x for k, x in rows if k == s])
        want = tuple(np.percentile(v, [1, 99]))
        assert got[s] == want and got2[s] == want


def test_trim_is_sequential_subset(spark):
    rng = np.random.default_rng(2)
    rows = [(1, i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (300, 2)))]
    df = spark.createDataFrame(rows, "s int, i int, a double, b double")
    out = Q.trim_sequential(df, ["s"], ["a", "b"])
    kept = {r.i for r in out.collect()}
    a = np.array([r[2] for r in rows])
    lo, hi = np.percentile(a, [1, 99])
    step1 = [r for r in rows if lo <= r[2] <= hi]
    b = np.array([r[3] for r in step1])
    lo2, hi2 = np.percentile(b, [1, 99])
    assert kept == {r[1] for r in step1 if lo2 <= r[3] <= hi2}


def test_zscore_population_std_and_zero_std(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, 5.0), (1, 4.0, 5.0)], "s int, x double, c double")
    fit = {r.feature: (r.mean, r.std) for r in Q.zscore_fit(df, ["s"], ["x", "c"]).collect()}
    assert np.isclose(fit["x"][1], np.std([1, 2, 4])) and fit["c"] == (5.0, 1.0)
    z = [r.x for r in Q.zscore_apply(df, ["s"], ["x", "c"]).orderBy("x").collect()]
    assert np.allclose(z, (np.array([1, 2, 4]) - 7 / 3) / np.std([1, 2, 4]))


def test_running_totals_over_many_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(x), int(c)) for k, x, c in zip(rng.integers(0, 3, 500), rng.random(500),
                                                           rng.integers(0, 5, 500))]
    df = spark.createDataFrame(rows, "k int, x double, c long")
    got = {(r.k, r.x): r.cum_c for r in running_totals(df, ["k"], "x", ["c"], num_partitions=7).collect()}
    for k in range(3):
        sub = sorted((x, c) for kk, x, c in rows if kk == k)
        acc = 0
        for x, c in sub:
            acc += c
            assert got[(k, x)] == acc


def test_coverage_and_span(spark):
    import datetime as dt
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (1, dt.date(2024, 1, 4))], "s int, date date")
    r = Q.coverage(df, ["s"]).first()
    assert (r.n_days, r.span_days, r.coverage_ratio) == (2, 4, 0.5)


def test_trim_names_each_step_once(spark):
    """Nulls and several columns give the windows' rows, and the plan does not grow by doubling."""
    rng = np.random.default_rng(4)
    names = ["a", "b", "c", "d", "e"]
    rows = [(i % 7, i, *[None if rng.random() < 0.1 else float(x) for x in rng.normal(0, 1, 5)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "s int, i int, " + ", ".join(f"{n} double" for n in names))
    out = Q.trim_sequential(df, ["s"], names, 0.05, 0.95)
    want = df
    for n in names:
        want = Q.trim_one(want, ["s"], n, 0.05, 0.95)
    assert sorted(r.i for r in out.collect()) == sorted(r.i for r in want.collect())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") <= 2 * len(names)
