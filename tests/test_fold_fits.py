import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from vigil.operators.fold_fits import Matrix, _medians, fit_logits, fit_preps, preps_of
from vigil.operators.models import fit_logit_lbfgs
from vigil.operators.prep import fit_prep

SETS = [{0}, {0, 1}, {0, 1, 2}, {1, 3}, {0, 1, 2, 3}]
FEATURES = ["x1", "x2", "gap", "same", "c", "d"]


def frame(spark, n=900, seed=0):
    """Four cells that drift, with nulls, ties, a column that is all null in the first cell and categories that come late."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        cell = i * 4 // n
        a, b = rng.normal(cell, 1 + cell), float(np.round(rng.normal(), 1))
        y = int(a + b + rng.normal(0, 1) > cell + 0.5)
        rows.append((int(i % 2), dt.date(2020, 1, 1) + dt.timedelta(days=int(i // 2)), cell, float(a) if i % 17 else None, b,
                     None if cell == 0 or i % 5 == 0 else float(rng.integers(0, 4)), 7.25,
                     None if i % 13 == 0 else "abcz"[rng.integers(0, 3 + (cell > 1))], None if cell == 0 else "xy"[i % 2], y))
    schema = "series_id int, date date, cell int, x1 double, x2 double, gap double, same double, c string, d string, y int"
    return spark.createDataFrame(rows, schema)


def test_all_sets_are_prepared_as_each_alone(spark):
    df = frame(spark)
    for cells, got in zip(SETS, fit_preps(df, FEATURES, SETS)):
        want = fit_prep(df.where(F.col("cell").isin(*cells)), FEATURES)
        assert (got.numeric, got.categorical) == (want.numeric, want.categorical)
        assert got.mode == {c: v for c, v in want.mode.items() if v is not None}
        assert {c: got.median[c] for c in FEATURES[:4]} == {c: want.median[c] for c in FEATURES[:4]}
        assert got.feature_names() == want.feature_names()
        for c in got.numeric:
            assert np.isclose(got.mean[c], want.mean[c], rtol=1e-12) and np.isclose(got.std[c], want.std[c], rtol=1e-12)


def test_medians_of_many_rows_are_exact(spark):
    rows = spark.range(400_000).select((F.col("id") % 5).cast("int").alias("cell"), F.when(F.col("id") % 11 == 0, None).otherwise(
        F.pmod(F.xxhash64("id"), F.lit(10 ** 9)) / 7.0 * (1 + F.col("id") % 5)).alias("a"), (F.col("id") % 3).cast("double").alias("ties"))
    pdf = rows.toPandas()
    matrix = Matrix(rows, ["a", "ties"])
    assert _medians(matrix, matrix.moments(), SETS, 1e-9) == _medians(matrix, matrix.moments(), SETS)    # brackets that miss are widened
    for cells, got in zip(SETS, preps_of(matrix, SETS)):
        own = pdf[pdf["cell"].isin(cells)]
        assert got.median == {"a": float(np.nanmedian(own["a"])), "ties": 1.0}


def test_all_sets_are_fitted_as_each_alone(spark):
    df = frame(spark)
    for penalised in (True, False):
        models = fit_logits(df, FEATURES, "y", SETS, penalize_intercept=penalised)
        for cells, got in list(zip(SETS, models))[3 + penalised:4 + penalised]:
            want = fit_logit_lbfgs(df.where(F.col("cell").isin(*cells)), FEATURES, "y", penalize_intercept=penalised, tol=1e-14)
            assert np.allclose(got.coefficients + [got.intercept], want.coefficients + [want.intercept], atol=1e-6)


def test_one_class_and_sums_in_a_tree(spark, monkeypatch):
    from vigil.operators import fold_fits
    monkeypatch.setattr(fold_fits, "FAN_IN", 3)
    monkeypatch.setattr(fold_fits, "BLOCK_ROWS", 50)
    df = frame(spark).repartition(16)
    monkeypatch.setattr(fold_fits, "HELD", 2)
    a, b = fit_logits(df, ["x1", "x2"], "y", [{0, 1}]), fit_logits(df.coalesce(1), ["x1", "x2"], "y", [{0, 1}])
    assert np.allclose(a[0].coefficients, b[0].coefficients, atol=1e-9)
    one = fit_logits(df.withColumn("y", F.lit(0)), ["x1"], "y", [{0}])[0]
    assert all(r.y_prob < 0.5 for r in one.score(df).select("y_prob").limit(50).collect())


def test_vectors_of_a_matrix_are_the_prepared_rows(spark):
    from pyspark.ml.functions import vector_to_array

    from vigil.operators.fold_fits import Matrix, preps_of
    df = spark.createDataFrame([(i, float(i % 7) if i % 5 else None, float(i * i), "abc"[i % 3] if i % 4 else None, i % 2, i % 3)
                                for i in range(60)], "id int, a double, b double, c string, y int, cell int")
    matrix = Matrix(df, ["a", "b", "c"], "cell", "y")
    prep = preps_of(matrix, [{0, 1}])[0]
    own = matrix.vectors(matrix.design(prep), {0, 1}).select(vector_to_array("_x").alias("x"), F.col("_y").cast("int").alias("y"))
    want = prep.transform(df.where("cell < 2"), "x").select(vector_to_array("x").alias("x"), "y")
    rows = lambda t: sorted((r.y, [round(v, 9) for v in r.x]) for r in t.collect())
    assert rows(own) == rows(want) and own.count() == 40


def test_blocks_of_lagged_columns_are_stored_once(spark):
    from vigil.operators.fold_fits import Matrix
    rng = np.random.default_rng(2)
    a = rng.normal(size=4100)
    rows = [(i, *[float(a[i + k]) for k in range(20)], 0) for i in range(4000)]
    names = [f"c{k}" for k in range(20)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} double" for n in names) + ", cell int").coalesce(1).orderBy("id")
    matrix = Matrix(df, names)
    size = matrix.blocks.agg(F.sum(F.length("x"))).first()[0]
    assert size < 4000 * 20 * 8 / 4


def test_folds_of_the_evaluation_store_no_features(spark, monkeypatch):
    import datetime as dt

    from vigil.plans import modeling
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=i), float((i * 7 + s) % 11), float(i % 5), (i + s) % 3 == 0)
            for s in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "s int, date date, a double, b double, hit boolean").withColumn("y", F.col("hit").cast("int")).drop("hit")
    seen = []
    cut = modeling.cut_lineage
    monkeypatch.setattr(modeling, "cut_lineage", lambda d, *a: seen.append(d.columns) or cut(d, *a))
    _, folds, _, oof = modeling.evaluate_models(df, ["a", "b"], "y", ["s"], ("logit_balanced",))
    assert folds.count() == 5 and oof.count() == 100
    assert seen and not any("a" in columns for columns in seen)
