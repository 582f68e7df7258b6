"""Newton fits against Spark's own logistic regression, alone and together."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import Vectors

from newsprism.operators import linear


def drawn(seed, n=120, width=60, dense=False):
    draw = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        k = int(draw.integers(0, 12))
        at = np.sort(draw.choice(width, k, replace=False))
        x = draw.random(k)
        label = int(draw.random() < (0.85 if (at < 20).sum() > 1 else 0.3))
        if dense:
            full = np.zeros(width)
            full[at] = x
            rows.append((label, Vectors.dense(full)))
        else:
            rows.append((label, Vectors.sparse(width, at.tolist(), x.tolist())))
    return rows


@pytest.mark.parametrize("dense", [False, True])
def test_against_spark(spark, dense, tmp_path):
    df = spark.createDataFrame(drawn(1, dense=dense), ["label", "features"])
    ours = linear.NewtonLogisticRegression().fit(df)
    spark_own = LogisticRegression(regParam=1 / 120, standardization=False, tol=1e-12, maxIter=500).fit(df)
    assert np.abs(ours.coefficients.toArray() - spark_own.coefficients.toArray()).max() < 1e-4
    assert abs(ours.intercept - spark_own.intercept) < 1e-4
    told = linear.certificate(df, ours.coefficients.toArray(), ours.intercept)
    assert told["rows"] == 120 and told["gradient"] < 1e-10 and told["loss"] < told["zero_loss"] == math.log(2)
    off = linear.certificate(df, ours.coefficients.toArray() * 1.01, ours.intercept)
    assert off["gradient"] > 1e-5 and off["loss"] > told["loss"]
    ours.write().overwrite().save(str(tmp_path / "lr"))
    assert LogisticRegressionModel.load(str(tmp_path / "lr")).intercept == ours.intercept


def test_together_as_alone():
    """Models over subsets of rows and terms, in one set of passes, against each one fitted by itself."""
    draw = np.random.default_rng(5)
    n, width, models = 90, 25, 4
    x = draw.random((n, width)) * (draw.random((n, width)) < 0.3)
    x[7] = 0.0
    y = (draw.random(n) < 0.5).astype(float)
    scale = (draw.random((width, models)) + 0.5) * (draw.random((width, models)) < 0.7)
    member = draw.random((n, models)) < 0.6
    norm = draw.random((n, models)) + 0.5
    at = np.argwhere(x)
    starts = np.searchsorted(at[:, 0], np.arange(n))
    rows = linear.Rows(y, starts, at[:, 1], x[at[:, 0], at[:, 1]], norm, member)

    class InProcess(linear.Fitter):
        def __init__(self, scale):
            self.scale, self.read = scale, None
            self.terms = [np.flatnonzero(scale[:, c]) for c in range(scale.shape[1])]
            self.frame = type("F", (), {"sparkSession": type("S", (), {"sparkContext": self})})
        def broadcast(self, value):
            return type("B", (), {"value": value, "destroy": lambda self: None})()
        def _add_up(self, read, shared, n_terms, wide):
            total = [np.zeros((n_terms, wide)), np.zeros((n_terms, wide)), np.zeros(wide), np.zeros(wide), np.zeros(wide)]
            for piece in rows.pieces(wide):
                term, *found = linear._sums(piece, *shared.value)
                total[0][term] += found[0]
                total[1][term] += found[1]
                for i in (2, 3, 4):
                    total[i] += found[i]
            return total

    cells, linear.CELLS = linear.CELLS, 50  # many small pieces
    try:
        fitter = InProcess(scale)
        found = fitter.solve(member.sum(axis=0).tolist(), 1e-12, 100)
    finally:
        linear.CELLS = cells
    for c, got in enumerate(found):
        own = fitter.terms[c]
        features = (x[:, own] * scale[own, c] / norm[:, [c]])[member[:, c]]
        z = features @ got[:-1] + got[-1]
        pull = 1 / (1 + np.exp(-z)) - y[member[:, c]]
        assert np.abs(features.T @ pull + got[:-1]).max() < 1e-9 and abs(pull.sum()) < 1e-9


def test_one_class_and_rows_without_features(spark):
    rows = [(1, Vectors.sparse(3, [], []))] * 6 + [(1, Vectors.sparse(3, [0], [1.0]))]
    model = linear.NewtonLogisticRegression(tol=1e-6).fit(spark.createDataFrame(rows, ["label", "features"]))
    assert model.intercept > 10 and np.abs(model.coefficients.toArray()).max() < 1e-3


def test_sums_reach_the_driver_once(spark):
    """Slices of the terms are added up by tasks: each number is sent once, however many partitions hold a share of it."""
    width, models = 700, 30
    rows = [(i % 2, Vectors.sparse(width, list(range(i % 7, width, 7)), [0.1 * (1 + i % 3)] * len(range(i % 7, width, 7)))) for i in range(84)]
    frame = spark.createDataFrame(rows, ["label", "features"]).selectExpr("cast(label as double) label", "features").repartition(24)

    def read(batch):
        r = linear.of_vectors(batch)
        yield linear.Rows(r.label, r.starts, r.index, r.value, np.ones((len(r), models)), np.arange(models) % 3 != r.label[:, None])
    asked = {c: (linear.GRADIENT, np.full(width + 1, 0.01 * c)) if c % 2 else
             (linear.HESSIAN, np.zeros(width + 1), np.full(width + 1, 0.1 * c)) for c in range(models)}
    fitter = linear.Fitter(frame, read, np.ones((width, models)), 24)
    whole = linear.Fitter(frame.coalesce(1), read, np.ones((width, models)), 1).run(asked)
    direct, linear.DIRECT, sent = linear.DIRECT, 0, []
    collect = type(frame).collect
    try:
        type(frame).collect = lambda self: sent.extend(collect(self)) or sent
        found = fitter.run(asked)
    finally:
        linear.DIRECT, type(frame).collect = direct, collect
    assert sorted(r["part"] for r in sent) == list(range(-(-width // (linear.SLICE // models))))
    for c in range(models):
        for a, b in zip(found[c], whole[c], strict=True):
            assert np.allclose(a, b, rtol=1e-12, atol=1e-12)


def test_stretches_hold_the_rows(spark):
    """Packed rows read back as they were, empty rows and small stretches included."""
    df = spark.createDataFrame(drawn(3), ["label", "features"]).selectExpr("cast(label as double) label", "features").coalesce(1)
    packed = linear.in_stretches(df).toArrow().combine_chunks().to_batches()[0]
    one = linear.of_vectors(df.toArrow().combine_chunks().to_batches()[0])
    got = list(linear.of_stretches(packed))
    for name in ("label", "index", "value"):
        assert np.array_equal(np.concatenate([getattr(g, name) for g in got]), getattr(one, name))
    assert np.array_equal(got[0].starts, one.starts[:len(got[0])]) and sum(map(len, got)) == len(one)


def test_kept_directions_need_fewer_passes():
    """Directions of earlier steps precondition the later ones: the same optimum in fewer products."""
    draw = np.random.default_rng(7)
    x = draw.random((300, 80)) * (draw.random((300, 80)) < 0.2) * np.geomspace(30, 0.1, 80)
    y = (x @ draw.normal(size=80) + draw.normal(size=300) > 0).astype(float)
    x1 = np.hstack([x, np.ones((300, 1))])
    found = {}
    for kept in (0, linear.KEPT):
        steps, passes = linear.newton(80, 1e-9, 100, kept), 0
        asked = next(steps)
        while True:
            passes += 1
            z = x1 @ asked[1]
            p = 1 / (1 + np.exp(-z))
            d = p * (1 - p)
            answer = ((np.logaddexp(0, z) - y * z).sum(), x1.T @ (p - y), (x1 ** 2).T @ d) if asked[0] == linear.GRADIENT else (
                x1.T @ (d * (x1 @ asked[2])),)
            try:
                asked = steps.send(answer)
            except StopIteration as end:
                found[kept] = end.value, passes
                break
    (plain, most), (eased, fewer) = found[0], found[linear.KEPT]
    assert np.allclose(plain, eased, atol=1e-7) and fewer < 0.8 * most


def test_products_in_single_precision(spark):
    """Gradients stay double whatever else is asked for; only products and curvatures are rounded."""
    rows = [(i % 2, Vectors.sparse(9, [i % 9, (i + 4) % 9] if i % 9 < (i + 4) % 9 else [(i + 4) % 9, i % 9], [0.3, 0.7])) for i in range(40)]
    frame = spark.createDataFrame(rows, ["label", "features"]).selectExpr("cast(label as double) label", "features").repartition(3)

    def read(batch):
        r = linear.of_vectors(batch)
        yield linear.Rows(r.label, r.starts, r.index, r.value, np.ones((len(r), 2)), np.ones((len(r), 2), dtype=bool))
    asked = {0: (linear.GRADIENT, np.full(10, 0.1)), 1: (linear.HESSIAN, np.zeros(10), np.full(10, 1 / 3))}
    double, single = (linear.Fitter(frame, read, np.ones((9, 2)), 3, single=s).run(asked) for s in (False, True))
    assert single[0][0] == pytest.approx(double[0][0], rel=1e-14) and np.allclose(single[0][1], double[0][1], rtol=1e-13, atol=1e-14)
    assert np.allclose(single[0][2], double[0][2], rtol=1e-6) and np.allclose(single[1][0], double[1][0], rtol=1e-6)
