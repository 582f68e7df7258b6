"""Metrics against brute-force Python on small fixtures."""

import math
import random

from pyspark.sql import functions as F

from newsprism.operators import metrics as mt


def _brute_auc(y, p):
    pos = [s for s, t in zip(p, y) if t == 1]
    neg = [s for s, t in zip(p, y) if t == 0]
    tot = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
    return tot / (len(pos) * len(neg))


def _frame(spark, n=400, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = rnd.random() < 0.3
        p = round(min(max(rnd.gauss(0.6 if y else 0.4, 0.2), 0.0), 1.0), 2)  # ties on purpose
        rows.append((i, "a" if i % 2 else "b", int(y), p, int(p >= 0.5)))
    return rows, spark.createDataFrame(rows, "row_id long, g string, label int, p double, prediction int")


def test_auc_matches_brute_force_with_ties(spark):
    rows, df = _frame(spark)
    got = {r["g"]: r["roc_auc"] for r in mt.roc_auc(df, group_cols=("g",)).collect()}
    for g in ("a", "b"):
        sub = [r for r in rows if r[1] == g]
        assert abs(got[g] - _brute_auc([r[2] for r in sub], [r[3] for r in sub])) < 1e-6
    total = mt.roc_auc(df).first()["roc_auc"]
    assert abs(total - _brute_auc([r[2] for r in rows], [r[3] for r in rows])) < 1e-6


def test_auc_null_when_one_class(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "label int, p double")
    assert mt.roc_auc(df).first()["roc_auc"] is None


def test_counts_metrics_and_log_loss(spark):
    rows, df = _frame(spark)
    m = {r["metric"]: r["value"] for r in mt.classification_metrics(df, weighted=True).collect()}
    y = [r[2] for r in rows]
    yhat = [r[4] for r in rows]
    p = [r[3] for r in rows]
    tp = sum(a == 1 and b == 1 for a, b in zip(y, yhat))
    tn = sum(a == 0 and b == 0 for a, b in zip(y, yhat))
    fp = sum(a == 0 and b == 1 for a, b in zip(y, yhat))
    fn = sum(a == 1 and b == 0 for a, b in zip(y, yhat))
    acc = (tp + tn) / len(y)
    mcc = (tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    eps = mt.LOG_LOSS_EPS
    ll = -sum(math.log(min(max(q if t else 1 - q, eps), 1 - eps)) for t, q in zip(y, p)) / len(y)
    assert abs(m["accuracy"] - acc) < 1e-6
    assert abs(m["mcc"] - mcc) < 1e-6
    assert abs(m["log_loss"] - ll) < 1e-6
    assert abs(m["balanced_accuracy"] - (tp / (tp + fn) + tn / (tn + fp)) / 2) < 1e-6


def test_confusion_full_domain(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "label int, prediction int")
    got = {(r["label"], r["prediction"]): r["count"] for r in mt.confusion(df).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}


def test_zero_shot_requires_a_valid_answer(spark):
    df = spark.createDataFrame([(1, None, 0.1), (0, None, None)], "true_label int, prediction int, latency_seconds double")
    try:
        mt.evaluate_zero_shot(df)
    except RuntimeError:
        pass
    else:
        raise AssertionError("expected RuntimeError")


def test_best_run_isclose_rule(spark):
    hist = spark.createDataFrame(
        [(1, 1, 0.80, 0.5), (1, 2, 0.80 + 1e-9, 0.4), (1, 3, 0.79, 0.1), (2, 1, 0.5, 0.3), (2, 2, 0.6, 0.9)],
        "run_id long, epoch long, f1 double, loss double")
    got = {r["run_id"]: r["best_epoch"] for r in mt.select_best_run(hist).collect()}
    assert got == {1: 2, 2: 2}


def test_histogram_has_all_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 1, 10]], "latency_seconds double")
    h = mt.latency_histogram(df).orderBy("bin").collect()
    assert len(h) == 20 and sum(r["count"] for r in h) == 4 and h[-1]["count"] == 1


def _counts(spark, tp, tn, fp, fn):
    wide = spark.createDataFrame([(tp, tn, fp, fn)], "tp long, tn long, fp long, fn long")
    return wide.select(*[c.alias(k) for k, c in mt.metric_columns(True).items()]).first().asDict()


def test_metrics_do_not_overflow(spark):
    n = 5 * 10 ** 9
    m = _counts(spark, n, n, 0, 0)
    assert abs(m["mcc"] - 1.0) < 1e-12 and m["f1_macro"] == 1.0
    assert abs(_counts(spark, n, n, n, n)["mcc"]) < 1e-12


def test_macro_means_take_present_classes_only(spark):
    m = _counts(spark, 7, 0, 0, 0)
    assert m["precision_macro"] == m["recall_macro"] == m["f1_macro"] == 1.0
    m = _counts(spark, 3, 0, 0, 1)  # class 0 is only predicted
    assert m["recall_macro"] == (0.75 + 0.0) / 2
    report = {r["row"]: r for r in mt.classification_report(
        spark.createDataFrame([(1, 1)] * 3, "label int, prediction int")).collect()}
    assert report["macro avg"]["f1_score"] == 1.0 and report["0"]["support"] == 0


def test_log_loss_ignores_labels_outside_the_domain(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (None, 0.99), (2, 0.01)], "label int, p double")
    want = -(math.log(0.9) + math.log(0.8)) / 2
    assert abs(mt.log_loss(df).first()["log_loss"] - want) < 1e-6


def test_values_are_selected_by_rank(spark):
    rnd = random.Random(3)
    values = [rnd.expovariate(1.0) ** 9 for _ in range(3001)] + [0.5] * 2000 + [float("inf")] * 3 + [-float("inf"), 1e308, -1e308]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    dist = df.groupBy("v").agg(F.count(F.lit(1)).alias("n")).cache()
    ordered = sorted(values)
    ranks = [0, 1, 2500, 4000, len(values) - 4, len(values) - 1]
    for fetched in (100_000, 20):
        assert mt.values_at_ranks(dist, "v", "n", ranks, fetched) == [ordered[r] for r in ranks]
    finite = sorted(v for v in values if math.isfinite(v))
    got = mt.latency_stats(df.unionByName(spark.createDataFrame([(None,), (float("nan"),)], "v double")), "v").first()
    assert abs(got["median"] - finite[len(finite) // 2]) < 1e-6 and got["min"] == -1e308 and got["max"] == 1e308


def test_scores_that_are_no_number_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0, 0.1), (1, nan), (1, 0.9), (0, None), (0, 0.95)], "label int, p double").withColumn("prediction", F.col("label"))
    assert mt.roc_auc(df).first()["roc_auc"] == 0.5
    want = -(math.log(0.9) + math.log(0.9) + math.log(0.05)) / 3
    assert abs(mt.log_loss(df).first()["log_loss"] - want) < 1e-6
    m = {r["metric"]: r["value"] for r in mt.classification_metrics(df).collect()}
    assert m["roc_auc"] == 0.5 and abs(m["log_loss"] - want) < 1e-6 and m["accuracy"] == 1.0
    assert mt.roc_auc(spark.createDataFrame([(1, inf), (0, -inf), (1, 3.0)], "label int, p double")).first()["roc_auc"] == 1.0


def test_histogram_of_finite_values_only(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(x,) for x in [0.0, 5.0, 10.0, nan, inf, -inf, None]], "latency_seconds double")
    h = {r["bin"]: r for r in mt.latency_histogram(df, bins=2).collect()}
    assert [h[0]["count"], h[1]["count"]] == [1, 2] and (h[0]["lower"], h[1]["upper"]) == (0.0, 10.0)
    wide = spark.createDataFrame([(x,) for x in [-1.7e308, 0.0, 1.7e308]], "latency_seconds double")
    assert sorted(r["count"] for r in mt.latency_histogram(wide, bins=4).collect()) == [0, 1, 1, 1]
    none = mt.latency_histogram(spark.createDataFrame([(nan,)], "latency_seconds double")).collect()
    assert len(none) == 20 and not any(r["count"] for r in none)


def test_zero_shot_result_holds_the_confusion(spark):
    df = spark.createDataFrame([(1, 1, 0.1), (0, 1, 0.3), (0, None, None)],
                               "true_label int, prediction int, latency_seconds double")
    got = {r["metric"]: r["value"] for r in mt.evaluate_zero_shot(df).collect()}
    assert (got["confusion_1_1"], got["confusion_0_1"], got["confusion_0_0"], got["confusion_1_0"]) == (1.0, 1.0, 0.0, 0.0)
    assert got["accuracy"] == 0.5 and got["invalid_predictions"] == 1.0 and got["average_latency_seconds"] == 0.2
