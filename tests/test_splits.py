"""Splits, folds, samples: exact stratification, determinism, equality with naive ranks."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsprism.operators import splits
from newsprism.operators.ranks import hash_rank, order_hash, rank_cuts
from newsprism.plans import views as V
from newsprism.plans.catalog import REGISTRY


def test_hash_rank_equals_naive_row_number(spark, sf):
    c = V.labeled(spark, sf)
    fast = hash_rank(c, "label", bucket_digits=2).select("row_id", "rank")
    w = Window.partitionBy("label").orderBy(order_hash(), "row_id")
    naive = c.select("row_id", F.row_number().over(w).alias("naive"))
    assert fast.join(naive, "row_id").filter(F.col("rank") != F.col("naive")).count() == 0


def test_split_is_exhaustive_disjoint_and_stratified(spark, sf):
    c = V.labeled(spark, sf)
    s = splits.stratified_split(c)
    assert s.count() == c.count() == s.select("row_id").distinct().count()
    n = c.count()
    train = s.filter(F.col("split") == "train").count()
    assert abs(train / n - 0.70) < 0.01
    for r in s.groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                    F.count_if(F.col("split") == "train").alias("tr")).collect():
        exp_train, _, _ = splits.split_counts(r["n"])
        assert r["tr"] == exp_train


def test_split_is_deterministic(spark, sf):
    a = splits.stratified_split(V.labeled(spark, sf)).select("row_id", "split")
    b = splits.stratified_split(V.labeled(spark, sf)).select("row_id", "split")
    assert a.exceptAll(b).count() == 0


def test_kfold_balanced(spark, sf):
    k = splits.stratified_kfold(V.labeled(spark, sf), k=5)
    per = k.groupBy("label", "fold").count().groupBy("label").agg(F.max("count").alias("mx"),
                                                                 F.min("count").alias("mn")).collect()
    assert all(r["mx"] - r["mn"] <= 1 for r in per)


def test_stratified_sample_reference_case(spark):
    df = spark.createDataFrame([(i, f"article {i}", 0 if i < 6 else 1) for i in range(12)],
                               "row_id long, content string, label int")
    sample = splits.stratified_sample(df, per_class=3, seed=42)
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    assert counts == {0: 3, 1: 3}
    assert sample.count() == 6


def test_stratified_sample_too_small(spark):
    df = spark.createDataFrame([(i, 0 if i < 2 else 1) for i in range(12)], "row_id long, label int")
    with pytest.raises(ValueError):
        splits.stratified_sample(df, per_class=3)


def test_null_labels_are_a_class_and_never_lost(spark):
    rows = [(i, None if i % 3 == 0 else i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, label int")
    s = splits.stratified_split(df)
    assert s.count() == 30 and s.where("label is null").count() == 10
    assert splits.stratified_kfold(df, k=3).count() == 30


def test_cuts_are_the_keys_at_the_ranks(spark):
    df = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"))
    w = Window.partitionBy("label").orderBy(order_hash(), "row_id")
    ranked = {(r["label"], r["n"]): r["row_id"] for r in df.withColumn("n", F.row_number().over(w)).collect()}
    cuts = rank_cuts(df, {"a": F.lit(1), "b": F.col("n"), "c": F.lit(0), "d": F.lit(100)}, bucket_digits=1).collect()
    for r in cuts:
        assert r["n"] == 250 and r["c"] is None
        assert [r[x]["id"] for x in "abd"] == [ranked[r["label"], k] for k in (1, 250, 100)]


def test_split_moves_no_text(spark, sf):
    plan = splits.stratified_split(V.labeled(spark, sf))._jdf.queryExecution().executedPlan().toString()
    sort_aggregates = [line for line in plan.splitlines() if "SortAggregate" in line and "content" in line]
    assert not sort_aggregates


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 257, 1000])
def test_shuffled_positions_are_a_permutation(spark, n):
    df = spark.createDataFrame([(10 * i,) for i in range(n)], "row_id long").repartition(5)
    first = {r["row_id"]: r["position"] for r in splits.shuffle_rows(df).collect()}
    assert sorted(first.values()) == list(range(n)) and len(first) == n
    assert {r["row_id"]: r["position"] for r in splits.shuffle_rows(df.repartition(2)).collect()} == first
    if n > 60:
        other = {r["row_id"]: r["position"] for r in splits.shuffle_rows(df, seed=7).collect()}
        assert other != first and sorted(other.values()) == list(range(n))
        moved = sum(abs(p - i // 10) for i, p in first.items()) / n
        assert n / 4 < moved < n / 2.4  # a third of n on average for a random order


def test_shuffle_keeps_columns_and_takes_nothing(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(9)], "row_id long, title string")
    assert [r["title"] for r in splits.shuffle_rows(df).orderBy("position").collect()] != [str(i) for i in range(9)]
    assert splits.shuffle_rows(df).columns == ["row_id", "title", "position"]
    assert splits.shuffle_rows(df.limit(0)).count() == 0


def test_texts_are_not_shuffled_by_label(spark):
    """The cuts are broadcast whatever the planner knows of their size: no task gets all texts of a label."""
    rows = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"), F.lit("x").alias("text"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out, n in ((splits.stratified_split(rows), 300), (splits.stratified_sample(rows, per_class=5), 10)):
            joins = [line for line in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]
            assert "BroadcastHashJoin" in joins[0] and out.count() == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


class Planned(Exception):
    """Holds the first frame that a query materialises."""


@pytest.fixture(scope="module")
def few_labelled(spark, tmp_path_factory):
    """A folder of documents, all labelled."""
    home, n = str(tmp_path_factory.mktemp("few")), F.col("id")
    docs = spark.range(40).select(n.alias("doc_id"), F.concat(F.lit("title\nword"), n).alias("text"), F.lit("s").alias("source"))
    docs.write.parquet(f"{home}/documents.parquet")
    spark.range(40).select(n.alias("doc_id"), (n % 2).alias("quality")).write.parquet(f"{home}/labels.parquet")
    return home


@pytest.mark.parametrize("name", [
    "build_pipeline", "decision_scores", "explain_decision", "feature_coef_join", "feature_matrix_shape", "fit_experiment",
    "load_model", "logistic_regression", "predict", "prediction_contributions", "save_model", "score_new_articles",
    "summary_table", "tfidf", "top_terms_global"])
def test_queries_over_the_split_join_no_texts_by_label(spark, few_labelled, monkeypatch, name):
    """The split that each of them materialises takes its cuts by broadcast, even if the planner would not."""
    def planned(df):
        raise Planned(df)
    monkeypatch.setattr(V, "cut_lineage", planned)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with pytest.raises(Planned) as first:
            REGISTRY[name](spark, few_labelled)
        split = first.value.args[0]
        joins = [line for line in split._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]
        assert "split" in split.columns and "content" in split.columns
        assert "BroadcastHashJoin" in joins[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
