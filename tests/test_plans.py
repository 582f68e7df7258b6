"""Plan-shape helpers: one-aggregate reshaping, shared tf subtrees, parquet lineage cuts."""

import os

from pyspark.sql import functions as F

from newsprism.functions.reshape import rows_from
from newsprism.operators import fisher, metrics, quality
from newsprism.operators import terms as tm
from newsprism.plans import views as V
from newsprism import session
from newsprism.session import checkpoint_dir, cut_lineage, drop_cut

SCHEMA = "row_id long, title string, text string, subject string, date string, label int"


def _scans(df):
    """Parquet scans in the optimized plan (before any AQE re-planning)."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation ")


def test_rows_from_emits_one_row_per_mapping(spark):
    wide = spark.createDataFrame([(1, 2.0)], "a long, b double")
    out = rows_from(wide, [{"k": F.lit("a"), "v": F.col("a").cast("double")},
                           {"k": F.lit("b"), "v": F.col("b")}])
    assert sorted(tuple(r) for r in out.collect()) == [("a", 1.0), ("b", 2.0)]


def test_multi_row_summaries_scan_their_input_once(spark, sf):
    c = V.cleaned(spark, sf)
    base = _scans(c)
    styled = c.withColumn("x", F.length("title"))
    assert _scans(fisher.fisher_numeric(styled, ["x", "text_words"])) == base
    assert _scans(quality.quality_report(c)) == base
    assert _scans(quality.duplicate_counts(c)) == base
    preds = c.select("label", (F.length("text") % 2).alias("prediction"))
    assert _scans(metrics.classification_report(preds)) == base


def test_duplicate_counts_mixed_widths_tiny(spark):
    rows = [(1, "t", "x", "s", "d", 0), (2, "t", "y", "s", "d", 1), (3, "t", "x", "s", "d", 1),
            (4, "u", "x", "s", "d", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["subset"]: r["duplicates"] for r in quality.duplicate_counts(df).collect()}
    # brute force: rows - distinct key tuples
    assert got == {"title": 4 - 2, "text": 4 - 2, "title+text": 4 - 3}


def test_quality_report_matches_brute_force(spark):
    rows = [(1, "t", "x", None, "d", 0), (2, "t", "x", "s", None, 1), (3, "u", " \t", "s", "d", 1),
            (4, None, None, "s", "d", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["metric"]: r["value"] for r in quality.quality_report(df).collect()}
    assert got == {"missing_values": 4, "blank_texts": 2, "duplicate_title_text": 1}


def test_vocabulary_row_predicate_equals_prefiltered(spark, sf):
    s = V.split_articles(spark, sf, materialize=True)
    tf = tm.term_frequencies(s, "content", keep=("split",))
    train = F.col("split") == "train"
    a = tm.vocabulary(tf, 2, 500, rows=train).collect()
    b = tm.vocabulary(tf.filter(train), 2, 500).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert len(a) == 500


def test_cut_lineage_writes_under_checkpoint_dir(spark):
    df = spark.range(10).withColumn("sq", F.col("id") * F.col("id"))
    cut = cut_lineage(df)
    files = cut.inputFiles()
    assert files and all("/tables/" in f for f in files)
    drop_later = cut
    assert checkpoint_dir(spark).split(":")[-1].rstrip("/") in files[0]
    assert sorted(tuple(r) for r in cut.collect()) == [(i, i * i) for i in range(10)]
    drop_cut(drop_later)
    assert not os.path.exists(files[0].removeprefix("file://"))


def test_term_counts_inside_the_row(spark):
    rows = [(1, "b a b c b"), (2, ""), (3, None), (4, "x"), (5, "Zz zz é É é")]
    df = spark.createDataFrame(rows, "row_id long, content string").withColumn("t", F.split(F.lower("content"), " "))
    got = {(r["row_id"], r["term"]): r["tf"] for r in df.select("row_id", F.inline(tm.counted(F.col("t")))).collect()}
    assert got == {(1, "a"): 1, (1, "b"): 3, (1, "c"): 1, (2, ""): 1, (4, "x"): 1, (5, "zz"): 2, (5, "é"): 3}
    empty = df.select(tm.counted(F.array().cast("array<string>")).alias("c")).first()["c"]
    assert empty == []


def test_unlimited_and_limited_vocabulary(spark):
    rows = [(i, f"t{i % 7:02d} t{i % 3:02d} u{i:03d}") for i in range(200)]
    tf = tm.term_frequencies(spark.createDataFrame(rows, "row_id long, content string"), "content")
    every = tm.vocabulary(tf, 1, None).orderBy("term").collect()
    assert [r["feature_index"] for r in every] == list(range(207)) and every == sorted(every, key=lambda r: r["term"])
    some = tm.vocabulary(tf, 1, 10).orderBy("term").collect()
    want = sorted(sorted(every, key=lambda r: (-r["total_count"], r["term"]))[:10], key=lambda r: r["term"])
    assert [(r["term"], r["total_count"], r["feature_index"]) for r in some] == [
        (r["term"], r["total_count"], i) for i, r in enumerate(want)]


def test_constant_feature_scores_zero(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.1), (0, 0.1), (1, 0.3), (1, 0.3), (1, 0.3)], "label int, x double")
    assert fisher.fisher_numeric(df, ["x"]).first()["fisher_score"] == 0.0


def test_the_table_written_for_metrics_is_narrow(spark, sf):
    before = len(session._CUTS)
    metrics.classification_metrics(V.predictions(spark, sf), group_cols=("split",))
    assert max(len(cut.columns) for cut, _ in session._CUTS[before:]) <= 5


def test_terms_counted_without_row_counts(spark, sf):
    """One explode of distinct and of all terms against counts made in the rows."""
    rows = V.cleaned(spark, sf).select("row_id", "content").unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, "same same same other")], "row_id long, content string"))
    straight = tm.stats_of(rows.select(tm.analyzed_terms(F.coalesce("content", F.lit("")), (1, 2)).alias("t")), "t")
    counted = tm.term_stats(tm.term_frequencies(rows, "content", ngram_range=(1, 2)))
    assert straight.exceptAll(counted).count() == 0 and counted.exceptAll(straight).count() == 0
