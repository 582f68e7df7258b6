"""Cleaning flow and quality checks on small frames and on the supplied tables."""

from pyspark.sql import functions as F

from newsprism.operators import clean, quality
from newsprism.plans import views as V
from newsprism.sources import articles as src

SCHEMA = "row_id long, title string, text string, subject string, date string, label int"


def test_dedup_keeps_first_after_strip(spark):
    rows = [(3, "a ", "x", "s", "d", 1), (1, "a", " x", "s", "d", 1), (2, None, "y", "s", "d", 0),
            (4, "", "y", "s", "d", 1), (5, "b", "x", None, None, 0)]
    df = clean.clean_articles(spark.createDataFrame(rows, SCHEMA))
    got = sorted((r["row_id"], r["title"], r["text"]) for r in df.collect())
    # (a, x) twice -> keep row 1; null title == "" after fill -> keep row 2
    assert got == [(1, "a", "x"), (2, "", "y"), (5, "b", "x")]
    assert df.filter(F.col("content").isNull()).count() == 0


def test_cleaned_tables_have_no_duplicates(spark, sf):
    c = V.cleaned(spark, sf)
    assert c.count() == c.select("title", "text").distinct().count()


def test_label_conflicts_tiny(spark):
    rows = [(1, "t", "x", "s", "d", 0), (2, "t", "x", "s", "d", 1), (3, "u", "x", "s", "d", 1),
            (4, None, "x", "s", "d", 0), (5, None, "x", "s", "d", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert quality.label_conflicts(df).first()[0] == 1


def test_duplicate_counts_null_is_a_value(spark):
    rows = [(1, None, "x", "s", "d", 0), (2, None, "x", "s", "d", 1), (3, "t", None, "s", "d", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["subset"]: r["duplicates"] for r in quality.duplicate_counts(df).collect()}
    assert got == {"title": 1, "text": 1, "title+text": 1}


def test_validate_columns_raises(spark):
    df = spark.createDataFrame([(1, "t")], "row_id long, title string")
    try:
        src.validate_columns(df, "frame")
    except ValueError as exc:
        assert "['date', 'subject', 'text']" in str(exc)
    else:
        raise AssertionError("expected ValueError")


def test_label_domain(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "row_id long, label int")
    assert quality.label_domain_check(df).first()["invalid_labels"] == 1
    try:
        quality.assert_label_domain(df)
    except ValueError:
        pass
    else:
        raise AssertionError("expected ValueError")


def test_quarantine_routes_every_row_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text('subject,title,text,date,extra\ns,t1,x1,d,e\ns,t2,"x2,""q""",d,e\ntoo,few\ns,,  ,d,e\ns,t3,x3,d,e,f,g\ns,t4,,d,e\n')
    rows = src.read_checked_csv(spark, str(folder / "a.csv"))
    good, bad, seen = quality.quarantine(rows, str(tmp_path / "out"))
    assert sorted(r["title"] for r in good.collect()) == ["t1", "t2", "t4"]
    assert sorted((r["reason"], r["corrupt_line"]) for r in bad.collect() if r["reason"] == "malformed") == [
        ("malformed", "s,t3,x3,d,e,f,g"), ("malformed", "too,few")]
    assert [r["reason"] for r in bad.collect()].count("blank") == 1
    assert seen == {"good": 3, "bad": 3} and good.columns == rows.columns
    labelled = spark.createDataFrame([(1, "a", "b", 1), (2, None, None, 0), (3, "c", "", 5), (4, "c", "d", None)],
                                     "row_id long, title string, text string, label int")
    good, bad, seen = quality.quarantine(labelled, str(tmp_path / "labels"))
    assert [r["row_id"] for r in good.collect()] == [1] and seen == {"good": 1, "bad": 3}
    assert {r["row_id"]: r["reason"] for r in bad.collect()} == {2: "blank", 3: "label", 4: "label"}
    good, bad, seen = quality.quarantine(labelled.limit(0), str(tmp_path / "none"))
    assert seen == {"good": 0, "bad": 0}
