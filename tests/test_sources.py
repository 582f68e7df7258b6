"""CSV sources: declared schema, quoted multi-line fields, labels, validation."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from newsprism.sources import articles as src
from newsprism.sources.tables import read_table


def _write(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_load_labeled_reads_both_sources(spark):
    d = tempfile.mkdtemp(prefix="np-csv-")
    fake, real = os.path.join(d, "Fake.csv"), os.path.join(d, "True.csv")
    _write(fake, 'title,text,subject,date\n"Shock","line one\nline ""two""",News,"December 31, 2017"\n'
                 'Plain,,politics,31-Dec-17\n')
    _write(real, 'title,text,subject,date\nCalm,"WASHINGTON (Reuters) - a, b",politicsNews,"Dec 1, 2017 "\n')
    df = src.load_labeled(spark, fake, real)
    rows = sorted(df.select("title", "text", "label").collect(), key=lambda r: r["title"])
    assert [(r["title"], r["label"]) for r in rows] == [("Calm", 1), ("Plain", 0), ("Shock", 0)]
    assert rows[2]["text"] == 'line one\nline "two"'
    assert rows[1]["text"] is None                       # empty field -> null, cleaned to "" later
    assert df.select("row_id").distinct().count() == 3
    assert dict(df.dtypes)["label"] == "int"


def test_missing_column_is_reported(spark):
    d = tempfile.mkdtemp(prefix="np-csv-")
    bad = os.path.join(d, "bad.csv")
    _write(bad, "title,text\nA,B\n")
    with pytest.raises(ValueError, match="subject"):
        src.read_article_csv(spark, bad)


def test_columns_are_read_by_name(spark):
    d = tempfile.mkdtemp(prefix="np-csv-")
    odd, real = os.path.join(d, "odd.csv"), os.path.join(d, "real.csv")
    _write(odd, 'date,extra,text,title,subject\n"Dec 1, 2017",9,body,head,News\n')
    _write(real, "title,text,subject,date\na,b,c,d\n")
    rows = {r["label"]: r for r in src.load_labeled(spark, odd, real).collect()}
    assert (rows[0]["title"], rows[0]["text"], rows[0]["subject"], rows[0]["date"]) == ("head", "body", "News", "Dec 1, 2017")
    assert set(rows[0].asDict()) == {"title", "text", "subject", "date", "label", "row_id"}


def test_ids_depend_on_the_files_alone(spark):
    d = tempfile.mkdtemp(prefix="np-csv-")
    for side in ("fake", "real"):
        os.mkdir(os.path.join(d, side))
        for k in range(5):
            body = "".join(f"{side}{k}_{i},x,s,d\n" for i in range(20))
            _write(os.path.join(d, side, f"{k}.csv"), "title,text,subject,date\n" + body)
    load = lambda: {r["title"]: r["row_id"] for r in src.load_labeled(
        spark, os.path.join(d, "fake"), os.path.join(d, "real")).collect()}
    first = load()
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert load() == first
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(set(first.values())) == 200


def test_source_files(spark, sf):
    files = src.source_files(read_table(spark, sf, "documents")).collect()
    assert len(files) == 1 and files[0]["file_path"].endswith("documents.parquet") and files[0]["count"] == 1000


def test_articles_adapter(spark, sf):
    a = src.articles_from_tables(spark, sf)
    assert a.count() == read_table(spark, sf, "documents").count()
    assert a.where("label is not null").count() == read_table(spark, sf, "labels").count()
    assert set(a.columns) == {"row_id", "title", "text", "subject", "date", "label"}
    assert a.filter(F.col("title").contains("\n")).count() == 0
