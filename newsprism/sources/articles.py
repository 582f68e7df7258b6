"""Article sources: labelled CSV pairs, and the adapter over the supplied tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsprism.sources.tables import read_table

# The two labels and the columns of an article file.
FAKE_LABEL = 0
REAL_LABEL = 1
REQUIRED_COLUMNS = ("title", "text", "subject", "date")
LABEL_DOMAIN = (FAKE_LABEL, REAL_LABEL)


def validate_columns(df_or_columns, source: str = "input") -> None:
    """Raise when required columns are missing (schema-only check, no job)."""
    columns = df_or_columns.columns if isinstance(df_or_columns, DataFrame) else list(df_or_columns)
    missing = sorted(set(REQUIRED_COLUMNS) - set(columns))
    if missing:
        raise ValueError(f"missing columns in {source}: {missing}")


def read_article_csv(spark: SparkSession, path: str) -> DataFrame:
    """The required columns of one article CSV, by name: any order, further columns ignored.

    The schema is the file's own header with every column a string (never
    inferred). Quoted multi-line fields make the file unsplittable: convert once
    to parquet and run everything else on that.
    """
    header = spark.read.option("header", True).csv(path).columns
    validate_columns(header, path)
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in header])
    return (spark.read.schema(schema)
            .option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"')
            .csv(path).select(*REQUIRED_COLUMNS, "_metadata.file_path"))


#: Column of a malformed line's text in ``read_checked_csv``.
CORRUPT = "corrupt_line"


def read_checked_csv(spark: SparkSession, path: str) -> DataFrame:
    """The required columns as strings, and ``corrupt_line``: the text of a line with too few or too many fields, else null.

    One record per line, so that a broken quote spoils its own line only.
    """
    header = spark.read.option("header", True).csv(path).columns
    validate_columns(header, path)
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in [*header, CORRUPT]])
    rows = (spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
            .option("columnPruning", False)  # else fields of columns that nobody reads are not counted
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    return rows.select(*REQUIRED_COLUMNS, CORRUPT)


# A file's rows are numbered below this; the file's own number stands above it.
_ROWS_PER_FILE = 1 << 40


def with_row_ids(df: DataFrame, file_col: str = "file_path") -> DataFrame:
    """Replace ``file_col`` by ``row_id``: the file's number (by path) and the row's place in the file.

    A file that is read in one piece gives its rows in order, so the place is the
    distance from its first row, whatever files Spark packs into one partition.
    """
    numbered = df.withColumn("_at", F.monotonically_increasing_id())
    files = numbered.groupBy(file_col).agg(F.min("_at").alias("_first"))
    files = files.withColumn("_file", F.row_number().over(Window.orderBy(file_col)) - 1)  # one row per file
    return (numbered.join(files, file_col)
            .withColumn("row_id", F.col("_file") * F.lit(_ROWS_PER_FILE) + F.col("_at") - F.col("_first"))
            .drop(file_col, "_at", "_first", "_file"))


def load_labeled(spark: SparkSession, fake_path: str, true_path: str) -> DataFrame:
    """Both sources, each tagged with its label, unioned by name, with ids that depend on the files alone."""
    fake = read_article_csv(spark, fake_path).withColumn("label", F.lit(FAKE_LABEL))
    real = read_article_csv(spark, true_path).withColumn("label", F.lit(REAL_LABEL))
    return with_row_ids(union_sources([fake, real]))


def union_sources(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=False)
    return out


def _first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def _after_first_line(text: Column) -> Column:
    pos = F.instr(text, "\n")
    return F.when(text.isNull(), F.lit(None).cast("string")).when(
        pos > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.lit(""))


def articles_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an article, with its label where ``labels`` has one (else null).

    row_id = doc_id; title = first line of the document; text = the rest;
    subject = source; label = quality. Documents carry no date, so ``date`` is
    null (see ``dated_from_orders`` for the date operators). Queries that do not
    read the label let Catalyst drop the join's columns but keep every document.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (docs.join(labels, "doc_id", "left")
            .select(F.col("doc_id").alias("row_id"),
                    _first_line(F.col("text")).alias("title"),
                    _after_first_line(F.col("text")).alias("text"),
                    F.col("source").alias("subject"),
                    F.lit(None).cast("string").alias("date"),
                    F.col("quality").cast("int").alias("label")))


def unlabeled_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label: the 'new articles' to score."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = read_table(spark, sf_dir, "labels").select("doc_id")
    return (docs.join(labels, "doc_id", "left_anti")
            .select(F.col("doc_id").alias("row_id"),
                    _first_line(F.col("text")).alias("title"),
                    _after_first_line(F.col("text")).alias("text"),
                    F.col("source").alias("subject"),
                    F.lit(None).cast("string").alias("date")))


def dated_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date strings in mixed layouts, derived from ``orders``.

    Layout by o_orderkey % 16: 'MMMM d, yyyy', 'MMM d, yyyy ' (trailing space),
    'd-MMM-yy', a junk value (the order priority), 'yyyy-MM-dd', 'M/d/yyyy',
    'd MMMM yyyy', 'd MMM yyyy', 'MMM. d, yyyy', an ISO time stamp, 'd/M/yyyy',
    'yyyyMMdd', 'MMM d yyyy' in capitals, one with the weekday, 'M/d/yy', junk
    again. label = o_orderkey % 2.
    """
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey") % 16
    d = F.col("o_orderdate")
    date = (F.when(k == 0, F.date_format(d, "MMMM d, yyyy"))
            .when(k == 1, F.concat(F.date_format(d, "MMM d, yyyy"), F.lit(" ")))
            .when(k == 2, F.date_format(d, "d-MMM-yy"))
            .when(k == 4, F.date_format(d, "yyyy-MM-dd"))
            .when(k == 5, F.date_format(d, "M/d/yyyy"))
            .when(k == 6, F.date_format(d, "d MMMM yyyy"))
            .when(k == 7, F.date_format(d, "d MMM yyyy"))
            .when(k == 8, F.date_format(d, "MMM. d, yyyy"))
            .when(k == 9, F.date_format(d, "yyyy-MM-dd'T10:00:00Z'"))
            .when(k == 10, F.date_format(d, "d/M/yyyy"))
            .when(k == 11, F.date_format(d, "yyyyMMdd"))
            .when(k == 12, F.upper(F.date_format(d, "MMM d yyyy")))
            .when(k == 13, F.date_format(d, "EEEE, MMMM d, yyyy"))
            .when(k == 14, F.date_format(d, "M/d/yy"))
            .otherwise(F.col("o_orderpriority")))
    return o.select(F.col("o_orderkey").alias("row_id"), date.alias("date"),
                    (F.col("o_orderkey") % 2).cast("int").alias("label"))


def source_files(df: DataFrame) -> DataFrame:
    """Input files behind a file-based DataFrame: path, name and row count."""
    files = df.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"))
    return files.groupBy("file_path", "file_name").count()
