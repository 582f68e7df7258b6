"""Exact binary-classification metrics as aggregate queries.

All metrics derive from one conditional-count pass per group (tp, tn, fp, fn)
plus, where needed, a log-loss sum in the same pass and a scalable exact
ROC-AUC. Output is long form ``(*group, metric, value)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsprism.functions import text as tx
from newsprism.functions.reshape import rows_from
from newsprism.session import cut_lineage

# Fixed value: float64 machine epsilon, the probability clip of the log loss.
LOG_LOSS_EPS = 2.220446049250313e-16

#: Epochs that one training run may have in ``select_best_run``.
MAX_EPOCHS = 100_000


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def binary_counts(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                  group_cols: Sequence[str] = (), prob_col: str | None = None) -> DataFrame:
    """One row per group: tp, tn, fp, fn (class 1 positive) and optionally the log-loss sum.

    Rows whose label lies outside {0, 1} (or is null) count nowhere; those whose
    probability is null or NaN are left out of the log loss.
    """
    y, yhat = F.col(label_col), F.col(pred_col)
    aggs = [F.count_if((y == 1) & (yhat == 1)).alias("tp"), F.count_if((y == 0) & (yhat == 0)).alias("tn"),
            F.count_if((y == 0) & (yhat == 1)).alias("fp"), F.count_if((y == 1) & (yhat == 0)).alias("fn")]
    if prob_col:
        p_true = F.when(y == 1, F.col(prob_col)).otherwise(1.0 - F.col(prob_col))
        clipped = F.greatest(F.least(p_true, F.lit(1.0 - LOG_LOSS_EPS)), F.lit(LOG_LOSS_EPS))
        known = y.isin(0, 1) & F.col(prob_col).isNotNull() & ~F.isnan(F.col(prob_col).cast("double"))
        aggs += [F.sum(F.when(known, -F.log(clipped))).alias("_ll_sum"), F.count_if(known).alias("_ll_n")]
    gb = df.groupBy(*group_cols) if group_cols else df.groupBy()
    return gb.agg(*aggs)


def confusion(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
              group_cols: Sequence[str] = ()) -> DataFrame:
    """Full 2x2 domain (zero cells included): (*group, label, prediction, count)."""
    c = binary_counts(df, label_col, pred_col, group_cols)
    cells = "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (label, prediction, count)"
    out = c.selectExpr(*group_cols, cells)
    return out.select(*group_cols, F.col("label").cast("int"), F.col("prediction").cast("int"), "count")


def _class_columns() -> tuple[Column, ...]:
    """Counts as doubles, so that products of large counts cannot overflow."""
    return tuple(F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))


def _macro(of_0: Column, of_1: Column) -> Column:
    """Mean over the classes present in truth or prediction."""
    tp, tn, fp, fn = _class_columns()
    in_0, in_1 = (tn + fp + fn > 0).cast("int"), (tp + fp + fn > 0).cast("int")
    return _safe_div(of_0 * in_0 + of_1 * in_1, in_0 + in_1)


def metric_columns(weighted: bool = False) -> dict[str, Column]:
    """Closed forms over tp/tn/fp/fn with zero_division = 0."""
    tp, tn, fp, fn = _class_columns()
    n = tp + tn + fp + fn
    s1, s0 = tp + fn, tn + fp                      # support per true class
    p1, p0 = _safe_div(tp, tp + fp), _safe_div(tn, tn + fn)
    r1, r0 = _safe_div(tp, s1), _safe_div(tn, s0)
    f1_1, f1_0 = _safe_div(2 * tp, 2 * tp + fp + fn), _safe_div(2 * tn, 2 * tn + fn + fp)
    present = (s1 > 0).cast("int") + (s0 > 0).cast("int")
    bal = _safe_div(F.when(s1 > 0, r1).otherwise(0.0) + F.when(s0 > 0, r0).otherwise(0.0), present)
    den = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    cols = {
        "accuracy": _safe_div(tp + tn, n),
        "balanced_accuracy": bal,
        "precision_macro": _macro(p0, p1),
        "recall_macro": _macro(r0, r1),
        "f1_macro": _macro(f1_0, f1_1),
        "mcc": _safe_div(tp * tn - fp * fn, den),
    }
    if weighted:
        cols["precision_weighted"] = _safe_div(p0 * s0 + p1 * s1, n)
        cols["recall_weighted"] = _safe_div(r0 * s0 + r1 * s1, n)
        cols["f1_weighted"] = _safe_div(f1_0 * s0 + f1_1 * s1, n)
    return cols


def _long(wide: DataFrame, group_cols: Sequence[str], names: Sequence[str]) -> DataFrame:
    stacked = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in names)
    out = wide.selectExpr(*group_cols, f"stack({len(names)}, {stacked}) AS (metric, value)")
    return out.withColumn("value", F.round("value", 6))


def roc_auc(df: DataFrame, label_col: str = "label", score_col: str = "p",
            group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC (ties count 1/2) per group: (*group, roc_auc); null if a class is absent.

    Rows with a null or NaN score take no part; infinite scores are the extremes they are.
    AUC = sum_s pos_s * (neg_below_s + neg_s / 2) / (P * N) over distinct scores s.
    Distinct (group, score) rows are range partitioned, so every partition holds a
    stretch of scores; its totals are prefix-summed over the partitions (a table of
    groups x partitions rows) and only the rest is a window inside a partition. A
    score shared by a third of all rows is a single row after the first aggregation.
    The range-partitioned table feeds both, so it is written once to the shared folder.
    """
    g = list(group_cols) or ["_g"]
    base = df if group_cols else df.withColumn("_g", F.lit(0))
    y = F.col(label_col)
    there = F.col(score_col).isNotNull() & ~F.isnan(F.col(score_col).cast("double"))
    dist = base.where(there).groupBy(*g, score_col).agg(
        F.count_if(y == 1).alias("_pos"), F.count_if(y == 0).alias("_neg"))
    dist = cut_lineage(dist.repartitionByRange(*g, score_col).withColumn("_b", F.spark_partition_id()))
    totals = dist.groupBy(*g, "_b").agg(F.sum("_neg").alias("_bneg"), F.sum("_pos").alias("_bpos"))
    by_group = Window.partitionBy(*g)
    offsets = totals.select(
        *g, "_b",
        F.coalesce(F.sum("_bneg").over(by_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_bpos").over(by_group).alias("_P"), F.sum("_bneg").over(by_group).alias("_N"))
    within = Window.partitionBy(*g, "_b").orderBy(score_col).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_neg").over(within), F.lit(0))
    part = F.col("_pos").cast("double") * (F.col("_below") + F.col("_neg") / 2.0)
    inside = (dist.withColumn("_below", below).groupBy(*g, "_b")
              .agg(F.sum(part).alias("_s"), F.sum("_pos").alias("_here")))
    out = inside.join(offsets, g + ["_b"]).groupBy(*g).agg(
        F.sum(F.col("_s") + F.col("_here").cast("double") * F.col("_off")).alias("_s"),
        F.first("_P").alias("_P"), F.first("_N").alias("_N"))
    auc = F.when((F.col("_P") == 0) | (F.col("_N") == 0), F.lit(None).cast("double")).otherwise(
        F.col("_s") / (F.col("_P").cast("double") * F.col("_N").cast("double")))
    return out.select(*group_cols, F.round(auc, 6).alias("roc_auc"))


def log_loss(df: DataFrame, label_col: str = "label", prob_col: str = "p",
             group_cols: Sequence[str] = ()) -> DataFrame:
    c = binary_counts(df, label_col, label_col, group_cols, prob_col)
    return c.select(*group_cols, F.round(F.col("_ll_sum") / F.col("_ll_n"), 6).alias("log_loss"))


def classification_metrics(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                           prob_col: str | None = "p", group_cols: Sequence[str] = (),
                           weighted: bool = False) -> DataFrame:
    """accuracy, balanced accuracy, macro P/R/F1, MCC (+ weighted), ROC-AUC, log loss.

    With a probability the four columns needed are written once, as counts and
    ROC-AUC both read them.
    """
    if prob_col:
        df = cut_lineage(df.select(*group_cols, label_col, pred_col, prob_col))
    counts = binary_counts(df, label_col, pred_col, group_cols, prob_col)
    cols = metric_columns(weighted)
    if prob_col:
        cols["log_loss"] = F.col("_ll_sum") / F.col("_ll_n")
    wide = counts.select(*group_cols, *[c.alias(k) for k, c in cols.items()])
    out = _long(wide, group_cols, list(cols))
    if prob_col:
        auc = roc_auc(df, label_col, prob_col, group_cols)
        out = out.unionByName(auc.select(*group_cols, F.lit("roc_auc").alias("metric"),
                                         F.col("roc_auc").alias("value")))
    return out


def classification_report(df: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """Per-class precision/recall/f1/support plus accuracy, macro avg and weighted avg rows."""
    c = binary_counts(df, label_col, pred_col)
    tp, tn, fp, fn = _class_columns()
    n = tp + tn + fp + fn
    p1, p0 = _safe_div(tp, tp + fp), _safe_div(tn, tn + fn)
    r1, r0 = _safe_div(tp, tp + fn), _safe_div(tn, tn + fp)
    f1, f0 = _safe_div(2 * tp, 2 * tp + fp + fn), _safe_div(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp

    def row(name, p, r, f, s):
        return {"row": F.lit(name), "precision": F.round(p, 6), "recall": F.round(r, 6),
                "f1_score": F.round(f, 6), "support": s.cast("bigint")}

    return rows_from(c, [row("0", p0, r0, f0, s0), row("1", p1, r1, f1, s1),
                         row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), _safe_div(tp + tn, n), n),
                         row("macro avg", _macro(p0, p1), _macro(r0, r1), _macro(f0, f1), n),
                         row("weighted avg", _safe_div(p0 * s0 + p1 * s1, n), _safe_div(r0 * s0 + r1 * s1, n),
                             _safe_div(f0 * s0 + f1 * s1, n), n)])


def error_rates(df: DataFrame, group_col: str = "split", label_col: str = "label",
                pred_col: str = "prediction") -> DataFrame:
    correct = tx.correct_flag(pred_col, label_col).cast("double")
    return df.groupBy(group_col).agg(F.round(1.0 - F.avg(correct), 6).alias("error_rate"))


def train_val_gap(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                  split_col: str = "split") -> DataFrame:
    correct = tx.correct_flag(pred_col, label_col).cast("double")
    acc = {s: F.avg(F.when(F.col(split_col) == s, correct)) for s in ("train", "validation")}
    return df.agg(F.round(acc["train"], 6).alias("train_accuracy"),
                  F.round(acc["validation"], 6).alias("validation_accuracy"),
                  F.round(acc["train"] - acc["validation"], 6).alias("gap"))


#: Values that one selection may fetch, and the points that bracket a rank.
FETCHED, PIVOTS = 100_000, 4096


def bracket(dist: DataFrame, col: str, count_col: str, ranks: Sequence[int], pivots: int = PIVOTS) -> list[tuple]:
    """(low, high, rows below low) around each 0-based rank of (value, count) rows, by one job.

    The rows are range partitioned by value; partitions are cut into stretches of equal
    numbers of rows, whose first value, last value and count are all that reaches the driver.
    """
    spark = dist.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stretch = F.floor(F.row_number().over(Window.partitionBy("_p").orderBy(col)) * F.lit(max(1, pivots // parts))
                      / F.count(F.lit(1)).over(Window.partitionBy("_p")))
    dealt = dist.repartitionByRange(parts, col).withColumn("_p", F.spark_partition_id()).withColumn("_s", stretch)
    table = dealt.groupBy("_p", "_s").agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.sum(count_col).alias("n")).collect()
    out, below = [], 0
    asked = sorted(ranks)
    for r in sorted(table, key=lambda r: (r["lo"], r["hi"])):
        while len(out) < len(asked) and asked[len(out)] < below + r["n"]:
            out.append((r["lo"], r["hi"], below))
        below += r["n"]
    return out


def values_at_ranks(dist: DataFrame, col: str, count_col: str, ranks: Sequence[int], fetched: int = FETCHED) -> list:
    """The values at 0-based ``ranks`` (sorted) among (value, count) rows with distinct values other than NaN.

    One job brackets the ranks, a second fetches the brackets; a bracket that holds more
    than ``fetched`` distinct values is bracketed again, which shrinks it by the number
    of pivots each time, whatever the values are (infinities too).
    """
    out = []
    for rank, (low, high, below) in zip(sorted(ranks), bracket(dist, col, count_col, ranks)):
        inside = dist.where(F.col(col).between(low, high))
        while inside.count() > fetched:
            low, high, more = bracket(inside, col, count_col, [rank - below])[0]
            below += more
            inside = dist.where(F.col(col).between(low, high))
        for value, count in sorted(tuple(r) for r in inside.select(col, count_col).collect()):
            below += count
            if below > rank:
                out.append(value)
                break
    return out


def latency_stats(df: DataFrame, col: str = "latency_seconds") -> DataFrame:
    """mean / exact median / min / max; null, NaN and infinite values take no part.

    A hot value collapses before the shuffle. The median is selected by pivots that
    bracket its rank and a fetch of the bracket, so no task ever holds all values.
    """
    x = F.col(col).cast("double")
    dist = cut_lineage(_finite(df, col).groupBy(x.alias(col)).agg(F.count(F.lit(1)).alias("_n")))
    total = dist.agg(F.sum("_n")).first()[0] or 0
    median = None
    if total:
        middle = values_at_ranks(dist, col, "_n", sorted({(total - 1) // 2, total // 2}))
        median = sum(middle) / len(middle)
    return dist.agg(F.round(F.sum(F.col(col) * F.col("_n")) / F.sum("_n"), 6).alias("mean"),
                    F.round(F.lit(median).cast("double"), 6).alias("median"),
                    F.min(col).alias("min"), F.max(col).alias("max"))


def _finite(df: DataFrame, col: str) -> DataFrame:
    x = F.col(col).cast("double")
    return df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def latency_histogram(df: DataFrame, col: str = "latency_seconds", bins: int = 20) -> DataFrame:
    """Equal-width bins between min and max (last bin closed); empty bins kept.

    Null, NaN and infinite values take no part, as in ``latency_stats``. The range is one
    bounded collect; the bin domain is ``spark.range(bins)``.
    """
    x = _finite(df, col)
    row = x.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = row["lo"], row["hi"]
    if lo is None:
        lo, hi = 0.0, 1.0
    lo, hi = float(lo), float(hi)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    part = 0.5 ** (bins.bit_length() + 2)  # scaled down by a power of two: exact, and no range overflows
    span = hi * part - lo * part
    width = span / bins / part
    b = F.least(F.floor((F.col(col) * F.lit(part) - F.lit(lo * part)) * F.lit(float(bins)) / F.lit(span)), F.lit(bins - 1))
    counts = x.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    domain = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (domain.join(F.broadcast(counts), "bin", "left")
            .select("bin", F.round(F.lit(lo) + F.col("bin") * F.lit(width), 6).alias("lower"),
                    F.round(F.lit(lo) + (F.col("bin") + 1) * F.lit(width), 6).alias("upper"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def valid_invalid_counts(df: DataFrame, pred_col: str = "prediction") -> DataFrame:
    return df.agg(F.count(pred_col).alias("valid_predictions"),
                  (F.count(F.lit(1)) - F.count(pred_col)).alias("invalid_predictions"))


def ms_per_article(df: DataFrame, seconds_col: str = "latency_seconds") -> DataFrame:
    return df.agg(F.round(1000.0 * F.sum(seconds_col) / F.count(F.lit(1)), 6).alias("ms_per_article"))


def evaluate_zero_shot(details: DataFrame, label_col: str = "true_label", pred_col: str = "prediction",
                       latency_col: str = "latency_seconds") -> DataFrame:
    """Metrics and the fixed-domain confusion on parsed answers only, plus mean latency and valid/invalid counts.

    One pass over the details; raises when no answer could be parsed.
    """
    known, answered = F.col(label_col).isin(0, 1), F.col(pred_col).isNotNull()
    y, yhat = F.col(label_col), F.col(pred_col)
    wide = details.agg(
        *[F.count_if(known & (y == a) & (yhat == b)).alias(name) for name, a, b in _CELLS],
        F.avg(F.when(answered, F.col(latency_col))).alias("average_latency_seconds"),
        F.count_if(answered).alias("valid_predictions"), F.count_if(~answered).alias("invalid_predictions"))
    row = wide.first()  # one row
    if not row["valid_predictions"]:
        raise RuntimeError("no valid generator answer")
    wide = details.sparkSession.createDataFrame([tuple(row)], wide.schema)
    cols = metric_columns(False)
    names = ["average_latency_seconds", "valid_predictions", "invalid_predictions"]
    cells = {f"confusion_{a}_{b}": F.col(name) for name, a, b in _CELLS}
    out = wide.select(*[c.alias(k) for k, c in (cols | cells).items()], *names)
    return _long(out, (), [*cols, *cells, *names])


# counts of the 2 x 2 domain: name, label, prediction
_CELLS = (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))


def select_best_run(history: DataFrame, run_col: str = "run_id", epoch_col: str = "epoch",
                    f1_col: str = "f1", loss_col: str = "loss") -> DataFrame:
    """Best epoch per run, scanned in epoch order: higher F1 wins; an F1 equal within
    |a - b| <= 1e-8 + 1e-5 * |b| wins only with a lower loss. A run's epochs are
    folded inside one row; MAX_EPOCHS bounds them, a longer run raises."""
    hist = history.groupBy(run_col).agg(
        F.sort_array(F.collect_list(F.struct(F.col(epoch_col).alias("epoch"), F.col(f1_col).alias("f1"),
                                             F.col(loss_col).alias("loss")))).alias("_h"))

    def better(acc, x):
        close = F.abs(x["f1"] - acc["f1"]) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(acc["f1"])
        return F.when((x["f1"] > acc["f1"]) | (close & (x["loss"] < acc["loss"])), x).otherwise(acc)

    too_long = F.raise_error(F.lit(f"a run has more than {MAX_EPOCHS} epochs"))
    hist = hist.withColumn("_h", F.when(F.size("_h") <= MAX_EPOCHS, F.col("_h")).otherwise(too_long))
    best = F.aggregate(F.slice("_h", 2, F.greatest(F.size("_h") - 1, F.lit(0))), F.element_at("_h", 1), better)
    return hist.select(run_col, best["epoch"].alias("best_epoch"), best["f1"].alias("best_f1"),
                       best["loss"].alias("best_loss"))
