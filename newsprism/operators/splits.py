"""Reproducible stratified splits, folds, samples and shuffles.

Random draws of other libraries cannot be reproduced; the contract here is
determinism (hash order), exact per-class stratification and the fractions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsprism.operators.ranks import hash_rank, rank_cuts, within_cut
from newsprism.session import cut_lineage
from newsprism.sources.articles import LABEL_DOMAIN


def split_counts(n: int, test_size: float = 0.15, validation_size: float = 0.15) -> tuple[int, int, int]:
    """(train, validation, test) sizes for a class of n rows (same rule as the Spark column)."""
    hold = math.ceil(n * (test_size + validation_size))
    test = math.ceil(hold * (test_size / (test_size + validation_size)))
    return n - hold, hold - test, test


def stratified_split(df: DataFrame, test_size: float = 0.15, validation_size: float = 0.15,
                     seed: int = 42, label_col: str = "label", id_col: str = "row_id") -> DataFrame:
    """Add ``split`` in {train, validation, test}.

    Per class of n rows: holdout = ceil(n * (test + validation)), of which
    test = ceil(holdout * test / (test + validation)); rows are taken in hash
    order. Train share is 1 - test - validation within one row per class. Rows
    with a null label are a class of their own. Two cut keys per class decide;
    rows are never ranked or shuffled.
    """
    hold = F.ceil(F.col("n") * F.lit(float(test_size + validation_size)))
    n_train = F.col("n") - hold
    n_val = hold - F.ceil(hold * F.lit(float(test_size / (test_size + validation_size))))
    cuts = rank_cuts(df, {"_train": n_train, "_validation": n_train + n_val}, label_col, id_col, seed)
    cuts = cuts.withColumnRenamed(label_col, "_label")
    split = (F.when(within_cut(F.col("_train"), id_col, seed), F.lit("train"))
             .when(within_cut(F.col("_validation"), id_col, seed), F.lit("validation"))
             .otherwise(F.lit("test")))
    # one row per label: without the hint the planner, which does not know it, shuffles the texts by label
    return (df.join(F.broadcast(cuts), df[label_col].eqNullSafe(cuts["_label"]))
            .select(*df.columns, split.alias("split")))


def stratified_kfold(df: DataFrame, k: int = 5, seed: int = 42, label_col: str = "label",
                     id_col: str = "row_id") -> DataFrame:
    """``fold`` = (rank within class - 1) mod k: every fold gets each class within one row.

    The column can feed ``CrossValidator(foldCol="fold")``.
    """
    ranked = hash_rank(df, label_col, id_col, seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "class_size")


def stratified_sample(df: DataFrame, per_class: int = 50, seed: int = 42,
                      domain: Sequence[int] = LABEL_DOMAIN, label_col: str = "label",
                      id_col: str = "row_id") -> DataFrame:
    """``per_class`` rows of every label in ``domain``; raises if a class is too small.

    The size check collects one count per label (bounded by the domain).
    """
    counts = {r[label_col]: r["count"] for r in
              df.groupBy(label_col).count().filter(F.col(label_col).isin(*domain)).collect()}
    if any(counts.get(v, 0) < per_class for v in domain):
        raise ValueError("not enough articles for the stratified sample")
    wanted = df.filter(F.col(label_col).isin(*domain))
    cuts = rank_cuts(wanted, {"_last": F.lit(per_class)}, label_col, id_col, seed).withColumnRenamed(label_col, "_label")
    chosen = wanted.join(F.broadcast(cuts), wanted[label_col] == cuts["_label"]).where(within_cut(F.col("_last"), id_col, seed))
    return chosen.select(*df.columns)


#: Rounds of the permutation, and steps after which a walk back into the domain is given up (chance below 2^-128 per row).
ROUNDS, WALK = 4, 128


def dense_ids(df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(id, place): 0-based place of each row in the order of ``id_col`` (repeated ids: some order), by range partitions."""
    dealt = cut_lineage(df.select(id_col).repartitionByRange(id_col).sortWithinPartitions(id_col)
                        .withColumns({"_p": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = (dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
               .select("_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    return dealt.join(offsets, "_p").select(id_col, (F.col("_off") + F.col("_at") - F.col("_first")).alias("place"))


def permuted(place: Column, n: int, seed: int = 42) -> Column:
    """Place of ``place`` under a keyed permutation of 0 ... n - 1, a Feistel network that walks back into the domain.

    The numbers below the next power of two are permuted in rounds: their two halves of
    bits swap, one of them xored with a hash of the other. Results of n or more are
    permuted again until they are smaller.
    """
    bits = max(2, (n - 1).bit_length())

    def once(value: Column, step: int = 0) -> Column:
        left, right = (bits // 2, bits - bits // 2) if step % 2 == 0 else (bits - bits // 2, bits // 2)

        def swapped(v: Column) -> Column:
            high, low = F.shiftright(v, right), v.bitwiseAND(F.lit((1 << right) - 1))
            hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(step)), low.cast("string")))
            mixed = F.conv(F.substring(hashed, 1, 12), 16, 10).cast("long").bitwiseAND(F.lit((1 << left) - 1))
            return F.shiftleft(low, left).bitwiseOR(high.bitwiseXOR(mixed))

        value = F.transform(F.array(value), swapped)[0]  # bound once per round
        return value if step == ROUNDS - 1 else once(value, step + 1)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(place.cast("long")),
                         lambda value, _: F.when(value >= n, once(value)).otherwise(value))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the walk did not return")))


def shuffle_rows(df: DataFrame, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """Every row with its new ``position``, a permutation of 0 ... n - 1 that depends on the ids and the seed alone.

    No total sort: ids are numbered by range partitions and the position is computed in
    the row. Relations are unordered, so sort by it only where ordered rows are emitted.
    Ids are taken to be distinct.
    """
    places = dense_ids(df, id_col)
    n = places.count()
    return df.join(places.select(id_col, permuted(F.col("place"), n, seed).alias("position")), id_col)
