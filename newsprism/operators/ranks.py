"""Exact, deterministic rank within a class without a class-wide window.

A window partitioned only by label sends a whole class (possibly most rows) to
one task. Instead rows are ordered by ``md5(id || ':' || seed)``, and the first
hex digits of that hash pick one of ``16 ** bucket_digits`` buckets:

1. count rows per (label, bucket)            -> |labels| x buckets rows
2. prefix-sum those counts per label         -> a window over that small table
3. join the offsets back, null labels with null labels (the planner picks the join)
4. row_number inside (label, bucket) only    -> groups of n / buckets rows

rank = offset + row_number equals ``row_number() OVER (PARTITION BY label
ORDER BY hash, id)`` exactly, because the bucket is a prefix of the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def order_hash(id_col: str = "row_id", seed: int = 42) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def hash_rank(df: DataFrame, partition_col: str = "label", id_col: str = "row_id",
              seed: int = 42, bucket_digits: int = 3, rank_col: str = "rank",
              size_col: str = "class_size") -> DataFrame:
    """Add ``rank`` (1-based, by hash within ``partition_col``) and the class size."""
    keyed = (df.withColumn("_h", order_hash(id_col, seed))
               .withColumn("_b", F.conv(F.substring("_h", 1, bucket_digits), 16, 10).cast("int")))
    counts = keyed.groupBy(partition_col, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    by_class = Window.partitionBy(partition_col)
    before = by_class.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(partition_col, "_b",
                            F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"),
                            F.sum("_bn").over(by_class).alias(size_col))
    offsets = offsets.withColumnsRenamed({partition_col: "_p", "_b": "_ob"})
    joined = keyed.join(offsets, keyed[partition_col].eqNullSafe(offsets["_p"]) & (keyed["_b"] == offsets["_ob"]))
    within = Window.partitionBy(partition_col, "_b").orderBy("_h", id_col)
    return (joined.withColumn(rank_col, F.col("_off") + F.row_number().over(within))
            .drop("_h", "_b", "_off", "_p", "_ob"))


def rank_cuts(df: DataFrame, positions: dict[str, Column], partition_col: str = "label", id_col: str = "row_id",
              seed: int = 42, bucket_digits: int = 3) -> DataFrame:
    """One row per class: ``partition_col``, ``n`` and, for each name, the (hash, id) key at that rank.

    ``positions`` are ranks as expressions over the class size ``n``; rank 0 or less
    gives a null key. Ids and labels alone are counted per bucket; just the buckets
    that hold a wanted rank are then ordered. A row has rank <= r exactly if its
    ``rank_key`` is at most the key at r, so callers need no rank per row.
    """
    keyed = df.select(F.col(partition_col).alias("_p"), rank_key(id_col, seed).alias("_key"))
    keyed = keyed.withColumn("_b", F.conv(F.substring("_key.h", 1, bucket_digits), 16, 10).cast("int"))
    counts = keyed.groupBy("_p", "_b").agg(F.count(F.lit(1)).alias("_bn"))
    by_class = Window.partitionBy("_p")
    before = by_class.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.withColumns({"_off": F.coalesce(F.sum("_bn").over(before), F.lit(0)),
                                  "n": F.sum("_bn").over(by_class)})
    asked = F.array(*[F.struct(F.lit(name).alias("_name"), at.cast("long").alias("_at")) for name, at in positions.items()])
    asked = buckets.select("*", F.inline(asked))
    holding = asked.where((F.col("_at") > F.col("_off")) & (F.col("_at") <= F.col("_off") + F.col("_bn")))
    holding = holding.select(F.col("_p").alias("_hp"), F.col("_b").alias("_hb"), "_name", (F.col("_at") - F.col("_off")).alias("_nth"))
    inside = keyed.join(holding, keyed["_p"].eqNullSafe(holding["_hp"]) & (keyed["_b"] == holding["_hb"]))
    order = Window.partitionBy("_p", "_name").orderBy("_key")
    hit = inside.withColumn("_rank", F.row_number().over(order)).where("_rank = _nth")
    keys = hit.groupBy(F.col("_p").alias("_kp")).agg(*[
        F.max(F.when(F.col("_name") == name, F.col("_key"))).alias(name) for name in positions])
    sizes = counts.groupBy("_p").agg(F.sum("_bn").alias("n"))
    return (sizes.join(keys, sizes["_p"].eqNullSafe(keys["_kp"]), "left")
            .select(F.col("_p").alias(partition_col), "n", *positions))


def rank_key(id_col: str = "row_id", seed: int = 42) -> Column:
    """Orders rows as their rank does: hash, then id."""
    return F.struct(order_hash(id_col, seed).alias("h"), F.col(id_col).alias("id"))


def within_cut(cut: Column, id_col: str = "row_id", seed: int = 42) -> Column:
    """Whether a row's rank is at most that of ``cut``; false for a null cut."""
    return F.coalesce(rank_key(id_col, seed) <= cut, F.lit(False))
