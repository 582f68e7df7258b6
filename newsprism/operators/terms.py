"""Tokens, n-grams, vocabularies and TF-IDF in long form ``(row_id, term, value)``.

Semantics follow the usual scikit-learn text vectoriser defaults the reference
relies on: lower-case, tokens of two or more word characters, stop words
removed *before* n-grams, vocabulary = terms with document frequency >=
min_df, top ``max_features`` by total count (ties by term), smooth IDF
ln((1+n)/(1+df)) + 1, raw counts times IDF, rows L2-normalised.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsprism.functions.stopwords import ENGLISH_STOP_WORDS
from newsprism.session import cut_lineage, drop_cut, reach_workers
from newsprism.sources.articles import LABEL_DOMAIN

# Two or more letters / digits / underscores (Python's \w\w+ on Unicode text).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

#: Hash slices of a class's terms that are ranked apart before the class as a whole.
SLICES = 64

#: Entries of documents that are weighted at once.
ENTRIES = 1 << 18

#: Cells into which ``heavy_stats`` hashes terms: a bound on the rows that it broadcasts.
CELLS = 1 << 20


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokenize(col) -> Column:
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TOKEN_PATTERN), 0)


def remove_stop_words(tokens, stop_words: Sequence[str] | None = ENGLISH_STOP_WORDS) -> Column:
    """Drop stop words, keeping order and repeats (the IN list becomes a hash set)."""
    if not stop_words:
        return _c(tokens)
    return F.filter(_c(tokens), lambda t: ~t.isin(*stop_words))


def ngrams(tokens, n: int) -> Column:
    """Space-joined n-grams of consecutive tokens.

    Built by zipping n shifted slices of the token array, so the array is
    referenced only outside lambdas and each document costs O(tokens).
    """
    t = _c(tokens)
    if n == 1:
        return t
    length = F.size(t) - n + 1
    grams = F.slice(t, 1, length)
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(t, k + 1, length), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))


def analyzed_terms(col, ngram_range: tuple[int, int] = (1, 1),
                   stop_words: Sequence[str] | None = ENGLISH_STOP_WORDS) -> Column:
    """tokenize -> stop words -> n-grams for every n in the (inclusive) range."""
    return analyzed_tokens(tokenize(col), ngram_range, stop_words)


def analyzed_tokens(tokens, ngram_range: tuple[int, int] = (1, 1),
                    stop_words: Sequence[str] | None = ENGLISH_STOP_WORDS) -> Column:
    """``analyzed_terms`` of a text's tokens."""
    toks = remove_stop_words(tokens, stop_words)
    lo, hi = ngram_range
    parts = [ngrams(toks, n) for n in range(lo, hi + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def counted(terms: Column) -> Column:
    """array<struct<term, tf>> of an array of terms: sorted, then run lengths, inside the row."""
    def of(ordered: Column) -> Column:
        size = F.size(ordered)
        starts = F.filter(F.transform(ordered, lambda t, i: F.when(
            (i == 0) | (t != F.get(ordered, i - 1)), i)), lambda i: i.isNotNull())
        ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(size))
        # an empty row has no start; its lone end pairs with null and is filtered out
        runs = F.zip_with(starts, ends, lambda a, b: F.struct(F.get(ordered, a).alias("term"),
                                                              (b - a).cast("long").alias("tf")))
        return F.filter(runs, lambda r: r["term"].isNotNull())
    return F.transform(F.array(F.sort_array(terms)), of)[0]


def term_rows(df: DataFrame, text_col: str, keep: Sequence[str] = ("row_id",), ngram_range: tuple[int, int] = (1, 1),
              stop_words: Sequence[str] | None = ENGLISH_STOP_WORDS) -> DataFrame:
    """(*keep, terms): one row per document with its array of (term, tf), sorted by term; no exchange."""
    text = F.coalesce(_c(text_col), F.lit(""))
    return df.select(*keep, counted(analyzed_terms(text, ngram_range, stop_words)).alias("terms"))


def term_frequencies(df: DataFrame, text_col: str, id_col: str = "row_id",
                     ngram_range: tuple[int, int] = (1, 1),
                     stop_words: Sequence[str] | None = ENGLISH_STOP_WORDS,
                     keep: Sequence[str] = ()) -> DataFrame:
    """Long form ``(id, *keep, term, tf)``, counted inside each document's row: no exchange."""
    return term_rows(df, text_col, (id_col, *keep), ngram_range, stop_words).select(id_col, *keep, F.inline("terms"))


def term_stats(tf_long: DataFrame, rows: Column | None = None) -> DataFrame:
    """(term, doc_freq, total_count): partial aggregation before the shuffle.

    ``rows`` restricts the counts to matching rows (e.g. the train split) as
    conditional aggregates, so a plan that also joins ``tf_long`` back keeps
    one identical tf subtree and Spark reuses its exchange instead of
    tokenising twice.
    """
    if rows is None:
        return tf_long.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"),
                                           F.sum("tf").alias("total_count"))
    return tf_long.groupBy("term").agg(F.count_if(rows).alias("doc_freq"),
                                       F.sum(F.when(rows, F.col("tf"))).alias("total_count"))


def stats_of(df: DataFrame, terms_col: str) -> DataFrame:
    """(term, doc_freq, total_count) straight from rows with an array of terms.

    Each row gives its distinct terms and all its terms; the partial aggregation collapses
    both before the one shuffle, so no row is sorted and counted by itself.
    """
    return _sums(_occurrences(df, terms_col), "term")


def _occurrences(df: DataFrame, terms_col: str, *keep: str) -> DataFrame:
    """(*keep, _kind, term): of each row its distinct terms, kind 0, and all its terms, kind 1."""
    both = df.select(*keep, F.posexplode(F.array(F.array_distinct(terms_col), F.col(terms_col))).alias("_kind", "_terms"))
    return both.select(*keep, "_kind", F.explode("_terms").alias("term"))


def _celled(occurrences: DataFrame, cells: int) -> DataFrame:
    return occurrences.withColumn("_cell", F.pmod(F.xxhash64("term"), F.lit(cells)).cast("int"))


def _sums(occurrences: DataFrame, key: str) -> DataFrame:
    return occurrences.groupBy(key).agg(F.count_if(F.col("_kind") == 0).alias("doc_freq"),
                                        F.count_if(F.col("_kind") == 1).alias("total_count"))


def heavy_stats(df: DataFrame, terms_col: str, min_df: int = 2, max_features: int | None = 20000,
                cells: int = CELLS) -> DataFrame:
    """The rows of ``stats_of`` from which ``vocabulary_of`` chooses; terms that cannot get in are not shuffled.

    One pass sums documents and occurrences per hash cell, ``cells`` rows at most whatever
    the number of terms. A cell's sums are at least those of each of its terms, so terms of
    cells below ``min_df`` documents, or below a count that ``max_features`` other terms
    reach, are out. That count is first guessed from the cells and only their terms are
    counted exactly; where fewer terms than asked for reach the guess, the count that so
    many do reach is a proven one, and a second pass takes all terms of its cells. Terms
    equal to the last one's count are kept, so ties are settled as over all terms.

    Rows are read two or three times: give a cut of them. A null array has no terms; an
    empty table gives no rows.
    """
    every = _celled(_occurrences(df, terms_col), cells)
    sums = cut_lineage(_sums(every, "_cell").where(F.col("doc_freq") >= min_df))

    def counted_exactly(least: int) -> DataFrame:
        kept = F.broadcast(sums.where(F.col("total_count") >= least).select("_cell"))
        return cut_lineage(_sums(every.join(kept, "_cell", "left_semi"), "term").where(F.col("doc_freq") >= min_df))

    guess = 0 if max_features is None else _reached_by(sums, 2 * max_features)
    stats = counted_exactly(guess)
    if guess:
        proven = _reached_by(stats, max_features)
        if proven < guess:
            drop_cut(stats)
            stats = counted_exactly(proven)
    drop_cut(sums)
    return stats


def _reached_by(counts: DataFrame, n: int) -> int:
    """The largest total_count that ``n`` rows reach; 0 if there are fewer rows."""
    last = _last_count(counts, n).first()
    return last["_least"] if last["_all"] and last["_all"] >= n else 0


def left_out_stats(df: DataFrame, terms_col: str, fold_col: str, folds: int, choices: Sequence[tuple[int, int]],
                   cells: int = CELLS) -> DataFrame:
    """(term, doc_freq, total_count): arrays of the counts without fold 0, 1, ... in turn, and last of all rows.

    Holds every term that gets into a vocabulary of any of these row sets for any of the
    ``choices`` (min_df, max_features). As in ``heavy_stats`` terms of light hash cells are
    not shuffled: a term's count without a fold is at most its count, so a count that
    ``max_features`` terms reach whichever fold is left out keeps all lighter terms out.

    Rows are read two or three times. Folds are 0 ... ``folds`` - 1; a null array has no terms.
    """
    every = _celled(_occurrences(df, terms_col, fold_col), cells)
    least_df = min(min_df for min_df, _ in choices)
    sums = cut_lineage(_sums(every, "_cell").where(F.col("doc_freq") >= least_df))

    def counted_exactly(least: int) -> DataFrame:
        kept = F.broadcast(sums.where(F.col("total_count") >= least).select("_cell"))
        own = {(kind, f): F.count_if((F.col("_kind") == kind) & (F.col(fold_col) == f)) for kind in (0, 1) for f in range(folds)}
        counts = every.join(kept, "_cell", "left_semi").groupBy("term").agg(*[c.alias(f"_{k}_{f}") for (k, f), c in own.items()])

        def without(kind: int) -> Column:
            parts = [F.col(f"_{kind}_{f}") for f in range(folds)]
            whole = functools.reduce(lambda a, b: a + b, parts)
            return F.array(*[whole - part for part in parts], whole)

        counts = counts.select("term", without(0).alias("doc_freq"), without(1).alias("total_count"))
        return cut_lineage(counts.where(F.col("doc_freq")[folds] >= least_df))

    def proven(stats: DataFrame) -> int:
        reach = []
        for i, (min_df, max_features) in enumerate(choices):
            each = vocabulary_cells(stats, folds + 1, min_df).groupBy("cell", "total_count").agg(F.count(F.lit(1)).alias("_n"))
            upto = F.sum("_n").over(Window.partitionBy("cell").orderBy(F.desc("total_count")))  # distinct counts, as in _last_count
            reach.append(each.withColumn("_upto", upto).where(F.col("_upto") >= max_features).groupBy("cell")
                         .agg(F.max("total_count").alias("_least")))
        found = functools.reduce(DataFrame.unionByName, reach).agg(F.count(F.lit(1)).alias("n"), F.min("_least").alias("least")).first()
        return found["least"] if found["n"] == len(choices) * (folds + 1) else 0

    guess = _reached_by(sums, 2 * max(max_features for _, max_features in choices)) * (folds - 1) // folds
    stats = counted_exactly(guess)
    if guess:
        least = proven(stats)
        if least < guess:
            drop_cut(stats)
            stats = counted_exactly(least)
    drop_cut(sums)
    return stats


def vocabulary_cells(stats: DataFrame, n: int, min_df: int) -> DataFrame:
    """(cell, term, doc_freq, total_count) of the ``n`` row sets of ``left_out_stats``: terms of ``min_df`` of their rows, at least one."""
    each = [F.struct(F.lit(i).alias("cell"), F.col("doc_freq")[i].alias("doc_freq"), F.col("total_count")[i].alias("total_count"))
            for i in range(n)]
    return stats.select("term", F.inline(F.array(*each))).where(F.col("doc_freq") >= max(min_df, 1))


def vocabulary(tf_long: DataFrame, min_df: int = 2, max_features: int | None = 20000,
               rows: Column | None = None) -> DataFrame:
    """``vocabulary_of`` the counts of ``(term, tf)`` rows; ``rows`` fits it on matching rows only (see ``term_stats``)."""
    return vocabulary_of(term_stats(tf_long, rows), max(min_df, 1) if rows is not None else min_df, max_features)


def vocabulary_of(stats: DataFrame, min_df: int = 2, max_features: int | None = 20000) -> DataFrame:
    """(term, feature_index, doc_freq, total_count) of the ``max_features`` most counted terms, or of all (None).

    A histogram of the counts gives the least count that still gets in, so only
    terms at or above it (the vocabulary and ties) are ordered. Feature indices are
    alphabetical: terms are range partitioned and numbered within their partition.
    """
    if max_features is not None and max_features < 1:
        raise ValueError("max_features must be at least 1, or None for all terms")
    stats = stats.filter(F.col("doc_freq") >= min_df)
    if max_features is not None:
        least = _last_count(stats, max_features).select("_least")
        stats = (stats.join(F.broadcast(least), F.col("total_count") >= F.col("_least")).drop("_least")
                 .orderBy(F.desc("total_count"), F.asc("term")).limit(max_features))
    return _numbered(stats).select("term", "feature_index", "doc_freq", "total_count")


def _last_count(stats: DataFrame, n: int) -> DataFrame:
    """One row: ``_least``, the total_count of the n-th row in descending order (of the last, if fewer), and ``_all`` rows."""
    tally = stats.groupBy("total_count").agg(F.count(F.lit(1)).alias("_n"))
    # one row per distinct count: at most the square root of twice the tokens
    above = F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("total_count"))
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return tally.withColumn("_above", above).agg(F.min(F.when(F.col("_above") < n, F.col("total_count"))).alias("_least"),
                                                 F.sum("_n").alias("_all"))


def _numbered(terms: DataFrame) -> DataFrame:
    """Add ``feature_index``, the place in the order of the distinct ``term``."""
    dealt = cut_lineage(terms.repartitionByRange("term").sortWithinPartitions("term")
                        .withColumns({"_p": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = (dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
               .select("_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    index = F.col("_off") + F.col("_at") - F.col("_first")
    return dealt.join(offsets, "_p").withColumn("feature_index", index.cast("int"))


def smooth_idf(doc_freq: Column, n_docs: int) -> Column:
    return F.log(F.lit(float(1 + n_docs)) / (doc_freq + F.lit(1.0))) + F.lit(1.0)


FEATURES = "array<struct<term: string, feature_index: int, tfidf: double>>"
PARTS = "array<struct<term: string, feature_index: int, tfidf: double, coefficient: double, contribution: double>>"


def weighted_rows(rows: DataFrame, terms: Sequence[str], idf: Sequence[float],
                  coefficients: Sequence[float] | None = None) -> DataFrame:
    """``term_rows`` with ``features`` in place of ``terms``: per document its (term, feature_index, tfidf), L2-normalised.

    The vocabulary, at most its ``max_features`` terms with their weights, goes to the
    workers; look-up, weight and norm stay inside the row, so nothing is exchanged. With
    coefficients the column is ``parts`` and holds each feature's coefficient and
    contribution as well, and ``contribution_sum`` their sum.
    """
    reach_workers(rows.sparkSession)
    keep = [c for c in rows.columns if c != "terms"]
    shared = rows.sparkSession.sparkContext.broadcast((list(terms), np.asarray(idf, dtype=float),
                                                       None if coefficients is None else np.asarray(coefficients, dtype=float)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weight, slope = shared.value
        known = pa.array(names, pa.string())
        for batch in (piece for batch in batches for piece in _pieces(batch)):
            column = batch.column("terms")
            entries, offsets = column.flatten(), column.offsets.to_numpy()
            at = pc.index_in(entries.field("term"), value_set=known)
            there = at.is_valid().to_numpy(zero_copy_only=False)
            index = at.fill_null(0).to_numpy(zero_copy_only=False)[there].astype(np.int32)
            value = entries.field("tf").to_numpy(zero_copy_only=False)[there] * weight[index]
            ends = np.concatenate([[0], np.cumsum(there)])[offsets - offsets[0]]
            filled = np.flatnonzero(np.diff(ends))
            norm = np.ones(len(ends) - 1)
            if len(filled):
                norm[filled] = np.sqrt(np.add.reduceat(value * value, ends[:-1][filled]))
            value = value / np.repeat(norm, np.diff(ends))
            fields = {"term": known.take(pa.array(index)), "feature_index": pa.array(index), "tfidf": pa.array(value)}
            extra = []
            if slope is not None:
                pushed = value * slope[index]
                fields |= {"coefficient": pa.array(slope[index]), "contribution": pa.array(pushed)}
                sums = np.zeros(len(norm))
                if len(filled):
                    sums[filled] = np.add.reduceat(pushed, ends[:-1][filled])
                extra = [pa.array(sums)]
            structs = pa.StructArray.from_arrays(list(fields.values()), list(fields))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), structs)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists, *extra], out_names)

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "terms"]
    added = [f"features {FEATURES}"] if coefficients is None else [f"parts {PARTS}", "contribution_sum double"]
    out_names = keep + [x.split()[0] for x in added]
    return rows.select(*keep, "terms").mapInArrow(weigh, ", ".join(kept + added))


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch of at most ENTRIES entries, but for a single document: a batch bounds its rows, not their size."""
    offsets, at = batch.column("terms").offsets.to_numpy(), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + ENTRIES, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def collected(vocab: DataFrame, n_docs: int) -> tuple[list[str], list[float]]:
    """Terms in order of their index, and their idf; at most ``max_features`` of them reach the driver."""
    rows = vocab.select("term", "feature_index", smooth_idf(F.col("doc_freq"), n_docs).alias("idf")).collect()
    rows = sorted(rows, key=lambda r: r["feature_index"])
    return [r["term"] for r in rows], [r["idf"] for r in rows]


def top_terms_per_class(df: DataFrame, text_col: str, k: int = 20, ngram_range: tuple[int, int] = (1, 1),
                        stop_words: Sequence[str] | None = ENGLISH_STOP_WORDS,
                        domain: Sequence[int] = LABEL_DOMAIN) -> DataFrame:
    """(label, term, frequency): the k most frequent terms of every class.

    One count per (label, term) before the shuffle, then the k best of each hash slice
    of a label, then the k best of these: no task ever receives a class's whole
    vocabulary, whatever ``k`` is.
    """
    terms = (df.filter(F.col("label").isin(*domain))
             .select("label", F.explode(analyzed_terms(text_col, ngram_range, stop_words)).alias("term")))
    counts = terms.groupBy("label", "term").agg(F.count(F.lit(1)).alias("frequency"))
    counts = counts.withColumn("_slice", F.pmod(F.xxhash64("term"), F.lit(SLICES)))
    for keys in (("label", "_slice"), ("label",)):
        w = Window.partitionBy(*keys).orderBy(F.desc("frequency"), F.asc("term"))
        counts = counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
    return counts.drop("_slice")


def fisher_terms(df: DataFrame, text_col: str, min_df: int = 5, max_features: int = 20000,
                 top_n: int = 30) -> DataFrame:
    """Per-term Fisher score on TF-IDF values fitted on ``df``; the top ``top_n``.

    Mean and population variance per class include rows where the term is absent
    (value 0): the variance of the present values and the two groups' distances
    from the mean, which cannot go negative. Output columns: term, fisher_score,
    mean_fake, mean_real.
    """
    rows = cut_lineage(term_rows(df, text_col, ("label",)))
    n_docs, sizes = _class_sizes(df)
    vocab = vocabulary(rows.select(F.inline("terms")), min_df, max_features)
    x = weighted_rows(rows, *collected(vocab, n_docs)).select("label", F.inline("features"))
    own = {v: F.when(F.col("label") == v, F.col("tfidf")) for v in LABEL_DOMAIN}
    per = x.groupBy("term").agg(*[f(own[v]).alias(f"{name}{v}") for v in LABEL_DOMAIN
                                  for name, f in (("k", F.count), ("a", F.avg), ("v", F.var_pop))])
    mean, spread = {}, {}
    for v in LABEL_DOMAIN:
        n, k = F.lit(float(sizes.get(v, 0))), F.col(f"k{v}")
        there = F.coalesce(F.col(f"a{v}"), F.lit(0.0))
        mean[v] = there * k / n
        inner = F.coalesce(F.col(f"v{v}"), F.lit(0.0)) + (there - mean[v]) * (there - mean[v])
        spread[v] = (k * inner + (n - k) * mean[v] * mean[v]) / n
    score = (mean[0] - mean[1]) * (mean[0] - mean[1]) / (spread[0] + spread[1] + F.lit(1e-10))
    scored = per.select("term", score.alias("fisher_score"), mean[0].alias("mean_fake"), mean[1].alias("mean_real"))
    top = scored.orderBy(F.desc("fisher_score"), F.asc("term")).limit(top_n)
    return top.select("term", *[F.round(c, 6).alias(c) for c in ("fisher_score", "mean_fake", "mean_real")])


def _class_sizes(df: DataFrame) -> tuple[int, dict]:
    """Document count and per-class counts (one bounded collect)."""
    rows = df.groupBy("label").count().collect()
    sizes = {r["label"]: r["count"] for r in rows}
    return sum(sizes.values()), sizes
