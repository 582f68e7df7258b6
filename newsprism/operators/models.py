"""Linear text classifiers on Spark ML: TF-IDF (+1 smooth IDF) and logistic regression.

``build_pipeline`` gives an unfitted ``Pipeline`` of ``TfIdfVectorizer`` and
``NewtonLogisticRegression``; both it and what it fits save and load with the ML
writers. Vocabularies are computed relationally (deterministic ties) and are the only
thing, together with the coefficients, that reaches the driver.
"""

from __future__ import annotations

import functools
import math
import time
from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from newsprism.functions.stopwords import ENGLISH_STOP_WORDS
from newsprism.operators import linear
from newsprism.operators import metrics as mt
from newsprism.operators import terms as tm
from newsprism.operators.linear import NewtonLogisticRegression
from newsprism.operators.ranks import hash_rank
from newsprism.operators.splits import stratified_kfold
from newsprism.session import cut_lineage, drop_cut, reach_workers, scratch

TERMS_COL = "_terms"
FEATURES_COL = "features"


class TermAnalyzer(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """tokenize -> stop words -> n-grams, as the same Column expression the
    long-form operators use (so vector and long form agree). A column of arrays
    holds texts that are tokenised already."""

    ngramMin = Param(Params._dummy(), "ngramMin", "smallest n-gram", TypeConverters.toInt)
    ngramMax = Param(Params._dummy(), "ngramMax", "largest n-gram", TypeConverters.toInt)
    stopWords = Param(Params._dummy(), "stopWords", "words removed before n-grams", TypeConverters.toListString)

    @keyword_only
    def __init__(self, inputCol="content", outputCol=TERMS_COL, ngramMin=1, ngramMax=1, stopWords=None):
        super().__init__()
        self._setDefault(ngramMin=1, ngramMax=1, stopWords=list(ENGLISH_STOP_WORDS))
        kwargs = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rng = (self.getOrDefault(self.ngramMin), self.getOrDefault(self.ngramMax))
        col, stop_words = F.col(self.getInputCol()), self.getOrDefault(self.stopWords)
        if isinstance(dataset.schema[self.getInputCol()].dataType, ArrayType):
            expr = tm.analyzed_tokens(F.coalesce(col, F.array().cast("array<string>")), rng, stop_words)
        else:
            expr = tm.analyzed_terms(F.coalesce(col, F.lit("")), rng, stop_words)
        return dataset.withColumn(self.getOutputCol(), expr)


class _Analysis(HasInputCol, HasOutputCol):
    """Params that the vectorizer and its model share."""

    ngramMin = Param(Params._dummy(), "ngramMin", "smallest n-gram", TypeConverters.toInt)
    ngramMax = Param(Params._dummy(), "ngramMax", "largest n-gram", TypeConverters.toInt)
    stopWords = Param(Params._dummy(), "stopWords", "words removed before n-grams", TypeConverters.toListString)

    def _defaults(self) -> None:
        self._setDefault(inputCol="content", outputCol=FEATURES_COL, ngramMin=1, ngramMax=1, stopWords=list(ENGLISH_STOP_WORDS))

    def analyzer(self) -> TermAnalyzer:
        return TermAnalyzer(inputCol=self.getInputCol(), outputCol=TERMS_COL, ngramMin=self.getOrDefault(self.ngramMin),
                            ngramMax=self.getOrDefault(self.ngramMax), stopWords=self.getOrDefault(self.stopWords))


class TfIdfVectorizer(Estimator, _Analysis, DefaultParamsReadable, DefaultParamsWritable):
    """Vocabulary and smooth IDF + 1 of a text column, in two passes over the rows.

    Terms of ``minDF`` documents or more, the ``maxFeatures`` most counted of them (ties by
    term), numbered alphabetically. Null texts are empty. No such term raises ValueError.
    """

    minDF = Param(Params._dummy(), "minDF", "least number of documents of a term", TypeConverters.toInt)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "most terms kept", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="content", outputCol=FEATURES_COL, ngramMin=1, ngramMax=1, stopWords=None, minDF=2,
                 maxFeatures=20000):
        super().__init__()
        self._defaults()
        self._setDefault(minDF=2, maxFeatures=20000)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> TfIdfVectorizerModel:
        stats = tm.stats_of(self.analyzer().transform(dataset), TERMS_COL)
        with scratch(dataset.sparkSession):
            vocab = tm.vocabulary_of(stats, self.getOrDefault(self.minDF), self.getOrDefault(self.maxFeatures))
            rows = vocab.select("term", "doc_freq").orderBy("term").collect()  # <= maxFeatures rows
        if not rows:
            raise ValueError(f"no term occurs in {self.getOrDefault(self.minDF)} training documents: the vocabulary is empty")
        n_docs = dataset.count()
        return self.model_of([r["term"] for r in rows], [math.log((1 + n_docs) / (1 + r["doc_freq"])) + 1.0 for r in rows])

    def model_of(self, vocabulary: list[str], idf: list[float]) -> TfIdfVectorizerModel:
        """The model of this vocabulary, in order, and its weights."""
        shared = {p.name: self.getOrDefault(p) for p in (self.inputCol, self.outputCol, self.ngramMin, self.ngramMax, self.stopWords)}
        return TfIdfVectorizerModel()._set(**shared, vocabulary=vocabulary, idf=idf)


class TfIdfVectorizerModel(Model, _Analysis, DefaultParamsReadable, DefaultParamsWritable):
    """Counts times IDF over the vocabulary, rows of length 1; JVM stages only."""

    vocabulary = Param(Params._dummy(), "vocabulary", "terms in order of their index", TypeConverters.toListString)
    idf = Param(Params._dummy(), "idf", "weights of the terms", TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()
        self._defaults()

    def terms(self) -> list[str]:
        return self.getOrDefault(self.vocabulary)

    def weights(self) -> list[float]:
        return self.getOrDefault(self.idf)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        counts = CountVectorizerModel.from_vocabulary(self.terms(), inputCol=TERMS_COL, outputCol="_tf")
        scale = ElementwiseProduct(scalingVec=Vectors.dense(self.weights()), inputCol="_tf", outputCol="_tfidf")
        norm = Normalizer(p=2.0, inputCol="_tfidf", outputCol=self.getOutputCol())
        stages = PipelineModel([self.analyzer(), counts, scale, norm])
        return stages.transform(dataset).drop(TERMS_COL, "_tf", "_tfidf")


def build_pipeline(ngram_range: tuple[int, int] = (1, 1), *, max_features: int = 20000, min_df: int = 2,
                   text_col: str = "content", label_col: str = "label", max_iter: int = 100) -> Pipeline:
    """Unfitted pipeline: TF-IDF (min_df, max_features, n-grams) and L2 logistic regression with C = 1."""
    return Pipeline(stages=[
        TfIdfVectorizer(inputCol=text_col, ngramMin=ngram_range[0], ngramMax=ngram_range[1], minDF=min_df, maxFeatures=max_features),
        NewtonLogisticRegression(labelCol=label_col, maxIter=max_iter)])


def parts_of(model: PipelineModel) -> tuple[TfIdfVectorizerModel, LogisticRegressionModel]:
    """The vectorizer and the classifier of a fitted text pipeline."""
    return (next(s for s in model.stages if isinstance(s, TfIdfVectorizerModel)),
            next(s for s in model.stages if isinstance(s, LogisticRegressionModel)))


def predict(model: PipelineModel, df: DataFrame, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Class, P(class 1) and the raw decision score for every row."""
    return scored(model, df, keep)


def scored(model: Model, df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(*keep, prediction, p, score) by a fitted pipeline, or by its classifier over features."""
    out = model.transform(df)
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array("probability")[1].alias("p"),
                      vector_to_array("rawPrediction")[1].alias("score"))


@dataclass
class ExperimentResult:
    name: str
    model: PipelineModel
    predictions: DataFrame
    metrics: DataFrame
    confusion: DataFrame
    vectorizer_seconds: float
    training_seconds: float
    text_column: str
    ngram_range: tuple[int, int]
    extra: dict = field(default_factory=dict)


def fit_experiment(name: str, df: DataFrame, *, text_column: str, ngram_range: tuple[int, int],
                   split_col: str = "split", max_iter: int = 100, max_features: int = 20000) -> ExperimentResult:
    """Fit on the train split only; metrics per split.

    Texts are tokenised for the vocabulary and once more for the features of all splits,
    which the fit and the predictions share.
    """
    vectorizer, classifier = build_pipeline(ngram_range, max_features=max_features, text_col=text_column,
                                            max_iter=max_iter).getStages()
    started = time.perf_counter()
    vec = vectorizer.fit(df.filter(F.col(split_col) == "train"))
    featured = cut_lineage(vec.transform(df).select("row_id", split_col, "label", FEATURES_COL))
    fitted = time.perf_counter()
    found = classifier.fit(featured.filter(F.col(split_col) == "train"))
    ended = time.perf_counter()
    model = PipelineModel([vec, found])
    preds = cut_lineage(scored(found, featured, ("row_id", split_col, "label")))  # narrow: read by every metric
    metrics = cut_lineage(mt.classification_metrics(preds, group_cols=(split_col,), weighted=True).coalesce(1))
    confusion = mt.confusion(preds.filter(F.col(split_col) == "test"))
    return ExperimentResult(name, model, preds, metrics, confusion, fitted - started, ended - fitted,
                            text_column, ngram_range, {"features": featured})


def run_experiments(df: DataFrame, grid=None, parallelism: int = 3) -> list[ExperimentResult]:
    """``fit_experiment`` for every (name, text column, n-gram range) of the grid, some at a time."""
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(lambda e: fit_experiment(e[0], df, text_column=e[1], ngram_range=e[2]), grid or EXPERIMENT_GRID))


# The experiment grid of the reference notebook.
EXPERIMENT_GRID = (
    ("title_unigram", "title", (1, 1)),
    ("title_bigram", "title", (2, 2)),
    ("text_unigram", "text", (1, 1)),
    ("content_unigram", "content", (1, 1)),
    ("content_bigram", "content", (2, 2)),
)


def compare_experiments(results: list[ExperimentResult]) -> DataFrame:
    """One row per experiment, best first: rank, validation accuracy, test accuracy / macro F1 / ROC-AUC, training time.

    Ranked by validation accuracy, ties by name; ``best`` marks the first. The rows are
    a handful of metric values, so one window orders them.
    """
    parts = [r.metrics.withColumns({"experiment": F.lit(r.name), "training_seconds": F.lit(r.training_seconds)})
             for r in results]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    pick = lambda split, metric: F.max(F.when(
        (F.col("split") == split) & (F.col("metric") == metric), F.col("value")))
    table = every.groupBy("experiment", "training_seconds").agg(
        pick("validation", "accuracy").alias("validation_accuracy"), pick("test", "accuracy").alias("test_accuracy"),
        pick("test", "f1_macro").alias("test_f1_macro"), pick("test", "roc_auc").alias("test_roc_auc"))
    rank = F.row_number().over(Window.orderBy(F.desc("validation_accuracy"), F.asc("experiment")))
    return table.withColumn("rank", rank).withColumn("best", F.col("rank") == 1)


def best_experiment(results: list[ExperimentResult]) -> ExperimentResult:
    """The experiment of highest validation accuracy; ties by name."""
    name = compare_experiments(results).where("best").first()["experiment"]
    return next(r for r in results if r.name == name)


def summary_table(result: ExperimentResult, curve: DataFrame | None = None) -> DataFrame:
    """Long (metric, value) rows: test metrics (weighted ones too), the train-validation gap, with a learning
    curve also its cross-validated gap, and the seconds of the vectorizer and of the fit."""
    m = result.metrics
    test = m.filter(F.col("split") == "test").select("metric", "value")
    acc = m.filter(F.col("metric") == "accuracy").groupBy().agg(
        F.max(F.when(F.col("split") == "train", F.col("value"))).alias("tr"),
        F.max(F.when(F.col("split") == "validation", F.col("value"))).alias("va"))
    out = test.unionByName(acc.select(F.lit("train_val_gap").alias("metric"), (F.col("tr") - F.col("va")).alias("value")))
    if curve is not None:
        out = out.unionByName(final_gap(curve).select(F.lit("cross_validated_gap").alias("metric"), F.col("gap").alias("value")))
    seconds = [("vectorizer_seconds", result.vectorizer_seconds), ("training_seconds", result.training_seconds)]
    out = out.unionByName(m.sparkSession.createDataFrame(seconds, "metric string, value double"))
    return out.select("metric", F.round("value", 4).alias("value"))


def final_gap(curve: DataFrame) -> DataFrame:
    """Train less validation accuracy at the largest size of a learning curve."""
    last = curve.agg(F.max_by("train_mean", "size").alias("tr"), F.max_by("val_mean", "size").alias("va"))
    return last.select(F.round(F.col("tr") - F.col("va"), 6).alias("gap"))


@dataclass(frozen=True)
class Cells:
    """The cells of a learning curve: fold left out, size and number of training rows, fold by fold."""
    folds: tuple[int, ...]
    sizes: tuple[float, ...]
    n_train: tuple[tuple[int, ...], ...]  # per fold, per size

    def flat(self) -> list[tuple[int, float, int]]:
        return [(f, s, n) for f, ns in zip(self.folds, self.n_train) for s, n in zip(self.sizes, ns)]


def _curve_rows(df: DataFrame, text_column: str, ngram_range: tuple[int, int], folds: int, seed: int) -> DataFrame:
    """label, fold, the row's rank among the training rows of every fold left out (0: none), its counted terms."""
    narrow = stratified_kfold(df.select("row_id", "label"), k=folds, seed=seed)
    ranks = narrow.select("row_id", "label", "fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("_out"))
    ranks = hash_rank(ranks.where("fold <> _out"), "_out", seed=seed + 1, rank_col="_tr", size_col="_n")
    ranks = ranks.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("_out", "_tr"))).alias("_rank"))
    at = F.array(*[F.coalesce(F.try_element_at("_rank", F.lit(f)), F.lit(0)).cast("int") for f in range(folds)])
    terms = tm.counted(tm.analyzed_terms(F.coalesce(F.col(text_column), F.lit("")), ngram_range))
    return cut_lineage(df.select("row_id", "label", terms.alias("terms")).join(narrow.select("row_id", "fold"), "row_id")
                       .join(ranks.select("row_id", at.alias("ranks")), "row_id"))


def nested_vocabularies(rows: DataFrame, cells: Cells, min_df: int, max_features: int) -> DataFrame:
    """(cell, term, doc_freq) of the vocabularies of all cells, from one count of the corpus.

    A row counts where it first comes in: per term, fold left out and first size that
    holds the row. Sums over the smaller sizes then give every cell's counts.
    """
    steps = []
    for i, (f, ns) in enumerate(zip(cells.folds, cells.n_train)):
        rank = F.col("ranks")[f]
        steps.append(F.struct(F.lit(i).alias("f"), F.when(rank > 0, functools.reduce(
            lambda a, b: a + b, [(rank > n).cast("int") for n in ns])).alias("step")))
    first = rows.select(F.inline(F.array(*steps)), "terms").where(F.col("step") < len(cells.sizes))
    counts = (first.select("f", "step", F.inline("terms")).groupBy("f", "step", "term")
              .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")))
    upto = [F.struct((F.col("f") * len(cells.sizes) + k).alias("cell"), F.col(f"df{k}").alias("doc_freq"), F.col(f"tf{k}").alias("tf"))
            for k in range(len(cells.sizes))]
    nested = counts.groupBy("f", "term").agg(*[
        F.sum(F.when(F.col("step") <= k, F.col(c))).alias(f"{c}{k}") for k in range(len(cells.sizes)) for c in ("df", "tf")])
    return most_counted(nested.select("term", F.inline(F.array(*upto))).where(F.col("doc_freq") >= min_df), "tf", max_features)


def most_counted(counts: DataFrame, count_col: str, max_features: int) -> DataFrame:
    """(cell, term, doc_freq) of the ``max_features`` most counted terms of every cell, ties by term."""
    vocab = counts.withColumn("_slice", F.pmod(F.xxhash64("term"), F.lit(tm.SLICES)))
    for keys in (("cell", "_slice"), ("cell",)):  # no task receives a cell's whole vocabulary
        order = Window.partitionBy(*keys).orderBy(F.desc(count_col), F.asc("term"))
        vocab = vocab.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_features)
    return vocab.select("cell", "term", "doc_freq")


def union_weights(vocab: pa.Table, n_docs: list[int]) -> tuple[list[str], np.ndarray]:
    """The terms of all cells' vocabularies in order, and their idf per cell (terms x cells): 0 where a cell lacks the term."""
    cell, doc_freq = (vocab.column(c).to_numpy() for c in ("cell", "doc_freq"))
    named = vocab.column("term").cast(pa.string()).combine_chunks().dictionary_encode()
    order = np.array(pc.sort_indices(named.dictionary), dtype=np.int64)
    terms, place = named.dictionary.take(pa.array(order)).to_pylist(), np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    idf = np.zeros((len(terms), len(n_docs)))
    idf[place[named.indices.to_numpy()], cell] = np.log((1 + np.array(n_docs)[cell]) / (1 + doc_freq)) + 1.0
    return terms, idf


def _of_packed(batch: pa.RecordBatch) -> linear.Rows:
    """Rows of all cells from their packed columns."""
    read = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=kind)
    sizes = np.array([len(x) // 4 for x in batch.column("index").to_pylist()], dtype=np.int64)
    n = batch.num_rows
    return linear.Rows(batch.column("label").to_numpy(), np.cumsum(sizes) - sizes, read("index", "<i4").astype(np.int64),
                       read("tf", "<f8"), read("norm", "<f8").reshape(n, -1), read("member", "u1").reshape(n, -1) == 1)


def _packed(rows: DataFrame, terms: list[str], idf: np.ndarray, cells: Cells) -> DataFrame:
    """Per row its label, the union vocabulary's indices and counts, and per cell its norm, membership and use for validation."""
    shared = rows.sparkSession.sparkContext.broadcast((terms, idf))  # at most max_features terms per cell
    flat = cells.flat()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weight = shared.value
        known = pa.array(names, pa.string())
        for batch in batches:
            entries = batch.column("terms")
            at = pc.index_in(entries.flatten().field("term"), value_set=known)
            there = at.is_valid().to_numpy(zero_copy_only=False)
            index = at.fill_null(0).to_numpy(zero_copy_only=False)[there].astype("<i4")
            tf = entries.flatten().field("tf").to_numpy(zero_copy_only=False)[there].astype("<f8")
            offsets = entries.offsets.to_numpy()
            ends = np.concatenate([[0], np.cumsum(there)])[offsets - offsets[0]]
            fold = batch.column("fold").to_numpy()
            ranks = np.array(batch.column("ranks").to_pylist(), dtype=np.int64).reshape(len(fold), -1)
            member = np.stack([(ranks[:, f] > 0) & (ranks[:, f] <= n) for f, _, n in flat], axis=1)
            held = np.stack([fold == f for f, _, _ in flat], axis=1)
            out = {"index": [], "tf": [], "norm": []}
            for a, b in zip(ends[:-1], ends[1:]):
                norm = np.sqrt(((weight[index[a:b]] * tf[a:b, None]) ** 2).sum(axis=0))
                for name, x in (("index", index[a:b]), ("tf", tf[a:b]), ("norm", np.where(norm > 0, norm, 1.0))):
                    out[name].append(x.tobytes())
            binary = [out["index"], out["tf"], out["norm"], [x.tobytes() for x in member], [x.tobytes() for x in held]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").cast(pa.float64()), *[pa.array(x, pa.binary()) for x in binary]],
                ["label", "index", "tf", "norm", "member", "held"])
    reach_workers(rows.sparkSession)
    return rows.select("label", "fold", "ranks", "terms").mapInArrow(
        pack, "label double, index binary, tf binary, norm binary, member binary, held binary")


def _hits(frame: DataFrame, idf: np.ndarray, found: list[np.ndarray], own: list[np.ndarray]) -> np.ndarray:
    """Per cell: training rows, those told right, their log loss, then the same of the validation rows."""
    width = idf.shape[1]
    weights, bias = np.zeros(idf.shape), np.array([x[-1] for x in found])
    for c, (x, terms) in enumerate(zip(found, own)):
        weights[terms, c] = x[:-1] * idf[terms, c]
    shared = frame.sparkSession.sparkContext.broadcast((weights, bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, width))
        for batch in batches:
            rows = _of_packed(batch)
            held = np.frombuffer(b"".join(batch.column("held").to_pylist()), dtype="u1").reshape(len(rows), -1) == 1
            z = np.concatenate([np.zeros((0, width)), *[p.dot(shared.value[0]) for p in rows.pieces(width)]]) + shared.value[1]
            y = rows.label[:, None]
            right, loss = (z > 0) == (y == 1), np.logaddexp(0.0, z) - y * z
            total += np.stack([(use * x).sum(axis=0) for use in (rows.member, held) for x in (1.0, right, loss)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), *map(pa.array, total)], ["cell", *"abcdef"])

    sums = frame.mapInArrow(score, "cell long, " + ", ".join(f"{x} double" for x in "abcdef"))
    sums = sums.groupBy("cell").agg(*[F.sum(x).alias(x) for x in "abcdef"])
    return np.array([tuple(r) for r in sums.orderBy("cell").collect()])[:, 1:]


def learning_curve(df: DataFrame, *, text_column: str = "content", ngram_range: tuple[int, int] = (1, 1),
                   sizes: tuple[float, ...] = (0.1, 0.28, 0.46, 0.64, 0.82, 1.0), folds: int = 5,
                   seed: int = 42, max_iter: int = 100, max_features: int = 20000, min_df: int = 2,
                   tol: float = 1e-8) -> DataFrame:
    """Accuracy on growing, nested training subsets under stratified k-fold.

    Rows are tokenised once and written with their fold and, for every fold left out,
    their rank by hash among its training rows; size s keeps the first int(s * n). The
    vocabularies of all cells come from one count, and all cells are fitted together:
    each pass over the rows serves every model that is still being fitted. Output per
    size: train and validation mean / population std of accuracy, the error rates and mean log losses.
    A cell whose training rows share no term fits its intercept alone.
    """
    spark = df.sparkSession
    sizes = tuple(sorted(sizes))
    with scratch(spark):
        rows = _curve_rows(df, text_column, ngram_range, folds, seed)
        in_fold = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
        total = sum(in_fold.values())
        cells = Cells(tuple(sorted(in_fold)), sizes, tuple(
            tuple(max(int(s * (total - in_fold[f])), 1) for s in sizes) for f in sorted(in_fold)))
        flat = cells.flat()
        vocab = nested_vocabularies(rows, cells, min_df, max_features).toArrow()  # max_features rows per cell at most
        terms, idf = union_weights(vocab, [n for *_, n in flat])
        frame, parts = linear.partitioned(_packed(rows, terms, idf, cells), total,
                                          max(50, 4 * linear.ROWS_PER_PARTITION // max(1, len(flat))))
        try:
            fitter = linear.Fitter(frame, lambda batch: [_of_packed(batch)], idf, parts)
            found = fitter.solve([n for *_, n in flat], tol, max_iter)
            hits = _hits(frame, idf, found, fitter.terms)
        finally:
            frame.unpersist(blocking=True)
    scores = [(float(s), int(n), right / max(rows_in, 1), loss / max(rows_in, 1), told / max(held, 1), held_loss / max(held, 1))
              for (_, s, n), (rows_in, right, loss, held, told, held_loss) in zip(flat, hits.tolist())]
    scores = spark.createDataFrame(scores, "size double, n_train int, train_acc double, train_loss double, val_acc double, val_loss double")
    return (scores.groupBy("size").agg(
        F.min("n_train").alias("train_size"),
        F.round(F.avg("train_acc"), 6).alias("train_mean"), F.round(F.stddev_pop("train_acc"), 6).alias("train_std"),
        F.round(F.avg("val_acc"), 6).alias("val_mean"), F.round(F.stddev_pop("val_acc"), 6).alias("val_std"),
        F.round(F.avg("train_loss"), 6).alias("train_loss"), F.round(F.avg("val_loss"), 6).alias("val_loss"))
        .withColumn("train_error", F.round(1 - F.col("train_mean"), 6))
        .withColumn("val_error", F.round(1 - F.col("val_mean"), 6)))


def embedding_classifier(df: DataFrame, *, vector_col: str = "embedding", label_col: str = "label",
                         split_col: str = "split", max_iter: int = 100) -> tuple:
    """Logistic regression on dense embeddings (array<float> -> vector): the model, and every row's class and probability."""
    data = df.select("row_id", split_col, F.col(label_col).cast("int").alias("label"),
                     array_to_vector(F.col(vector_col).cast("array<double>")).alias(FEATURES_COL))
    model = NewtonLogisticRegression(maxIter=max_iter).fit(data.filter(F.col(split_col) == "train"))
    return model, scored(model, data, ("row_id", split_col, "label"))


def _indexed(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Rows (label, fold, terms) with the sorted numbers of their known terms and how often each occurs, packed."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)  # at most max_features terms per row set
    reach_workers(rows.sparkSession)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for batch in (piece for batch in batches for piece in tm._pieces(batch)):
            column = batch.column("terms")
            at = pc.index_in(column.flatten(), value_set=known)
            there = at.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))[there]
            key, tf = np.unique(row * len(known) + at.fill_null(0).to_numpy(zero_copy_only=False)[there], return_counts=True)
            ends = np.searchsorted(key, np.arange(batch.num_rows + 1) * len(known)).tolist()
            number, tf = (key % max(len(known), 1)).astype("<i4"), tf.astype("<i4")
            packed = [pa.array([x[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()) for x in (number, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("fold"), *packed], ["label", "fold", "index", "tf"])

    return rows.mapInArrow(index, "label double, fold int, index binary, tf binary")


def _fold_stretches(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """``_indexed`` rows as stretches of one fold in one row each, with the rows' norms in every model."""
    shared = rows.sparkSession.sparkContext.broadcast(np.asfortranarray(idf))
    names = ["label", "fold", "sizes", "index", "tf", "norm"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column("fold").to_numpy()
            for f in np.unique(fold).tolist():
                own = batch.take(pa.array(np.flatnonzero(fold == f)))
                at = 0
                ends = np.cumsum([len(x) // 4 for x in own.column("index").to_pylist()])
                while at < own.num_rows:
                    before = ends[at - 1] if at else 0
                    stop = max(at + 1, int(np.searchsorted(ends, before + linear.STRETCH, side="right")))
                    yield stretch(own.slice(at, stop - at), f)
                    at = stop

    def stretch(own: pa.RecordBatch, fold: int) -> pa.RecordBatch:
        index, tf = (b"".join(own.column(name).to_pylist()) for name in ("index", "tf"))
        sizes = np.array([len(x) // 4 for x in own.column("index").to_pylist()], dtype="<i4")
        at, times = np.frombuffer(index, dtype="<i4"), np.frombuffer(tf, dtype="<i4")
        norm, filled = np.ones((own.num_rows, shared.value.shape[1])), np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[filled]
        if len(filled):
            for c in range(norm.shape[1]):
                norm[filled, c] = np.sqrt(np.add.reduceat((shared.value[:, c][at] * times) ** 2, starts))
        norm[norm == 0] = 1.0
        label = own.column("label").to_numpy(zero_copy_only=False).astype("<f8")
        data = [label.tobytes(), None, sizes.tobytes(), index, tf, norm.astype("<f8").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()) if d is None else pa.array([d], pa.binary()) for d in data], names)

    return rows.mapInArrow(pack, "label binary, fold int, sizes binary, index binary, tf binary, norm binary")


def _of_fold_stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, linear.Rows]]:
    """The fold and the rows of each stretch; the rows are in every model but the one without their fold."""
    for i in range(batch.num_rows):
        label, sizes, index, tf, norm = (np.frombuffer(batch.column(name)[i].as_buffer(), dtype=kind) for name, kind in (
            ("label", "<f8"), ("sizes", "<i4"), ("index", "<i4"), ("tf", "<i4"), ("norm", "<f8")))
        fold, n = batch.column("fold")[i].as_py(), len(label)
        norm = norm.reshape(n, -1)
        member = np.broadcast_to(np.arange(norm.shape[1]) != fold, norm.shape)
        yield fold, linear.Rows(label, np.cumsum(sizes, dtype=np.int64) - sizes, index.astype(np.int64), tf.astype(float), norm, member)


def _held_out(frame: DataFrame, idf: np.ndarray, found: list[np.ndarray], own: list[np.ndarray]) -> DataFrame:
    """Every row's label, fold and what the model without its fold says, in the columns of Spark's classifiers."""
    weights, bias = np.zeros(idf.shape, order="F"), np.array([x[-1] for x in found])
    for c, (x, terms) in enumerate(zip(found, own)):
        weights[terms, c] = x[:-1] * idf[terms, c]
    shared = frame.sparkSession.sparkContext.broadcast((weights, bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, rows in _of_fold_stretches(batch):
                rows.norm = rows.norm[:, f:f + 1]
                z = rows.dot(shared.value[0][:, f:f + 1])[:, 0] + shared.value[1][f]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows.label), pa.array(np.full(len(rows), f, dtype=np.int32)), pa.array(z)], ["label", "fold", "z"])

    z, first = F.col("z"), F.lit(1.0) / (F.lit(1.0) + F.exp("z"))
    return frame.mapInArrow(score, "label double, fold int, z double").select(
        "label", "fold", "z", F.when(z > 0, 1.0).otherwise(0.0).alias("prediction"), first.alias("_first"))


class FoldCrossValidator(CrossValidator):
    """Spark's CrossValidator over ``build_pipeline``'s stages and a fold column, with the fits of a setting done together.

    Terms are counted once per analysis for all its settings and folds; the vocabularies
    follow by taking a fold's counts from the whole. A setting's models, one without each
    fold and one of all rows, are fitted in the same passes; ``parallelism`` settings run at
    a time. The models without a fold are judged by the evaluator on its rows, the best
    setting's model of all rows is the best model. Sub-models are not collected.
    """

    def _fit(self, dataset: DataFrame) -> CrossValidatorModel:
        pipeline, evaluator, folds, fold = self.getEstimator(), self.getEvaluator(), self.getNumFolds(), self.getFoldCol()
        settings = [pipeline.copy(extra).getStages() for extra in self.getEstimatorParamMaps()]
        in_fold = {r[fold]: r["count"] for r in dataset.groupBy(fold).count().collect()}
        if not set(in_fold) <= set(range(folds)):
            raise ValueError(f"Fold numbers must be in range [0, {folds}), but got {sorted(map(str, in_fold))}")
        sizes = [sum(in_fold.values()) - in_fold.get(f, 0) for f in range(folds)] + [sum(in_fold.values())]
        for f in range(folds):
            for name, n in (("training", sizes[f]), ("validation", in_fold.get(f, 0))):
                if not n:
                    raise ValueError(f"The {name} data at fold {f} is empty.")
        analyses: dict[tuple, list[int]] = {}
        for i, (vectorizer, _) in enumerate(settings):
            same = [vectorizer.getOrDefault(p) for p in (vectorizer.inputCol, vectorizer.ngramMin, vectorizer.ngramMax)]
            analyses.setdefault((*same, *vectorizer.getOrDefault(vectorizer.stopWords)), []).append(i)
        metrics = [[0.0] * len(settings) for _ in range(folds)]
        models: dict[int, PipelineModel] = {}

        def terms_of(i: int) -> DataFrame:
            vectorizer, classifier = settings[i]
            return vectorizer.analyzer().transform(dataset).select(
                F.col(classifier.getLabelCol()).cast("double").alias("label"), F.col(fold).cast("int").alias("fold"),
                F.col(TERMS_COL).alias("terms"))

        def count(members: list[int]) -> DataFrame:
            choices = [tuple(settings[i][0].getOrDefault(name) for name in ("minDF", "maxFeatures")) for i in members]
            return tm.left_out_stats(terms_of(members[0]), "terms", "fold", folds, choices)

        def fit(i: int, counted: Future) -> None:
            (vectorizer, classifier), stats, spark = settings[i], counted.result(), dataset.sparkSession
            with scratch(spark):
                min_df, most = (vectorizer.getOrDefault(name) for name in ("minDF", "maxFeatures"))
                vocab = most_counted(tm.vocabulary_cells(stats, folds + 1, min_df), "total_count", most).toArrow()
                terms, idf = union_weights(vocab, sizes)
                if not (idf != 0).any(axis=0).all():
                    raise ValueError(f"no term occurs in {min_df} training documents: the vocabulary is empty")
                # few tasks, so that the driver can add up the sums of some settings at once; at scale more, whose sums tasks add up
                few = max(1, min(spark.sparkContext.defaultParallelism, linear.DIRECT // (32 * idf.size)))
                per_part = max(linear.ROWS_PER_PARTITION, min(16 * linear.ROWS_PER_PARTITION, math.ceil(sizes[-1] / few)))
                frame, parts = linear.partitioned(_indexed(terms_of(i), terms), sizes[-1], per_part, lambda rows: _fold_stretches(rows, idf))
                try:
                    fitter = linear.Fitter(frame, lambda batch: (rows for _, rows in _of_fold_stretches(batch)), idf, parts, single=True)
                    found = fitter.solve(sizes, classifier.getTol(), classifier.getMaxIter(), linear.KEPT)
                    told = cut_lineage(_held_out(frame, idf, found, fitter.terms))
                finally:
                    frame.unpersist(blocking=True)
                vector = lambda a, b: array_to_vector(F.array(a, b))
                told = told.select(F.col("label").alias(classifier.getLabelCol()), "fold", "prediction",
                                   vector(-F.col("z"), F.col("z")).alias("rawPrediction"),
                                   vector(F.col("_first"), 1 - F.col("_first")).alias("probability"))
                for f in range(folds):
                    metrics[f][i] = evaluator.evaluate(told.where(F.col("fold") == f))
            own = fitter.terms[folds]
            models[i] = PipelineModel([vectorizer.model_of([terms[t] for t in own], idf[own, folds].tolist()), classifier.model_of(found[folds])])

        with ThreadPoolExecutor(max_workers=self.getParallelism()) as pool:
            counted = {key: pool.submit(count, members) for key, members in analyses.items()}  # ahead of the fits that wait for them
            fits = [pool.submit(fit, i, counted[key]) for key, members in analyses.items() for i in members]
        for done in fits:
            done.result()
        for table in counted.values():
            drop_cut(table.result())
        mean, std = CrossValidator._gen_avg_and_std_metrics(metrics)
        best = int(np.argmax(mean) if evaluator.isLargerBetter() else np.argmin(mean))
        return self._copyValues(CrossValidatorModel(models[best], mean, None, std))


def cross_validate(df: DataFrame, grid: list[dict], *, metric: str = "accuracy", folds: int = 5, seed: int = 42,
                   parallelism: int = 2) -> DataFrame:
    """(setting, rank, mean, std) of the folds' metric for every setting of the grid; rank 1 is the best.

    Spark's CrossValidator over ``build_pipeline``, with the folds of ``stratified_kfold`` and the
    fits of a setting done together (``FoldCrossValidator``).
    A setting maps names of the vectorizer's params to values; ``metric`` is one of
    MulticlassClassificationEvaluator.
    """
    columns = sorted({setting.get("inputCol", "content") for setting in grid})
    words = [tm.tokenize(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns]  # once for all settings and folds
    data = cut_lineage(stratified_kfold(df, k=folds, seed=seed).select("label", "fold", *words))
    pipeline = build_pipeline()
    vectorizer = pipeline.getStages()[0]
    maps = [{vectorizer.getParam(name): value for name, value in setting.items()} for setting in grid]
    check = MulticlassClassificationEvaluator(labelCol="label", metricName=metric)
    cv = FoldCrossValidator(estimator=pipeline, estimatorParamMaps=maps, evaluator=check, foldCol="fold", numFolds=folds,
                            parallelism=parallelism)
    fitted = cv.fit(data)
    drop_cut(data)
    rows = [(i, float(mean), float(std)) for i, (mean, std) in enumerate(zip(fitted.avgMetrics, fitted.stdMetrics))]
    table = df.sparkSession.createDataFrame(rows, "setting int, mean double, std double")
    best = F.desc("mean") if check.isLargerBetter() else F.asc("mean")
    rank = F.row_number().over(Window.orderBy(best, F.asc("setting")))  # one row per setting
    return table.withColumn("rank", rank)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
