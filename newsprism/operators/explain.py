"""Explanations of linear text models: coefficient tables and per-row contributions.

Contributions are worked out inside each document's row (``terms.weighted_rows`` with
coefficients): its features, their sum and the top n of them need no exchange. Rows
without any feature stay.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.operators import terms as tm
from newsprism.operators.models import parts_of


def coefficient_table(spark: SparkSession, model: PipelineModel) -> tuple[DataFrame, float]:
    """(term, feature_index, coefficient) and the intercept of a fitted text pipeline.

    Both come from the model object (size = vocabulary <= max_features).
    """
    vec, lr = parts_of(model)
    coefs = lr.coefficients.toArray().tolist()
    rows = [(t, i, float(c)) for i, (t, c) in enumerate(zip(vec.terms(), coefs))]
    df = spark.createDataFrame(rows, "term string, feature_index int, coefficient double")
    return df, float(lr.intercept)


def explained(model: PipelineModel, df: DataFrame, id_col: str = "row_id") -> tuple[DataFrame, float]:
    """(id, parts, contribution_sum) of every row by a fitted text pipeline, and its intercept."""
    vec, lr = parts_of(model)
    analyzer = vec.analyzer()
    rows = analyzer.transform(df).select(id_col, tm.counted(F.col(analyzer.getOutputCol())).alias("terms"))
    return tm.weighted_rows(rows, vec.terms(), vec.weights(), lr.coefficients.toArray()), float(lr.intercept)


def feature_coef_join(parts: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(id, term, tfidf, coefficient, contribution) for every active feature of every row."""
    return parts.select(id_col, F.inline("parts")).drop("feature_index")


def _score(intercept: float) -> Column:
    return F.lit(float(intercept)) + F.col("contribution_sum")


def _p_real(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def decision_scores(parts: DataFrame, intercept: float, id_col: str = "row_id") -> DataFrame:
    """One row per document: intercept + sum of contributions (the model's raw score), the
    probability of class 1, the class, and how many features push either way.

    A row without any vocabulary term scores the intercept alone.
    """
    towards = lambda sign: F.size(F.filter("parts", lambda f: f["contribution"] * sign > 0)).cast("long")
    scored = parts.select(id_col, _score(intercept).alias("decision_score"), towards(1).alias("n_toward_real"),
                          towards(-1).alias("n_toward_fake"))
    p = _p_real(F.col("decision_score"))
    return scored.select(id_col, "decision_score", p.alias("p_real"), (F.lit(1.0) - p).alias("p_fake"),
                         (F.col("decision_score") > 0).cast("int").alias("prediction"), "n_toward_real", "n_toward_fake")


def _strongest(features: Column, top_n: int) -> Column:
    """The ``top_n`` features by |contribution|, ties by term."""
    keyed = F.transform(features, lambda f: F.struct((-F.abs(f["contribution"])).alias("k"), f["term"].alias("term"), f.alias("f")))
    return F.transform(F.slice(F.sort_array(keyed), 1, top_n), lambda x: x["f"])


def prediction_contributions(parts: DataFrame, intercept: float, top_n: int = 15, id_col: str = "row_id") -> DataFrame:
    """For every row its class and both probabilities, and its ``top_n`` features by |contribution| (ties by term).

    A row without features keeps one line, whose rank and feature columns are null.
    """
    score = _score(intercept)
    p = _p_real(score)
    top = parts.select(id_col, (score > 0).cast("int").alias("prediction"), (F.lit(1.0) - p).alias("p_fake"), p.alias("p_real"),
                       F.posexplode_outer(_strongest(F.col("parts"), top_n)).alias("at", "f"))
    return top.select(id_col, "prediction", "p_fake", "p_real", (F.col("at") + 1).alias("rank"), "f.term", "f.tfidf",
                      "f.coefficient", "f.contribution")


def explain_decision(parts: DataFrame, intercept: float, top_n: int = 15, id_col: str = "row_id") -> DataFrame:
    """Per row its decision score, and the features pushing toward class 1 (contribution > 0) and toward
    class 0 (< 0), each ranked by magnitude: (id, decision_score, direction, rank, term, contribution).

    A row without features keeps one line, whose direction, rank and feature are null.
    """
    def side(name: str, sign: int) -> Column:
        strongest = _strongest(F.filter("parts", lambda f: f["contribution"] * sign > 0), top_n)
        return F.transform(strongest, lambda f, i: F.struct(
            F.lit(name).alias("direction"), (i + 1).alias("rank"), f["term"].alias("term"), f["contribution"].alias("contribution")))
    return parts.select(id_col, _score(intercept).alias("decision_score"),
                        F.inline_outer(F.concat(side("real", 1), side("fake", -1))))


def explain_rows(model: PipelineModel, df: DataFrame, top_n: int = 15, id_col: str = "row_id") -> DataFrame:
    """``prediction_contributions`` of a fitted text pipeline over every row of ``df``."""
    parts, intercept = explained(model, df, id_col)
    return prediction_contributions(parts, intercept, top_n, id_col)


def top_terms_global(coefficients: DataFrame, k: int = 15) -> DataFrame:
    """k most negative (toward class 0) and k most positive (toward class 1) terms; ``coefficients`` is read twice."""
    fake = (coefficients.orderBy(F.asc("coefficient"), F.asc("term")).limit(k)
            .select(F.lit("fake").alias("direction"), "term", "coefficient"))
    real = (coefficients.orderBy(F.desc("coefficient"), F.asc("term")).limit(k)
            .select(F.lit("real").alias("direction"), "term", "coefficient"))
    return fake.unionByName(real)
