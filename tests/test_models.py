"""Reference model test re-created, plus explanation and persistence invariants."""

import math

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from newsprism import session
from newsprism.operators import explain as ex
from newsprism.operators import models as md
from newsprism.operators import terms as tm
from newsprism.operators.splits import stratified_kfold


@pytest.fixture(scope="module")
def toy(spark):
    rows = []
    for i in range(12):
        fake = i % 2 == 0
        split = "train" if i < 8 else "validation" if i < 10 else "test"
        rows.append((i, "fake rumor" if fake else "verified report",
                     "fake rumor clickbait" if fake else "verified report official", 0 if fake else 1, split))
    return spark.createDataFrame(rows, "row_id long, title string, content string, label int, split string")


@pytest.fixture(scope="module")
def toy_result(toy):
    return md.fit_experiment("smoke", toy, text_column="content", ngram_range=(1, 1), max_iter=100)


def test_toy_articles_are_told_apart(spark, toy_result):
    m = {(r["split"], r["metric"]): r["value"] for r in toy_result.metrics.collect()}
    assert m[("test", "accuracy")] == 1.0
    probe = spark.createDataFrame([(99, "verified official report")], "row_id long, content string")
    out = toy_result.model.transform(probe).select("prediction", vector_to_array("probability").alias("p")).first()
    assert out["prediction"] == 1.0
    assert len(out["p"]) == 2


def test_contributions_reconstruct_decision(spark, toy_result):
    model = toy_result.model
    probe = spark.createDataFrame([(99, "verified official report"), (98, "fake rumor rumor"), (97, "unseen words"), (96, None)],
                                  "row_id long, content string")
    want = {r["row_id"]: r for r in md.predict(model, probe).collect()}
    parts, intercept = ex.explained(model, probe)
    scores = {r["row_id"]: r for r in ex.decision_scores(parts, intercept).collect()}
    assert scores.keys() == want.keys()
    for i, r in want.items():
        assert abs(scores[i]["decision_score"] - r["score"]) < 1e-9 and abs(scores[i]["p_real"] - r["p"]) < 1e-9
        assert scores[i]["prediction"] == r["prediction"]
    lines = ex.explain_rows(model, probe).collect()
    probe_lines = [r for r in lines if r["row_id"] == 99]
    assert probe_lines[0]["prediction"] == 1 and {r["term"] for r in probe_lines} == {"verified", "official", "report"}
    assert [r["rank"] for r in probe_lines] == [1, 2, 3]
    assert all(abs(r["tfidf"] * r["coefficient"] - r["contribution"]) < 1e-12 for r in probe_lines)
    alone = [r for r in lines if r["row_id"] == 97]
    assert len(alone) == 1 and alone[0]["term"] is None and abs(alone[0]["p_real"] - want[97]["p"]) < 1e-9
    total = intercept + sum(r["contribution"] for r in probe_lines)
    assert abs(total - want[99]["score"]) < 1e-9
    sides = {(r["direction"], r["rank"]) for r in ex.explain_decision(parts, intercept, 2).where("row_id = 99").collect()}
    assert sides == {("real", 1), ("real", 2)}


def test_explanations_exchange_nothing_by_row(spark, toy_result, toy, capsys):
    parts, intercept = ex.explained(toy_result.model, toy)
    ex.explain_decision(parts, intercept).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_coefficients_are_the_optimum(spark, toy, toy_result):
    """Against plain gradient descent on the same penalised loss."""
    train = toy.filter("split = 'train'")
    feats = [(r["label"], r["f"]) for r in toy_result.model.transform(train).select(
        "label", vector_to_array("features").alias("f")).collect()]
    n, width = len(feats), len(feats[0][1])
    w, b = [0.0] * width, 0.0
    for _ in range(20_000):
        gw, gb = [x / n for x in w], 0.0
        for y, f in feats:
            e = 1 / (1 + math.exp(-(b + sum(a * c for a, c in zip(w, f))))) - y
            gb += e / n
            for k, c in enumerate(f):
                gw[k] += e * c / n
        w, b = [a - 0.5 * g for a, g in zip(w, gw)], b - 0.5 * gb
    coefs, intercept = ex.coefficient_table(spark, toy_result.model)
    got = [r["coefficient"] for r in coefs.orderBy("feature_index").collect()]
    assert abs(intercept - b) < 1e-6 and max(abs(x - y) for x, y in zip(got, w)) < 1e-6


def test_experiments_are_ranked_and_summed_up(spark, toy, toy_result):
    other = md.fit_experiment("another", toy, text_column="title", ngram_range=(1, 1), max_iter=100)
    table = md.compare_experiments([toy_result, other]).orderBy("rank").collect()
    assert [r["experiment"] for r in table] == ["another", "smoke"] and [r["best"] for r in table] == [True, False]
    assert md.best_experiment([toy_result, other]) is other
    curve = spark.createDataFrame([(0.5, 0.9, 0.7), (1.0, 1.0, 0.75)], "size double, train_mean double, val_mean double")
    got = {r["metric"]: r["value"] for r in md.summary_table(toy_result, curve).collect()}
    assert got["cross_validated_gap"] == 0.25 and got["train_val_gap"] == 0.0 and got["f1_weighted"] == 1.0
    assert got["vectorizer_seconds"] > 0 and got["training_seconds"] > 0


def test_an_empty_vocabulary_is_an_error(spark, toy):
    with pytest.raises(ValueError, match="vocabulary is empty"):
        md.build_pipeline((1, 1), min_df=100).fit(toy)


def test_cuts_of_a_fit_are_gone_afterwards(spark, toy):
    before = len(session._CUTS)
    md.build_pipeline((1, 1), max_iter=5).fit(toy)
    assert len(session._CUTS) == before


def test_vector_tfidf_equals_long_form(spark, sf):
    from newsprism.plans import views as V
    s = V.split_articles(spark, sf)
    train = s.filter(F.col("split") == "train")
    vec = md.TfIdfVectorizer(ngramMin=1, ngramMax=2, maxFeatures=500).fit(train)
    rows = tm.term_rows(train, "content", ngram_range=(1, 2))
    vocab = tm.vocabulary(rows.select(F.inline("terms")), 2, 500)
    terms, idf = tm.collected(vocab, train.count())
    assert terms == vec.terms() and max(abs(a - b) for a, b in zip(idf, vec.weights())) < 1e-12
    long = tm.weighted_rows(rows, terms, idf).select("row_id", F.inline("features")).select("row_id", "feature_index", "tfidf")
    dense = vec.transform(train).select("row_id", F.posexplode(vector_to_array("features")).alias("feature_index", "v"))
    joined = long.join(dense, ["row_id", "feature_index"])
    assert joined.count() == long.count()
    assert joined.filter(F.abs(F.col("tfidf") - F.col("v")) > 1e-9).count() == 0
    assert dense.filter("v != 0").count() == long.count()


def test_the_pipeline_saves_unfitted_and_fitted(spark, toy, tmp_path):
    train = toy.where("split = 'train'")
    unfitted = md.build_pipeline((1, 2), max_features=7, min_df=1, max_iter=50)
    unfitted.write().overwrite().save(str(tmp_path / "unfitted"))
    again = Pipeline.load(str(tmp_path / "unfitted"))
    vectorizer, classifier = again.getStages()
    assert isinstance(vectorizer, md.TfIdfVectorizer) and vectorizer.getOrDefault("maxFeatures") == 7
    assert vectorizer.getOrDefault("ngramMax") == 2 and classifier.getMaxIter() == 50
    fitted, other = unfitted.fit(train), again.fit(train)
    fitted.write().overwrite().save(str(tmp_path / "fitted"))
    loaded = PipelineModel.load(str(tmp_path / "fitted"))
    assert md.parts_of(loaded)[0].terms() == md.parts_of(fitted)[0].terms()
    want = [r["p"] for r in md.predict(fitted, toy).orderBy("row_id").collect()]
    for model in (other, loaded):
        assert [r["p"] for r in md.predict(model, toy).orderBy("row_id").collect()] == pytest.approx(want, abs=1e-9)
    assert set(fitted.transform(toy).columns) == {*toy.columns, "features", "rawPrediction", "probability", "prediction"}


def test_cross_validation_uses_the_folds(spark, toy):
    rows = [(i, f"w{i % 3} {'fake rumor' if i % 2 else 'real report'} w{i % 5}", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, content string, label int")
    grid = [{"ngramMax": 1}, {"ngramMin": 2, "ngramMax": 2, "minDF": 1}, {"maxFeatures": 1}]
    table = {r["setting"]: r for r in md.cross_validate(df, grid, folds=4).collect()}
    assert sorted(r["rank"] for r in table.values()) == [1, 2, 3] and table[0]["mean"] == 1.0
    folds = stratified_kfold(df, k=4)
    accuracies = []
    for f in range(4):
        model = md.build_pipeline((2, 2), min_df=1).fit(folds.where(F.col("fold") != f))
        held = md.predict(model, folds.where(F.col("fold") == f), ("label",))
        accuracies.append(held.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0])
    assert table[1]["mean"] == pytest.approx(sum(accuracies) / 4)


def test_save_and_load(spark, toy, toy_result, tmp_path):
    path = str(tmp_path / "model")
    md.save_model(toy_result.model, path)
    loaded = md.load_model(path)
    a = md.predict(toy_result.model, toy).select("row_id", "p")
    b = md.predict(loaded, toy).select("row_id", F.col("p").alias("q"))
    assert a.join(b, "row_id").filter(F.abs(F.col("p") - F.col("q")) > 1e-12).count() == 0


def test_top_terms_global(spark, toy_result):
    coefs, _ = ex.coefficient_table(spark, toy_result.model)
    top = ex.top_terms_global(coefs, 2).collect()
    real = [r["term"] for r in top if r["direction"] == "real"]
    assert set(real) <= {"verified", "report", "official"}


def test_learning_curve_equals_single_fits(spark, sf):
    """Every cell of the joint fit against a pipeline of its own over the same rows."""
    from newsprism.plans import views as V
    df = V.labeled(spark, "/root/testdata/sf0.001").select("row_id", "label", "text")
    sizes, folds = (0.3, 1.0), 3
    got = {r["size"]: r for r in md.learning_curve(df, text_column="text", sizes=sizes, folds=folds, max_features=300).collect()}
    rows = md._curve_rows(df, "text", (1, 1), folds, 42).join(df, ["row_id", "label"]).cache()
    total = rows.count()
    for size in sizes:
        train, held, sizes_in = [], [], []
        for f in range(folds):
            n = max(int(size * (total - rows.where(F.col("fold") == f).count())), 1)
            own = rows.where((F.col("ranks")[f] > 0) & (F.col("ranks")[f] <= n))
            assert own.count() == n
            model = md.build_pipeline((1, 1), max_features=300, text_col="text").fit(own)
            right = F.avg((F.col("label") == F.col("prediction")).cast("double"))
            train.append(md.predict(model, own, ("label",)).agg(right).first()[0])
            held.append(md.predict(model, rows.where(F.col("fold") == f), ("label",)).agg(right).first()[0])
            sizes_in.append(n)
        r = got[size]
        assert r["train_size"] == min(sizes_in)
        assert r["train_mean"] == pytest.approx(sum(train) / folds, abs=1e-6)
        assert r["val_mean"] == pytest.approx(sum(held) / folds, abs=1e-6)
        assert r["val_error"] == pytest.approx(1 - r["val_mean"])


def test_nested_vocabularies_are_those_of_the_cells(spark):
    rows = spark.createDataFrame([
        (0, [0, 1], [("a", 1), ("b", 2)]), (0, [0, 2], [("a", 3)]), (1, [1, 0], [("b", 1), ("c", 1)]), (1, [2, 0], [("b", 5), ("d", 1)])],
        "fold int, ranks array<int>, terms array<struct<term: string, tf: long>>")
    cells = md.Cells((0, 1), (0.5, 1.0), ((1, 2), (1, 2)))
    got = {}
    for r in md.nested_vocabularies(rows, cells, 1, 2).collect():
        got.setdefault(r["cell"], {})[r["term"]] = r["doc_freq"]
    assert got == {0: {"b": 1, "c": 1}, 1: {"b": 2, "c": 1}, 2: {"a": 1, "b": 1}, 3: {"a": 2, "b": 1}}


def test_cross_validation_tokenises_once(spark, monkeypatch):
    """Texts are tokenised before the folds and settings, not once or more for each fit; the stages take the tokens."""
    seen, tokenize = [], tm.tokenize
    monkeypatch.setattr(tm, "tokenize", lambda col: seen.append(col) or tokenize(col))
    rows = [(i, "Fake rumor the a" if i % 2 else None if i == 4 else "real report", i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "row_id long, content string, label int")
    assert md.cross_validate(df, [{"minDF": 1}, {"minDF": 1, "ngramMax": 2}], folds=2, parallelism=2).count() == 2
    assert len(seen) == 1
    both = df.withColumn("tokens", tokenize("content"))
    for rng in ((1, 1), (1, 2)):
        text, tokens = (md.TermAnalyzer(inputCol=c, outputCol="t", ngramMin=rng[0], ngramMax=rng[1]).transform(both)
                        .orderBy("row_id").select("t").collect() for c in ("content", "tokens"))
        assert text == tokens


def test_cross_validation_fits_a_settings_folds_together(spark, monkeypatch):
    """One joint fit per setting, not one per setting and fold; each fold's loss is that of a pipeline fitted without it."""
    solves, solve = [], md.linear.Fitter.solve
    rows = [(i // 2 if i < 8 else None if i == 9 else i, None if i == 11 else f"w{i % 3} w{i % 7} {'fake' if i % 5 else 'real'} w{i % 2}",
             int(i % 5 == 0 or i % 7 == 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, content string, label int")
    grid = [{"ngramMin": 2, "ngramMax": 2}, {"maxFeatures": 3}]
    want = []
    for setting in grid:
        check, losses = MulticlassClassificationEvaluator(labelCol="label", metricName="logLoss"), []
        folds = stratified_kfold(df, k=2).cache()
        for f in range(2):
            model = md.build_pipeline()
            model.getStages()[0]._set(**setting)
            losses.append(check.evaluate(model.fit(folds.where(F.col("fold") != f)).transform(folds.where(F.col("fold") == f))))
        want.append((sum(losses) / 2, (sum((x - sum(losses) / 2) ** 2 for x in losses) / 2) ** 0.5))
    monkeypatch.setattr(md.linear.Fitter, "solve", lambda self, *a, **k: solves.append(len(self.terms)) or solve(self, *a, **k))
    got = {r["setting"]: r for r in md.cross_validate(df, grid, metric="logLoss", folds=2, parallelism=2).collect()}
    assert solves == [3, 3]  # without each fold, and of all rows
    for i, (mean, std) in enumerate(want):
        assert got[i]["mean"] == pytest.approx(mean, abs=1e-7) and got[i]["std"] == pytest.approx(std, abs=1e-7)
    assert [r["rank"] for r in sorted(got.values(), key=lambda r: r["mean"])] == [1, 2]


def test_the_best_setting_is_fitted_on_all_rows(spark):
    rows = [(i % 2, i % 3, f"{'fake' if i % 2 else 'real'} w{i % 4} w{i % 5}") for i in range(30)]
    df = spark.createDataFrame(rows, "label int, fold int, content string")
    pipeline = md.build_pipeline()
    params = [{pipeline.getStages()[0].getParam("maxFeatures"): n} for n in (1, 6)]
    cv = md.FoldCrossValidator(estimator=pipeline, estimatorParamMaps=params, numFolds=3, foldCol="fold",
                               evaluator=MulticlassClassificationEvaluator(labelCol="label", metricName="logLoss"))
    fitted = cv.fit(df)
    best, alone = fitted.bestModel, pipeline.copy(params[fitted.avgMetrics.index(min(fitted.avgMetrics))]).fit(df)
    assert md.parts_of(best)[0].terms() == md.parts_of(alone)[0].terms()
    assert md.parts_of(best)[0].weights() == pytest.approx(md.parts_of(alone)[0].weights())
    assert md.parts_of(best)[1].coefficients.toArray() == pytest.approx(md.parts_of(alone)[1].coefficients.toArray(), abs=1e-7)
    with pytest.raises(ValueError, match="validation data at fold 3 is empty"):
        cv.copy({cv.numFolds: 4}).fit(df)
    with pytest.raises(ValueError, match="the vocabulary is empty"):
        cv.copy({cv.estimatorParamMaps: [{pipeline.getStages()[0].minDF: 31}]}).fit(df)


def test_documents_are_weighted_in_bounded_pieces():
    """A batch of long documents is not weighted at once; its rows stay whole and in order, empty ones too."""
    import pyarrow as pa
    sizes = [0, 5, 0, tm.ENTRIES + 7, 3, tm.ENTRIES // 2, tm.ENTRIES // 2, 0, 4]
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))
    entry = pa.StructArray.from_arrays([pa.array(["x"] * sum(sizes)), pa.array(range(sum(sizes)))], ["term", "tf"])
    lists = pa.ListArray.from_arrays(pa.array([sum(sizes[:i]) for i in range(len(sizes) + 1)], pa.int32()), entry).cast(kind)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), lists], ["row_id", "terms"])
    pieces = list(tm._pieces(batch))
    assert [i for p in pieces for i in p.column("row_id").to_pylist()] == list(range(len(sizes)))
    held = [[sizes[i] for i in p.column("row_id").to_pylist()] for p in pieces]
    assert max(sum(h) for h in held if sum(1 for n in h if n) > 1) <= tm.ENTRIES and len(pieces) > 2
