"""Matrix, small training runs, persistence, attribution, scoring."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from creditloom.modeling import attribution, matrix, scoring, selection, training
from creditloom.plans.application import application_features
from creditloom.sources.schemas import APPLICANT, LABEL

SMALL_TREES = {"maxIter": 3, "maxDepth": 2, "stepSize": 0.3, "minInstancesPerNode": 2}


@pytest.fixture(scope="module")
def train(spark):
    """The sf0.01 applicants: enough of both classes for two folds."""
    from creditloom.queries.common import Inputs

    names = ["EXT_SOURCE_1", "EXT_SOURCE_3", "AMT_CREDIT", "APP_AGE_YEARS", "APP_DOCUMENT_COUNT"]
    table = Inputs(spark, "/root/testdata/sf0.01")["application_train"]
    return application_features(table).select(
        APPLICANT, LABEL, *names, "ORGANIZATION_TYPE", "OCCUPATION_TYPE"
    ).cache()


@pytest.fixture(scope="module")
def result(train):
    return training.train_cv(train, "boosted", SMALL_TREES, n_folds=2)


def test_matrix_fills_nulls(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, None, float("nan"))], "SK_ID_CURR int, a double, b double")
    fills = matrix.column_fills(df.select("a"), ["a"]) | {"b": -1.0}
    out = matrix.assembled(df, ["a", "b"], fills)
    got = [tuple(r[0]) for r in out.orderBy("SK_ID_CURR").select(vector_to_array("features")).collect()]
    assert got == [(2.0, -1.0), (pytest.approx(0.8, abs=1e-6), -1.0)]


def test_two_fold_training(result, train):
    assert len(result.models) == 2 and len(result.fold_auc) == 2
    assert all(0.0 <= a <= 1.0 for a in result.fold_auc)
    assert result.scores.count() == train.count()
    assert result.scores.where(~F.col("score").between(0, 1)).count() == 0
    assert result.features[-2:] == ["TE_ORGANIZATION_TYPE", "TE_OCCUPATION_TYPE"]
    assert result.importance.count() == len(result.features)


@pytest.mark.parametrize("learner,params", [("forest", {"numTrees": 3, "maxDepth": 2}), ("linear", {"maxIter": 3})])
def test_other_learners(train, learner, params):
    result = training.train_cv(train, learner, params, n_folds=2)
    assert result.scores.select(APPLICANT).distinct().count() == train.count()


def test_saved_models_score_the_same(spark, result, train, tmp_path):
    scoring.save_model(result, str(tmp_path))
    about, models = scoring.load_model(spark, str(tmp_path))
    assert about["numeric"] == result.numeric and about["fold_auc"] == result.fold_auc
    again = scoring.held_out_scores(train, about, models)
    both = again.withColumnRenamed("score", "s2").join(result.scores, [APPLICANT, "fold"])
    assert both.count() == train.count()
    assert both.where(F.abs(F.col("s2") - F.col("score")) > 1e-12).count() == 0

    test = train.drop(LABEL, "AMT_CREDIT")  # a column the models know is absent
    scores = scoring.score_rows(test, about, models, train)
    check = scoring.submission_check(scores, least_rows=10).first()
    assert check["columns_ok"] and check["range_ok"] and check["keys_unique"] and check["enough_rows"]
    assert scoring.score_rows(test, about, models).count() == test.count()  # warns, encodes as zero


def test_contributions_add_up_to_the_margin(spark, train):
    names = ["EXT_SOURCE_1", "EXT_SOURCE_3", "AMT_CREDIT"]
    fills = matrix.column_fills(train, names)
    rows = matrix.assembled(train.select(APPLICANT, LABEL, *names), names, fills)
    model = training.GBTClassifier(labelCol=LABEL, maxIter=3, maxDepth=3, seed=1).fit(rows)
    every_leaf = attribution.leaves(model, rows)
    x = np.stack([r[0] for r in rows.limit(50).select(vector_to_array("features")).collect()])
    scored = model.transform(rows).select(vector_to_array("features"), vector_to_array("probability"))
    odds = {tuple(a): np.log(p[1] / p[0]) for a, p in scored.collect()}
    parts = attribution.contributions(x, every_leaf)
    base = sum(value * np.prod([s[3] for s in steps]) for value, steps in every_leaf)
    want = np.array([odds[tuple(row)] for row in x])
    assert np.allclose(parts.sum(axis=1) + base, want, atol=1e-9)

    table = attribution.contribution_importance(model, rows, names)
    got = {r["feature"]: r["importance"] for r in table.collect()}
    every = np.stack([r[0] for r in rows.select(vector_to_array("features")).collect()])
    mean = np.abs(attribution.contributions(every, every_leaf)).mean(axis=0)
    assert got == {n: pytest.approx(v) for n, v in zip(names, mean)}


def test_attribution_equals_definition():
    """Against the Shapley sum over all coalitions, on one hand-made tree."""
    from itertools import combinations
    from math import factorial

    inf = float("inf")
    tree = [
        (1.0, [(0, -inf, 0.5, 0.6), (1, -inf, 2.0, 0.5)]),
        (3.0, [(0, -inf, 0.5, 0.6), (1, 2.0, inf, 0.5)]),
        (-2.0, [(0, 0.5, inf, 0.4), (2, -inf, 0.0, 0.25)]),
        (5.0, [(0, 0.5, inf, 0.4), (2, 0.0, inf, 0.75)]),
    ]
    x = np.array([[0.1, 3.0, 1.0], [0.9, 1.0, -1.0]])

    def worth(row, coalition):
        total = 0.0
        for value, steps in tree:
            for f, lo, hi, share in steps:
                value *= float(lo < row[f] <= hi) if f in coalition else share
            total += value
        return total

    got = attribution.contributions(x, tree)
    for i, row in enumerate(x):
        for f in range(3):
            others = [j for j in range(3) if j != f]
            want = sum(
                factorial(k) * factorial(2 - k) / 6 * (worth(row, {*s, f}) - worth(row, set(s)))
                for k in range(3)
                for s in combinations(others, k)
            )
            assert got[i, f] == pytest.approx(want)


def test_pruning(spark):
    rows = [(f"f{i}", float(i)) for i in range(5)] + [("TE_x", 9.0)]
    table = spark.createDataFrame(rows, "feature string, importance double")
    kept = {r["feature"]: r["encoded"] for r in selection.prune_features(table, 25.0).collect()}
    assert kept == {"f3": False, "f4": False, "TE_x": True}


def test_search_space_is_reproducible():
    draws = [training.draw_trial(i) for i in range(30)]
    assert draws == [training.draw_trial(i) for i in range(30)] and len({str(d) for d in draws}) == 30
    assert all(low <= d[n] <= high for d in draws for n, (low, high) in training.SEARCHED.items())


def test_rounds_are_chosen_by_auc(spark, train, result):
    """AUC per round against Spark's evaluator, the cut ensemble against the whole one."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from creditloom.modeling import trees

    names = ["EXT_SOURCE_1", "EXT_SOURCE_3", "AMT_CREDIT"]
    rows = matrix.assembled(train.select(APPLICANT, LABEL, *names), names, matrix.column_fills(train, names))
    model = training.GBTClassifier(labelCol=LABEL, maxIter=6, maxDepth=3, seed=1).fit(rows)
    aucs = trees.round_aucs(model, rows)
    area = BinaryClassificationEvaluator(labelCol=LABEL)
    for rounds in (1, 4, 6):
        short = trees.cut(model, rounds)
        assert short.getNumTrees == rounds and short.numFeatures == 3
        assert area.evaluate(short.transform(rows)) == pytest.approx(aucs[rounds - 1], abs=1e-9)
    found = {r["feature"]: r["importance"] for r in trees.node_importance(trees.node_table(model, spark), names).collect()}
    assert [found[n] for n in names] == pytest.approx(model.featureImportances.toArray())

    for aucs, kept in zip(result.round_auc, result.models):
        assert len(aucs) == 3 and kept.getNumTrees == training.best_round(aucs)[0]
    for fold, auc in enumerate(result.fold_auc):
        assert auc == pytest.approx(max(result.round_auc[fold]), abs=1e-12)


def test_patience():
    assert training.best_round([0.5, 0.6, 0.6, 0.55], 2) == (2, True)
    assert training.best_round([0.5, 0.6, 0.6, 0.55], 3) == (2, False)
    assert training.best_round([0.5, 0.6, 0.5, 0.5, 0.9], 2) == (2, True)
    assert training.best_round([0.5], 2) == (1, False)


def test_forest_importance_from_nodes(spark, train):
    from creditloom.modeling import trees

    names = ["EXT_SOURCE_1", "EXT_SOURCE_3", "AMT_CREDIT"]
    rows = matrix.assembled(train.select(APPLICANT, LABEL, *names), names, matrix.column_fills(train, names))
    model = training.RandomForestClassifier(labelCol=LABEL, numTrees=4, maxDepth=4, seed=1).fit(rows)
    nodes = trees.node_table(model, spark)
    found = {r["feature"]: r["importance"] for r in trees.node_importance(nodes, names, per_tree=True).collect()}
    assert [found[n] for n in names] == pytest.approx(model.featureImportances.toArray())


def test_importance_equals_sql_over_the_same_nodes(spark, result, train, tmp_path):
    """The gains of two fold models, summed by another engine."""
    import duckdb

    from creditloom.modeling import trees

    parts = [trees.node_table(m, spark).withColumn("model", F.lit(k)) for k, m in enumerate(result.models)]
    parts[0].unionByName(parts[1]).coalesce(1).write.parquet(f"{tmp_path}/nodes")
    want = duckdb.sql(
        "WITH s AS (SELECT model, feature, sum(gain * cover) AS g FROM"
        f" '{tmp_path}/nodes/*.parquet' WHERE feature IS NOT NULL GROUP BY ALL)"
        " SELECT feature, sum(share) / 2 FROM"
        " (SELECT feature, g / sum(g) OVER (PARTITION BY model) AS share FROM s) GROUP BY feature"
    ).fetchall()
    got = {r["feature"]: r["importance"] for r in result.importance.collect()}
    assert {n: v for n, v in got.items() if v} == {result.features[i]: pytest.approx(v) for i, v in want}


def test_interrupted_save_is_not_loaded(spark, result, train, tmp_path):
    path = str(tmp_path)
    first = scoring.save_model(result, path)
    result.models[0].write().save(f"{path}/unfinished/fold_0")  # a driver lost before its commit
    assert scoring.load_model(spark, path)[0]["fold_auc"] == result.fold_auc
    with pytest.raises(FileNotFoundError):
        scoring.load_model(spark, path, "unfinished")
    second = scoring.save_model(result, path)
    assert {r["version"] for r in scoring.versions(spark, path).collect()} == {first, second}
    assert len(scoring.load_model(spark, path, first)[1]) == 2


def test_search_goes_on_where_it_was_interrupted(spark, train, tmp_path, monkeypatch):
    names, ledger = ["EXT_SOURCE_1", "EXT_SOURCE_3"], f"{tmp_path}/ledger"
    real, calls = training.cross_validated, []

    def counted(*args, **kwargs):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("driver lost")
        return real(*args, **kwargs)

    monkeypatch.setattr(training, "cross_validated", counted)
    options = dict(n_trials=3, n_folds=2, features=names, rounds=1, ledger=ledger, patience=1)
    with pytest.raises(RuntimeError):
        training.random_search(train, **options)
    best, trials = training.random_search(train, **options)
    assert len(calls) == 4  # trial 0, the lost one, trials 1 and 2
    rows = {r["trial"]: r for r in trials.collect()}
    assert rows.keys() == {0, 1, 2} and best["maxIter"] == 1
    assert all(rows[i]["max_depth"] == training.draw_trial(i)["max_depth"] for i in rows)
    training.random_search(train, **options)
    assert len(calls) == 4
    training.random_search(train, **{**options, "n_trials": 1, "rounds": 2})  # another job
    assert len(calls) == 5


def test_contributions_over_all_folds(train, result):
    """Patterns looked up per leaf against the direct sum, and the mean over the fold models."""
    names = ["EXT_SOURCE_1", "EXT_SOURCE_3", "AMT_CREDIT", "APP_AGE_YEARS", "APP_DOCUMENT_COUNT"]
    ready = training.prepared(train, 2, names, result.encoded)
    table = {r["feature"]: r["importance"] for r in attribution.cv_contributions(result, ready).collect()}
    assert table.keys() == set(result.features)
    wanted = np.zeros(len(result.features))
    for k, model in enumerate(result.models):
        rows = training.model_rows(ready.rows, k, result.numeric, result.encoded, result.fills)
        x = np.stack([r[0] for r in rows.select(vector_to_array("features")).collect()])
        every_leaf = attribution.leaves(model, rows)
        parts = [attribution.contributions(x[i : i + 1], every_leaf) for i in range(len(x))]
        wanted += np.abs(np.concatenate(parts)).mean(axis=0) / 2
    assert table == {n: pytest.approx(v) for n, v in zip(result.features, wanted)}


def test_sample_is_the_rows_with_the_smallest_hashes(spark):
    import hashlib

    keys = [*range(300), *[7] * 40, None, None]
    df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(4)
    ranked = sorted(keys, key=lambda k: hashlib.md5(f"42:{'' if k is None else k}".encode()).hexdigest())
    for n in (0, 1, 5, 100, 299, 341, 342, 1000):
        got = [r["k"] for r in selection.sample_rows(df, n, "k").collect()]
        assert sorted(map(str, got)) == sorted(map(str, ranked[:n]))
    plan = selection.sample_rows(df, 100, "k")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan.split("Limit")[0]


def test_numbers_are_assembled_once(train, result, monkeypatch):
    """Later fits read the written vectors, which hold what the columns hold."""
    names = ["EXT_SOURCE_1", "EXT_SOURCE_3", "AMT_CREDIT", "APP_AGE_YEARS"]
    ready = training.prepared(train, 2, names, result.encoded)
    fills = ready.fills(False)
    for chosen in (names, names[::2]):
        at = None if chosen == names else [0, 2]
        one = training.model_rows(ready.rows, 1, chosen, result.encoded, fills)
        two = training.fold_rows(ready.vectors(False), 1, at, result.encoded)
        told = [APPLICANT, LABEL, "fold", vector_to_array("features").alias("x")]
        assert sorted(one.select(*told).collect()) == sorted(two.select(*told).collect())
    files = set(ready.vectors(False).inputFiles())
    assert {f.split("/fold=")[1][0] for f in files} == {"0", "1"}
    training.cross_validated(ready, "boosted", SMALL_TREES, scored=False)
    monkeypatch.setattr(training, "written", None)  # nothing is assembled or written again
    training.cross_validated(ready, "boosted", SMALL_TREES, features=names[:2], scored=False)


def test_tasks_of_a_fit_are_bounded():
    """A task returns the statistics of all nodes: their number follows the cores, not the rows."""
    assert training.fit_tasks(1_000, 12, 5) == 1
    assert training.fit_tasks(80_000, 12, 5) == 2
    assert training.fit_tasks(800_000, 12, 5) == 8
    assert training.fit_tasks(800_000, 12, 1) == 12
    assert training.fold_width(787_500, 378, 5) == 5
    assert training.fold_width(4_725_000, 378, 5) == 1


def test_few_refits(monkeypatch):
    """A search for rounds that never ends by itself fits a third more than its last fit."""
    fitted = []

    class Fit:
        maxIter = "maxIter"

        def __init__(self, rounds):
            self.rounds = rounds

        def getOrDefault(self, _):
            return self.rounds

        def copy(self, extra):
            return Fit(extra["maxIter"])

        def fit(self, _):
            fitted.append(self.rounds)
            return self.rounds

    monkeypatch.setattr(training, "round_aucs", lambda model, _: [i / model for i in range(model)])
    monkeypatch.setattr(training, "cut", lambda model, rounds: rounds)
    assert training.fit_rounds(Fit(1000), None, None, 8)[0] == 1000
    assert sum(fitted) < 1.4 * 1000


def test_one_fit_for_an_early_best_round(monkeypatch):
    """Patience that ends soon after twice its length does not cost a second fit."""
    fitted = []

    class Fit:
        maxIter = "maxIter"

        def __init__(self, rounds):
            self.rounds = rounds

        def getOrDefault(self, _):
            return self.rounds

        def copy(self, extra):
            return Fit(extra["maxIter"])

        def fit(self, _):
            fitted.append(self.rounds)
            return self.rounds

    monkeypatch.setattr(training, "round_aucs", lambda model, _: [-abs(i - 11) for i in range(model)])
    monkeypatch.setattr(training, "cut", lambda model, rounds: rounds)
    assert training.fit_rounds(Fit(1000), None, None, 8)[0] == 12
    assert len(fitted) == 1
    assert training.fit_lengths(1000, 8) == [24, 82, 286, 1000]
    assert training.fit_lengths(1, 1) == [1] and training.fit_lengths(3, 50) == [3]


def test_trials_read_one_copy_of_the_rows(train, monkeypatch):
    """Vectors without encodings are kept once for all trials and folds, with the same AUCs."""
    names = ["EXT_SOURCE_1", "EXT_SOURCE_3", "AMT_CREDIT"]
    ready = training.prepared(train, 2, names, [])
    params = {**training.learner_params(training.draw_trial(0)), "maxIter": 1}
    want = training.cross_validated(ready, "boosted", params, patience=1, scored=False).fold_auc

    kind, kept = type(train), []
    real = kind.persist
    monkeypatch.setattr(kind, "persist", lambda df, *level: kept.append(df) or real(df, *level))
    options = dict(n_trials=2, n_folds=2, features=names, rounds=1, patience=1)
    trials = training.random_search(train, **options)[1].orderBy("trial").collect()
    assert len(kept) == 1 and not kept[0].is_cached
    assert len(trials) == 2 and trials[0]["auc"] == pytest.approx(np.mean(want), abs=1e-12)


def test_trees_are_those_of_spark(spark):
    """Without draws the fitted trees equal Spark's, node by node, whatever the weight of a class."""
    from creditloom.modeling import boosting, trees

    rng = np.random.default_rng(3)
    x = rng.integers(0, 7, (400, 5)).astype(float) / 2
    label = ((x[:, 0] + x[:, 2] * x[:, 1] / 3 + rng.normal(0, 0.8, 400)) > 2.5).astype(int)
    rows = [(i, int(y), i % 2, *map(float, v)) for i, (y, v) in enumerate(zip(label, x))]
    names = [f"f{i}" for i in range(5)]
    table = spark.createDataFrame(rows, [APPLICANT, LABEL, "fold", *names]).repartition(3)
    ready = training.Prepared(table, 2, names, [])
    exact = {
        "maxIter": 4, "maxDepth": 3, "stepSize": 0.2, "minInstancesPerNode": 25,
        "subsamplingRate": 1.0, "featureSubsetStrategy": "all",
    }
    for positive in (None, 2.5):
        own = exact if positive is None else {**exact, "positive": positive}
        got = training.cross_validated(ready, "boosted", own, patience=4)
        vectors = training._weighted(ready.vectors(False), positive)
        for k, model in enumerate(got.models):
            rows = training.fold_rows(vectors, k, None, []).where(F.col("fold") != k)
            want = training.GBTClassifier(labelCol=LABEL, weightCol="weight", seed=42, **exact).fit(rows)
            kept = model.getNumTrees
            assert len(got.round_auc[k]) == 4 and kept == training.best_round(got.round_auc[k], 4)[0]
            told = [
                sorted(map(tuple, trees.node_table(m, spark).where(F.col("tree") < kept).collect()))
                for m in (model, want)
            ]
            for a, b in zip(*told, strict=True):
                assert [v is None for v in a] == [v is None for v in b]
                assert [v for v in a if v is not None] == pytest.approx([v for v in b if v is not None], abs=1e-9)
    assert boosting.drawn_features("0.8", 378) == 303 and boosting.drawn_features("sqrt", 10) == 4


def test_every_round_is_fitted_once(train, monkeypatch):
    """The boosted learner waits for its patience without a second fit, with files in any order."""
    monkeypatch.setattr(training, "fit_rounds", None)
    names = ["EXT_SOURCE_1", "EXT_SOURCE_3", "AMT_CREDIT", "APP_AGE_YEARS"]
    params = {**SMALL_TREES, "maxIter": 40}
    one, two = (
        training.cross_validated(training.prepared(rows, 2, names), "boosted", params, patience=5)
        for rows in (train, train.repartition(7))
    )
    assert one.round_auc == two.round_auc
    for aucs, model in zip(one.round_auc, one.models):
        best, ended = training.best_round(aucs, 5)
        assert model.getNumTrees == best and len(aucs) == (best + 5 if ended else 40)


def test_bins_have_equal_shares():
    from creditloom.modeling import boosting

    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=40_000), np.full(3_000, -9.0)])
    rng.shuffle(values)
    ones = np.ones(10_000, np.int64)
    parts = [boosting.summary(p, ones[: len(p)]) for p in np.array_split(values, 5)]
    merged = boosting.summary(*(np.concatenate(c) for c in zip(*parts)))
    assert merged[1].sum() == len(values) and len(merged[0]) <= boosting.SUMMARY
    bounds = boosting.thresholds(*merged)
    sizes = np.bincount(np.searchsorted(bounds, values), minlength=32) / len(values)
    assert len(bounds) == 31 and sizes[0] == 3_000 / len(values) and max(sizes[1:]) < 1.5 / 32
    assert boosting.thresholds(np.array([0.0, 1.0, 4.0]), np.array([1, 9_999, 1])) == [0.5, 2.5]


def test_sums_of_nodes_are_exact():
    """Single features, pairs and pieces of rows give the same sums as one feature at a time."""
    from creditloom.modeling import boosting

    rng = np.random.default_rng(9)
    n = boosting.PIECE + 5_000
    x = rng.integers(0, 32, (5, n)).astype(np.uint16)
    pairs = np.stack([x[0] << 5 | x[1], x[2] << 5 | x[3], x[4] << 5])
    residual = rng.integers(-(1 << 19) + 1, 1 << 19, n)
    for slots in (1, 3, 40):
        slot = rng.integers(0, slots, n)
        got = boosting.Rows(pairs, 5).sums(np.arange(n), slot, residual + boosting.COUNT, slots)
        for f in range(5):
            want = np.zeros((2, slots, 32))
            np.add.at(want[0], (slot, x[f]), 1)
            np.add.at(want[1], (slot, x[f]), residual)
            assert (got[0][:, f] == want[0]).all() and (got[1][:, f] == want[1]).all()


def test_registered_fits_run_the_learners_defaults(monkeypatch):
    """The queries name neither fewer rounds nor less patience than the operators have."""
    from creditloom.queries import models

    asked = {}
    monkeypatch.setattr(models, "_kept", {})
    monkeypatch.setattr(models, "_ready", lambda *_: "ready")
    monkeypatch.setattr(training, "cross_validated", lambda *a, **k: asked.update(fit=k))

    class Session:
        class sparkContext:
            applicationId, defaultParallelism = "none", 8

    models._fitted(Session, "nowhere", "boosted")
    assert asked["fit"].get("patience", training.PATIENCE) == training.PATIENCE == 50

    class Asked(Exception):
        pass

    def search(*_, **settings):
        asked.update(search=settings)
        raise Asked

    monkeypatch.setattr(models, "_wide", lambda *_: "wide")
    monkeypatch.setattr(training, "random_search", search)
    with pytest.raises(Asked):
        models._search(Session, "nowhere")
    assert asked["search"]["rounds"] == 1500 and asked["search"].get("n_trials", 30) == 30
    assert asked["search"].get("patience", training.PATIENCE) == training.PATIENCE
