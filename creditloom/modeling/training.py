"""Cross-validated training of three learners, search and ablation."""

from __future__ import annotations

import hashlib
import json
import math
import statistics
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.modeling import boosting
from creditloom.modeling.logs import append_run
from creditloom.modeling.matrix import VECTOR, assembled, column_fills
from creditloom.modeling.selection import class_weights, mean_importance
from creditloom.modeling.trees import cut, node_importance, node_table, round_aucs
from creditloom.operators.folds import (
    encode_every_fold, fold_encodings, present_encoded, stratified_folds,
)
from creditloom.operators.metrics import auc_exact
from creditloom.plans.feature_table import feature_columns, numeric_feature_columns
from creditloom.session import in_threads, materialised, scratch_dir, written
from creditloom.sources.schemas import APPLICANT, LABEL

#: Defaults of the boosted trees: depth, rate, rounds, row and column share, leaf size.
BOOSTED = {
    "maxDepth": 6, "stepSize": 0.05, "maxIter": 1000, "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8", "minInstancesPerNode": 20, "seed": 42,
}
FOREST = {
    "maxDepth": 8, "numTrees": 300, "subsamplingRate": 0.8, "featureSubsetStrategy": "sqrt",
    "minInstancesPerNode": 20, "seed": 42,
}
#: Rounds without a larger held-out AUC after which boosting is over.
PATIENCE = 50
LINEAR = {"maxIter": 100, "regParam": 0.01, "elasticNetParam": 0.0}


@dataclass(frozen=True)
class Learner:
    """A Spark ML classifier with its defaults and what it needs of its input.

    ``validated`` learners keep as many rounds as are best on the held-out rows,
    ``median`` fills nulls with medians, ``positive`` weighs the positive class
    (None: not at all, 0: balanced).
    """

    make: Callable[..., Estimator]
    defaults: dict
    validated: bool = False
    median: bool = False
    positive: float | None = None


def learners() -> dict[str, Learner]:
    return {
        "boosted": Learner(GBTClassifier, BOOSTED, validated=True),
        "forest": Learner(RandomForestClassifier, FOREST, positive=2.5),
        "linear": Learner(LogisticRegression, LINEAR, median=True, positive=0.0),
    }


@dataclass
class CvResult:
    """What a cross-validated run leaves behind."""

    learner: str
    params: dict
    models: list[Model]
    numeric: list[str]
    encoded: list[str]
    fills: dict[str, float]
    scores: DataFrame | None
    fold_auc: list[float]
    #: Held-out AUC after every fitted round of each fold; empty for other learners.
    round_auc: list[list[float]]
    spark: SparkSession

    @cached_property
    def importance(self) -> DataFrame:
        """Mean importance of each feature over the fold models."""
        return model_importance(self.spark, self.models, self.features)

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *(f"TE_{c}" for c in self.encoded)]

    @property
    def mean_auc(self) -> float:
        return statistics.fmean(self.fold_auc)

    @property
    def std_auc(self) -> float:
        return statistics.pstdev(self.fold_auc)


def with_score(model: Model, rows: DataFrame, name: str = "score") -> DataFrame:
    """Probability of the positive class; the learner's own output columns are dropped."""
    out = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return out.drop("rawPrediction", "probability", "prediction")


def best_round(aucs: list[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """Round with the highest AUC before ``patience`` rounds brought nothing better.

    Also whether patience ended the search, so that later rounds cannot matter.
    """
    best = 0
    for i, auc in enumerate(aucs):
        if auc > aucs[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def fit_rounds(
    estimator: Estimator, rows: DataFrame, held: DataFrame, patience: int
) -> tuple[Model, list[float]]:
    """Boosted trees cut at the round with the best AUC on ``held``, and the AUC of all rounds.

    Spark fits a given number of rounds and cannot go on from a model, so the lengths of
    :func:`fit_lengths` are tried until patience ends the search.
    """
    lengths = fit_lengths(estimator.getOrDefault(estimator.maxIter), patience)
    for rounds in lengths:
        model = estimator.copy({estimator.maxIter: rounds}).fit(rows)
        aucs = round_aucs(model, held)
        best, ended = best_round(aucs, patience)
        if ended or rounds == lengths[-1]:
            return cut(model, best), aucs


def fit_lengths(wanted: int, patience: int) -> list[int]:
    """Rounds of the fits that are tried one after the other, the last of ``wanted`` rounds.

    Each is ``GROWTH`` times the one before, the first at least twice the patience.
    Counted down from the last, so that no fit is nearly as long as the next: all
    earlier ones together cost two fifths of it.
    """
    lengths = [wanted]
    while (shorter := math.ceil(wanted / GROWTH ** len(lengths))) >= max(1, 2 * patience):
        if shorter == lengths[0]:
            break
        lengths.insert(0, shorter)
    return lengths


#: Rounds of the next fit, in those of the one that patience did not end.
GROWTH = 3.5
#: Rows that a task of a fit has at least and, beyond a task per core, at most.  Every
#: level of every tree is a job in which each task returns the statistics of all nodes,
#: so tasks of few rows cost more than their rows; tree points of 100,000 rows and 400
#: features take 160 MB.
TASK_ROWS, MOST_TASK_ROWS = 5_000, 100_000
#: Numbers of all folds that are fitted at a time (12 GB in double precision): what a
#: cluster cannot keep in memory it reads from disk again in every pass.
MOST_CELLS = 1_500_000_000


def fold_width(rows: int, features: int, parallel: int) -> int:
    """Folds that are fitted at a time."""
    return max(1, min(parallel, MOST_CELLS // max(1, rows * features)))


def fit_tasks(rows: int, cores: int, width: int) -> int:
    """Tasks of one fold's fit, where ``width`` folds share the cores."""
    return max(1, min(rows // TASK_ROWS, max(cores // width, rows // MOST_TASK_ROWS)))


@dataclass
class Prepared:
    """Folded rows with all features, written once and read by every model.

    Target encodings are arrays over the folds.  Fills and filled vectors are computed
    once per kind.
    """

    rows: DataFrame
    n_folds: int
    numeric: list[str]
    encoded: list[str]
    _fills: dict[bool, dict[str, float]] = field(default_factory=dict)
    _vectors: dict[bool, DataFrame] = field(default_factory=dict)

    @cached_property
    def bins(self) -> tuple[DataFrame, list[list[float]]]:
        """Rows with the bin of every feature, and the bounds of the bins.

        Features are the numbers, then each encoding as every model sees it.
        """
        names = [f"TE_{c}" for c in self.encoded]
        seen = {f"_{k}_{n}": F.get(n, F.lit(k)) for n in names for k in range(self.n_folds)}
        ready = self.vectors(False).withColumns(seen).drop(*names)
        zeros = {c: 0.0 for c in seen}
        if seen:
            ready = assembled(ready, list(seen), zeros, before=[NUMBERS])
        else:
            ready = ready.withColumnRenamed(NUMBERS, VECTOR)
        bounds = boosting.bin_bounds(ready)
        return written(boosting.binned(ready, bounds)), bounds

    @cached_property
    def count(self) -> int:
        return self.rows.count()

    def fills(self, median: bool) -> dict[str, float]:
        if median not in self._fills:
            self._fills[median] = column_fills(self.rows, self.numeric, median)
        return self._fills[median]

    def vectors(self, median: bool) -> DataFrame:
        """Key, label, fold, encodings and one vector of all filled numbers.

        Fits read their rows several times, and each model of a search or an ablation
        again: the expressions of some hundred columns run once.
        """
        if median not in self._vectors:
            filled = assembled(self.rows, self.numeric, self.fills(median), NUMBERS)
            self._vectors[median] = written(filled, "fold")
        return self._vectors[median]


def prepared(
    df: DataFrame, n_folds: int = 5, numeric: list[str] | None = None, encoded: list[str] | None = None
) -> Prepared:
    """Key, label, fold and features of all labelled rows as one Parquet table."""
    numeric = numeric_feature_columns(df) if numeric is None else numeric
    encoded = present_encoded(df) if encoded is None else encoded
    folded = stratified_folds(df.select(APPLICANT, LABEL, *numeric, *encoded), n_folds)
    if encoded:
        slim = materialised(folded.select(LABEL, "fold", *encoded))
        encodings = materialised(fold_encodings(slim, encoded))
        folded = encode_every_fold(folded, encodings, encoded).drop(*encoded)
    return Prepared(written(folded), n_folds, numeric, encoded)


def model_rows(
    rows: DataFrame, fold: int, numeric: list[str], encoded: list[str], fills: dict[str, float]
) -> DataFrame:
    """:class:`Prepared` rows as model ``fold`` sees them: filled and assembled."""
    names = [*numeric, *(f"TE_{c}" for c in encoded)]
    seen = (F.get(f"TE_{c}", F.lit(fold)).alias(f"TE_{c}") for c in encoded)
    kept = [c for c in (APPLICANT, LABEL, "fold", "weight") if c in rows.columns]
    ready = rows.select(*kept, *numeric, *seen)
    return assembled(ready, names, {**{n: 0.0 for n in names}, **fills})


#: Vector of the filled numeric columns, in front of the encodings.
NUMBERS = "_numbers"


def fold_rows(vectors: DataFrame, fold: int, positions: list[int] | None, encoded: list[str]) -> DataFrame:
    """:func:`model_rows` from :meth:`Prepared.vectors`, of the numbers at ``positions`` (None: all)."""
    names = [f"TE_{c}" for c in encoded]
    kept = [c for c in (APPLICANT, LABEL, "fold", "weight") if c in vectors.columns]
    seen = (F.get(n, F.lit(fold)).alias(n) for n in names)
    ready = vectors.select(*kept, NUMBERS, *seen)
    if positions is not None:
        sliced = VectorSlicer(inputCol=NUMBERS, outputCol="_chosen", indices=positions)
        ready = sliced.transform(ready).drop(NUMBERS).withColumnRenamed("_chosen", NUMBERS)
    if not names:
        return ready.withColumnRenamed(NUMBERS, VECTOR)  # nothing to assemble
    return assembled(ready, names, {n: 0.0 for n in names}, before=[NUMBERS])


def train_cv(
    df: DataFrame,
    learner: str = "boosted",
    params: dict | None = None,
    n_folds: int = 5,
    features: list[str] | None = None,
    name: str = "default",
    log_path: str | None = None,
    target_encoding: bool = True,
    parallel: int = 2,
    patience: int = PATIENCE,
) -> CvResult:
    """Train one model per stratified fold and score the rows held out from it."""
    chosen = set(features or feature_columns(df))
    numeric = [c for c in numeric_feature_columns(df) if c in chosen]
    ready = prepared(df, n_folds, numeric, None if target_encoding else [])
    result = cross_validated(ready, learner, params, parallel=parallel, patience=patience)
    if log_path:
        count = len(result.features)
        append_run(df.sparkSession, log_path, name, result.fold_auc, count, result.params)
    return result


def cross_validated(
    ready: Prepared,
    learner: str = "boosted",
    params: dict | None = None,
    features: list[str] | None = None,
    parallel: int = 2,
    patience: int = PATIENCE,
    scored: bool = True,
) -> CvResult:
    """:func:`train_cv` over prepared rows, or over some ``features`` of them.

    Training and scoring run on the executors, the driver only starts the fold
    jobs.  Without ``scored`` no held-out scores are kept; boosted trees have the
    AUC of their folds from the rounds.
    """
    spec = learners()[learner]
    settings = spec.defaults | (params or {})
    positive = settings.pop("positive", spec.positive)  # ours, not the classifier's
    numeric = [c for c in ready.numeric if features is None or c in set(features)]
    encoded = ready.encoded
    fills = {c: v for c, v in ready.fills(spec.median).items() if c in set(numeric)}
    spark = ready.rows.sparkSession
    if _in_task(ready, spec, settings):
        return _boosted(ready, learner, settings, positive, numeric, fills, parallel, patience, scored)
    positions = None if numeric == ready.numeric else [ready.numeric.index(c) for c in numeric]
    width = fold_width(ready.count, len(numeric) + len(encoded), min(parallel, ready.n_folds))
    tasks = fit_tasks(ready.count, spark.sparkContext.defaultParallelism, width)
    vectors = ready.vectors(spec.median)
    # only ever fewer partitions than the files have, by merging whole ones
    weighted = _weighted(vectors.coalesce(tasks), positive)
    scored = scored or not spec.validated
    # vectors that are kept and taken as they are need no second copy per fold
    as_kept = vectors.is_cached and positions is None and not encoded

    def fit(k: int) -> tuple[Model, DataFrame | None, list[float]]:
        rows = fold_rows(weighted, k, positions, encoded)
        train, held = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        if not as_kept:
            train = train.persist()  # a fit reads its rows three times before the first tree
        estimator = spec.make(featuresCol=VECTOR, labelCol=LABEL, weightCol="weight", **settings)
        try:
            if spec.validated:
                model, aucs = fit_rounds(estimator, train, held, patience)
            else:
                model, aucs = estimator.fit(train), []
        finally:
            if not as_kept:
                train.unpersist()
        if not scored:
            return model, None, aucs
        # each held-out row is scored once
        scores = written(with_score(model, held).select(APPLICANT, LABEL, "fold", "score"))
        return model, scores, aucs

    scratch_dir(spark)  # names the checkpoint folder before threads start
    fitted = in_threads(spark, [lambda k=k: fit(k) for k in range(ready.n_folds)], width)
    scores = None
    if scored:
        scores = reduce(DataFrame.unionByName, (part for _, part, _ in fitted))
        found = auc_exact(scores, "score", by=["fold"]).orderBy("fold").collect()  # one row per fold
        aucs = [row["auc"] for row in found]
    else:
        aucs = [rounds[best_round(rounds, patience)[0] - 1] for _, _, rounds in fitted]
    return CvResult(
        learner, settings, [model for model, _, _ in fitted], numeric, encoded, fills, scores,
        aucs, [rounds for _, _, rounds in fitted], spark,
    )


def _in_task(ready: Prepared, spec: Learner, settings: dict) -> bool:
    """Whether each fit finds place in one task, as a function of the rows and settings alone."""
    cells = ready.count * (len(ready.numeric) + len(ready.encoded) * ready.n_folds)
    known = settings.keys() <= boosting.KNOWN and settings.get("maxDepth", 0) <= boosting.DEEPEST
    return spec.validated and known and 0 < cells <= boosting.MOST_TASK_CELLS


def _boosted(
    ready: Prepared, learner: str, settings: dict, positive: float | None, numeric: list[str],
    fills: dict[str, float], parallel: int, patience: int, scored: bool,
) -> CvResult:
    """:func:`cross_validated` by :mod:`boosting`: every fit is one task, no round is fitted twice.

    Without ``scored`` there are no models either.
    """
    spark = ready.rows.sparkSession
    table, bounds = ready.bins
    at = {c: i for i, c in enumerate(ready.numeric)}
    columns = {"featuresCol": VECTOR, "labelCol": LABEL, "weightCol": "weight"}

    def fit(k: int) -> tuple[Model | None, DataFrame | None, list[float]]:
        own = [len(at) + i * ready.n_folds + k for i in range(len(ready.encoded))]
        positions = [*(at[c] for c in numeric), *own]
        weight = 1.0 if positive is None else positive
        rows = boosting.fitted(
            table, k, positions, bounds, ready.count, settings, weight, patience, scored
        ).toArrow()  # as large as the model
        aucs = rows.column("aucs")[-1].as_py()
        if not scored:
            return None, None, aucs
        nodes = rows.slice(0, rows.num_rows - 1).drop_columns(["aucs"])
        model = boosting.model_of(spark, nodes, len(positions), columns, settings)
        chosen = None if numeric == ready.numeric else [at[c] for c in numeric]
        held = fold_rows(ready.vectors(False).where(F.col("fold") == k), k, chosen, ready.encoded)
        scores = written(with_score(model, held).select(APPLICANT, LABEL, "fold", "score"))
        return model, scores, aucs

    scratch_dir(spark)  # names the checkpoint folder before threads start
    fits = in_threads(
        spark, [lambda k=k: fit(k) for k in range(ready.n_folds)], min(parallel, ready.n_folds)
    )
    rounds, scores = [aucs for _, _, aucs in fits], None
    if scored:
        scores = reduce(DataFrame.unionByName, (part for _, part, _ in fits))
        found = auc_exact(scores, "score", by=["fold"]).orderBy("fold").collect()  # one row per fold
        fold_auc = [row["auc"] for row in found]
    else:
        fold_auc = [aucs[best_round(aucs, patience)[0] - 1] for aucs in rounds]
    models = [model for model, _, _ in fits if model is not None]
    return CvResult(
        learner, settings, models, numeric, ready.encoded, fills, scores, fold_auc, rounds, spark
    )


def _weighted(df: DataFrame, positive: float | None) -> DataFrame:
    if positive is None:
        return df.withColumn("weight", F.lit(1.0))
    return class_weights(df, positive or None)


def model_importance(spark: SparkSession, models: list[Model], names: list[str]) -> DataFrame:
    """Mean importance per feature over the fold models.

    Tree models: gains, from their node tables.  Linear models: size of the coefficients.
    """
    if not hasattr(models[0], "coefficients"):
        tables = [node_table(m, spark).withColumn("model", F.lit(k)) for k, m in enumerate(models)]
        per_tree = not hasattr(models[0], "evaluateEachIteration")  # forests
        return node_importance(reduce(DataFrame.unionByName, tables), names, per_tree)
    rows = [
        (k, n, float(v))
        for k, model in enumerate(models)
        for n, v in zip(names, abs(model.coefficients.toArray()), strict=True)
    ]
    schema = "fold int, feature string, importance double"
    return mean_importance(spark.createDataFrame(rows, schema))


# --- search and ablation ----------------------------------------------------


def uniform(trial: int, name: str, seed: int) -> float:
    """A number from 0 to 1 by the first 12 hex digits of a hash, so that any engine can draw it."""
    digits = hashlib.md5(f"{seed}:{trial}:{name}".encode()).hexdigest()[:12]
    return int(digits, 16) / 16**12


#: Drawn settings with their bounds; whole numbers where both bounds are, ``step_size``
#: on a logarithmic scale.  Penalties on leaf weights have no counterpart in Spark's trees.
SEARCHED = {
    "max_depth": (3, 8),
    "step_size": (0.01, 0.15),
    "row_share": (0.6, 0.95),
    "column_share": (0.5, 0.9),
    "min_rows": (5, 100),
    "positive_weight": (1.0, 5.0),
}


def draw_trial(trial: int, seed: int = 42) -> dict:
    """The settings of one trial, by the names of ``SEARCHED``."""
    out = {}
    for name, (low, high) in SEARCHED.items():
        u = uniform(trial, name, seed)
        if isinstance(low, int):
            out[name] = low + math.floor(u * (high - low + 1))
        elif name == "step_size":
            out[name] = math.exp(math.log(low) + u * (math.log(high) - math.log(low)))
        else:
            out[name] = low + u * (high - low)
    return out


def learner_params(drawn: dict) -> dict:
    """Drawn settings by the learner's names."""
    return {
        "maxDepth": drawn["max_depth"],
        "stepSize": drawn["step_size"],
        "subsamplingRate": drawn["row_share"],
        "featureSubsetStrategy": f"{drawn['column_share']:.4f}",
        "minInstancesPerNode": drawn["min_rows"],
        "positive": drawn["positive_weight"],
    }


TRIALS = (
    "job string, trial int, max_depth int, step_size double, row_share double, column_share double,"
    " min_rows int, positive_weight double, auc double"
)


def finished_trials(spark: SparkSession, ledger: str, job: str) -> DataFrame:
    """The trials of a job whose rows were written to the end, one row each."""
    files = spark.read.schema(TRIALS).option("recursiveFileLookup", True)
    try:
        rows = files.parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TRIALS)
    return rows.where(F.col("job") == job).dropDuplicates(["trial"])


def random_search(
    df: DataFrame, n_trials: int = 30, n_folds: int = 5, features: list[str] | None = None,
    rounds: int = 1500, seed: int = 42, parallel: int = 2, ledger: str | None = None,
    patience: int = PATIENCE, at_once: int = 1,
) -> tuple[dict, DataFrame]:
    """Best settings by mean fold AUC, and the table of all trials.  No target encoding.

    ``at_once`` trials run side by side, each with ``parallel`` folds at a time.

    Every finished trial is one file of ``ledger`` (a fresh folder by default).  A
    driver that is started again with the same job, i.e. the same columns, folds,
    rounds and seed, takes the finished trials from there and goes on with the rest.
    """
    spark = df.sparkSession
    ledger = ledger or scratch_dir(spark)
    columns = features or numeric_feature_columns(df)
    ready = prepared(df, n_folds, columns, [])
    about = json.dumps([columns, n_folds, rounds, patience, seed])
    job = hashlib.sha256(about.encode()).hexdigest()
    done = {r["trial"] for r in finished_trials(spark, ledger, job).collect()}  # a row per trial
    if _in_task(ready, learners()["boosted"], {**BOOSTED, "maxDepth": SEARCHED["max_depth"][1]}):
        kept = ready.bins[0].persist()  # read by every fit of every trial
    else:
        kept, at_once = ready.vectors(learners()["boosted"].median).persist(), 1

    def run(trial: int) -> None:
        drawn = draw_trial(trial, seed)
        params = {**learner_params(drawn), "maxIter": rounds}
        auc = cross_validated(
            ready, "boosted", params, parallel=parallel, patience=patience, scored=False
        ).mean_auc
        row = spark.createDataFrame([(job, trial, *drawn.values(), auc)], TRIALS)
        # a folder per attempt: two drivers at the same job share no temporary files
        row.coalesce(1).write.parquet(f"{ledger}/{trial}-{uuid.uuid4().hex}")

    try:
        left = [t for t in range(n_trials) if t not in done]
        if at_once == 1:
            for trial in left:
                run(trial)
        else:
            in_threads(spark, [lambda t=t: run(t) for t in left], at_once)
    finally:
        kept.unpersist()
    trials = finished_trials(spark, ledger, job).where(F.col("trial") < n_trials)
    best = trials.orderBy(F.col("auc").desc(), "trial").first()
    params = learner_params({name: best[name] for name in SEARCHED})
    return {**params, "maxIter": rounds}, trials.drop("job")


def ablation(
    df: DataFrame, base: list[str], groups: dict[str, list[str]], n_folds: int = 5,
    target_encoding: bool = True, **training,
) -> DataFrame:
    """AUC with each group of columns added to ``base``, and with all of them.

    ``delta_bps`` is the gain over the base in hundredths of a percent.  All runs
    read one table of prepared rows.
    """
    runs = {"baseline": base}
    runs |= {name: [*base, *columns] for name, columns in groups.items()}
    runs["all"] = [*base, *(c for columns in groups.values() for c in columns)]
    every = [c for c in numeric_feature_columns(df) if c in set(runs["all"])]
    ready = prepared(df, n_folds, every, None if target_encoding else [])
    aucs = {
        name: cross_validated(ready, features=columns, scored=False, **training).mean_auc
        for name, columns in runs.items()
    }
    rows = []
    for name, columns in runs.items():
        delta = (aucs[name] - aucs["baseline"]) * 10_000
        rows.append((name, len(columns), aucs[name], delta, delta > 0))
    schema = "name string, n_features int, auc double, delta_bps double, winner boolean"
    return df.sparkSession.createDataFrame(rows, schema)
