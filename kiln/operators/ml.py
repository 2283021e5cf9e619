"""Distributed training and evaluation with ``pyspark.ml``.

* problem type, feature preparation and an exact-size split (rank of a key or
  row hash; per label when stratified);
* a name -> estimator registry (linear / random forest / gradient boosted trees
  for regression and classification);
* k-fold cross-validation with per-fold scores over contiguous folds (per label
  when stratified) along a given order or the seeded order of the rows' hashes;
  the k linear fits come from one scan of co-moments per fold; then a final fit on
  the training part;
* metrics and importances as DataFrames (``kiln.operators.metrics``).
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.core import is_numeric, join_small, materialize, written
from kiln.operators import boosted
from kiln.operators import metrics as M
from kiln.plans import folds as P7
from kiln.plans.ordering import hash_places, ordered_index

REGRESSION = "regression"
CLASSIFICATION = "classification"
TREE_DEPTH = 30
FOREST_TREES = 100
BOOSTED_ROUNDS = 100
ROWS_PER_PARTITION = 50_000
FOREST_ROWS_PER_PARTITION = 10_000
MAX_ROWS_PER_PARTITION = 2_000_000
MAX_CLASSES = 10_000


def problem_types(df: DataFrame, targets: Sequence[str], threshold: int = 10) -> DataFrame:
    """``target, problem_type`` of several columns in one aggregation: a numeric
    target with more than ``threshold`` distinct values -> regression."""
    numeric = [t for t in targets if is_numeric(df.schema[t].dataType)]
    # one exact count a column, side by side: a distinct aggregate each would copy every row per column
    seen = df.select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"`{t}`").cast("double").alias("v"))
                                         for t in numeric])).alias("x")).select("x.*").filter("v is not null") \
        .distinct().groupBy("target").count() if numeric else None
    rows = df.sparkSession.createDataFrame([(t,) for t in targets], "target string")
    if seen is None:
        return rows.withColumn("problem_type", F.lit(CLASSIFICATION))
    return join_small(rows, seen, ["target"], how="left").select("target", F.when(
        F.col("count") > threshold, F.lit(REGRESSION)).otherwise(F.lit(CLASSIFICATION)).alias("problem_type"))


def detect_problem_type(df: DataFrame, target: str, threshold: int = 10) -> str:
    """Numeric target with more than ``threshold`` distinct values -> regression."""
    if not is_numeric(df.schema[target].dataType):
        return CLASSIFICATION
    return problem_types(df, [target], threshold).first()["problem_type"]


def prepare_features(df: DataFrame, target: str, feature_cols: Sequence[str] | None = None,
                     drop_na: bool = True) -> tuple[DataFrame, list[str]]:
    """Numeric features (chosen, or all but the target) + ``label``; rows with any
    NULL in the features or target dropped.  Returns (frame, feature names)."""
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found.")
    pool = list(feature_cols) if feature_cols else [c for c in df.columns if c != target]
    feats = [c for c in pool if is_numeric(df.schema[c].dataType)]
    out = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in feats], F.col(f"`{target}`").alias("label"))
    if drop_na:
        out = out.dropna(how="any")
    return out, feats


def _ranked(df: DataFrame, seed: int, by: list[str], key: Sequence[str] | None) -> DataFrame:
    """Adds ``__i``: the rank (from 0, per ``by``) in the order of a hash of ``key``.

    Without a key the whole row is hashed and rows that repeat are told apart by
    their place in the input, pinned with a checkpoint; which of equal rows gets
    which rank is arbitrary, so the ranked rows are the same in every run.
    """
    cols = list(key) if key else df.columns
    h = df.withColumn("__h", F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in cols]))
    if key:
        return ordered_index(h, ["__h", *key], by=by, idx_col="__i").drop("__h")
    h = materialize(h.withColumn("__row", F.monotonically_increasing_id()))
    return ordered_index(h, ["__h", "__row"], by=by, idx_col="__i").drop("__h", "__row")


def split(df: DataFrame, test_size: float = 0.2, seed: int = 42, stratify: bool = False,
          label: str = "label", key: Sequence[str] | None = None, ranked: bool = False) -> DataFrame:
    """Adds boolean ``is_test``: the ceil(test_size * n) rows of the smallest hash
    rank (per label when ``stratify``), also where rows repeat.  ``key`` names the
    columns of a unique key, if there is one.  Only rows near the last test row are
    ranked; with ``ranked`` all are, and stand in the order of their ranks."""
    by = [label] if stratify else []
    if ranked:
        rows = _ranked(df, seed, by, key)
        sizes = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) * test_size).alias("__test"))
        return join_small(rows, sizes, by).withColumn("is_test", F.col("__i") < F.col("__test")).drop("__i", "__test")
    h = df.withColumn("__h", F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in key or df.columns]))
    if not key:
        h = h.withColumn("__row", F.monotonically_increasing_id())
    placed = hash_places(h, ["__h", *(key or ["__row"])], lambda sizes: sizes.withColumn(
        "__b0", F.ceil(F.col("__c") * test_size)), 1, by, "__place")
    return placed.withColumn("is_test", F.col("__place") == 0).select(*df.columns, "is_test")


def fold_column(df: DataFrame, k: int, seed: int = 42, stratify: bool = False, label: str = "label",
                key: Sequence[str] | None = None) -> DataFrame:
    """Adds ``fold`` in 0..k-1: hash rank (per label when stratified) modulo k."""
    ranked = _ranked(df, seed + 1, [label] if stratify else [], key)
    return ranked.withColumn("fold", F.pmod(F.col("__i"), F.lit(k)).cast("int")).drop("__i")


def get_estimator(name: str, problem_type: str, seed: int = 42, n_train: int | None = None,
                  n_classes: int = 2, tree_depth: int = TREE_DEPTH):
    """Registry of estimators by name (unknown names raise).  ``tree_depth`` bounds
    the trees of a forest (Spark allows up to 30).  A row keeps the node it has reached
    in every tree of a forest, so that a level costs one step a tree and no task is sent
    the trees; the trees are the same."""
    if problem_type == REGRESSION:
        if name == "Linear Regression":
            return LinearRegression(regParam=0.0, solver="normal")
        if name == "Random Forest Regressor":
            return RandomForestRegressor(numTrees=FOREST_TREES, maxDepth=tree_depth, seed=seed, cacheNodeIds=True)
        if name in ("XGBoost Regressor", "Gradient Boosted Regressor"):
            return GBTRegressor(maxIter=BOOSTED_ROUNDS, maxDepth=6, stepSize=0.3, seed=seed)
    elif problem_type == CLASSIFICATION:
        if name == "Logistic Regression":
            reg = 1.0 / max(int(n_train or 1), 1)      # C = 1 in the (1/n) loss scaling
            return LogisticRegression(maxIter=1000, regParam=reg, elasticNetParam=0.0, standardization=False)
        if name == "Random Forest Classifier":
            return RandomForestClassifier(numTrees=FOREST_TREES, maxDepth=tree_depth, seed=seed, cacheNodeIds=True)
        if name in ("XGBoost", "XGBoost Classifier", "Gradient Boosted Classifier"):
            gbt = GBTClassifier(maxIter=BOOSTED_ROUNDS, maxDepth=6, stepSize=0.3, seed=seed)
            return gbt if n_classes <= 2 else OneVsRest(classifier=gbt)
    else:
        raise ValueError(f"Unknown problem type: {problem_type}")
    raise ValueError(f"Model '{name}' not available for {problem_type}.")


def _pipeline(features: list[str], estimator, scale: bool, n_train: int) -> Pipeline:
    """Assembler, scaler where ``scale``, and the estimator, if there is one."""
    stages = [VectorAssembler(inputCols=features, outputCol="raw_features" if scale else "features",
                              handleInvalid="error")]
    if scale:
        # Spark divides by the sample deviation; the factor makes it the population's
        factor = (n_train / (n_train - 1)) ** 0.5 if n_train > 1 else 1.0
        stages += [StandardScaler(inputCol="raw_features", outputCol="std_features", withMean=True, withStd=True),
                   ElementwiseProduct(inputCol="std_features", outputCol="features",
                                      scalingVec=Vectors.dense([factor] * len(features)))]
    return Pipeline(stages=stages + [estimator] * (estimator is not None))


@dataclass
class TrainResult:
    model_name: str
    problem_type: str
    features: list[str]
    model: PipelineModel
    predictions: DataFrame          # test rows: features, label, prediction[, probability]
    metrics: DataFrame              # metric, value
    cv_scores: DataFrame            # fold, score
    cv_summary: DataFrame           # cv_mean, cv_std
    sizes: DataFrame                # n_train, n_test, n_features
    importance: DataFrame | None    # feature, importance  (or class, feature, importance)
    extra: dict = field(default_factory=dict)


def _score(pred: DataFrame, problem_type: str) -> DataFrame:
    if problem_type == REGRESSION:
        return pred.agg((-F.avg((F.col("label") - F.col("prediction")) ** 2)).alias("score"))
    rep = M.classification_report(pred, "label", "prediction")
    return rep.filter(F.col("class") == "weighted avg").select(F.col("f1").alias("score"))


def train_model(df: DataFrame, target: str, model_name: str, feature_cols: Sequence[str] | None = None,
                problem_type: str | None = None, test_size: float = 0.2, cv_folds: int = 5,
                random_state: int = 42, scale_features: bool = True, test_flag: str | None = None,
                label_index: bool = True, tree_depth: int = TREE_DEPTH,
                max_classes: int = MAX_CLASSES, order_by: Sequence[str] | None = None) -> TrainResult:
    """Split, cross-validate, fit and evaluate one model.

    ``test_flag`` names a boolean column that fixes the split instead of the
    hash split.  ``order_by`` names columns that put the rows in a total order; the
    folds are contiguous in it (without: in the order of a seeded hash of the row);
    ``cv_folds=0`` leaves cross-validation out.  Classification labels are indexed to 0..k-1 in sorted order of
    the original labels (kept in ``extra['labels']``); a target of more than
    ``max_classes`` values raises an error.
    """
    spark = df.sparkSession
    base = df
    if test_flag:
        base = df.withColumn("__test", F.col(test_flag))
    problem_type = problem_type or detect_problem_type(base, target)
    _, feats = prepare_features(base.drop("__test") if test_flag else base, target, feature_cols)
    # the split flag and the order stand beside the prepared columns
    order = [f"__order{i}" for i in range(len(order_by or []))]
    data = base.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in feats], F.col(f"`{target}`").alias("label"),
                       *[F.col(f"`{c}`").alias(o) for c, o in zip(order_by or [], order)],
                       *([F.col("__test").alias("is_test")] if test_flag else [])).dropna(
        how="any", subset=[*feats, "label", *(["is_test"] if test_flag else [])])
    forest = model_name.startswith("Random Forest")
    # the hash decides on split and folds, so that they are found from counts and written once.  Forests
    # draw their samples by the places of the rows, which stay in the order of their ranks
    hashed = not test_flag and not order and not forest
    if hashed:
        data = written(data, "rows")
    prepared = data if test_flag else split(data, test_size, random_state, stratify=problem_type == CLASSIFICATION,
                                            ranked=not hashed)
    labels = None
    if problem_type == CLASSIFICATION and label_index:
        labs = data.select("label").distinct()
        labels = sorted(r["label"] for r in labs.limit(max_classes + 1).collect())
        if len(labels) > max_classes:
            raise ValueError(f"more than {max_classes} classes in {target!r}")
        mapping = spark.createDataFrame([(float(i), str(v)) for i, v in enumerate(labels)],
                                        "label_idx double, __lab string")
        prepared = (prepared.withColumn("__lab", F.col("label").cast("string"))
                    .join(F.broadcast(mapping), "__lab").drop("__lab", "label")
                    .withColumnRenamed("label_idx", "label"))
    # iterative fits launch jobs per round and tiny partitions only add task overhead: up
    # to the cluster's parallelism ROWS_PER_PARTITION rows each, beyond it as many as
    # MAX_ROWS_PER_PARTITION needs
    n_all = data.count()
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, min(cores, -(-n_all // (FOREST_ROWS_PER_PARTITION if forest else ROWS_PER_PARTITION))),
                -(-n_all // MAX_ROWS_PER_PARTITION))
    folds, by = None, "label" if problem_type == CLASSIFICATION else None
    if hashed:
        if cv_folds:
            rows = prepared.filter(~F.col("is_test"))
            hashes = F.xxhash64(F.lit(random_state + 1), *[F.col(f"`{c}`") for c in rows.columns if c != "is_test"])
            rows = rows.withColumn("__hash", hashes).withColumn("__place", F.monotonically_increasing_id())
            rows = P7.contiguous_folds(rows, cv_folds, ["__hash", "__place"], by, hashed=True).drop("__hash", "__place")
            prepared = rows.unionByName(prepared.filter("is_test"), allowMissingColumns=True)
        prepared = written(prepared.repartition(parts), "split")
        folds = prepared.filter(~F.col("is_test")).drop("is_test")
        train, test = folds.drop("fold"), prepared.filter(F.col("is_test")).drop("is_test", "fold")
    else:
        prepared = prepared.repartition(parts).checkpoint(eager=True)
        ordered = prepared.filter(~F.col("is_test")).drop("is_test")
        train = ordered.drop(*order)
        test = prepared.filter(F.col("is_test")).drop("is_test", *order)
    n_train = train.count()
    n_classes = len(labels) if labels else 2
    scale = scale_features and problem_type == REGRESSION

    def fitted(rows, n):
        est = get_estimator(model_name, problem_type, random_state, n, n_classes, tree_depth)
        if "Boost" in model_name:
            return boosted.fit(rows, feats, _pipeline(feats, None, scale, n).fit(rows), est, n,
                               problem_type == CLASSIFICATION)
        return _pipeline(feats, est, scale, n).fit(rows)

    # cross-validation: linear fits of all folds come from one scan of co-moments; other
    # models are fitted once a fold, the k distributed fits and the final one concurrently.
    # Forests follow one another: one fold's forest and cached rows are held at a time.
    at_once = 1 if forest else cv_folds + 1
    if cv_folds and not hashed and not order:
        order = ["__hash", "__place"]
        ordered = ordered.withColumn("__hash", F.xxhash64(F.lit(random_state + 1), *[F.col(f"`{c}`") for c in
                                                                                    train.columns])) \
            .withColumn("__place", F.monotonically_increasing_id())
    if cv_folds and not hashed:
        folds = (P7.contiguous_folds(ordered, cv_folds, order, by)
                 .drop(*order).repartition(parts).checkpoint(eager=True))
    if not cv_folds:
        model, cv = fitted(train, n_train), spark.createDataFrame([], "fold int, score double")
    elif model_name == "Linear Regression" and problem_type == REGRESSION:
        fits = P7.leave_fold_out_ols(folds, feats, "label", "fold", cv_folds)
        cv = materialize(P7.held_out_scores(folds, fits, feats, "label", "fold"))
        model = fitted(train, n_train)
    else:
        held = {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()}   # one row a fold

        def fold_score(k):
            fit = fitted(folds.filter(F.col("fold") != k).drop("fold"), n_train - held.get(k, 0))
            s = _score(fit.transform(folds.filter(F.col("fold") == k).drop("fold")), problem_type)
            return s.select(F.lit(k + 1).alias("fold"), "score").checkpoint(eager=True)

        with ThreadPoolExecutor(max_workers=at_once) as pool:
            final = pool.submit(lambda: fitted(train, n_train))
            scores = list(pool.map(fold_score, range(cv_folds)))
            model = final.result()
        cv = scores[0]
        for s in scores[1:]:
            cv = cv.unionByName(s)
    cv_summary = cv.agg(F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"))
    pred = model.transform(test)
    if problem_type == REGRESSION:
        met = M.regression_metrics(pred, "label", "prediction")
    else:
        met = M.classification_metrics(pred, "label", "prediction")
        if "probability" in pred.columns:
            prob = pred.withColumn("__p", vector_to_array("probability"))
            if n_classes == 2:
                auc = M.roc_auc(prob.withColumn("__s", F.col("__p")[1]), "label", "__s", positive=1.0)
                met = met.unionByName(auc.select(F.lit("ROC-AUC").alias("metric"), F.col("auc").alias("value")))
            else:
                sc = prob.select("label", *[F.col("__p")[i].alias(f"__s{i}") for i in range(n_classes)])
                auc = M.roc_auc_ovr(sc, "label", {float(i): f"__s{i}" for i in range(n_classes)})
                met = met.unionByName(auc.select(F.lit("ROC-AUC (OvR)").alias("metric"),
                                                 F.col("auc").alias("value")))
    sizes = spark.createDataFrame([(n_train, len(feats))], "n_train long, n_features int").crossJoin(
        test.agg(F.count(F.lit(1)).alias("n_test")))
    return TrainResult(model_name, problem_type, feats, model, pred, met, cv, cv_summary, sizes,
                       feature_importance(model, feats, labels), {"labels": labels, "train": train})


def feature_importance(model: PipelineModel, features: list[str], labels=None) -> DataFrame | None:
    """Impurity importances (trees) or |coefficients| (linear), descending.

    Model parameters live on the driver already and are bounded by the feature
    count (times the class count).  Multiclass coefficients give one row per
    (class, feature) plus the mean |coef| per feature (class NULL).
    """
    spark = model.stages[0].sparkSession if hasattr(model.stages[0], "sparkSession") else None
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    m = model.stages[-1]
    if hasattr(m, "featureImportances"):
        vals = m.featureImportances.toArray().tolist()
        rows = [(None, f, float(v)) for f, v in zip(features, vals)]
    elif hasattr(m, "coefficientMatrix") and m.coefficientMatrix.numRows > 1:
        mat = m.coefficientMatrix.toArray()
        rows = []
        for ci in range(mat.shape[0]):
            name = str(labels[ci]) if labels else str(ci)
            rows += [(name, f, float(abs(mat[ci][j]))) for j, f in enumerate(features)]
        rows += [(None, f, float(abs(mat[:, j]).mean())) for j, f in enumerate(features)]
    elif hasattr(m, "coefficients"):
        rows = [(None, f, float(abs(v))) for f, v in zip(features, m.coefficients.toArray().tolist())]
    else:
        return None
    df = spark.createDataFrame(rows, "class string, feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature"))
