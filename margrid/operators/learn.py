"""Training and scoring of classifiers on tables through pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margrid.domain import Constraint
from margrid.functions.hashing import uniform
from margrid.operators.ci import pillai_from_residuals
from margrid.operators.fairness import auc_rank, confusion_metrics
from margrid.operators.ranking import dense_codes

# Hidden layer widths of the perceptron.
MLP_LAYERS = [128, 64, 32]


def classifier(name: str, label: str, n_features: int, n_classes: int = 2, weight: str | None = None, seed: int = 42):
    """Estimator by name: LR, GBT, RF, SVM, BSVM or MLP."""
    common = {"labelCol": label, "featuresCol": "features"}
    w = {"weightCol": weight} if weight else {}
    if name == "LR":
        return LogisticRegression(maxIter=50, **common, **w)
    if name == "GBT":
        return GBTClassifier(maxIter=10, maxDepth=3, seed=seed, **common, **w)
    if name == "RF":
        return RandomForestClassifier(numTrees=20, seed=seed, **common, **w)
    if name == "SVM":
        return LinearSVC(maxIter=30, **common, **w)
    if name == "MLP":
        layers = [n_features, *MLP_LAYERS, n_classes]
        return MultilayerPerceptronClassifier(layers=layers, maxIter=20, seed=seed, **common)
    raise ValueError(f"unknown classifier {name}")


def fit_classifier(
    train: DataFrame, features: Sequence[str], label: str, name: str = "LR", weight: str | None = None, seed: int = 42
) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    model = classifier(name, label, len(features), weight=weight, seed=seed)
    return Pipeline(stages=[assembler, model]).fit(train.withColumn(label, F.col(label).cast("double")))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with ``prediction`` and ``score`` (probability of class 1, or the margin of an SVM)."""
    out = model.transform(df)
    raw = "probability" if "probability" in out.columns else "rawPrediction"
    score = F.element_at(vector_to_array(F.col(raw)), 2)
    return out.withColumn("score", score).drop("features", "rawPrediction", "probability")


def bagged_scores(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str, bags: int = 3, seed: str = "bag"
) -> DataFrame:
    """Mean margin of linear SVMs, each trained on its own hash half of the rows."""
    scored = test
    for b in range(bags):
        half = train.where(uniform(f"{seed}/{b}", key) < 0.5)
        model = fit_classifier(half, features, label, "SVM")
        scored = predict(model, scored).withColumnRenamed("score", f"__s{b}").drop("prediction")
    mean = sum((F.col(f"__s{b}") for b in range(bags)), F.lit(0.0)) / bags
    return scored.withColumn("score", mean).withColumn(
        "prediction", (F.col("score") > 0).cast("double")
    ).drop(*[f"__s{b}" for b in range(bags)])


def train_score(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str, name: str = "LR",
    weight: str | None = None, key: str | None = None, seed: int = 42,
) -> DataFrame:
    """Fit on one table, score on another: AUC, accuracy and F1 as one row."""
    if name == "BSVM":
        scored = bagged_scores(train, test, features, label, key)
    else:
        scored = predict(fit_classifier(train, features, label, name, weight, seed), test)
    scored = scored.select(F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("p"), "score")
    auc = auc_rank(scored, "score", F.col("y") == 1).select("auc").scalar()
    m = confusion_metrics(scored, "y", "p")
    return m.select(F.lit(name).alias("algorithm"), auc.alias("auc"), "accuracy", "f1", "macro_f1")


def evaluate_folds(
    folds: DataFrame, test: DataFrame, features: Sequence[str], label: str, algorithms: Sequence[str],
    by: Sequence[str] = ("method", "cs", "eps"),
) -> DataFrame:
    """{algorithm}_AUC of every (method, fold, budget) table against the test rows of its fold.

    Each key is one training job; the keys are the few partitions of the experiment.
    """
    keys = folds.select(*by).distinct().orderBy(*by).collect()
    out = None
    for k in keys:
        hit = F.lit(True)
        for c in by:
            hit = hit & F.col(c).eqNullSafe(F.lit(k[c]))
        train, held = folds.where(hit), test.where(F.col("cs") == k["cs"])
        for a in algorithms:
            row = train_score(train, held, features, label, a).select(
                F.lit(str(k["method"])).alias("method_name"), F.lit(k["cs"]).cast("int").alias("fold_num"),
                F.lit(str(k["eps"])).alias("epsilon"), F.lit(f"{a}_AUC").alias("metric"), F.col("auc").alias("value"),
            )
            out = row if out is None else out.unionByName(row)
    return out


def select_model(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Cross-validated grid over model families; one row per family, best test accuracy first."""
    scorer = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    data = assembler.transform(train.withColumn(label, F.col(label).cast("double"))).select("features", label)
    held = assembler.transform(test.withColumn(label, F.col(label).cast("double"))).select("features", label)
    lr = classifier("LR", label, len(features))
    rf = classifier("RF", label, len(features))
    gbt = classifier("GBT", label, len(features))
    svm = classifier("SVM", label, len(features))
    grids = {
        "LR": (lr, ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1]).build()),
        "RF": (rf, ParamGridBuilder().addGrid(rf.maxDepth, [3, 5]).build()),
        "GBT": (gbt, ParamGridBuilder().addGrid(gbt.maxDepth, [2, 3]).build()),
        "SVM": (svm, ParamGridBuilder().addGrid(svm.regParam, [0.0, 0.1]).build()),
    }
    rows = []
    for name, (model, grid) in grids.items():
        cv = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=scorer, numFolds=folds, seed=seed, parallelism=2)
        fitted = cv.fit(data)
        at = max(range(len(grid)), key=lambda i: fitted.avgMetrics[i])
        params = ",".join(f"{p.name}={v}" for p, v in grid[at].items())
        rows.append((name, params, float(fitted.avgMetrics[at]), float(scorer.evaluate(fitted.transform(held)))))
    rows.sort(key=lambda r: -r[3])
    return train.sparkSession.createDataFrame(rows, "model string, params string, cv_accuracy double, accuracy double")


def feature_ranking(df: DataFrame, features: Sequence[str], label: str, seed: int = 42) -> DataFrame:
    """Recursive elimination by forest importance: the last feature left has rank 1."""
    left, ranks = list(features), []
    while len(left) > 1:
        model = fit_classifier(df, left, label, "RF", seed=seed)
        weights = model.stages[-1].featureImportances.toArray()
        worst = min(range(len(left)), key=lambda i: (weights[i], left[i]))
        ranks.append((left.pop(worst), len(left) + 1))
    ranks.append((left[0], 1))
    return df.sparkSession.createDataFrame(sorted(ranks, key=lambda r: r[1]), "feature string, rank int")


def feature_importance(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Logistic coefficients on features divided by their deviation."""
    stats = df.agg(*[F.stddev_samp(c).alias(c) for c in features])
    scaled = df.withColumns({c: F.col(c) / stats.select(c).scalar() for c in features})
    model = fit_classifier(scaled, features, label, "LR")
    coefs = model.stages[-1].coefficients.toArray()
    rows = [(f, float(v)) for f, v in zip(features, coefs)]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def impute_with_model(df: DataFrame, col: str, features: Sequence[str], seed: int = 42) -> DataFrame:
    """Missing values of a column predicted by boosted trees on the others, rounded half-even."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="__f")
    target = F.col(col).cast("double")
    known = df.where(F.col(col).isNotNull()).withColumn("__y", target)
    gbt = GBTRegressor(featuresCol="__f", labelCol="__y", predictionCol="__p", maxIter=10, maxDepth=4, seed=seed)
    model = Pipeline(stages=[assembler, gbt]).fit(known)
    filled = F.bround(F.coalesce(target, F.col("__p")), 0)
    return model.transform(df).withColumn(col, filled).select(*df.columns)


def pillai_logistic(df: DataFrame, c: Constraint) -> DataFrame:
    """Residual test with logistic-regression predictions of X and Y codes from numeric Z columns.

    Models are fitted and applied on distinct cells weighted by their count.
    """
    cells = df.dropna(subset=list(c.columns)).groupBy(*c.columns).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows, blocks = VectorAssembler(inputCols=list(c.z), outputCol="features").transform(cells), {}
    for side, cols in (("x", c.x), ("y", c.y)):
        text = F.concat_ws("_", *[F.col(v).cast("string") for v in cols])
        rows = rows.withColumn(f"__{side}", text)
        codes = dense_codes(rows.select(f"__{side}").distinct(), f"__{side}", f"{side}_code")
        k = codes.count()
        rows = rows.join(codes, f"__{side}").withColumn(f"{side}_code", F.col(f"{side}_code").cast("double"))
        lr = LogisticRegression(
            featuresCol="features", labelCol=f"{side}_code", weightCol="n", maxIter=50,
            probabilityCol=f"{side}_p", rawPredictionCol=f"{side}_raw", predictionCol=f"{side}_hat",
        )
        rows = lr.fit(rows).transform(rows)
        probs = vector_to_array(F.col(f"{side}_p"))
        names = [f"r{side}{i}" for i in range(k - 1)]
        rows = rows.withColumns(
            {name: (F.col(f"{side}_code") == i).cast("double") - F.element_at(probs, i + 1) for i, name in enumerate(names)}
        )
        blocks[side] = names
    return pillai_from_residuals(rows, blocks["x"], blocks["y"], "n")
