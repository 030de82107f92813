"""Models on window tensors (K1-K4, K6, G10, F21) with Spark ML.

Training and scoring are distributed: features are ``array_to_vector`` of the
flattened window; class weights come from F23; the held-out split is only
ever used for evaluation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators import ranking
from wardline.session import write_scratch


def flat_features(X: Column) -> Column:
    """Window → Spark ML vector (row-major)."""
    return array_to_vector(F.transform(F.flatten(X), lambda v: v.cast("double")))


def with_balanced_weights(df: DataFrame, label: str = "y", weight: str = "w") -> DataFrame:
    """F23 weights attached per row (class table: one row per class, broadcast)."""
    cw = ranking.class_weights(df, label).select(F.col("label").alias(label), F.col("weight").alias(weight))
    return df.join(F.broadcast(cw), label)


def _subset(num_trees: int) -> str:
    """What "auto" means for a forest of so many trees, also when its parts are smaller."""
    return "all" if num_trees == 1 else "sqrt"


# A fit holds a count and the node (before and after a level) for each row and tree; above so many, the trees are
# fitted in several forests.
FOREST_COUNTS = 300_000_000


def rf_importance(df: DataFrame, channels: Sequence[str], label: str = "y", num_trees: int = 200, max_depth: int = 12,
                  balanced: bool = True, seed: int = 42) -> DataFrame:
    """K2: random-forest importance on per-channel features; empty input is an error."""
    data = df.select(array_to_vector(F.array(*[F.col(c).cast("double") for c in channels])).alias("features"),
                     F.col(label).cast("double").alias("label"))
    kw = {}
    if balanced:
        data = with_balanced_weights(data, "label", "w")
        kw["weightCol"] = "w"
    n = data.count()
    if n == 0:
        raise ValueError("no training rows for feature importance")
    each = max(1, min(num_trees, FOREST_COUNTS // n))
    if each < num_trees:
        # several forests read them; rows that are alike go the same way down a tree, so they stand together
        data = write_scratch(data.withColumn("_v", vector_to_array("features")).sortWithinPartitions("_v").drop("_v"), "forest-rows")
    # with the nodes kept, a level looks one step down a tree, not from its root; the trees are the same
    models = [RandomForestClassifier(numTrees=min(each, num_trees - k), maxDepth=max_depth, seed=seed + k, cacheNodeIds=True,
                                     checkpointInterval=-1, featureSubsetStrategy=_subset(num_trees), **kw).fit(data)
              for k in range(0, num_trees, each)]
    if len(models) == 1:
        imp = models[0].featureImportances.toArray().tolist()
    else:  # as one forest has them: the sum over the trees, each tree's importances adding up to one
        total = sum(t.featureImportances.toArray() for m in models for t in m.trees)
        imp = (total / (total.sum() or 1.0)).tolist()
    spark = df.sparkSession
    return spark.createDataFrame([(c, float(v)) for c, v in zip(channels, imp)], "channel string, importance double") \
        .orderBy(F.col("importance").desc())


def train_window_classifier(windows: DataFrame, label: str = "y", reg: Sequence[float] = (0.0, 0.01, 0.1),
                            max_iter: int = 50, balanced: bool = True):
    """K3 (re-aimed): logistic regression on flattened windows, fit on train,
    regularisation chosen by validation AUROC. Returns (model, table of candidates)."""
    data = windows.select("split", flat_features(F.col("X")).alias("features"), F.col(label).cast("double").alias("label"))
    data = write_scratch(data, "window-features")  # a dozen passes read them
    train = data.filter(F.col("split") == "train")
    if balanced:
        train = with_balanced_weights(train, "label", "w")
    val = data.filter(F.col("split") == "val")
    best, rows = None, []
    for r in reg:
        lr = LogisticRegression(maxIter=max_iter, regParam=r, weightCol="w" if balanced else None)
        m = lr.fit(train)
        auc = auroc_of(m.transform(val))
        rows.append((float(r), auc))
        if best is None or (auc is not None and auc > best[1]):
            best = (m, auc)
    spark = windows.sparkSession
    return best[0], spark.createDataFrame(rows, "reg_param double, val_auroc double")


def logistic_predictor(model) -> Callable[[np.ndarray], np.ndarray]:
    """A fitted logistic model as a plain function of windows (n, steps, channels), for scoring inside Arrow batches."""
    weights, intercept = model.coefficients.toArray(), float(model.intercept)

    def predict(x: np.ndarray) -> np.ndarray:
        z = x.reshape(len(x), -1) @ weights + intercept
        return 1.0 / (1.0 + np.exp(-z))

    return predict


def probability(scored: DataFrame) -> Column:
    return vector_to_array(F.col("probability"))[1]


def auroc_of(scored: DataFrame) -> float | None:
    """Validation AUROC for model selection: Spark ML's evaluator (one distributed pass, exact
    with numBins=0); the reported held-out metrics use the histogram operators below."""
    if scored.limit(1).count() == 0:
        return None
    ev = BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol="label", metricName="areaUnderROC", numBins=0)
    return float(ev.evaluate(scored))


def evaluate(model, windows: DataFrame, split: str = "test", label: str = "y", threshold: float | None = None) -> DataFrame:
    """K4: held-out metrics: AUROC, AUPRC, best-F1 threshold, confusion at 0.5 and at best F1."""
    data = windows.filter(F.col("split") == split).select(flat_features(F.col("X")).alias("features"),
                                                          F.col(label).cast("double").alias("label"))
    scored = model.transform(data)
    s = scored.select(F.col("label").cast("int").alias("y"), probability(scored).alias("score"))
    cum = ranking.cumulative_desc(ranking.score_histogram(s))
    areas = ranking.auroc_auprc(cum).collect()[0]
    best = ranking.best_f1_threshold(cum).collect()[0]["threshold"]
    at_half = ranking.confusion_at(s, 0.5).withColumn("which", F.lit("0.5"))
    at_best = ranking.confusion_at(s, threshold if threshold is not None else best).withColumn("which", F.lit("best_f1"))
    return at_half.unionByName(at_best).withColumn("auroc", F.lit(areas["auroc"])).withColumn("auprc", F.lit(areas["auprc"]))


def score(df: DataFrame, predict: Callable[[np.ndarray], np.ndarray], X: str = "X", out: str = "probability") -> DataFrame:
    """K1: pluggable scorer over Arrow batches; ``predict`` maps (n, w, c) → n probabilities."""
    def run(it):
        for pdf in it:
            arr = np.stack([np.stack(x) for x in pdf[X]]) if len(pdf) else np.zeros((0, 1, 1))
            yield pdf.assign(**{out: np.asarray(predict(arr), dtype=float) if len(pdf) else []})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {out} double"
    return df.mapInPandas(run, schema)


def sample_windows(df: DataFrame, n: int, seed: int = 42, id_cols: Sequence[str] = ("patient_id", "window_end_idx")) -> DataFrame:
    """K6: deterministic sample without replacement (sampling is the feature here)."""
    key = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in id_cols], F.lit(str(seed))))
    return df.orderBy(key).limit(n)


def background_fill(windows: DataFrame, n_channels: int) -> DataFrame:
    """mean over windows and timesteps per channel (one row with an array)."""
    steps = windows.select(F.explode("X").alias("r"))
    return steps.agg(F.array(*[F.avg(F.col("r")[j].cast("double")) for j in range(n_channels)]).alias("fill"))


def example_windows(scored: DataFrame, prob: str = "probability", label: str = "y", idx: str = "window_end_idx",
                    entity: str = "patient_id") -> DataFrame:
    """Highest-probability positive, lowest-probability positive, lowest-probability negative; first index on ties."""
    pos = F.col(label) == 1
    # ties: smallest index, then smallest patient (the least of a maximum is the least by -probability)
    tie = F.struct(-F.col(prob), F.col(idx), F.col(entity))
    tie_min = F.struct(F.col(prob), F.col(idx), F.col(entity))
    row = F.struct(*scored.columns)
    return scored.agg(F.min_by(F.when(pos, row), F.when(pos, tie)).alias("max_prob_positive"),
                      F.min_by(F.when(pos, row), F.when(pos, tie_min)).alias("min_prob_positive"),
                      F.min_by(F.when(~pos, row), F.when(~pos, tie_min)).alias("min_prob_negative"))
