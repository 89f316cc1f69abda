"""Risk models on MLlib: fitting, tuning, ablation, saving. Nothing is fitted on rows that it is judged on."""

from __future__ import annotations

import functools
import itertools
import json
import random
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row, functions as F

from riskframe.operators.metrics import point_metrics, ranking_metrics
from riskframe.operators.report import over_seeds
from riskframe.operators.splits import folds
from riskframe.plans.features import GROUPS, columns_of
from riskframe.sources.records import stored

#: Seeds of the protocol, and the grid of the random search.
SEEDS = (42, 123, 456)
GRID = {
    "maxDepth": [3, 4, 5, 6, 7],
    "stepSize": [0.01, 0.05, 0.1, 0.2],
    "maxIter": [100, 200, 300, 500],
    "subsamplingRate": [0.7, 0.8, 0.9, 1.0],
    "featureSubsetStrategy": ["0.7", "0.9", "1.0"],
}


def class_weights(df: DataFrame) -> DataFrame:
    """df with weight: negatives over positives for label 1, else 1."""
    totals = df.agg(F.sum(F.expr("cast(label = 1 as double)")).alias("p"), F.sum(F.expr("cast(label = 0 as double)")).alias("n")).first()
    ratio = totals.n / totals.p if totals.p and totals.n else 1.0
    return df.withColumn("weight", F.when(F.col("label") == 1, F.lit(ratio)).otherwise(F.lit(1.0)))


def assembler(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error")


def logistic(columns: list[str], n_rows: int) -> Pipeline:
    """Scaled features, L2 penalty 1/n, which is C = 1 of the summed loss."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    model = LogisticRegression(featuresCol="scaled", maxIter=2000, regParam=1 / max(1, n_rows), elasticNetParam=0.0, standardization=False)
    return Pipeline(stages=[assembler(columns), scaler, model])


def forest(columns: list[str], seed: int, trees: int = 300, depth: int = 12) -> Pipeline:
    return Pipeline(stages=[assembler(columns), RandomForestClassifier(numTrees=trees, minInstancesPerNode=5, maxDepth=depth, seed=seed)])


#: Rows of a partition that fits read: at least, while there are cores for them, and at most.
FEWEST, MOST = 4_096, 262_144


def packed(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, or more if these would be too large.

    A fit reads its rows in hundreds of small jobs, and each partition sends figures of its own for every node of a tree or step of a
    gradient; files of a wide shuffle would multiply both.
    """
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(1, -(-n // MOST), min(cores, -(-n // FEWEST))))


def boosted(columns: list[str], seed: int, validate: bool = True, **params) -> Pipeline:
    """Boosted trees, stopped early on rows with is_val where validate is set."""
    options = {"maxIter": 300, "maxDepth": 5, "stepSize": 0.05, **params}
    model = GBTClassifier(weightCol="weight", seed=seed, **options)
    return Pipeline(stages=[assembler(columns), model.setValidationIndicatorCol("is_val") if validate else model])


def fit_boosted(df: DataFrame, columns: list[str], seed: int, **params) -> PipelineModel:
    """On train rows of df (with split), stopping by its val rows."""
    rows = class_weights(df.filter("split in ('train', 'val')")).withColumn("is_val", F.col("split") == "val")
    return boosted(columns, seed, **params).fit(packed(rows))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with prob and pred; 0.5 counts as positive."""
    made = model.transform(df.withColumn("is_val", F.lit(False))).withColumn("prob", vector_to_array("probability")[1])
    return made.select(*df.columns, "prob", (F.col("prob") >= 0.5).cast("int").alias("pred"))


def random_params(n: int = 30, seed: int = 42) -> list[dict]:
    """n distinct points of the grid."""
    points = [dict(zip(GRID, values)) for values in itertools.product(*GRID.values())]
    return random.Random(seed).sample(points, min(n, len(points)))


def tune(df: DataFrame, columns: list[str], candidates: list[dict], n_folds: int = 5, by: str = "group", seed: int = 42, parallelism: int = 8, group: str = "item_idx") -> tuple[dict, float]:
    """The candidate of best mean AUROC over folds, which hold whole groups by default.

    A candidate's rounds are its most: each fit stops early by a tenth of its own groups, which isn't fitted on, so that the fold it
    is judged on plays no part. Without that the usual 30 points over five folds are 51,500 rounds.
    """
    rows = stored(folds(class_weights(df), n_folds, by, group=group, seed=seed), "folds")
    ready = assembler(columns).transform(rows.withColumn("is_val", F.pmod(F.xxhash64(F.lit("stop"), F.col(group)), F.lit(10)) == 0))
    evaluator = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0)
    areas = []
    for k in range(n_folds):
        train, held = (packed(ready.filter(f"fold {sign} {k}").select("features", "label", "weight", "is_val")).cache() for sign in ("<>", "="))

        def judged(candidate: dict) -> float:
            model = GBTClassifier(weightCol="weight", seed=seed, validationIndicatorCol="is_val", **candidate).fit(train)
            return evaluator.evaluate(model.transform(held))

        areas.append(concurrently([functools.partial(judged, c) for c in candidates], parallelism))
        train.unpersist()
        held.unpersist()
    means = [sum(x) / n_folds for x in zip(*areas)]
    best = max(range(len(candidates)), key=lambda i: means[i])
    return candidates[best], float(means[best])


def fit_logistic(train: DataFrame, columns: list[str]) -> PipelineModel:
    """On all rows of train."""
    return logistic(columns, train.count()).fit(packed(train))


#: Most node numbers, one for each row and tree, that a forest's fit keeps (1 GB).
NODE_IDS = 2**28


def fit_forest(df: DataFrame, columns: list[str], seed: int, **params) -> PipelineModel:
    """On train rows of df (with split).

    A fit keeps the node that each row has come to in each tree, unless these would be too many; else every pass sends the trees to all
    tasks, which walk them from the root for each row. The forest is the same.
    """
    rows, made = df.filter("split = 'train'"), forest(columns, seed, **params)
    trees = made.getStages()[-1]
    trees.setCacheNodeIds(rows.count() * trees.getNumTrees() <= NODE_IDS)
    return made.fit(packed(rows))


#: Fits that are submitted at a time.
AT_ONCE = 4


def concurrently(tasks: list[Callable[[], object]], at_once: int | None = None) -> list:
    """What the tasks return, in their order. A bounded pool submits their jobs; under the fair scheduler each has a pool of its own.

    Each task has its own copy of the local properties: threads that share one take each other's execution ids out of it.
    """
    from pyspark.sql import SparkSession

    session = SparkSession.active()

    def run(number: int, task: Callable[[], object]) -> object:
        session.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{number % (at_once or AT_ONCE)}")
        return task()

    own = [inheritable_thread_target(session)(functools.partial(run, i, task)) for i, task in enumerate(tasks)]
    with ThreadPool(at_once or AT_ONCE) as pool:
        return pool.map(lambda task: task(), own, chunksize=1)


def union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def over_protocol(df: DataFrame, columns: list[str], seeds: tuple[int, ...] = SEEDS, name: str = "boosted_trees", fit=fit_boosted, **params) -> DataFrame:
    """(model, seed, metric, value) on test rows of one fit for each seed; fits overlap, and each scores its rows once."""
    return union(concurrently(protocol(df, columns, seeds, name, fit, **params)))


def protocol(df: DataFrame, columns: list[str], seeds: tuple[int, ...], name: str, fit, **params) -> list[Callable[[], DataFrame]]:
    """The tasks of over_protocol()."""

    def one(seed: int) -> DataFrame:
        scored = stored(predict(fit(df, columns, seed, **params), df.filter("split = 'test'")).select("label", "prob", "pred"), "scored")
        row = point_metrics(scored).crossJoin(F.broadcast(ranking_metrics(scored)))  # one row each
        long = row.select(F.lit(name).alias("model"), F.lit(seed).alias("seed"), F.expr("stack(4, 'f1', f1, 'mcc', mcc, 'auroc', auroc, 'pr_auc', pr_auc) as (metric, value)"))
        return stored(long, "figures")

    return [functools.partial(one, seed) for seed in seeds]


def ablation(df: DataFrame, seeds: tuple[int, ...] = SEEDS, **params) -> DataFrame:
    """(removed_group, metric, mean, std) after leaving out each group and fitting anew; all fits of all groups overlap."""
    groups = [g for g in GROUPS if all(c in df.columns for c in GROUPS[g])]
    tasks = [t for gone in groups for t in protocol(df, columns_of(df, [g for g in groups if g != gone]), seeds, gone, fit_boosted, **params)]
    out = union(concurrently(tasks)).filter("metric in ('f1', 'auroc')")
    return over_seeds(out).select(F.col("model").alias("removed_group"), "metric", "mean", "std")


def save_bundle(path: str, model: PipelineModel, columns: list[str], params: dict, weights: DataFrame | None = None) -> None:
    """The fitted pipeline, whatever its stages, with its feature names and parameters, and the weights of its cosines, beside it."""
    from pyspark.sql import SparkSession

    model.write().overwrite().save(f"{path}/model")
    if weights is not None:
        weights.write.mode("overwrite").parquet(f"{path}/weights")
    about = (columns, json.dumps(params, sort_keys=True), weights is not None)
    SparkSession.active().createDataFrame([about], ABOUT).write.mode("overwrite").json(f"{path}/about")


ABOUT = "columns array<string>, params string, weighted boolean"


def load_bundle(path: str) -> tuple[PipelineModel, list[str], dict]:
    """(pipeline, feature names, parameters) of a saved bundle."""
    about = _about(path)
    return PipelineModel.load(f"{path}/model"), list(about.columns), json.loads(about.params)


def load_weights(path: str) -> DataFrame | None:
    """The weights of a saved bundle's cosines, where it has them."""
    from pyspark.sql import SparkSession

    return SparkSession.active().read.schema("term string, weight double").parquet(f"{path}/weights") if _about(path).weighted else None


def _about(path: str) -> Row:
    from pyspark.sql import SparkSession

    return SparkSession.active().read.schema(ABOUT).json(f"{path}/about").first()
