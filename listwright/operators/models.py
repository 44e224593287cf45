"""Models on features: boosted trees with weights and validation, search, importances, scores by organisation."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import IDF, HashingTF, OneHotEncoder, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import TrainValidationSplit
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.operators.rows import sums_before
from listwright.session import shared_table

#: Categories of a column that get a bit of their own; a column with more is given as the mean label of a category.
MAX_CATEGORIES = 100
#: Rows with the mean label of all that each category is taken to have besides its own.
PRIOR = 1.0


#: Hashed words of a text column.
TEXT_DIMS = 256


def drawn(key: str) -> Column:
    """A repeatable random order of rows by their key."""
    return F.xxhash64(F.col(key), F.lit("order"))


def ordered_targets(df: DataFrame, category: str, label: str, key: str, name: str, prior: float = PRIOR, order: Column | None = None) -> DataFrame:
    """df with `name`: the mean label of the rows of the same category that come before in a drawn order, with `prior` rows of the mean of all. A row's own label is not in it.

    Sums are taken over ranges of rows, so no task sees a whole category. key: unique; null is a category.
    """
    mean = df.agg(F.avg(label)).first()[0] or 0.0
    own = df.withColumns({"_d": drawn(key) if order is None else order, "_y": F.col(label).cast("double"), "_one": F.lit(1)})
    there = sums_before(own, [category], [F.col("_d"), F.col(key)], {"_by": "_y", "_bn": "_one"})
    return there.withColumn(name, (F.col("_by") + prior * mean) / (F.col("_bn") + prior)).drop("_d", "_y", "_one", "_by", "_bn")


def whole_targets(df: DataFrame, category: str, label: str, name: str, prior: float = PRIOR) -> tuple[DataFrame, float]:
    """(category, name: its mean label over all rows, with the prior; the mean of all, for categories that are not known)."""
    mean = df.agg(F.avg(label)).first()[0] or 0.0
    return df.groupBy(category).agg(((F.sum(label) + prior * mean) / (F.count(label) + prior)).alias(name)), mean


@dataclass(frozen=True)
class Boosted:
    """A fitted pipeline, and for each column with very many categories the table of their mean labels."""

    pipeline: PipelineModel
    targets: dict[str, tuple[DataFrame, float]]


def train(df: DataFrame, numbers: list[str], categories: list[str], label: str, weight: str, valid: str, depth: int = 3, rounds: int = 10, texts: list[str] | None = None, key: str = "id") -> Boosted:
    """Boosted trees on numbers, categories and texts (hashed words by TF-IDF), with weights and a validation set. Texts may not be null.

    A category is a bit, or, in a column with more than MAX_CATEGORIES, its mean label: in training that of the rows before, in a drawn order by the key.
    """
    kinds = df.agg(*(F.approx_count_distinct(c).alias(c) for c in categories)).first().asDict() if categories else {}
    wide = [c for c in categories if kinds[c] > MAX_CATEGORIES]
    targets = {}
    for c in wide:
        table, mean = whole_targets(df, c, label, f"{c}_m")
        targets[c] = (shared_table(table, "targets"), mean)
        df = ordered_targets(df, c, label, key, f"{c}_m")
    narrow = [c for c in categories if c not in wide]
    index = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in narrow]
    hot = [OneHotEncoder(inputCols=[f"{c}_i" for c in narrow], outputCols=[f"{c}_v" for c in narrow])] if narrow else []
    words = []
    for c in texts or []:
        words += [RegexTokenizer(inputCol=c, outputCol=f"{c}_w", pattern=r"\P{L}+"), HashingTF(inputCol=f"{c}_w", outputCol=f"{c}_t", numFeatures=TEXT_DIMS), IDF(inputCol=f"{c}_t", outputCol=f"{c}_v")]
    vector = VectorAssembler(inputCols=[*numbers, *(f"{c}_m" for c in wide), *(f"{c}_v" for c in [*narrow, *(texts or [])])], outputCol="features", handleInvalid="keep")
    trees = GBTRegressor(featuresCol="features", labelCol=label, weightCol=weight, validationIndicatorCol=valid, maxDepth=depth, maxIter=rounds, seed=200)
    return Boosted(Pipeline(stages=[*index, *hot, *words, vector, trees]).fit(df), targets)


def predict(model: Boosted, df: DataFrame) -> DataFrame:
    for c, (table, mean) in model.targets.items():
        known = table.withColumnRenamed(c, "_c")
        df = df.join(known, F.col(c).eqNullSafe(F.col("_c")), "left").drop("_c").fillna({f"{c}_m": mean})
    return model.pipeline.transform(df)


#: Ranges that a search draws from.
RANGES = {"maxDepth": (2, 6), "stepSize": (0.03, 0.3), "maxIter": (5, 20), "subsamplingRate": (0.6, 1.0), "minInstancesPerNode": (1, 8)}


def draws(ranges: dict[str, tuple], n: int, seed: int = 200) -> list[dict]:
    """So many settings, each parameter drawn on its own: whole numbers where a range has them, steps evenly on a logarithmic scale."""
    rng = random.Random(seed)

    def one(name, low, high):
        if isinstance(low, int) and isinstance(high, int):
            return rng.randint(low, high)
        return math.exp(rng.uniform(math.log(low), math.log(high))) if name == "stepSize" else rng.uniform(low, high)

    return [{k: one(k, *r) for k, r in ranges.items()} for _ in range(n)]


def search(df: DataFrame, numbers: list[str], label: str, ranges: dict[str, tuple] | None = None, n: int = 4, seed: int = 200) -> PipelineModel:
    """Randomised search: the best model of so many drawn settings, by a held-back part."""
    return searched(df, numbers, label, ranges, n, seed)[0]


def searched(df: DataFrame, numbers: list[str], label: str, ranges: dict[str, tuple] | None = None, n: int = 4, seed: int = 200) -> tuple[PipelineModel, list[tuple[dict, float]]]:
    """search(), with each drawn setting and its error."""
    trees = GBTRegressor(featuresCol="features", labelCol=label, seed=seed)
    params = [{trees.getParam(k): v for k, v in d.items()} for d in draws(ranges or RANGES, n, seed)]
    pipe = Pipeline(stages=[VectorAssembler(inputCols=numbers, outputCol="features", handleInvalid="keep"), trees])
    fitted = TrainValidationSplit(estimator=pipe, estimatorParamMaps=params, evaluator=RegressionEvaluator(labelCol=label), trainRatio=0.8, seed=seed).fit(df)
    return fitted.bestModel, [({p.name: v for p, v in d.items()}, m) for d, m in zip(params, fitted.validationMetrics, strict=True)]


def feature_statistics(df: DataFrame, features: list[str], label: str, prediction: str, bins: int = 10) -> DataFrame:
    """feature, bin, n, least, most, mean_label, mean_prediction: rows by quantiles of each numeric feature (borders belong to the bin below; null is bin -1).

    Quantiles are values of the feature and exact: distinct values are counted, and the counts summed up over ranges of values; then one pass over the rows.
    """
    every = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features))).alias("f")).select("f.*").where("x is not null")
    values = sums_before(every.groupBy("feature", "x").agg(F.count("*").alias("n")), ["feature"], [F.col("x")], {"before": "n"})
    total = F.broadcast(every.groupBy("feature").agg(F.count("*").alias("total")))  # a row for each feature
    rank = F.explode(F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda k: F.col("total") * k)).alias("k")
    ranks = values.join(total, "feature").select("*", rank).withColumn("rank", F.expr(f"(k + {bins - 1}) div {bins}")).where("before < rank and rank <= before + n")
    borders = {c: [] for c in features}
    for r in ranks.select("feature", "x").distinct().collect():  # a few numbers for each feature
        borders[r.feature].append(r.x)
    borders = {c: sorted(b) for c, b in borders.items()}
    bin_of = lambda c: F.when(F.col(c).isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, borders[c])).cast("array<double>"), lambda b: F.col(c) > b)))
    each = df.select(label, prediction, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), bin_of(c).alias("bin"), F.col(c).cast("double").alias("x")) for c in features))).alias("f"))
    return each.groupBy("f.feature", "f.bin").agg(F.count("*").alias("n"), F.min("f.x").alias("least"), F.max("f.x").alias("most"), F.avg(label).alias("mean_label"), F.avg(prediction).alias("mean_prediction"))


def importance(model: PipelineModel, spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, model.stages[-1].featureImportances.toArray(), strict=True)], "feature string, importance double")


def risk_scores(posts: DataFrame, organisations: DataFrame, predict_: Callable[[DataFrame], DataFrame], key: str = "id") -> DataFrame:
    """key, scores: the score of each post for each organisation, as a map. predict_ adds `prediction` to posts with an organisation column.

    Posts meet all organisations, as each is scored for each; the organisations' table is small and written, so that Spark knows its size.
    """
    orgs = shared_table(organisations.select("organisation").distinct(), "organisations")
    scored = predict_(posts.drop("organisation").join(orgs, F.lit(True)))
    return scored.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("organisation", F.col("prediction").cast("double").alias("score"))))).alias("scores"))
