"""Training recipes: from labelled posts to an evaluated model, in named steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.operators import datasets as S
from listwright.operators import evaluation as E


@dataclass(frozen=True)
class Recipe:
    """What a training run does: whether posts are extended over organisations and weighed, how they are split, and which features by tags."""

    extended: bool = True
    weighed: bool = True
    least: int = 10
    test_share: float = 0.2
    stratum: str | None = "organisation"
    include: frozenset[str] = frozenset({"tg_all"})
    exclude: frozenset[str] = frozenset()
    recall: float = 0.98
    threshold: float = 0.2


#: Recipes by name.
RECIPES = {
    "v4": Recipe(extended=False, weighed=False), "v6": Recipe(), "v7": Recipe(stratum=None), "v8": Recipe(extended=False, weighed=False, stratum=None, exclude=frozenset({"tg_account", "tg_cluster", "tg_image"})),
    "one_brand": Recipe(extended=False, weighed=True, threshold=0.7),
}


def prepared(posts: DataFrame, recipe: Recipe, test: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(training rows with weight, test rows) of posts (id, organisation, domain, label, positive).

    A given test set is taken out of the posts by id; else a share is split off, by strata if the recipe says so. Training rows are
    extended and weighed as the recipe says; the weight is 1 without weights.
    """
    if test is None:
        s = S.split(posts, F.col("id"), 1 - recipe.test_share, recipe.stratum)
        train, test = s.where("train").drop("train"), s.where("not train").drop("train")
    else:
        train = posts.join(test.select("id"), "id", "left_anti")
    if recipe.extended:
        train, test = S.extend(train, recipe.least), S.extend(test, 1)
    if not recipe.weighed:
        return train.withColumn("weight", F.lit(1.0)), test
    w = S.weights(train, test)
    return train.join(w, ["organisation", "label"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))), test


def run(posts: DataFrame, recipe: Recipe, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], positive: Callable, test: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a training run: train, test, scored (test rows with label 0 or 1 and score), at_recall, at_threshold, confusion.

    fit trains on the weighed rows and gives a function that adds `score`; positive gives a label's value as a column.
    """
    train, held = prepared(posts, recipe, test)
    scored = fit(train)(held).select("organisation", positive(F.col("label")).cast("int").alias("label"), "score")
    return {"train": train, "test": held, "scored": scored, "at_recall": E.at_recall(scored, "organisation", recipe.recall), "at_threshold": E.at_threshold(scored, "organisation", recipe.threshold), "confusion": E.confusion(scored)}
