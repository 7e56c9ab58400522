"""Baselines by random forest: spatial folds, predictions with the spread of the trees, permutation importance."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spatial_fold(df: DataFrame, x: str, y: str, spacing: float, n_folds: int) -> DataFrame:
    """df with fold: whole square blocks of the given spacing, dealt by a hash, so near points are never split."""
    block = F.struct(F.floor(F.col(x) / spacing), F.floor(F.col(y) / spacing))
    return df.withColumn("fold", F.pmod(F.xxhash64(block), F.lit(n_folds)).cast("int"))


def forest(df: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 6, seed: int = 7):
    """A fitted forest and the assembler of its features; rows with missing values are left out."""
    assembler = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip")
    model = RandomForestRegressor(featuresCol="_features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(assembler.transform(df))
    return model, assembler


def predict_with_spread(model, assembler, df: DataFrame) -> DataFrame:
    """df with prediction and tree_sd (population deviation over the trees, each evaluated by its own rules)."""
    out = model.transform(assembler.transform(df))
    for k, tree in enumerate(model.trees):
        tree.setPredictionCol(f"_t{k}")
        out = tree.transform(out)
    names = [f"_t{k}" for k in range(len(model.trees))]
    values = F.array(*names)
    mean = F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / len(names)
    var = F.aggregate(F.transform(values, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, b: a + b) / len(names)
    return out.withColumn("tree_sd", F.sqrt(var)).drop("_features", *names)


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """df with 1 ... n in the order of a hash: numbers within buckets of it plus the sizes of the buckets before."""
    n_buckets = max(1, df.count() // 200_000)
    keyed = df.withColumn("_h", order).withColumn("_b", F.floor((F.shiftrightunsigned("_h", 33).cast("double") / 2.0**31) * n_buckets))
    sizes = keyed.groupBy("_b").count()  # one row a bucket
    before = F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_b", before.alias("_start"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h"))
    return keyed.withColumn("_place", place).join(starts, "_b").withColumn(name, F.col("_start") + F.col("_place")).drop("_h", "_b", "_start", "_place")


def permutation_importance(model, assembler, df: DataFrame, features: list[str], label: str) -> DataFrame:
    """feature, rise of the squared error when the feature's values are permuted over the rows (each value is used once)."""
    base = model.transform(assembler.transform(df)).agg(F.avg((F.col("prediction") - F.col(label)) ** 2)).first()[0]
    columns, found = df.columns, []
    takers = numbered(df, F.xxhash64(F.lit("taker"), *columns), "_n")
    for f in features:
        givers = numbered(df, F.xxhash64(F.lit("giver"), F.lit(f), *columns), "_n").select("_n", F.col(f).alias("_v"))
        mixed = takers.join(givers, "_n").withColumn(f, F.col("_v")).drop("_n", "_v")
        err = model.transform(assembler.transform(mixed)).agg(F.avg((F.col("prediction") - F.col(label)) ** 2)).first()[0]
        found.append((f, float(err - base)))
    return df.sparkSession.createDataFrame(found, "feature string, importance double")


def out_of_fold(df: DataFrame, features: list[str], label: str, fold: str, trees: int = 20, depth: int = 6, seed: int = 7) -> DataFrame:
    """df with prediction and tree_sd, each row's by a forest that has seen no row of its fold.

    Rows with a missing feature, or a null fold, have NULLs; rows without a label are predicted but teach nothing. A fold whose
    other folds have no complete row is not predicted. There are as many forests as folds (a few).
    """
    complete = F.lit(True)
    for c in [*features, fold]:
        complete = complete & F.col(c).isNotNull()
    folds = sorted(r[0] for r in df.filter(complete).select(fold).distinct().collect())  # a number each
    nothing = [F.lit(None).cast("double").alias(c) for c in ("prediction", "tree_sd")]
    out = df.filter(~complete).select("*", *nothing)
    for k in folds:
        own, others = df.filter(complete & (F.col(fold) == k)), df.filter(complete & (F.col(fold) != k) & F.col(label).isNotNull())
        if others.limit(1).count():
            out = out.unionByName(predict_with_spread(*forest(others, features, label, trees, depth, seed), own))
        else:
            out = out.unionByName(own.select("*", *nothing))
    return out
