"""Training data and classifiers: splits, folds, augmentation, tabular and view models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photospark.functions.draws import cell, draw, normal, uniform
from photospark.functions.scalars import arg_max, array_sum, clean_num
from photospark.operators.evaluate import N_CLASSES, class_report, class_weights
from photospark.operators.features import FEATURE_COLUMNS
from photospark.operators.fold import shift_view
from photospark.plans.lineage import pin
from photospark.plans.prefix import ordinal

def group_split(
    df: DataFrame, group: str, label: str, fractions: dict[str, float] | None = None, seed: int = 42
) -> DataFrame:
    """Assign whole groups to the parts of a split, stratified by their most frequent label.

    Inside a label the groups are ordered by hash and cut at the fractions.
    Returns (group, label, split), one row per group.
    """
    fractions = fractions or {"train": 0.6, "calibration": 0.2, "test": 0.2}
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    leading = counts.groupBy(group).agg(
        F.max_by(label, F.struct(F.col("_n"), (-F.col(label)).alias("low"))).alias(label)
    )
    hashed = leading.withColumn("_h", draw("split", seed, F.col(group)))
    placed = ordinal(hashed, [label], cell(F.col("_h")), [F.col("_h"), F.col(group)], "_pos")
    sizes = leading.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    share = (F.col("_pos") - 1) / F.col("_size")
    names, limit = list(fractions), 0.0
    split = None
    for name in names[:-1]:
        limit = round(limit + fractions[name], 12)
        split = F.when(share < limit, name) if split is None else split.when(share < limit, name)
    split = split.otherwise(names[-1]) if split is not None else F.lit(names[0])
    return placed.join(sizes, label).select(group, label, split.alias("split"))


def kfold(df: DataFrame, k: int, seed: int = 42, key: str = "tic_id", label: str = "label") -> DataFrame:
    """Add ``fold`` 0..k-1: rows of a label are dealt out in hash order."""
    hashed = df.withColumn("_h", draw("fold", seed, F.col(key)))
    placed = ordinal(hashed, [label], cell(F.col("_h")), [F.col("_h"), F.col(key)], "_pos")
    return placed.withColumn("fold", ((F.col("_pos") - 1) % k).cast("int")).drop("_h", "_pos")


def _gauss_dip(view: Column, centre: Column, sigma: Column, depth: Column) -> Column:
    return F.transform(
        view, lambda x, i: x - depth * F.exp(F.lit(-0.5) * ((i - centre) / sigma) * ((i - centre) / sigma))
    )


def _noise(view: Column, sigma: Column, key: Column, stream: str, seed: int) -> Column:
    """Add Gaussian noise, drawn independently for every key and bin."""
    return F.transform(view, lambda x, i: x + sigma * normal(stream, seed, key, i))


def augment_views(
    df: DataFrame, key: str, seed: int = 42, variant_style: str = "dip", noise: float | None = None
) -> DataFrame:
    """Seven versions of every (global_view, local_view): ``variant`` 0 is the original.

    1 adds noise of ``median_flux_err`` (or ``noise``), 2 shifts by -5..5 bins,
    3-6 inject a Gaussian dip of 5-25 % of the view depth, or with
    ``variant_style='scale'`` stretch the depth by up to 10 %. All draws follow
    from the key, the variant and the seed.
    """
    sigma = F.lit(float(noise)) if noise is not None else F.coalesce(F.col("median_flux_err"), F.lit(0.001))
    base = df.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(6))))
    which = (F.col(key), F.col("variant"))
    g, v, variant = F.col("global_view"), F.col("local_view"), F.col("variant")
    shift = (F.floor(uniform("shift", seed, *which) * 11) - 5).cast("int")
    if variant_style == "scale":
        factor = F.lit(0.9) + uniform("stretch", seed, *which) * 0.2
        from photospark.functions.scalars import array_median, let

        stretch = lambda x: let(array_median(x), lambda m: F.transform(x, lambda e: m + (e - m) * factor))
        late_g, late_l = stretch(g), stretch(v)
    else:
        low = F.array_min(v)
        view_depth = F.when(low < -0.01, F.abs(low)).otherwise(F.lit(0.5))
        ppm = F.lit(50e-6) + uniform("depth", seed, *which) * 150e-6
        depth = F.least(F.greatest(view_depth * (ppm / 100e-6), F.lit(0.05)), F.lit(0.25))
        width = F.greatest(F.lit(5), F.floor(F.col("duration") / F.col("period") * F.size(g)).cast("int"))
        room = F.greatest(F.size(g) - width * 2, F.lit(1))
        centre = width + F.floor(uniform("centre", seed, *which) * room)
        late_g = _gauss_dip(g, F.col("_centre"), F.col("_width") / 4.0, F.col("_depth"))
        late_l = _gauss_dip(
            v, F.floor(F.size(v) / 2), F.greatest(F.lit(3), F.floor(F.col("_width") / 4)), F.col("_depth")
        )
        base = base.withColumns({"_centre": centre, "_width": width, "_depth": depth})
    base = base.withColumns({"_shift": shift, "_sigma": sigma})

    def version(view: Column, late: Column, stream: str) -> Column:
        return (
            F.when(variant == 0, view)
            .when(variant == 1, _noise(view, F.col("_sigma"), F.col(key), stream, seed))
            .when(variant == 2, shift_view(view, F.col("_shift")))
            .otherwise(late)
        )

    out = base.withColumns({"_g": version(g, late_g, "noise-global"), "_l": version(v, late_l, "noise-local")})
    return out.drop("global_view", "local_view", "_centre", "_width", "_depth", "_shift", "_sigma").withColumnsRenamed(
        {"_g": "global_view", "_l": "local_view"}
    )


# ---- models --------------------------------------------------------------------


def with_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add the balanced class weight; the four weights are looked up, not joined."""
    weights = {row["label"]: row["weight"] for row in class_weights(df, label).collect()}
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return df.withColumn("weight", F.try_element_at(table, F.col(label).cast("int")))


def _labelled(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label).between(0, N_CLASSES - 1))


def train_tabular(
    df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS, label: str = "label", trees: int = 40, depth: int = 6, seed: int = 42
) -> PipelineModel:
    """Weighted random forest on the feature vector; missing features count as 0."""
    rows = with_class_weights(_labelled(df, label), label).withColumns({c: clean_num(F.col(c), 0.0) for c in features})
    forest = RandomForestClassifier(
        labelCol=label, featuresCol="_features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed,
        probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction",
    )
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), forest]).fit(rows)


def _scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``probs`` (four classes) and ``pred`` from a fitted model."""
    out = model.transform(df).withColumn("_p", vector_to_array("_probability"))
    four = F.transform(F.sequence(F.lit(0), F.lit(N_CLASSES - 1)), lambda i: F.coalesce(F.get("_p", i), F.lit(0.0)))
    out = out.withColumn("probs", four).withColumn("pred", arg_max(F.col("probs")))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def predict_tabular(model: PipelineModel, df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    return _scored(model, df.withColumns({c: clean_num(F.col(c), 0.0) for c in features}))


def cross_validate(
    df: DataFrame, k: int = 5, features: Sequence[str] = FEATURE_COLUMNS, label: str = "label", key: str = "tic_id", seed: int = 42, **options
) -> DataFrame:
    """(fold, f1_macro, n) of the tabular model in stratified cross-validation; ``n`` rows were left out of the training and scored."""
    folded = pin(kfold(_labelled(df, label), k, seed, key, label))
    parts = None
    for fold in range(k):
        model = train_tabular(folded.filter(F.col("fold") != fold), features, label, seed=seed, **options)
        scored = predict_tabular(model, folded.filter(F.col("fold") == fold), features)
        report = class_report(scored, label, "pred")
        row = report.filter(F.col("support") > 0).agg(F.avg("f1").alias("f1_macro"), F.sum("support").alias("n")).select(
            F.lit(fold).alias("fold"), "f1_macro", "n")
        parts = row if parts is None else parts.unionByName(row)
    return parts


def cv_summary(folds: DataFrame) -> DataFrame:
    """One row: mean and population deviation of the fold scores."""
    return folds.agg(F.avg("f1_macro").alias("mean"), F.stddev_pop("f1_macro").alias("std"))


def importance_table(model: PipelineModel, df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Features by falling importance."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(x)) for name, x in zip(features, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )


def downbin(view: Column, bins: int) -> Column:
    """Mean of a view in ``bins`` equal runs (the rest at the end is dropped)."""
    width = F.floor(F.size(view) / bins).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda i: array_sum(F.slice(view, i * width + 1, width)) / width,
    )


def view_vector(df: DataFrame, global_bins: int = 32, local_bins: int = 32) -> DataFrame:
    joined = F.concat(downbin(F.col("global_view"), global_bins), downbin(F.col("local_view"), local_bins))
    return df.withColumn("_views", array_to_vector(joined))


def train_view_model(
    views: DataFrame, label: str = "label", global_bins: int = 32, local_bins: int = 32, iterations: int = 50, regularisation: float = 0.01
) -> PipelineModel:
    """Weighted multinomial regression on the averaged views, giving four class probabilities."""
    rows = view_vector(with_class_weights(_labelled(views, label), label), global_bins, local_bins)
    scaler = StandardScaler(inputCol="_views", outputCol="_features", withMean=True)
    regression = LogisticRegression(
        labelCol=label, featuresCol="_features", weightCol="weight", maxIter=iterations, regParam=regularisation,
        family="multinomial", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction",
    )
    return Pipeline(stages=[scaler, regression]).fit(rows)


def predict_views(model: PipelineModel, views: DataFrame, global_bins: int = 32, local_bins: int = 32) -> DataFrame:
    return _scored(model, view_vector(views, global_bins, local_bins))
