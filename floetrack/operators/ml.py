"""Distributed forests on track and cell features."""
from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from floetrack.functions import geo
from floetrack.operators.metrics import position_metrics, regression_metrics

TRACK_FEATURES = ["prev_latitude", "prev_longitude", "latitude", "longitude", "time_diff_hours", "prev_distance_km",
                  "prev_speed_kmh", "prev_direction_deg", "month"]


def fit_track_forest(train, features=TRACK_FEATURES, targets=("target_lat_delta", "target_lon_delta"), trees=40, depth=8, seed=42,
                     min_leaf=2):
    """Standardised features, one forest per target, fitted in one Pipeline.

    Missing features take the training median, in fit and prediction, so every row is predicted; rows without a target
    cannot be learned from and are left out of the fit only.
    """
    filled = [f"_f_{c}" for c in features]
    train = train.dropna(subset=list(targets)).withColumns({c: F.col(c).cast("double") for c in features})
    stages = [Imputer(inputCols=list(features), outputCols=filled, strategy="median"),
              VectorAssembler(inputCols=filled, outputCol="_raw", handleInvalid="error"),
              StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True)]
    for t in targets:
        stages.append(RandomForestRegressor(featuresCol="_x", labelCol=t, predictionCol=f"pred_{t}", numTrees=trees, maxDepth=depth,
                                            minInstancesPerNode=min_leaf, seed=seed))
    data = train.persist()                      # the stages pass over the rows several times
    try:
        return Pipeline(stages=stages).fit(data)
    finally:
        data.unpersist()


def predict_track_forest(model, df):
    """Add the predicted move to the current position."""
    names = model.stages[0].getInputCols()
    out = model.transform(df.withColumns({c: F.col(c).cast("double") for c in names})).drop("_raw", "_x", *model.stages[0].getOutputCols())
    return (out.withColumn("pred_lat", F.col("latitude") + F.col("pred_target_lat_delta"))
            .withColumn("pred_lon", F.col("longitude") + F.col("pred_target_lon_delta"))
            .withColumn("act_lat", F.col("target_latitude")).withColumn("act_lon", F.col("target_longitude")))


def score_track_forest(pred):
    """Forest and persistence (no move) position metrics side by side."""
    base = pred.withColumn("pred_lat", F.col("latitude")).withColumn("pred_lon", F.col("longitude"))
    return (position_metrics(pred).withColumn("model", F.lit("random_forest"))
            .unionByName(position_metrics(base).withColumn("model", F.lit("persistence"))))


def fit_cell_forest(windows, max_rows=200_000, trees=30, depth=8, seed=0, n_rows=None):
    """Forest on flattened cell windows. Training rows are a seeded random sample of about ``max_rows`` when there are more
    (sampling is part of the method), taken by a hash so no global sort is needed."""
    full = ok = windows.filter("valid").persist()
    n = n_rows if n_rows is not None else ok.count()
    if n == 0:
        raise ValueError("no valid training cells")
    if n > max_rows:
        ok = ok.sample(fraction=max_rows / n, seed=seed)
    from pyspark.ml.functions import array_to_vector
    data = ok.select(array_to_vector(F.col("features")).alias("_x"), F.col("target").cast("double").alias("_y"))
    try:
        return RandomForestRegressor(featuresCol="_x", labelCol="_y", predictionCol="pred", numTrees=trees, maxDepth=depth,
                                     seed=seed).fit(data)
    finally:
        full.unpersist()


def predict_cell_forest(model, windows):
    from pyspark.ml.functions import array_to_vector
    d = windows.filter("valid").withColumn("_x", array_to_vector(F.col("features")))
    return model.transform(d).drop("_x").withColumn("pred", geo.clamp("pred", 0.0, 1.0)).withColumn("actual", F.col("target"))


def score_cell_forest(pred):
    return regression_metrics(pred)
