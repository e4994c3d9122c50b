"""Model training and calibration with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.operators import metrics

NUMERIC = ["recency", "decay", "overdue", "n_orders", "n_months", "age", "med", "cv2", "adi", "v"]
CATEGORICAL = ["demand_shape_label", "province_code", "drug_category_code"]


def pipeline(numeric: Sequence[str], categorical: Sequence[str], kind: str = "logistic") -> Pipeline:
    """Median fill and scaling of numbers, index and one-hot of categories, class-balanced model."""
    filled = [f"{c}_f" for c in numeric]
    index, hot = [f"{c}_i" for c in categorical], [f"{c}_o" for c in categorical]
    stages = [
        Imputer(strategy="median", inputCols=list(numeric), outputCols=filled),
        StringIndexer(inputCols=list(categorical), outputCols=index, handleInvalid="keep"),
        OneHotEncoder(inputCols=index, outputCols=hot),
        VectorAssembler(inputCols=filled, outputCol="num"),
        StandardScaler(inputCol="num", outputCol="num_s", withMean=True),
        VectorAssembler(inputCols=["num_s", *hot], outputCol="x"),
    ]
    if kind == "logistic":
        stages.append(LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=50, regParam=0.01))
    else:
        stages.append(GBTClassifier(featuresCol="x", labelCol="y", weightCol="w", maxIter=20, maxDepth=4, seed=7))
    return Pipeline(stages=stages)


def prepare(rows: DataFrame, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL) -> DataFrame:
    out = rows.withColumns({c: F.col(c).cast("double") for c in numeric})
    out = out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__")) for c in categorical})
    return out.withColumn("y", F.col("y").cast("double"))


def balanced(train: DataFrame) -> DataFrame:
    """Weight of a class = rows / (2 x rows of the class)."""
    rate = train.agg(F.avg("y")).scalar()
    w = F.when(F.col("y") == 1, 0.5 / F.col("_rate")).otherwise(0.5 / (1 - F.col("_rate")))
    return train.withColumn("_rate", rate).withColumn("w", w).drop("_rate")


def train_per_horizon(
    rows: DataFrame, train: str, horizons: Sequence[str] = ("H3", "H6", "H12"), numeric: Sequence[str] = NUMERIC,
    categorical: Sequence[str] = CATEGORICAL, kind: str = "logistic",
) -> dict[str, PipelineModel]:
    data = prepare(rows, numeric, categorical).where(train)
    return {h: pipeline(numeric, categorical, kind).fit(balanced(data.where(F.col("horizon") == h))) for h in horizons}


def score_per_horizon(rows: DataFrame, models: Mapping[str, PipelineModel], numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL) -> DataFrame:
    data = prepare(rows, numeric, categorical)
    keep = [*rows.columns, "model_probability"]
    out = None
    for h, model in models.items():
        part = model.transform(data.where(F.col("horizon") == h)).withColumn("model_probability", vector_to_array("probability")[1]).select(*keep)
        out = part if out is None else out.unionByName(part)
    return out


def calibrate(scored: DataFrame, valid: str, test: str, p: str = "model_probability") -> DataFrame:
    """Raw, Platt and isotonic probabilities of the test rows, fitted on the validation rows."""
    data = scored.withColumn("logit", F.expr(f"ln(greatest({p}, 1e-6D) / greatest(1 - {p}, 1e-6D))"))
    data = VectorAssembler(inputCols=["logit"], outputCol="lx").transform(data)
    fit = data.where(valid)
    platt = LogisticRegression(featuresCol="lx", labelCol="y", probabilityCol="pp", rawPredictionCol="pr", predictionCol="pq").fit(fit)
    iso = IsotonicRegression(featuresCol=p, labelCol="y", predictionCol="isotonic").fit(fit)
    out = iso.transform(platt.transform(data.where(test)))
    return out.withColumn("platt", vector_to_array("pp")[1]).withColumnRenamed(p, "raw").drop("lx", "pp", "pr", "pq", "logit")


def calibration_choice(calibrated: DataFrame, by: Sequence[str] = ("horizon",), gain: float = 0.005) -> DataFrame:
    """ECE and Brier per method; a method replaces raw only when it lowers the mean ECE by `gain`."""
    long = calibrated.selectExpr(*by, "y", "inline(array(" + ", ".join(f"named_struct('method', '{m}', 'p', {m})" for m in ("raw", "platt", "isotonic")) + "))")
    m = metrics.full_metrics(long, [*by, "method"])
    mean = m.groupBy("method").agg(F.avg("ece").alias("mean_ece"), F.avg("brier_score").alias("mean_brier"), F.avg("roc_auc").alias("mean_auc"))
    raw = mean.where("method = 'raw'").select("mean_ece").scalar()
    return mean.withColumn("_raw", raw).withColumn("beats_raw", F.col("_raw") - F.col("mean_ece") >= gain).drop("_raw")


def ablation(rows: DataFrame, train: str, test: str, sets: Mapping[str, Sequence[str]], horizon: str = "H6") -> DataFrame:
    """Test metrics of one model per feature set."""
    out = None
    for name, cols in sets.items():
        models = train_per_horizon(rows, train, [horizon], cols, CATEGORICAL[:1])
        scored = score_per_horizon(rows.where(test), models, cols, CATEGORICAL[:1]).withColumn("feature_set", F.lit(name))
        part = metrics.full_metrics(scored.select("horizon", "feature_set", "y", F.col("model_probability").alias("p")), ["horizon", "feature_set"])
        out = part if out is None else out.unionByName(part)
    return out
