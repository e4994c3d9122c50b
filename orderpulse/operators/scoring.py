"""Probability scorers written as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.functions.exprs import case, clip
from orderpulse.operators.features import MODEL_META


def _share(c: str, top: float, missing: float) -> Column:
    return clip(F.coalesce(F.col(c).cast("double"), F.lit(missing)), 0.0, top) / top


def rule_probability() -> Column:
    """Blend of silence, overdue interval, frequency loss and quantity loss, kept inside 0.01..0.99."""
    raw = (
        0.35 * _share("months_since_last_purchase", 24.0, 0.0)
        + 0.25 * _share("current_interval_over_median", 4.0, 0.0)
        + 0.20 * (1 - _share("frequency_ratio", 1.0, 1.0))
        + 0.20 * (1 - _share("quantity_ratio", 1.0, 1.0))
    )
    return clip(raw, 0.01, 0.99)


def linear_probability(intercept: float, weights: Mapping[str, float], columns: list[str]) -> Column:
    z = F.lit(float(intercept))
    for name, w in weights.items():
        if name in columns:
            z = z + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * float(w)
    return 1.0 / (1.0 + F.exp(-z))


def score_frame(features: DataFrame, probability: Column, source: str, artifact_id: str) -> DataFrame:
    p = clip(probability, 0.0, 1.0)
    return features.select(
        *MODEL_META,
        F.concat_ws("|", "entity_id", "horizon").alias("candidate_id"),
        p.alias("churn_probability_H"),
        p.alias("risk_score"),
        F.lit(source).alias("score_source"),
        F.lit(artifact_id).alias("artifact_id"),
        F.lit("dry_run_only" if source == "dry_run_rule_baseline" else "").alias("score_caveat"),
    )


def score_rule_baseline(features: DataFrame) -> DataFrame:
    return score_frame(features, rule_probability(), "dry_run_rule_baseline", "dry_run_rule_baseline")


def score_linear(features: DataFrame, intercept: float, weights: Mapping[str, float], artifact_id: str) -> DataFrame:
    return score_frame(
        features, linear_probability(intercept, weights, features.columns), "artifact", artifact_id
    )


def score_linear_per_horizon(
    features: DataFrame, models: Mapping[str, tuple[float, Mapping[str, float]]], artifact_id: str
) -> DataFrame:
    """One linear model per horizon, chosen by a CASE so that the frame is read once."""
    p = case(
        [
            (F.col("horizon") == h, linear_probability(b, w, features.columns))
            for h, (b, w) in models.items()
        ]
    )
    return score_frame(features, p, "artifact", artifact_id)
