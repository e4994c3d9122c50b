"""Checks of past predictions against what happened: outcomes per state, error cases, proof cases, calibration flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.operators.ranking import exact_ranks
from orderpulse.schemas import ENTITY
from orderpulse.session import cut_lineage

REVIEWED = ["priority_review", "manual_review"]


def outcome_check(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows, observed rate and mean scores per group; rows hold the label y, the probability p and the priority prio."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), F.avg("y").alias("observed_die_rate"),
        F.avg("p").alias("avg_churn_probability"), F.avg("prio").alias("avg_business_priority"),
    )


def priority_check(rows: DataFrame, by: Sequence[str], share: float = 0.05, ties: Sequence[str] = ENTITY) -> DataFrame:
    """The top share by probability, that by business priority, and all rows, with what each captures and how much of
    it is also in the top by probability. Ties go by the entity."""
    base = cut_lineage(rows.select(*by, *ties, "p", "v", "prio", "y"))
    r = exact_ranks(base, [("p", by, "_rp"), ("prio", by, "_rb")], ties, total="_n")
    k = F.greatest(F.lit(1), F.ceil(F.col("_n") * share))
    r = r.withColumns({"_in_p": F.col("_rp") <= k, "_in_b": F.col("_rb") <= k})
    policies = [("probability_topk", F.col("_in_p")), ("business_priority_topk", F.col("_in_b")), ("current_policy", F.lit(True))]
    chosen = F.array(*[F.when(c, F.lit(name)) for name, c in policies])
    long = r.withColumn("policy", F.explode(F.filter(chosen, lambda x: x.isNotNull())))
    return long.groupBy(*by, "policy").agg(
        F.count(F.lit(1)).alias("candidate_count"), F.avg("p").alias("avg_churn_probability"), F.avg("v").alias("avg_value_at_risk"),
        F.avg("y").alias("observed_die_rate"), F.sum("v").alias("value_captured"),
        (F.count_if("_in_p") / F.count(F.lit(1))).alias("overlap_with_probability_topk"),
    )


def error_cases(status: DataFrame, kind: str, n: int, order: Sequence[str] = ("prio", "p")) -> DataFrame:
    """The n rows of highest priority of a kind: true_positive and false_positive are reviewed ones with label 1 and 0,
    false_negative are ones with label 1 that were not reviewed."""
    reviewed = F.col("final_candidate_status").isin(REVIEWED)
    picked = {"true_positive": (F.col("y") == 1) & reviewed, "false_positive": (F.col("y") == 0) & reviewed, "false_negative": (F.col("y") == 1) & ~reviewed}[kind]
    best = status.where(picked).orderBy(*[F.desc_nulls_last(c) for c in order], F.asc("entity_id"), F.asc("cutoff_month")).limit(n)
    return best.withColumn("case_type", F.lit(kind))


def backtest_cases(predictions: DataFrame, purchases: DataFrame, report_date: str, months: int, min_probability: float, n: int) -> DataFrame:
    """The n costliest right warnings of a report date with the purchases around it.

    Predictions hold the entity, p, v, y, closed, sample_class of one horizon and cutoff; purchases hold the entity,
    purchase_time and amount. Only the purchases of the n cases are read into sums.
    """
    report = F.to_date(F.lit(report_date))
    end = F.add_months(report, months)
    good = predictions.where(F.col("closed") & (F.col("y") == 1) & (F.col("sample_class") != "one_shot") & (F.col("p") >= min_probability))
    best = good.withColumn("business_score", F.col("p") * F.coalesce("v", F.lit(0.0))).orderBy(F.desc("business_score"), F.desc("p"), F.asc("entity_id")).limit(n)
    cases = best.select("entity_id", *ENTITY, "p", "v", "business_score")
    # At most n rows.
    near = purchases.join(F.broadcast(cases.select(*ENTITY)), list(ENTITY))
    t = F.col("purchase_time")
    sums = near.groupBy(*ENTITY).agg(
        F.max(F.when(t <= report, t)).alias("last_purchase_before_report"), F.min(F.when(t > report, t)).alias("next_purchase_after_report"),
        F.count_if((t > report) & (t <= end)).alias("validation_window_purchase_count"),
        F.coalesce(F.sum(F.when((t <= report) & (t > F.add_months(report, -12)), F.col("amount"))), F.lit(0.0)).alias("observed_amount_last_12m"),
    )
    out = cases.join(sums, list(ENTITY), "left").withColumn("validation_window_purchase_count", F.coalesce("validation_window_purchase_count", F.lit(0)))
    return out.withColumns(
        {
            "days_since_last_purchase": F.date_diff(report, F.to_date("last_purchase_before_report")),
            "outcome": F.when(F.col("validation_window_purchase_count") == 0, "hit").otherwise("miss"),
        }
    )


def histogram_calibration(fit: DataFrame, rows: DataFrame, by: Sequence[str] = ("horizon",), bins: int = 10) -> DataFrame:
    """Rows with q: the observed rate of the probability bin among the fitted rows, or p where that bin was empty."""
    place = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    rate = fit.groupBy(*by, place.alias("_bin")).agg(F.avg("y").alias("_rate"))
    return rows.withColumn("_bin", place).join(rate, [*by, "_bin"], "left").withColumn("q", F.coalesce("_rate", "p")).drop("_bin", "_rate")


def topk_stability(before_after: DataFrame) -> DataFrame:
    """stable up to 0.02, minor up to 0.05, else material, by the largest change of the top-k columns that are known."""
    changes = [F.abs(F.col(f"{c}_after") - F.col(f"{c}_before")) for c in ("lift", "ndcg", "precision") if f"{c}_after" in before_after.columns]
    most = F.greatest(*changes) if len(changes) > 1 else changes[0]
    # greatest() passes over nulls.
    level = F.when(most.isNull(), "not_available").when(most <= 0.02, "stable").when(most <= 0.05, "minor_change").otherwise("material_degradation_or_shift")
    return before_after.withColumn("topk_stability_status", level)


def small_extreme_bins(bins: DataFrame, by: Sequence[str]) -> DataFrame:
    """Whether a non-empty bin of at most three rows or one per cent of its group has a rate next to 0 or 1."""
    total = bins.where("row_count > 0").groupBy(*by).agg(F.sum("row_count").alias("_total"))
    marked = bins.where("row_count > 0").join(total, list(by))
    small = F.col("row_count") <= F.greatest(F.lit(3.0), F.col("_total") * 0.01)
    extreme = (F.col("observed_positive_rate") <= 0.05) | (F.col("observed_positive_rate") >= 0.95)
    return marked.groupBy(*by).agg(F.bool_or(small & extreme).alias("bin_small_extreme_flag"))


def overfit_flags(before_after: DataFrame, bins: DataFrame, by: Sequence[str]) -> DataFrame:
    """Flags of a calibration that improved one measure at the cost of another, rests on tiny bins or moved the top."""
    d = lambda c: F.col(f"{c}_after") - F.col(f"{c}_before")
    out = topk_stability(before_after).join(small_extreme_bins(bins, by), list(by), "left")
    declines = [F.coalesce(d(c) < -0.02, F.lit(False)) for c in ("auc", "pr_auc") if f"{c}_after" in before_after.columns]
    flags = {
        "ece_down_logloss_up": (d("ece") < 0) & (d("log_loss") > 0.02), "brier_down_logloss_up": (d("brier") < 0) & (d("log_loss") > 0.02),
        "bin_small_extreme_flag": F.coalesce("bin_small_extreme_flag", F.lit(False)),
        "auc_pr_decline": declines[0] | declines[-1] if declines else F.lit(False),
        "topk_degrades": F.col("topk_stability_status") == "material_degradation_or_shift",
    }
    out = out.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    names = F.array(*[F.when(F.col(k), F.lit(k)) for k in flags])
    reason = F.array_join(F.filter(names, lambda x: x.isNotNull()), ";")
    return out.withColumn("overfit_risk_reason", reason).withColumn("overfit_risk_flag", F.col("overfit_risk_reason") != "")
