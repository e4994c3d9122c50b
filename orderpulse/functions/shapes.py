"""Demand-shape classes and history-sufficiency flags in their named variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderpulse.functions.exprs import case, col, truth

# Syntetos-Boylan class limits.
ADI_LIMIT = 1.32
CV2_LIMIT = 0.49


def shape_closed(adi: Column | str, cv2: Column | str, cold: Column) -> Column:
    """Monthly variant: limits belong to the lower class; cold start first; unknown when a part is missing."""
    a, c = col(adi), col(cv2)
    return case(
        [
            (cold, "cold_start"),
            ((a <= ADI_LIMIT) & (c <= CV2_LIMIT), "smooth"),
            ((a <= ADI_LIMIT) & (c > CV2_LIMIT), "erratic"),
            ((a > ADI_LIMIT) & (c <= CV2_LIMIT), "intermittent"),
            ((a > ADI_LIMIT) & (c > CV2_LIMIT), "lumpy"),
        ],
        "unknown",
    )


def shape_open(adi: Column | str, cv2: Column | str, missing: str = "lumpy") -> Column:
    """Daily and research variant: limits belong to the upper class."""
    a, c = col(adi), col(cv2)
    return case(
        [
            (a.isNull() | c.isNull(), missing),
            ((a < ADI_LIMIT) & (c < CV2_LIMIT), "smooth"),
            (a < ADI_LIMIT, "erratic"),
            (c < CV2_LIMIT, "intermittent"),
        ],
        "lumpy",
    )


def history_monthly(count: Column | str, active: Column | str, observed: Column | str) -> Column:
    n, a, m = col(count), col(active), col(observed)
    return case(
        [
            ((n < 3) | (a < 2) | (m < 3), "history_insufficient"),
            ((n >= 6) & (a >= 4) & (m >= 12), "history_sufficient"),
        ],
        "history_medium",
    )


def history_interval() -> tuple[Column, Column]:
    """Flag and reason from counts and interval variance."""
    n, a = F.col("purchase_count_asof_cutoff"), F.col("active_month_count_asof_cutoff")
    med = F.col("median_purchase_interval_days_asof_cutoff")
    std, iqr = F.col("std_purchase_interval_days_asof_cutoff"), F.col("purchase_interval_iqr_asof_cutoff")
    wild = (
        truth((med > 0) & (std / med > 1.0))
        | truth((med > 0) & (iqr / med > 1.0))
        | truth(F.col("cv2_quantity_asof_cutoff") > 1.0)
    )
    one = truth("one_shot_flag")
    thin = truth(n < 3) | truth(a < 2) | med.isNull()
    flag = case(
        [(one, "one_shot"), (thin, "history_insufficient"), (truth(n >= 3) & truth(a >= 2) & wild, "history_medium")],
        "history_sufficient",
    )
    reason = case(
        [
            (one, "one_shot_not_applicable_for_m3"),
            (med.isNull(), "median_purchase_interval_missing"),
            (truth(a < 2), "active_month_count_asof_cutoff_lt_2"),
            (truth(n < 3), "purchase_count_asof_cutoff_lt_3"),
            (wild, "interval_variance_or_cv2_high"),
        ],
        "entity_interval_available",
    )
    return flag, reason


def history_observation() -> tuple[Column, Column]:
    """Flag and reason for observation rows: short or partial statistics."""
    n, a = F.col("purchase_count_asof_cutoff"), F.col("active_month_count_asof_cutoff")
    m = F.col("months_observed_asof_cutoff")
    no_adi, no_cv2 = F.col("adi_asof_cutoff").isNull(), F.col("cv2_quantity_asof_cutoff").isNull()
    missing = n.isNull() | a.isNull()
    medium = truth(m < 12) | (no_adi != no_cv2)
    flag = case(
        [
            (missing, "unknown"),
            ((n < 3) | (a < 2) | (no_adi & no_cv2), "history_insufficient"),
            (medium, "history_medium"),
        ],
        "history_sufficient",
    )
    reason = case(
        [
            (missing, "required_history_fields_missing"),
            (no_adi & no_cv2, "adi_and_cv2_missing_cannot_reliably_classify"),
            (a < 2, "active_month_count_asof_cutoff_lt_2"),
            (n < 3, "purchase_count_asof_cutoff_lt_3"),
            (medium, "short_months_observed_or_partial_interval_statistics"),
        ],
        "purchase_count>=3_and_active_month_count>=2",
    )
    return flag, reason
