"""Audits of evidence bundles before review: claims that contradict a bundle, what it lacks, how full it is, a sample.

Every rule is data, one pass over the bundles answers all of them. A bundle's lists are bounded by the number of rules.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.operators.ranking import first_rows

#: Rules whose results are shown but prove nothing.
INTERFACE_ONLY = ["low_price_purchase_warning", "order_price_spread_warning", "rejection_response_warning", "delayed_response_warning", "low_delivery_rate_warning"]

#: How many rows of each stratum are reviewed, and in which order statuses come.
STRATA = {
    "final_candidate_status": {"priority_review": 20, "manual_review": 20, "low_confidence_watch": 10, "observation_only": 10, "one_shot_attention": 20},
    "candidate_type": {"demand_shape_observation": 10},
    "review_priority": {"P1": 10, "P2": 10},
    "evidence_strength": {"insufficient": 10},
}
STATUS_ORDER = ["priority_review", "manual_review", "low_confidence_watch", "observation_only", "one_shot_attention", "not_actionable"]

CLAIM_RULES = {
    "allowed_claims_empty": "coalesce(trim(allowed_claims), '') = ''",
    "forbidden_claims_empty": "coalesce(size(forbidden_claims), 0) < 1",
    "allowed_contains_forbidden_phrase": "coalesce(exists(forbidden_claims, c -> contains(lower(allowed_claims), lower(c))), false)",
    "one_shot_probability_present": "candidate_type = 'one_shot' and probability is not null",
    "interface_only_detector_in_evidence": "coalesce(exists(detectors, d -> d.detector_name in ({})), false)".format(", ".join(f"'{d}'" for d in INTERFACE_ONLY)),
    "auto_dispatch_allowed": "coalesce(auto_dispatch_allowed, false)",
}

#: What each type of candidate must have for a review; a condition of several fields stands under a name of its own.
REQUIRED = {
    "recurring_business_priority": {
        **{c: f"{c} is not null" for c in ("final_candidate_status", "review_priority", "probability", "survival_state")},
        "forbidden_claims": "size(forbidden_claims) > 0", "detectors_or_survival_state": "size(detectors) > 0 or survival_state is not null",
    },
    "one_shot": {"allowed_claims": "length(trim(allowed_claims)) > 0", "forbidden_claims": "size(forbidden_claims) > 0", "recurring_probability_hidden": "probability is null"},
    "demand_shape_observation": {"demand_shape_label": "demand_shape_label is not null", "forbidden_claims": "size(forbidden_claims) > 0", "observation_only_status": "final_candidate_status = 'observation_only'"},
}

FIELDS = {
    "probability": "probability is not null", "survival_state": "survival_state is not null", "demand_shape_label": "demand_shape_label is not null",
    "detectors": "size(detectors) > 0", "allowed_claims": "length(trim(allowed_claims)) > 0", "forbidden_claims": "size(forbidden_claims) > 0",
}
STRATUM = ["candidate_type", "final_candidate_status", "review_priority", "evidence_strength"]


def _named(conditions: Mapping[str, str], when: bool) -> Column:
    """Names of the conditions that are (not) met, in their order; an unknown one counts as not met."""
    each = [F.when(F.coalesce(F.expr(c), F.lit(False)) == F.lit(when), F.lit(n)) for n, c in conditions.items()]
    return F.array_compact(F.array(*each))


def claim_consistency(bundles: DataFrame, rules: Mapping[str, str] | None = None) -> DataFrame:
    """One row per violation, or one row that passes for a bundle without any."""
    found = bundles.withColumn("_v", _named(rules or CLAIM_RULES, True))
    rows = found.select("candidate_id", "cutoff_month", "candidate_type", F.explode_outer("_v").alias("violation_type"))
    return rows.select("candidate_id", "cutoff_month", "candidate_type", F.col("violation_type").isNull().alias("claim_check_pass"), F.coalesce("violation_type", F.lit("")).alias("violation_type"))


def actionability(bundles: DataFrame, required: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """What each bundle lacks for a review of its type; a type without requirements lacks its type."""
    missing = F.array(F.lit("unknown_candidate_type"))
    for kind, conditions in (required or REQUIRED).items():
        missing = F.when(F.col("candidate_type") == kind, _named(conditions, False)).otherwise(missing)
    d = bundles.withColumn("_m", missing)
    return d.select(
        "candidate_id", "cutoff_month", "candidate_type", (F.size("_m") == 0).alias("actionable_flag"), F.array_join("_m", ";").alias("missing_critical_fields"),
        F.when(F.size("_m") == 0, "minimum_structured_material_available").otherwise("missing_critical_fields").alias("actionability_note"))


def field_completeness(bundles: DataFrame, by: Sequence[str] = STRATUM, fields: Mapping[str, str] | None = None) -> DataFrame:
    """Rows and the share of filled fields per group; null group values are a group."""
    share = [F.avg(F.when(F.coalesce(F.expr(c), F.lit(False)), 1.0).otherwise(0.0)).alias(f"{n}_rate") for n, c in (fields or FIELDS).items()]
    off = F.avg(F.when(F.coalesce("auto_dispatch_allowed", F.lit(False)), 0.0).otherwise(1.0)).alias("auto_dispatch_false_rate")
    return bundles.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), *share, off)


def stratified_sample(status: DataFrame, score: str, key: Sequence[str], strata: Mapping[str, Mapping[str, int]] | None = None) -> DataFrame:
    """The first rows of each stratum in review order, each row once; ties fall to the key.

    A stratum's rows are trimmed to its limit on the map side, so a stratum of any size is safe.
    """
    rank = F.lit(len(STATUS_ORDER))
    for i, s in enumerate(STATUS_ORDER):
        rank = F.when(F.col("final_candidate_status") == s, i).otherwise(rank)
    order = [F.asc_nulls_last("review_priority"), rank.asc(), F.desc_nulls_last(score), *[F.asc(k) for k in key]]
    parts = []
    for column, limits in (strata or STRATA).items():
        for n in sorted(set(limits.values())):
            values = [v for v, limit in limits.items() if limit == n]
            parts.append(first_rows(status.where(F.col(column).isin(values)), [column], order, n))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates([*key])
