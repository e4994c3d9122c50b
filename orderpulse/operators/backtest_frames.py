"""Row-level backtest frames of recurring and one-shot candidates, and the metrics of many policies over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.functions.exprs import null_safe_join
from orderpulse.operators import metrics
from orderpulse.operators.ranking import exact_ranks
from orderpulse.schemas import ENTITY, HORIZONS
from orderpulse.session import cut_lineage

#: Sizes of the selections that are measured.
K_SPECS: list[int | str] = [10, 20, 50, 100, "top_5_pct", "top_10_pct"]
ONE_SHOT_K_SPECS: list[int | str] = [10, 20, 50, "top_5_pct", "top_10_pct"]
#: Hits that a summary names.
NAMED_HITS = 5


def hit_summary(outputs: DataFrame, key: Sequence[str], reason: str = "reason_code") -> DataFrame:
    """`detector_hit_summary` of each key: its first five hits as name:reason in their order (a hit per rule at most)."""
    part = F.concat("detector_name", F.lit(":"), F.coalesce(F.col(reason), F.lit("")))
    named = F.array_join(F.slice(F.array_sort(F.collect_list(part)), 1, NAMED_HITS), ";")
    return outputs.where("hit_flag").groupBy(*key).agg(named.alias("detector_hit_summary"))


def recurring_frame(scored: DataFrame, labels: DataFrame, status: DataFrame, outputs: DataFrame, reason: str = "reason_code") -> DataFrame:
    """Scored recurring candidates with label, window, ranks, status and hit summary, one row per entity, cutoff and horizon.

    `scored` has the entity, candidate_id, cutoff_month, horizon, p, v and prio; `labels` the long labels. A label whose
    window isn't closed is emptied, so that no metric can read it. Ranks are by falling score, ties by entity.
    """
    key = [*ENTITY, "cutoff_month", "horizon"]
    closed = F.coalesce(F.col("label_window_closed"), F.lit(False))
    base = null_safe_join(scored, labels.select(*key, "label_alive", "label_die", "label_window_closed"), key)
    months = F.substring("horizon", 2, 3).cast("int")
    base = base.withColumns({
        "label_alive": F.when(closed, F.col("label_alive")), "label_die": F.when(closed, F.col("label_die")), "label_window_closed": closed,
        "label_window_start": F.col("cutoff_month"), "label_window_end": F.last_day(F.add_months("cutoff_month", months)),
    })
    same, own = ["cutoff_month", "horizon"], ["cutoff_month", "horizon", "manufacturer_code"]
    ranked = exact_ranks(cut_lineage(base), [
        ("p", same, "rank_probability_global"), ("prio", same, "rank_business_priority_global"),
        ("p", own, "rank_probability_within_manufacturer"), ("prio", own, "rank_business_priority_within_manufacturer"),
    ], ENTITY)
    of = ["candidate_id", "cutoff_month"]
    decided = ranked.join(status.select(*of, "final_candidate_status", "review_priority", "evidence_strength"), of, "left")
    return decided.join(hit_summary(outputs, of, reason), of, "left")


def one_shot_frame(samples: DataFrame, train_end: str, groups: Sequence[str], strength: float = 20.0, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """First purchases after `train_end` with label, repeat probability, risk, attention and ranks per horizon.

    The probability is the repeat rate of the group, smoothed by `strength` rows of the overall rate, over first
    purchases whose label window had ended by `train_end`: nothing later is learnt from. Attention is the risk of no
    repeat times the logarithm of the amount.
    """
    structs = ", ".join(
        f"named_struct('horizon', 'H{h}', 'label_window_end', label_window_end_H{h}, 'label_window_closed', label_window_closed_H{h}, 'label_repeat', label_repeat_H{h})" for h in horizons)
    long = cut_lineage(samples.selectExpr(*ENTITY, *[c for c in groups if c not in ENTITY], "first_purchase_month", "first_purchase_amount", f"inline(array({structs}))"))
    past = long.where((F.col("label_window_end") <= F.to_date(F.lit(train_end))) & F.col("label_repeat").isNotNull())
    overall = past.groupBy("horizon").agg(F.avg("label_repeat").alias("_overall"))
    rates = past.groupBy("horizon", *groups).agg(F.count(F.lit(1)).alias("_n"), F.sum("label_repeat").alias("_pos"))
    asked = long.where(F.col("first_purchase_month") > F.to_date(F.lit(train_end))).join(overall, "horizon")
    joined = null_safe_join(asked, rates, ["horizon", *groups])
    p = (F.coalesce("_pos", F.lit(0)) + F.col("_overall") * strength) / (F.coalesce("_n", F.lit(0)) + strength)
    out = joined.withColumn("repeat_probability", F.round(p, 9)).drop("_n", "_pos", "_overall")
    out = out.withColumn("non_repeat_risk", F.round(1 - F.col("repeat_probability"), 9)).withColumns({
        "label_non_repeat": 1 - F.col("label_repeat"),
        "selected_attention": F.round(F.col("non_repeat_risk") * F.ln(1 + F.greatest(F.col("first_purchase_amount"), F.lit(0.0))), 9),
    })
    ranks = [("repeat_probability", ["horizon"], "rank_repeat_probability"), ("non_repeat_risk", ["horizon"], "rank_non_repeat_risk"), ("selected_attention", ["horizon"], "rank_selected_attention")]
    return exact_ranks(cut_lineage(out), ranks, ENTITY)


def probability_table(frame: DataFrame, y: str, p: str, ties: Sequence[str] = ENTITY) -> DataFrame:
    """Brier, log loss, ECE, AUC and average precision per horizon over rows with a label."""
    closed = frame.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(*ties, "horizon", F.col(y).alias("y"), F.col(p).alias("p"))
    full = metrics.full_metrics(closed, ["horizon"])
    return full.join(metrics.pr_metrics(closed, ["horizon"], ties=ties).select("horizon", "average_precision"), "horizon", "left")


def bin_table(frame: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    closed = frame.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    return closed.withColumn("bin_id", F.expr(metrics.bin_right_closed(p, bins)) + 1).groupBy("horizon", "bin_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.avg(p).alias("average"), F.avg(y).alias("observed"), F.min(p).alias("min_pred"), F.max(p).alias("max_pred"))


def _size(spec: int | str, n: str) -> str:
    if isinstance(spec, str):
        return f"greatest(1, least({n}, cast(ceil({n} * {float(spec.split('_')[1]) / 100!r}D) as bigint)))"
    return f"least({spec}, {n})"


def policy_topk(frame: DataFrame, policies: Mapping[str, tuple[str, str]], means: Sequence[str], sums: Sequence[str], ks: Sequence[int | str] = K_SPECS, ties: Sequence[str] = ENTITY) -> DataFrame:
    """Every policy (score, label) at every k per horizon: selected rows, hits, precision, lift, NDCG, means and sums.

    Each row appears once per policy with its rank; all sizes are conditional sums of one aggregate. NDCG compares with
    the best order of what was selected.
    """
    need = sorted({label for _, label in policies.values()})
    closed = frame.where(" and ".join(f"{c} is not null" for c in need))
    ranked = exact_ranks(cut_lineage(closed), [(score, ["horizon"], f"_r_{name}") for name, (score, _) in policies.items()], ties, total="_total")
    structs = ", ".join(f"named_struct('policy', '{n}', '_rank', _r_{n}, '_y', cast({label} as double))" for n, (_, label) in policies.items())
    carried = list(dict.fromkeys([*means, *sums]))
    long = cut_lineage(ranked.selectExpr("horizon", "_total", *carried, f"inline(array({structs}))"))
    by = ["horizon", "policy"]
    aggs = [F.max("_total").alias("row_count"), F.avg("_y").alias("base_rate")]
    for i, k in enumerate(ks):
        top = f"_rank <= {_size(k, '_total')}"
        aggs += [F.expr(f"sum(if({top}, _y, 0D)) as hits{i}"), F.expr(f"count_if({top}) as count{i}"), F.expr(f"sum(if({top}, _y / log2(_rank + 1), 0D)) as dcg{i}")]
        aggs += [F.expr(f"avg(if({top}, {c}, null)) as avg{i}_{c}") for c in means] + [F.expr(f"sum(if({top}, {c}, 0D)) as sum{i}_{c}") for c in sums]
    wide = cut_lineage(long.groupBy(*by).agg(*aggs))
    hits = wide.select(*by, *[f"hits{i}" for i in range(len(ks))])
    ideal = long.join(hits, by).groupBy(*by).agg(*[F.expr(f"sum(if(_rank <= hits{i}, 1 / log2(_rank + 1), 0D)) as idcg{i}") for i in range(len(ks))])
    rows = ", ".join(
        f"named_struct('k', '{k}', 'topk_count', count{i}, 'hit_count', cast(hits{i} as bigint), 'precision_at_k', hits{i} / count{i}, 'lift_vs_base', (hits{i} / count{i}) / nullif(base_rate, 0D), "
        f"'ndcg_at_k', dcg{i} / nullif(idcg{i}, 0D)" + "".join(f", 'avg_{c}', avg{i}_{c}" for c in means) + "".join(f", 'sum_{c}', sum{i}_{c}" for c in sums) + ")" for i, k in enumerate(ks))
    return wide.join(ideal, by).selectExpr(*by, "row_count", "base_rate", f"inline(array({rows}))")


def policy_overlap(frame: DataFrame, scores: Mapping[str, str], label: str, ks: Sequence[int | str] = K_SPECS, ties: Sequence[str] = ENTITY) -> DataFrame:
    """Overlap and death rate of two selections per horizon and k, from the ranks of one pass."""
    (a, score_a), (b, score_b) = scores.items()
    closed = frame.where(F.col(label).isNotNull())
    ranked = exact_ranks(cut_lineage(closed), [(score_a, ["horizon"], "_a"), (score_b, ["horizon"], "_b")], ties, total="_total")
    aggs = []
    for i, k in enumerate(ks):
        in_a, in_b = f"_a <= {_size(k, '_total')}", f"_b <= {_size(k, '_total')}"
        aggs += [F.expr(f"count_if({in_a} and {in_b}) as both{i}"), F.expr(f"count_if({in_b}) as n{i}"), F.expr(f"avg(if({in_a}, {label}, null)) as ya{i}"), F.expr(f"avg(if({in_b}, {label}, null)) as yb{i}")]
    rows = ", ".join(f"named_struct('k', '{k}', 'overlap_count', both{i}, 'overlap_rate', both{i} / greatest(1, n{i}), '{a}_rate', ya{i}, '{b}_rate', yb{i})" for i, k in enumerate(ks))
    return ranked.groupBy("horizon").agg(*aggs).selectExpr("horizon", f"inline(array({rows}))")
