"""Grouped calibration, ranking, value and drift metrics, all in one pass per family."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.functions.exprs import null_safe_join
from orderpulse.operators.ranking import cumulate, exact_rank, exact_ranks
from orderpulse.schemas import ENTITY
from orderpulse.session import cut_lineage

K_VALUES: list[int | str] = [10, 20, 50, 100, "top_1_pct", "top_5_pct", "top_10_pct"]


def probability_metrics(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p", eps: float = 1e-15) -> DataFrame:
    q = f"least(greatest({p}, {eps!r}D), 1D - {eps!r}D)"
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(y).alias("positive_count"), F.avg(y).alias("positive_rate"),
        F.expr(f"avg(({p} - {y}) * ({p} - {y})) as brier_score"),
        F.expr(f"avg(-({y} * ln({q}) + (1 - {y}) * ln(1 - {q}))) as log_loss"),
    )


def roc_auc(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p", name: str = "roc_auc") -> DataFrame:
    """Mann-Whitney AUC with average ranks, from positive and negative counts per distinct score."""
    t = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(
        F.expr(f"sum({y}) as pos"), F.expr(f"sum(1 - {y}) as neg")
    )
    c = cumulate(t, by, p, ["pos", "neg"])
    return c.groupBy(*by).agg(
        F.expr(
            f"sum(pos * (neg_before + neg / 2)) / nullif(cast(max(pos_total) as double) * max(neg_total), 0D) as {name}"
        )
    )


def pr_metrics(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p", ties: Sequence[str] = ENTITY) -> DataFrame:
    """Trapezoid PR-AUC from (0, 1) and average precision, rows in order of falling score, then key."""
    r = exact_rank(df.select(*by, p, *ties, F.col(y).cast("double").alias("_y")), p, by, ties, name="_r", running=["_y"])
    prec, before = "_y_upto / _r", "if(_r > 1, (_y_upto - 1) / (_r - 1), 1D)"
    return r.where("_y = 1").groupBy(*by).agg(
        F.expr(f"sum(({prec} + {before}) / 2) / max(_y_total) as pr_auc"),
        F.expr(f"sum({prec}) / max(_y_total) as average_precision"),
    )


def bin_right_closed(p: str, n: int = 10) -> str:
    return f"greatest(cast(ceil({p} * {n}) as int) - 1, 0)"


def bin_left_closed(p: str, n: int = 10) -> str:
    return f"least(cast(floor({p} * {n}) as int), {n - 1})"


def calibration_curve(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p", n: int = 10, left: bool = False) -> DataFrame:
    b = bin_left_closed(p, n) if left else bin_right_closed(p, n)
    return df.withColumn("bin", F.expr(b)).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("count"), F.avg(p).alias("predicted_probability_mean"), F.avg(y).alias("actual_rate")
    )


def expected_calibration_error(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    return curve.groupBy(*by).agg(
        F.expr("sum(abs(predicted_probability_mean - actual_rate) * count) / sum(count) as ece")
    )


def _k(spec: int | str, n: str) -> str:
    """Rows that a top-k spec keeps in a group of size n."""
    if isinstance(spec, str):
        pct = float(spec.removeprefix("top_").removesuffix("_pct")) / 100
        return f"greatest(1, cast(ceil({n} * {pct!r}D) as int))"
    return f"greatest(1, least({int(spec)}, {n}))"


def topk_metrics(
    df: DataFrame, by: Sequence[str], y: str = "y", score: str = "p", ks: Sequence[int | str] = K_VALUES, ties: Sequence[str] = ENTITY,
) -> DataFrame:
    """Precision, recall, lift and NDCG at k for every group."""
    r = exact_rank(df.select(*by, score, *ties, F.col(y).cast("double").alias("_y")), score, by, ties, name="_r", total="_n", running=["_y"])
    aggs = [F.max("_n").alias("n"), F.max("_y_total").alias("pos")]
    for i, k in enumerate(ks):
        kk = _k(k, "_n")
        aggs += [
            F.expr(f"sum(if(_r <= {kk}, _y, 0D)) as hit{i}"),
            F.expr(f"sum(if(_r <= {kk}, _y / log2(_r + 1), 0D)) as dcg{i}"),
            # The ideal order has all positives first, so ranks 1..min(k, positives) each gain one.
            F.expr(f"sum(if(_r <= least({kk}, _y_total), 1 / log2(_r + 1), 0D)) as idcg{i}"),
        ]
    wide = r.groupBy(*by).agg(*aggs)
    rows = ", ".join(
        f"""named_struct('k', '{k}', 'precision_at_k', hit{i} / ({_k(k, 'n')}), 'recall_at_k', hit{i} / nullif(pos, 0D),
            'ndcg_at_k', dcg{i} / nullif(idcg{i}, 0D), 'lift_at_k', (hit{i} / ({_k(k, 'n')})) / nullif(pos / n, 0D), 'row_count', n)"""
        for i, k in enumerate(ks)
    )
    return wide.selectExpr(*by, f"inline(array({rows}))")


def value_metrics(
    df: DataFrame, by: Sequence[str], y: str, p: str, score: str, value: str, ks: Sequence[int | str] = K_VALUES, ties: Sequence[str] = ENTITY,
) -> DataFrame:
    """Value captured, expected loss captured, value NDCG and totals among the top k by business priority."""
    base = df.select(*by, score, *ties, F.col(y).cast("double").alias("_y"), F.col(p).alias("_p"), F.col(value).alias("_v")).withColumn(
        "_gain", F.expr("_y * _v")
    )
    # Both ranks and the sums read one materialised frame instead of deriving it six times.
    r = exact_ranks(cut_lineage(base), [(score, by, "_r"), ("_gain", by, "_ideal")], ties, total="_n")
    aggs = [F.max("_n").alias("n"), F.sum("_gain").alias("gain"), F.expr("sum(_p * _v) as loss")]
    for i, k in enumerate(ks):
        top, ideal = f"_r <= {_k(k, '_n')}", f"_ideal <= {_k(k, '_n')}"
        aggs += [
            F.expr(f"sum(if({top}, _gain, 0D)) as g{i}"), F.expr(f"sum(if({top}, _p * _v, 0D)) as l{i}"),
            F.expr(f"sum(if({top}, _v, 0D)) as v{i}"), F.expr(f"sum(if({top}, _y, 0D)) as y{i}"),
            F.expr(f"avg(if({top}, {score}, null)) as s{i}"),
            F.expr(f"sum(if({top}, _gain / log2(_r + 1), 0D)) as dcg{i}"),
            F.expr(f"sum(if({ideal}, _gain / log2(_ideal + 1), 0D)) as idcg{i}"),
        ]
    wide = r.groupBy(*by).agg(*aggs)
    rows = ", ".join(
        f"""named_struct('k', '{k}', 'captured_value_at_k', g{i} / nullif(gain, 0D), 'expected_loss_captured_at_k', l{i} / nullif(loss, 0D),
            'value_weighted_ndcg_at_k', dcg{i} / nullif(idcg{i}, 0D), 'topk_total_value_at_risk', v{i},
            'topk_average_business_priority_score', s{i}, 'precision_at_k', y{i} / ({_k(k, 'n')}))"""
        for i, k in enumerate(ks)
    )
    return wide.selectExpr(*by, f"inline(array({rows}))")


def macro_by_cutoff(metrics: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(
        *[F.avg(c).alias(f"{c}_macro") for c in columns], F.countDistinct("cutoff_month").alias("cutoff_count")
    )


def full_metrics(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Counts, Brier, log loss, AUC and ECE side by side."""
    out = probability_metrics(df, by, y, p)
    ece = expected_calibration_error(calibration_curve(df, by, y, p), by)
    out = null_safe_join(out, roc_auc(df, by, y, p), by)
    return null_safe_join(out, ece, by)


def coverage_rollup(df: DataFrame) -> DataFrame:
    """Candidate coverage per horizon and cutoff, per horizon, and overall."""
    agg = df.rollup("horizon", "cutoff_month").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("is_candidate").alias("candidate_count"), F.sum("y").alias("positive_count"),
        F.expr("sum(y * is_candidate) as captured_positive_count"), F.grouping_id().alias("_g"),
    )
    return agg.selectExpr(
        "case _g when 0 then 'horizon_cutoff' when 1 then 'horizon' else 'overall' end as level",
        "coalesce(horizon, 'ALL') as horizon", "cutoff_month", "row_count", "candidate_count", "positive_count", "captured_positive_count",
        "candidate_count / row_count as candidate_rate", "captured_positive_count / nullif(positive_count, 0) as positive_recall",
        "captured_positive_count / nullif(candidate_count, 0) as candidate_precision",
    )


def unpivot_dimensions(df: DataFrame, dimensions: Mapping[str, Column | str], keep: Sequence[str]) -> DataFrame:
    """Long form: one row per row and segment dimension."""
    rows = [
        F.struct(
            F.lit(name).alias("segment_dimension"),
            F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("__MISSING__")).alias("segment_value"),
        )
        for name, c in dimensions.items()
    ]
    return df.select(*keep, F.inline(F.array(*rows)))


def segment_matrix(df: DataFrame, dimensions: Mapping[str, Column | str], y: str = "y", p: str = "p") -> DataFrame:
    """Metrics of every value of every dimension per horizon in a single grouped job, with failure classes and gate."""
    long = unpivot_dimensions(df, dimensions, ["horizon", y, p])
    by = ["segment_dimension", "segment_value", "horizon"]
    m = full_metrics(long, by, y, p)
    mean = long.groupBy(*by).agg(F.avg(p).alias("mean_probability"))
    m = null_safe_join(m, mean, by)
    return m.selectExpr(
        "*", "mean_probability - positive_rate as calibration_bias",
        "row_count < 200 or positive_count < 20 as small_sample", "coalesce(roc_auc < 0.6, false) as weak_ranking",
        "coalesce(ece > 0.1, false) as poor_calibration",
    ).withColumn(
        "service_gate",
        F.expr(
            """case when small_sample then 'observe_only' when weak_ranking and poor_calibration then 'blocked'
               when weak_ranking or poor_calibration then 'review' else 'serve' end"""
        ),
    )


def distribution_shift(df: DataFrame, side: Column, features: Sequence[str]) -> DataFrame:
    """Standardised mean difference between a reference and a comparison side for many features in one aggregate."""
    d = df.withColumn("_side", side)
    aggs = []
    for i, f in enumerate(features):
        for s in (0, 1):
            v = f"if(_side = {s}, cast({f} as double), null)"
            aggs += [
                F.expr(f"avg({v}) as m{i}_{s}"), F.expr(f"stddev_pop({v}) as s{i}_{s}"),
                F.expr(f"avg(if(_side = {s}, if({f} is null, 1D, 0D), null)) as n{i}_{s}"),
            ]
    wide = d.agg(*aggs)
    rows = ", ".join(
        f"""named_struct('feature', '{f}', 'train_mean', m{i}_0, 'test_mean', m{i}_1, 'train_std', s{i}_0, 'test_std', s{i}_1,
            'train_missing_rate', n{i}_0, 'test_missing_rate', n{i}_1,
            'smd', (m{i}_1 - m{i}_0) / nullif(sqrt((s{i}_0 * s{i}_0 + s{i}_1 * s{i}_1) / 2), 0D))"""
        for i, f in enumerate(features)
    )
    return wide.selectExpr(f"inline(array({rows}))").withColumn(
        "drift_level", F.expr("case when smd is null then 'unknown' when abs(smd) >= 0.5 then 'high' when abs(smd) >= 0.2 then 'medium' else 'low' end")
    )


def share_table(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares per value; the total is a sum over the small counted table."""
    from pyspark.sql import Window

    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("__MISSING__")).alias(column)).agg(
        F.count(F.lit(1)).alias("row_count")
    )
    return counts.withColumn("row_share", F.col("row_count") / F.sum("row_count").over(Window.partitionBy(F.lit(0))))


def score_parity(runtime: DataFrame, reference: DataFrame, key: Sequence[str], score: str) -> DataFrame:
    """Key match and score difference of two batches."""
    a = runtime.select(*key, F.col(score).alias("_a"))
    b = reference.select(*key, F.col(score).alias("_b"))
    joined = a.join(b, list(key), "full")
    return joined.agg(
        F.expr("count_if(_a is not null and _b is not null) as matched_rows"), F.expr("count_if(_b is null) as runtime_only"),
        F.expr("count_if(_a is null) as reference_only"), F.expr("max(abs(_a - _b)) as max_abs_diff"),
        F.expr("avg(abs(_a - _b)) as mean_abs_diff"), F.expr("corr(_a, _b) as correlation"),
    )


def publish_scores(scores: DataFrame, path: str, batch_id: str) -> None:
    """Stores a batch of scores in a folder of its own; a batch that exists is refused by the writer."""
    scores.write.mode("errorifexists").parquet(f"{path}/batch_id={batch_id}")


def read_scores(spark, path: str, batch_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("batch_id") == batch_id).drop("batch_id")


def batch_parity(runtime: DataFrame, reference: DataFrame, key: Sequence[str], score: str, by: Sequence[str]) -> DataFrame:
    """Keys of both batches, of one only, and the score differences of the common ones, per group of key columns."""
    a = runtime.select(*key, F.lit(True).alias("_in_a"), F.col(score).alias("_a"))
    b = reference.select(*key, F.lit(True).alias("_in_b"), F.col(score).alias("_b"))
    joined = a.join(b, list(key), "full")
    # corr() divides by zero where all scores of a side are equal; the correlation is null there, as for a single pair.
    x, y = "if(_b is null, null, _a)", "if(_a is null, null, _b)"
    correlation = f"try_divide(covar_pop({x}, {y}), sqrt(var_pop({x})) * sqrt(var_pop({y})))"
    return joined.groupBy(*by).agg(
        F.expr("count_if(_in_a and _in_b) as matched_rows"), F.expr("count_if(_in_b is null) as runtime_only"), F.expr("count_if(_in_a is null) as reference_only"),
        F.expr("count_if(_in_a and _in_b and not (_a <=> _b)) as differing_rows"), F.expr("max(abs(_a - _b)) as max_abs_diff"), F.expr("avg(abs(_a - _b)) as mean_abs_diff"), F.expr(f"{correlation} as correlation"))


def bin_risks(bins: DataFrame, by: Sequence[str], min_count: int = 30, step: float = 0.05) -> DataFrame:
    """Small extreme bins and sawtooth: the observed rate changes direction by more than `step` between bins."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("bin")
    d = bins.withColumn("_step", F.expr("actual_rate") - F.lag("actual_rate").over(w))
    d = d.withColumn("_prev", F.lag("_step").over(w))
    return d.groupBy(*by).agg(
        F.expr(f"bool_or(bin in (0, 9) and count < {min_count}) as small_extreme_bin"),
        F.expr(f"coalesce(bool_or(_step * _prev < 0 and abs(_step) > {step} and abs(_prev) > {step}), false) as sawtooth"),
        F.count(F.lit(1)).alias("bin_count"),
    )
