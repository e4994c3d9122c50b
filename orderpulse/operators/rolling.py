"""Evaluation of models that are trained for it: rolling folds, nested samples, feature sets, held-out groups, calibration.

Every variant is a value of a grouping column of one frame with a `split` column, so that all variants are fitted and
scored together (`operators/fitting.py`) and no variant scans the input on its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.operators.fitting import grouped_logistic, grouped_scores, isotonic, isotonic_scores
from orderpulse.session import cut_lineage

FEATURES = ["recency", "decay", "overdue", "n_months"]
#: Parts of the hashed key range, for samples.
HASH_PARTS = 1000


def with_folds(rows: DataFrame, folds: Sequence[Mapping[str, str | None]], cutoff: str = "cutoff_month") -> DataFrame:
    """Rows repeated for each fold that uses them, with `split` train, valid or test; bounds are inclusive dates.

    A fold has the keys fold, train_end, valid_start, valid_end (both may be None), test_start and test_end. Folds whose
    parts overlap are refused: a cutoff would be learnt from and measured on.
    """
    for f in folds:
        bounds = [f["train_end"], f["valid_start"], f["valid_end"], f["test_start"], f["test_end"]]
        known = [b for b in bounds if b is not None]
        if (f["valid_start"] is None) != (f["valid_end"] is None) or known != sorted(known) or f["train_end"] in (f["valid_start"], f["test_start"]) or (f["valid_end"] is not None and f["valid_end"] == f["test_start"]):
            raise ValueError(f"parts of fold {f['fold']} overlap or are out of order")
    day = lambda x: f"date'{x}'" if x else "cast(null as date)"
    structs = ", ".join(f"named_struct('fold', '{f['fold']}', " + ", ".join(f"'_{k}', {day(f[k])}" for k in ("train_end", "valid_start", "valid_end", "test_start", "test_end")) + ")" for f in folds)
    split = F.expr(f"""case when {cutoff} <= _train_end then 'train' when {cutoff} between _valid_start and _valid_end then 'valid'
        when {cutoff} between _test_start and _test_end then 'test' end""")
    dealt = rows.selectExpr("*", f"inline(array({structs}))").withColumn("split", split).where("split is not null")
    return dealt.drop("_train_end", "_valid_start", "_valid_end", "_test_start", "_test_end")


def nested_samples(rows: DataFrame, key: str, percents: Sequence[int], train: str = "split = 'train'") -> DataFrame:
    """Training rows repeated for each sample that holds their key, all others for every sample (`sample_percent`).

    The key's hash decides, so that a sample is part of every larger one at any size and on any cluster.
    """
    part = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("long") % HASH_PARTS
    every = F.array(*[F.lit(int(x)) for x in sorted(percents)])
    held = F.filter(every, lambda x: ~F.coalesce(F.expr(train), F.lit(False)) | (F.col("_part") * 100 < x * HASH_PARTS))
    return rows.withColumn("_part", part).withColumn("sample_percent", F.explode(held)).drop("_part")


def feature_sets(rows: DataFrame, features: Sequence[str], sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows repeated for each set with the other features emptied: an empty feature gets no weight from the ridge."""
    names = F.array(*[F.struct(F.lit(n).alias("feature_set"), F.array(*[F.lit(c) for c in cols]).alias("_in")) for n, cols in sets.items()])
    wide = rows.select("*", F.inline(names))
    return wide.withColumns({c: F.when(F.array_contains("_in", c), F.col(c)) for c in features}).drop("_in")


def held_out_groups(rows: DataFrame, group: str, count: int, train: str, test: str) -> DataFrame:
    """`held_out`: one of the `count` groups with most training and test rows (ties by name); its test rows are tested,
    the training rows of all other groups are learnt from."""
    used = rows.where(f"({train}) or ({test})")
    top = used.groupBy(group).count().orderBy(F.desc("count"), group).limit(count).agg(F.sort_array(F.collect_list(group)))
    marked = rows.withColumn("_groups", top.scalar()).withColumn("held_out", F.explode("_groups"))
    split = F.when((F.col(group) == F.col("held_out")) & F.expr(test), "test").when((F.col(group) != F.col("held_out")) & F.expr(train), "train")
    return marked.drop("_groups").withColumn("split", split).where("split is not null")


def trained_scores(rows: DataFrame, by: Sequence[str], features: Sequence[str] = FEATURES, digits: int = 9) -> DataFrame:
    """Rows of the valid and test parts with `raw`, the probability by the model of their group's training rows."""
    settled = cut_lineage(rows)
    model = grouped_logistic(settled.where("split = 'train'"), by, features)
    scored = grouped_scores(settled.where("split <> 'train'"), model, by, features, "raw")
    return scored.withColumn("raw", F.round("raw", digits))


def calibrated(scored: DataFrame, by: Sequence[str], methods: Sequence[str] = ("platt", "isotonic"), score: str = "raw") -> DataFrame:
    """Test rows with a probability for each method, fitted on the valid rows; null where a group has no valid rows."""
    scored = cut_lineage(scored.withColumn("_logit", F.expr(f"ln(greatest({score}, 1e-6D) / greatest(1D - {score}, 1e-6D))")))
    valid, out = scored.where("split = 'valid'"), scored.where("split = 'test'")
    keys = [*by]
    if "platt" in methods:
        fitted = grouped_scores(out, grouped_logistic(valid, keys, ["_logit"]), keys, ["_logit"], "platt")
        missing = out.join(valid.select(*keys).distinct(), keys, "left_anti").withColumn("platt", F.lit(None).cast("double"))
        out = fitted.unionByName(missing)
    if "isotonic" in methods:
        out = isotonic_scores(out, isotonic(valid, keys, score), keys, score)
    return out.drop("_logit")


def by_method(rows: DataFrame, methods: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long form (keep, method, p); methods without a probability give no row."""
    structs = ", ".join(f"named_struct('method', '{m}', 'p', {m})" for m in methods)
    return rows.selectExpr(*keep, f"inline(array({structs}))").where("p is not null")


def fold_shift(rows: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Moments of every feature in the train and test part of each group, and their standardised mean difference.

    One pass: counts, sums and sums of squares are merged across tasks; a row per group and feature.
    """
    aggs = []
    for i, f in enumerate(features):
        for s, part in enumerate(("train", "test")):
            x = f"if(split = '{part}', cast({f} as double), null)"
            aggs += [F.expr(f"avg({x}) as m{i}_{s}"), F.expr(f"stddev_pop({x}) as s{i}_{s}"), F.expr(f"count({x}) as n{i}_{s}"), F.expr(f"count_if(split = '{part}') as r{i}_{s}")]
    wide = rows.groupBy(*by).agg(*aggs)
    structs = ", ".join(
        f"""named_struct('feature', '{f}', 'train_rows', r{i}_0, 'test_rows', r{i}_1, 'train_missing', r{i}_0 - n{i}_0, 'test_missing', r{i}_1 - n{i}_1,
            'train_mean', m{i}_0, 'test_mean', m{i}_1, 'smd', (m{i}_1 - m{i}_0) / nullif(sqrt((s{i}_0 * s{i}_0 + s{i}_1 * s{i}_1) / 2), 0D))"""
        for i, f in enumerate(features))
    level = "case when smd is null then 'unknown' when abs(smd) >= 0.5 then 'high' when abs(smd) >= 0.2 then 'medium' else 'low' end"
    return wide.selectExpr(*by, f"inline(array({structs}))").withColumn("drift_level", F.expr(level))


def model_against_rule(metrics: DataFrame, by: Sequence[str], model: str = "raw", rule: str = "rule") -> DataFrame:
    """Metrics of both side by side, and which of them is better by each: higher AUC, lower Brier score and ECE."""
    columns = ["roc_auc", "brier_score", "ece"]
    side = lambda m: metrics.where(F.col("method") == m).selectExpr(*by, *[f"{c} as {'model' if m == model else 'rule'}_{c}" for c in columns])
    both = side(model).join(side(rule), [*by])
    better = {"auc_winner": "model_roc_auc > rule_roc_auc", "brier_winner": "model_brier_score < rule_brier_score", "ece_winner": "model_ece < rule_ece"}
    return both.withColumns({k: F.expr(f"case when {test} then 'model' when {test.replace('>', '=').replace('<', '=')} then 'tie' else 'rule' end") for k, test in better.items()})
