"""Queries that train models: rolling folds, learning curve, feature sets, held-out groups, calibration, trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from orderpulse.catalog import common
from orderpulse.catalog import evaluation as EV
from orderpulse.catalog.base import cte, query, rnd
from orderpulse.functions.exprs import nudge, round_all
from orderpulse.operators import metrics as E
from orderpulse.operators import rolling as R
from orderpulse.operators.rolling import FEATURES
from orderpulse.session import cut_lineage

ROLLING = [
    {"fold": "fold_1", "train_end": "1999-06-30", "valid_start": None, "valid_end": None, "test_start": "1999-12-31", "test_end": "1999-12-31"},
    {"fold": "fold_2", "train_end": "1999-06-30", "valid_start": "1999-12-31", "valid_end": "1999-12-31", "test_start": "2000-06-30", "test_end": "2000-06-30"},
    {"fold": "fold_3", "train_end": "1999-12-31", "valid_start": "2000-06-30", "valid_end": "2000-06-30", "test_start": "2000-12-31", "test_end": "2000-12-31"},
]
TRAIN, TEST = "cutoff_month <= date'1999-12-31'", "cutoff_month > date'1999-12-31'"
SETS = {"all": FEATURES, "without_recency": FEATURES[1:], "recency_only": FEATURES[:1], "rhythm": ["overdue", "n_months"]}
PERCENTS = [10, 30, 60, 100]


def solved(n: int) -> str:
    """Columns x0.. that solve the symmetric system a{i}_{j}_0 x = r{i}_0 by elimination, each from the ones before it."""
    cols = []
    for p in range(n):
        for i in range(p + 1, n):
            cols.append(f"a{i}_{p}_{p} / a{p}_{p}_{p} AS f{i}_{p}")
            cols += [f"a{i}_{j}_{p} - f{i}_{p} * a{j}_{p}_{p} AS a{i}_{j}_{p + 1}" for j in range(p + 1, i + 1)]
            cols.append(f"r{i}_{p} - f{i}_{p} * r{p}_{p} AS r{i}_{p + 1}")
    for i in reversed(range(n)):
        rest = "".join(f" - a{j}_{i}_{i} * x{j}" for j in range(i + 1, n))
        cols.append(f"(r{i}_{i}{rest}) / a{i}_{i}_{i} AS x{i}")
    return ", ".join(cols)


def logistic_sql(src: str, by: Sequence[str], features: Sequence[str], out: str, steps: int = 14) -> str:
    """Expressions up to `{out}` (by, train_rows, m0.., s0.., b0..): the ridge logistic fit of each group of `src` by Newton steps."""
    keys, n = ", ".join(by), len(features) + 1
    z = ["1.0", *[f"z{i}" for i in range(1, n)]]
    fill = ", ".join(f"coalesce(avg({f}::DOUBLE), 0) AS m{i}, CASE WHEN stddev_pop({f}::DOUBLE) > 0 THEN stddev_pop({f}::DOUBLE) ELSE 1 END AS s{i}" for i, f in enumerate(features))
    parts = [
        f"{out}_s AS MATERIALIZED (SELECT {keys}, count(*) AS train_rows, sum(y) AS train_positives, {fill} FROM {src} GROUP BY {keys})",
        f"{out}_z AS MATERIALIZED (SELECT {keys}, y::DOUBLE AS y, " + ", ".join(f"coalesce(({f} - m{i}) / s{i}, 0) AS z{i + 1}" for i, f in enumerate(features)) + f" FROM {src} JOIN {out}_s USING ({keys}))",
        f"{out}_n0 AS (SELECT {keys}, " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(n)) + f" FROM {out}_s WHERE train_positives > 0 AND train_positives < train_rows)",
    ]
    eta = " + ".join(f"b{i} * {z[i]}" for i in range(n))
    sums = ", ".join(
        [f"any_value(b{i}) AS b{i}, sum((y - p) * {z[i]}) - {1.0 if i else 0.0} * any_value(b{i}) AS r{i}_0" for i in range(n)]
        + [f"sum(p * (1 - p) * {z[i]} * {z[j]}) + {1.0 if i == j and i else 0.0} AS a{i}_{j}_0" for i in range(n) for j in range(i + 1)])
    longest = ", ".join(f"abs(x{i})" for i in range(n))
    for t in range(steps):
        parts.append(f"""{out}_n{t + 1} AS MATERIALIZED (SELECT {keys}, {", ".join(f"b{i} + f * x{i} AS b{i}" for i in range(n))} FROM (SELECT *, least(1.0, 8 / greatest({longest}, 1e-300)) AS f FROM (
  SELECT *, {solved(n)} FROM (SELECT {keys}, {sums} FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS p FROM {out}_z JOIN {out}_n{t} USING ({keys})) GROUP BY {keys}))))""")
    rest = ", ".join(f"coalesce(b{i}, 0) AS b{i}" for i in range(1, n))
    parts.append(f"{out} AS MATERIALIZED (SELECT {out}_s.*, coalesce(b0, ln((train_positives + 0.5) / (train_rows - train_positives + 0.5))) AS b0, {rest} FROM {out}_s LEFT JOIN {out}_n{steps} USING ({keys}))")
    return ",\n".join(parts)


def score_sql(features: Sequence[str]) -> str:
    return "1 / (1 + exp(-(b0 + " + " + ".join(f"b{i + 1} * coalesce(({f} - m{i}) / s{i}, 0)" for i, f in enumerate(features)) + ")))"


_MET = "row_count, positive_count, brier_score, log_loss, roc_auc, ece"


def _metrics(rows, by):
    """Metrics of probabilities that are rounded, so that rows tie or not alike in any engine."""
    return round_all(E.full_metrics(rows.withColumn("p", F.round(F.col("p") + nudge(6), 6)), by), 6).select(*by, *[c.strip() for c in _MET.split(",")])


def _metrics_sql(src: str, by: str) -> str:
    digits = lambda c: f"round({c} + {nudge(6)!r}, 6) AS {c}"
    full = f"""SELECT {by}, count(*) AS row_count, CAST(sum(y) AS BIGINT) AS positive_count, avg((p - y) * (p - y)) AS brier_score, avg(-(y * ln({EV._Q}) + (1 - y) * ln(1 - {EV._Q}))) AS log_loss FROM {src} GROUP BY {by}"""
    return f"""SELECT {by}, row_count, positive_count, {digits('brier_score')}, {digits('log_loss')}, {digits('roc_auc')}, {digits('ece')} FROM ({full})
  LEFT JOIN (SELECT {by}, auc AS roc_auc FROM ({EV.auc_sql(src, by)})) USING ({by}) LEFT JOIN ({EV.ece_sql(src, by)}) USING ({by})"""


_FD = ", ".join("('" + f["fold"] + "', " + ", ".join(f"DATE '{f[k]}'" if f[k] else "NULL::DATE" for k in ("train_end", "valid_start", "valid_end", "test_start", "test_end")) + ")" for f in ROLLING)
cte("rfold", f"SELECT * FROM (VALUES {_FD}) t(fold, train_end, valid_start, valid_end, test_start, test_end)")
cte("rdealt", """
SELECT mf.*, fold, CASE WHEN cutoff_month <= train_end THEN 'train' WHEN cutoff_month BETWEEN valid_start AND valid_end THEN 'valid' ELSE 'test' END AS split
FROM mf, rfold WHERE cutoff_month <= train_end OR cutoff_month BETWEEN valid_start AND valid_end OR cutoff_month BETWEEN test_start AND test_end
""")
_LOGIT = "ln(greatest(raw, 1e-6) / greatest(1 - raw, 1e-6)) AS lg"
_RFIT = f"""rtrain AS (SELECT * FROM rdealt WHERE split = 'train'),
{logistic_sql('rtrain', ['fold', 'horizon'], FEATURES, 'rm')},
rsc AS MATERIALIZED (SELECT *, {_LOGIT} FROM (SELECT d.*, round({score_sql(FEATURES)}, 9) AS raw FROM rdealt d JOIN rm USING (fold, horizon) WHERE split <> 'train')),
rvalid AS (SELECT * FROM rsc WHERE split = 'valid'),
{logistic_sql('rvalid', ['fold', 'horizon'], ['lg'], 'rp')},
rall AS MATERIALIZED (
  SELECT fold, horizon, 'rule' AS method, y, {rnd('p', 6)} AS p FROM rsc WHERE split = 'test'
  UNION ALL SELECT fold, horizon, 'raw', y, {rnd('raw', 6)} FROM rsc WHERE split = 'test'
  UNION ALL SELECT fold, horizon, 'platt', y, {rnd(score_sql(['lg']), 6)} FROM rsc JOIN rp USING (fold, horizon) WHERE split = 'test'
)"""


def rolling(spark, sf):
    dealt = R.with_folds(EV.frame(spark, sf), ROLLING)
    scored = R.trained_scores(dealt, ["fold", "horizon"])
    tested = R.calibrated(scored, ["fold", "horizon"], ["platt"]).withColumnRenamed("p", "rule")
    return cut_lineage(R.by_method(tested, ["rule", "raw", "platt"], ["fold", "horizon", "y"]))


@query("metric_rolling_origin", f"WITH {_RFIT}\n{_metrics_sql('rall', 'fold, horizon, method')}")
def _(spark, sf):
    return _metrics(rolling(spark, sf), ["fold", "horizon", "method"])


def _winner(test: str) -> str:
    return f"CASE WHEN {test} THEN 'model' WHEN {test.replace('>', '=').replace('<', '=')} THEN 'tie' ELSE 'rule' END"


@query("metric_model_against_rule", f"""WITH {_RFIT}, met AS ({_metrics_sql('rall', 'fold, horizon, method')})
SELECT fold, horizon, m.roc_auc AS model_roc_auc, m.brier_score AS model_brier_score, m.ece AS model_ece, r.roc_auc AS rule_roc_auc, r.brier_score AS rule_brier_score, r.ece AS rule_ece,
  {_winner('m.roc_auc > r.roc_auc')} AS auc_winner, {_winner('m.brier_score < r.brier_score')} AS brier_winner, {_winner('m.ece < r.ece')} AS ece_winner
FROM (SELECT * FROM met WHERE method = 'raw') m JOIN (SELECT * FROM met WHERE method = 'rule') r USING (fold, horizon)
""")
def _(spark, sf):
    return R.model_against_rule(_metrics(rolling(spark, sf), ["fold", "horizon", "method"]), ["fold", "horizon"])


_FS = [*FEATURES, "n_orders", "age", "med", "cv2", "adi"]


@query("metric_fold_shift", " UNION ALL ".join(f"""SELECT *, CASE WHEN smd IS NULL THEN 'unknown' WHEN abs(smd) >= 0.5 THEN 'high' WHEN abs(smd) >= 0.2 THEN 'medium' ELSE 'low' END AS drift_level FROM (
  SELECT fold, horizon, '{c}' AS feature, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'test') AS test_rows,
  count(*) FILTER (split = 'train' AND {c} IS NULL) AS train_missing, count(*) FILTER (split = 'test' AND {c} IS NULL) AS test_missing,
  {rnd(f"avg({c}) FILTER (split = 'train')", 6)} AS train_mean, {rnd(f"avg({c}) FILTER (split = 'test')", 6)} AS test_mean,
  {rnd(f"(avg({c}) FILTER (split = 'test') - avg({c}) FILTER (split = 'train')) / nullif(sqrt((power(stddev_pop({c}) FILTER (split = 'train'), 2) + power(stddev_pop({c}) FILTER (split = 'test'), 2)) / 2), 0)", 6)} AS smd
  FROM rdealt GROUP BY fold, horizon)""" for c in _FS))
def _(spark, sf):
    return round_all(R.fold_shift(R.with_folds(EV.frame(spark, sf), ROLLING), ["fold", "horizon"], _FS), 6)


def split_frame(spark, sf):
    return EV.frame(spark, sf).withColumn("split", F.expr(f"if({TRAIN}, 'train', 'test')"))


cte("sfr", "SELECT *, CASE WHEN cutoff_month <= DATE '1999-12-31' THEN 'train' ELSE 'test' END AS split FROM mf")


def _variant(name: str, column: str, frame_sql: str, frame) -> None:
    """Registers the metrics of one model per value of `column` and horizon, over a frame with a split column."""
    by = ["horizon", column]
    keys = ", ".join(by)

    @query(name, f"""WITH vf AS MATERIALIZED ({frame_sql}), vtrain AS (SELECT * FROM vf WHERE split = 'train'),
{logistic_sql('vtrain', by, FEATURES, 'vm')},
vall AS MATERIALIZED (SELECT {keys}, y, {rnd(f'round({score_sql(FEATURES)}, 9)', 6)} AS p FROM vf JOIN vm USING ({keys}) WHERE split = 'test'),
vmet AS ({_metrics_sql('vall', keys)})
SELECT vmet.*, vm.train_rows, CAST(vm.train_positives AS BIGINT) AS train_positives FROM vmet JOIN vm USING ({keys})""")
    def _(spark, sf):
        rows = cut_lineage(frame(spark, sf))
        scored = cut_lineage(R.trained_scores(rows, by).select(*by, "y", F.col("raw").alias("p")))
        sizes = rows.where("split = 'train'").groupBy(*by).agg(F.count(F.lit(1)).alias("train_rows"), F.sum("y").cast("long").alias("train_positives"))
        return _metrics(scored, by).join(sizes, by)


_HASH = f"(('0x' || substr(md5(entity_id), 1, 7))::BIGINT % {R.HASH_PARTS}) * 100 < sample_percent * {R.HASH_PARTS}"
_variant(
    "train_learning_curve", "sample_percent",
    f"SELECT * FROM sfr, (VALUES {', '.join(f'({x})' for x in PERCENTS)}) t(sample_percent) WHERE split = 'test' OR {_HASH}",
    lambda spark, sf: R.nested_samples(split_frame(spark, sf), "entity_id", PERCENTS),
)
_variant(
    "train_ablation", "feature_set",
    " UNION ALL ".join("SELECT horizon, split, y, '" + n + "' AS feature_set, " + ", ".join(c if c in cols else f"NULL::DOUBLE AS {c}" for c in FEATURES) + " FROM sfr" for n, cols in SETS.items()),
    lambda spark, sf: R.feature_sets(split_frame(spark, sf), FEATURES, SETS),
)
_variant(
    "train_manufacturer_holdout", "held_out",
    """SELECT s.* EXCLUDE (split), held_out, split FROM sfr s, (SELECT manufacturer_code AS held_out FROM sfr GROUP BY ALL ORDER BY count(*) DESC, manufacturer_code LIMIT 4) t
  WHERE (split = 'test' AND manufacturer_code = held_out) OR (split = 'train' AND manufacturer_code <> held_out)""",
    lambda spark, sf: R.held_out_groups(EV.frame(spark, sf), "manufacturer_code", 4, TRAIN, TEST),
)


@query("train_learning_window", f"""WITH w AS (SELECT * FROM (VALUES ('to_1999_06', DATE '1999-06-30', DATE '1999-12-31'), ('to_1999_12', DATE '1999-12-31', DATE '2000-06-30'), ('to_2000_06', DATE '2000-06-30', DATE '2000-12-31')) t(fold, a, b)),
vf AS MATERIALIZED (SELECT mf.*, fold, CASE WHEN cutoff_month <= a THEN 'train' ELSE 'test' END AS split FROM mf, w WHERE cutoff_month <= a OR cutoff_month = b),
vtrain AS (SELECT * FROM vf WHERE split = 'train'),
{logistic_sql('vtrain', ['horizon', 'fold'], FEATURES, 'vm')},
vall AS MATERIALIZED (SELECT horizon, fold, y, {rnd(f'round({score_sql(FEATURES)}, 9)', 6)} AS p FROM vf JOIN vm USING (horizon, fold) WHERE split = 'test')
{_metrics_sql('vall', 'horizon, fold')}""")
def _(spark, sf):
    windows = [("to_1999_06", "1999-06-30", "1999-12-31"), ("to_1999_12", "1999-12-31", "2000-06-30"), ("to_2000_06", "2000-06-30", "2000-12-31")]
    folds = [{"fold": n, "train_end": a, "valid_start": None, "valid_end": None, "test_start": b, "test_end": b} for n, a, b in windows]
    scored = R.trained_scores(R.with_folds(EV.frame(spark, sf), folds), ["horizon", "fold"])
    return _metrics(cut_lineage(scored.select("horizon", "fold", "y", F.col("raw").alias("p"))), ["horizon", "fold"])


#: Digits of the scores that isotonic regression sees in the query: the max-min formula in SQL compares all pairs of them.
_CELLS = 2
_CAL = [{"fold": "cal", "train_end": "1999-06-30", "valid_start": "1999-12-31", "valid_end": "1999-12-31", "test_start": "2000-06-30", "test_end": "2000-12-31"}]


def calibration_rows(spark, sf):
    scored = R.trained_scores(R.with_folds(EV.frame(spark, sf), _CAL), ["horizon"], digits=_CELLS)
    return cut_lineage(R.by_method(R.calibrated(scored, ["horizon"]), ["raw", "platt", "isotonic"], ["horizon", "y"]))


_CALSQL = f"""cf AS MATERIALIZED (SELECT *, CASE WHEN cutoff_month <= DATE '1999-06-30' THEN 'train' WHEN cutoff_month = DATE '1999-12-31' THEN 'valid' ELSE 'test' END AS split FROM mf
  WHERE cutoff_month <= DATE '2000-12-31'),
ctrain AS (SELECT * FROM cf WHERE split = 'train'),
{logistic_sql('ctrain', ['horizon'], FEATURES, 'cm')},
csc AS MATERIALIZED (SELECT *, {_LOGIT} FROM (SELECT horizon, split, y, round({score_sql(FEATURES)}, {_CELLS}) AS raw FROM cf JOIN cm USING (horizon) WHERE split <> 'train')),
cvalid AS (SELECT * FROM csc WHERE split = 'valid'),
{logistic_sql('cvalid', ['horizon'], ['lg'], 'cp')},
pts AS (SELECT horizon, raw AS x, sum(y)::DOUBLE AS s, count(*)::DOUBLE AS n, row_number() OVER (PARTITION BY horizon ORDER BY raw) AS i FROM cvalid GROUP BY horizon, raw),
run AS MATERIALIZED (SELECT *, sum(s) OVER w AS cs, sum(n) OVER w AS cn FROM pts WINDOW w AS (PARTITION BY horizon ORDER BY i)),
means AS (SELECT a.horizon, a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS v FROM run a JOIN run b ON a.horizon = b.horizon AND b.i >= a.i),
low AS (SELECT horizon, a, b AS i, min(v) OVER (PARTITION BY horizon, a ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM means),
iso AS MATERIALIZED (SELECT r.horizon, r.x, max(v) AS v FROM low JOIN run r USING (horizon, i) GROUP BY r.horizon, r.x),
asked AS (SELECT DISTINCT horizon, raw AS x FROM csc WHERE split = 'test'),
left_of AS (SELECT asked.horizon, asked.x, max(iso.x) AS x0 FROM asked JOIN iso ON iso.horizon = asked.horizon AND iso.x <= asked.x GROUP BY ALL),
right_of AS (SELECT asked.horizon, asked.x, min(iso.x) AS x1 FROM asked JOIN iso ON iso.horizon = asked.horizon AND iso.x >= asked.x GROUP BY ALL),
fitted AS (
  SELECT q.horizon, q.x, CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL OR x0 = x1 THEN a.v ELSE a.v + (b.v - a.v) * (q.x - x0) / (x1 - x0) END AS v
  FROM asked q LEFT JOIN left_of l USING (horizon, x) LEFT JOIN right_of r USING (horizon, x)
    LEFT JOIN iso a ON a.horizon = q.horizon AND a.x = x0 LEFT JOIN iso b ON b.horizon = q.horizon AND b.x = x1
), call AS MATERIALIZED (
  SELECT horizon, 'raw' AS method, y, {rnd('raw', 6)} AS p FROM csc WHERE split = 'test'
  UNION ALL SELECT horizon, 'platt', y, {rnd(score_sql(['lg']), 6)} FROM csc JOIN cp USING (horizon) WHERE split = 'test'
  UNION ALL SELECT c.horizon, 'isotonic', y, {rnd('v', 6)} FROM csc c JOIN fitted f ON f.horizon = c.horizon AND f.x = c.raw WHERE split = 'test'
)"""


@query("train_calibration_horizons", f"WITH {_CALSQL}\n{_metrics_sql('call', 'horizon, method')}")
def _(spark, sf):
    return _metrics(calibration_rows(spark, sf), ["horizon", "method"])


@query("train_isotonic_blocks", f"""WITH {_CALSQL}
SELECT horizon, min(x) AS lo, max(x) AS hi, {rnd('min(v)', 6)} AS value, CAST(sum(n) AS BIGINT) AS n FROM iso JOIN run USING (horizon, x) GROUP BY horizon, round(v, 12)
""")
def _(spark, sf):
    from orderpulse.operators.fitting import isotonic

    scored = R.trained_scores(R.with_folds(EV.frame(spark, sf), _CAL), ["horizon"], digits=_CELLS)
    return round_all(isotonic(scored.where("split = 'valid'"), ["horizon"], "raw"), 6)


@query("train_trees_per_horizon", """
SELECT horizon, count(*) FILTER (split = 'train') AS train_rows, CAST(sum(y) FILTER (split = 'train') AS BIGINT) AS train_positives, count(*) FILTER (split = 'test') AS test_rows,
  CAST(sum(y) FILTER (split = 'test') AS BIGINT) AS test_positives, true AS beats_chance, true AS importances_sum_to_one FROM sfr GROUP BY horizon
HAVING count(DISTINCT y) FILTER (split = 'train') = 2 AND count(DISTINCT y) FILTER (split = 'test') = 2
""")
def _(spark, sf):
    """Boosted trees for every horizon with both classes in both parts; importances are those of the fitted trees."""
    from orderpulse.plans import training as TR

    rows = cut_lineage(split_frame(spark, sf))
    both = "count(distinct if(split = '{0}', y, null)) = 2"
    sizes = rows.groupBy("horizon").agg(
        *[F.expr(f"count_if(split = '{s}') as {s}_rows") for s in ("train", "test")], *[F.expr(f"sum(if(split = '{s}', y, 0)) as {s}_positives") for s in ("train", "test")],
        F.expr(f"{both.format('train')} and {both.format('test')} as _both")).where("_both").drop("_both")
    horizons = sorted(r["horizon"] for r in sizes.select("horizon").collect())
    models = TR.train_per_horizon(rows, "split = 'train'", horizons, kind="trees")
    shares = spark.createDataFrame([(h, bool(abs(m.stages[-1].featureImportances.toArray().sum() - 1) < 1e-9)) for h, m in models.items()], "horizon string, importances_sum_to_one boolean")
    scored = TR.score_per_horizon(rows.where("split = 'test'"), models)
    auc = E.roc_auc(scored.select("horizon", "y", F.col("model_probability").alias("p")), ["horizon"]).selectExpr("horizon", "roc_auc > 0.5 as beats_chance")
    return sizes.join(auc, "horizon").join(shares, "horizon").select("horizon", "train_rows", F.col("train_positives").cast("long"), "test_rows", F.col("test_positives").cast("long"), "beats_chance", "importances_sum_to_one")


@query("metric_score_parity", f"""WITH {_CALSQL},
va AS (SELECT entity_id, cutoff_month, horizon, p AS a FROM mf WHERE cutoff_month <= DATE '2000-06-30'),
vb AS (SELECT entity_id, cutoff_month, horizon, round({score_sql(FEATURES)}, 9) AS b FROM cf JOIN cm USING (horizon) WHERE split <> 'train')
SELECT horizon, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS matched_rows, count(*) FILTER (b IS NULL) AS runtime_only, count(*) FILTER (a IS NULL) AS reference_only, count(*) FILTER (a <> b) AS differing_rows,
  {rnd('max(abs(a - b))', 6)} AS max_abs_diff, {rnd('avg(abs(a - b))', 6)} AS mean_abs_diff, {rnd('corr(a, b)', 6)} AS correlation
FROM va FULL JOIN vb USING (entity_id, cutoff_month, horizon) GROUP BY horizon""")
def _(spark, sf):
    """Two stored batches that overlap in part: rule scores up to one cutoff, scores of a trained model after another."""
    import uuid

    from orderpulse.session import checkpoint_dir

    path = f"{checkpoint_dir(spark)}/orderpulse/score-batches-{uuid.uuid4().hex}"
    key = ["entity_id", "cutoff_month", "horizon"]
    rows = cut_lineage(EV.frame(spark, sf, common.settled_months(spark, sf)))
    E.publish_scores(rows.where("cutoff_month <= date'2000-06-30'").select(*key, F.col("p").alias("score")), path, "rule-v1")
    trained = R.trained_scores(R.with_folds(rows, _CAL), ["horizon"])
    E.publish_scores(trained.select(*key, F.col("raw").alias("score")), path, "model-v1")
    return round_all(E.batch_parity(E.read_scores(spark, path, "rule-v1"), E.read_scores(spark, path, "model-v1"), key, "score", ["horizon"]), 6)
