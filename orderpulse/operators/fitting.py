"""Models of many groups fitted together: ridge logistic regression by Newton steps, isotonic regression by pooled blocks.

A fold, a horizon, a sample size or a feature set is a grouping column here, not a loop: every Newton step is one grouped
aggregate over all rows of all groups, of which the driver sees one row of sums for each group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.session import cut_lineage

#: Groups whose coefficients are held by the driver and sent with every step.
MAX_GROUPS = 20_000
#: Blocks of an isotonic fit that are sent to the tasks that apply it (24 bytes each).
MAX_BLOCKS = 2_000_000


def standardisation(rows: DataFrame, by: Sequence[str], features: Sequence[str], y: str = "y") -> DataFrame:
    """Counts, means and deviations of each group; null counts for neither mean nor deviation."""
    aggs = [F.count(F.lit(1)).alias("train_rows"), F.sum(F.col(y).cast("double")).alias("train_positives")]
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        aggs += [F.coalesce(F.avg(x), F.lit(0.0)).alias(f"_m{i}"), F.stddev_pop(x).alias(f"_s{i}")]
    wide = rows.groupBy(*by).agg(*aggs)
    return wide.withColumns({f"_s{i}": F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(F.lit(1.0)) for i in range(len(features))})


def _scaled(rows: DataFrame, by: Sequence[str], features: Sequence[str]) -> list[str]:
    """Standardised features; a null stands at the mean."""
    return [f"coalesce((cast(`{f}` as double) - _m{i}) / _s{i}, 0D)" for i, f in enumerate(features)]


def grouped_logistic(
    rows: DataFrame, by: Sequence[str], features: Sequence[str], y: str = "y", ridge: float = 1.0, steps: int = 30, tolerance: float = 1e-10,
) -> DataFrame:
    """One row per group: train_rows, train_positives, means, deviations, beta (intercept first), converged, single_class.

    Minimises the summed log loss plus ridge / 2 times the squared coefficients (not the intercept) on standardised
    features. A group of one class gets the smoothed log odds as intercept and no slopes. Rows without label are left
    out; groups with a null key form a group of their own.
    """
    spark = rows.sparkSession
    known = rows.where(F.col(y).isNotNull())
    stats = standardisation(known, by, features, y)
    k = len(features)
    stat_rows = stats.limit(MAX_GROUPS + 1).collect()
    if len(stat_rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups to fit at once")
    local = [r.asDict() for r in stat_rows]
    names = [f"_b{j}" for j in range(k + 1)]
    beta = np.zeros((len(local), k + 1))
    single = np.array([r["train_positives"] in (0.0, float(r["train_rows"])) for r in local], bool)
    for g, r in enumerate(local):
        if single[g]:
            beta[g, 0] = np.log((r["train_positives"] + 0.5) / (r["train_rows"] - r["train_positives"] + 0.5))
    done = single.copy()
    # The group's number stands for its key from here on.
    kind = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    keys = spark.createDataFrame(
        [(g, *(r[c] for c in by), *(r[f"_m{i}"] for i in range(k)), *(r[f"_s{i}"] for i in range(k))) for g, r in enumerate(local)],
        ", ".join(["_g int", kind, *[f"_m{i} double" for i in range(k)], *[f"_s{i} double" for i in range(k)]]),
    )
    joined = _by_key(known, keys, by)
    if not done.all():
        z = cut_lineage(joined.selectExpr("_g", f"cast(`{y}` as double) as _y", *[f"{x} as _z{i + 1}" for i, x in enumerate(_scaled(rows, by, features))]))
    x = ["1D", *[f"_z{j}" for j in range(1, k + 1)]]
    for _ in range(steps):
        if done.all():
            break
        open_groups = np.flatnonzero(~done)
        coefficients = spark.createDataFrame([(int(g), *map(float, beta[g])) for g in open_groups], ", ".join(["_g int", *[f"{n} double" for n in names]]))
        eta = " + ".join(f"{names[j]} * {x[j]}" for j in range(k + 1))
        scored = z.join(F.broadcast(coefficients), "_g").selectExpr("_g", "_y", *[f"_z{j}" for j in range(1, k + 1)], f"1D / (1D + exp(-({eta}))) as _p")
        sums = [F.expr(f"sum((_y - _p) * {x[i]}) as g{i}") for i in range(k + 1)]
        sums += [F.expr(f"sum(_p * (1D - _p) * {x[i]} * {x[j]}) as h{i}_{j}") for i in range(k + 1) for j in range(i + 1)]
        for r in scored.groupBy("_g").agg(*sums).collect():
            g = r["_g"]
            slope = np.array([r[f"g{i}"] for i in range(k + 1)])
            curve = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
            penalty = np.diag([0.0, *[ridge] * k])
            move = np.linalg.solve(curve + penalty + 1e-12 * np.eye(k + 1), slope - penalty @ beta[g])
            # A long step of a nearly separable group is cut, so that the curvature doesn't vanish.
            beta[g] += move * min(1.0, 8.0 / max(float(np.abs(move).max()), 1e-300))
            done[g] = np.abs(move).max() < tolerance
    found = [
        (*(r[c] for c in by), int(r["train_rows"]), float(r["train_positives"]), [r[f"_m{i}"] for i in range(k)], [r[f"_s{i}"] for i in range(k)], [float(b) for b in beta[g]], bool(done[g]), bool(single[g]))
        for g, r in enumerate(local)
    ]
    schema = f"{kind}, train_rows long, train_positives double, means array<double>, deviations array<double>, beta array<double>, converged boolean, single_class boolean"
    return spark.createDataFrame(found, schema)


def _by_key(rows: DataFrame, keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the columns of the small table of groups, null keys among them."""
    right = keys.withColumnsRenamed({c: f"_key_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in by]
    condition = on[0]
    for part in on[1:]:
        condition &= part
    return rows.join(F.broadcast(right), condition).drop(*[f"_key_{c}" for c in by])


def grouped_scores(rows: DataFrame, model: DataFrame, by: Sequence[str], features: Sequence[str], name: str = "score") -> DataFrame:
    """Rows with the probability by the model of their group; rows of a group without a model are left out."""
    small = model.selectExpr(*[f"`{c}`" for c in by], "beta as _beta", *[f"means[{i}] as _m{i}" for i in range(len(features))], *[f"deviations[{i}] as _s{i}" for i in range(len(features))])
    joined = _by_key(rows, small, by)
    eta = " + ".join(["_beta[0]", *[f"_beta[{i + 1}] * {x}" for i, x in enumerate(_scaled(rows, by, features))]])
    return joined.withColumn(name, F.expr(f"1D / (1D + exp(-({eta})))")).select(*rows.columns, name)


def _pool(by: Sequence[str]):
    """Pool adjacent violators over sorted rows (by, lo, hi, s, n), group after group; holds the blocks of one group."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None
        blocks: list[list[float]] = []

        def result() -> pd.DataFrame:
            made = pd.DataFrame(blocks, columns=["lo", "hi", "s", "n"])
            for c, value in zip(by, last, strict=True):
                made[c] = value
            return made[[*by, "lo", "hi", "s", "n"]]

        for frame in frames:
            for key, lo, hi, s, n in zip(zip(*[frame[c] for c in by], strict=True), frame["lo"], frame["hi"], frame["s"], frame["n"], strict=True):
                if key != last:
                    if blocks:
                        yield result()
                    last, blocks = key, []
                blocks.append([lo, hi, s, n])
                while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
                    _, hi_, s_, n_ = blocks.pop()
                    blocks[-1][1] = hi_
                    blocks[-1][2] += s_
                    blocks[-1][3] += n_
        if blocks:
            yield result()

    return work


def isotonic(rows: DataFrame, by: Sequence[str], x: str, y: str = "y") -> DataFrame:
    """Rising step function of each group as blocks (by, lo, hi, value, n); rows without score or label are left out.

    Equal scores are summed first. Ranges of (group, score) are pooled where they lie, then the blocks that are left are
    pooled group by group: the means of 0/1 labels rise from block to block, so at most some (3 n)^(2/3) blocks of n
    rows reach the second round, whatever the number of rows in a range. `by` are texts or numbers without nulls.
    """
    points = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("lo")).agg(
        F.sum(F.col(y).cast("double")).alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by], "lo double", "hi double", "s double", "n double"])
    ordered = points.select(*by, "lo", F.col("lo").alias("hi"), "s", "n").repartitionByRange(*by, "lo").sortWithinPartitions(*by, "lo")
    parts = ordered.mapInPandas(_pool(by), schema)
    merged = parts.repartition(*by).sortWithinPartitions(*by, "lo").mapInPandas(_pool(by), schema)
    return merged.select(*by, "lo", "hi", (F.col("s") / F.col("n")).alias("value"), F.col("n").cast("long").alias("n"))


def isotonic_scores(rows: DataFrame, blocks: DataFrame, by: Sequence[str], x: str, name: str = "isotonic") -> DataFrame:
    """Rows with the fitted value: constant inside a block, linear between blocks, clipped outside; null without a fit."""
    found = blocks.limit(MAX_BLOCKS + 1).toPandas()
    if len(found) > MAX_BLOCKS:
        raise ValueError(f"an isotonic fit of more than {MAX_BLOCKS} blocks: round the scores first")
    steps = {}
    for key, part in found.sort_values("lo").groupby(list(by)):
        steps[key if isinstance(key, tuple) else (key,)] = (part[["lo", "hi"]].to_numpy().ravel(), np.repeat(part["value"].to_numpy(), 2))
    sent = rows.sparkSession.sparkContext.broadcast(steps)

    @F.pandas_udf("double")
    def value(score: pd.Series, *keys: pd.Series) -> pd.Series:
        out = np.full(len(score), np.nan)
        frame = pd.DataFrame(dict(enumerate(keys)))
        for key, at in frame.groupby(list(frame.columns)).indices.items():
            fit = sent.value.get(key if isinstance(key, tuple) else (key,))
            if fit is not None:
                out[at] = np.interp(score.to_numpy(float)[at], *fit)
        return pd.Series(out).where(~np.isnan(out), None)

    return rows.withColumn(name, value(F.col(x).cast("double"), *[F.col(c) for c in by]))
