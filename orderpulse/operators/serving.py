"""Queries over result tables: filters, ranked selections, top entities per manufacturer, pages, contexts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.functions.exprs import labels_where, null_safe_join
from orderpulse.operators.ranking import first_rows, sorted_rank


def apply_filters(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Equality or membership per column; None is ignored. Values are compared typed, so they push down."""
    for c, v in filters.items():
        if v is None or c not in df.columns:
            continue
        df = df.where(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return df


def select_rankable(df: DataFrame, filters: Mapping[str, object], kinds: Sequence[str], sort: Sequence[str], limit: int) -> DataFrame:
    kept = apply_filters(df, filters)
    if "all" not in kinds:
        kept = kept.where(F.col("sample_class").isin(list(kinds)))
    return kept.orderBy(*[F.desc_nulls_last(c) for c in sort], F.asc("entity_id")).limit(limit)


def top_entities(df: DataFrame, n: int, strategy: str, threshold: float | None = None, overflow: bool = False) -> DataFrame:
    """Top n per manufacturer by probability, amount or loss value; rows above the threshold may exceed n."""
    if strategy == "loss_value":
        order = [F.expr("case when loss > 0 then 0 when loss = 0 then 1 else 2 end"), F.desc_nulls_last("loss"), F.desc_nulls_last("p"), F.asc("entity_id")]
    else:
        order = [F.desc_nulls_last({"probability": "p", "amount": "v"}[strategy]), F.asc("entity_id")]
    if threshold is not None:
        order = [F.expr(f"if(p >= {threshold}, 0, 1)"), *order]
    top = first_rows(df, ["manufacturer_code"], order, n)
    if overflow and threshold is not None:
        more = df.where(F.col("p") >= threshold).join(top.select("entity_id"), "entity_id", "left_anti")
        top = top.unionByName(more)
    return top


#: Weights of the ascending percent ranks of probability, overdue interval, frequency loss and business priority.
MIXED_WEIGHTS = {"p": 0.5, "overdue": 0.2, "decay": 0.2, "loss": 0.1}


def top_entities_mixed(df: DataFrame, n: int, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Top n per manufacturer by a weighted sum of percent ranks over all rows; missing values rank as 0, ties by entity."""
    weights = weights or MIXED_WEIGHTS
    out = df.withColumns({f"_s_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in weights})
    for c in weights:
        out = sorted_rank(out, f"_s_{c}", [], ["entity_id"], name=f"_r_{c}", total="_n", descending=False).drop(f"_s_{c}")
        out = out.withColumn(f"_r_{c}", F.col(f"_r_{c}") / F.col("_n")).drop("_n")
    score = sum((F.lit(w) * F.col(f"_r_{c}") for c, w in weights.items()), F.lit(0.0))
    ranked = out.withColumn("ranking_score", F.round(score, 9)).drop(*[f"_r_{c}" for c in weights])
    return first_rows(ranked, ["manufacturer_code"], [F.desc("ranking_score"), F.asc("entity_id")], n)


def typed_sort(df: DataFrame, column: str, kind: str, descending: bool, tie: str) -> DataFrame:
    """Rows in the order of a column read as a date or a number; what cannot be read comes last, ties by `tie`."""
    typed = F.col(column).cast("string").try_cast({"date": "date", "number": "double"}[kind])
    return df.orderBy(typed.desc_nulls_last() if descending else typed.asc_nulls_last(), F.asc(tie))


#: Names a caller may sort clues by, and their columns.
CLUE_SORTS = {"detector_score": "detector_score", "confidence": "confidence", "risk_probability": "monthly_risk_probability", "loss_value": "monthly_loss_value", "created_at": "created_at"}


def sorted_clues(clues: DataFrame, by: str, descending: bool = True) -> DataFrame:
    """Clues by a known measure, nulls last, then by display rank and day; by display rank where the measure is absent."""
    column = CLUE_SORTS.get(by)
    rest = [F.asc_nulls_last("display_rank"), F.asc_nulls_last("observation_date")]
    if column is None or column not in clues.columns:
        return clues.orderBy(*rest)
    return clues.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_last(column), *rest)


def typed_places(df: DataFrame, column: str, kind: str, descending: bool, ties: Sequence[str], by: Sequence[str] = (), name: str = "place") -> DataFrame:
    """Every row with its place in the order of `typed_sort`, per group; rows of any number, dealt by sampled ranges."""
    typed = F.col(column).cast("string").try_cast({"date": "date", "number": "double"}[kind])
    number = F.unix_date(typed).cast("double") if kind == "date" else typed
    return _places(df, number, descending, ties, by, name)


def _places(df: DataFrame, number: Column, descending: bool, ties: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    """Places by a number whose nulls come last: a rank of the rows that have one, then of the others behind them."""
    marked = df.withColumns({"_value": number, "_unread": number.isNull().cast("int")})
    groups = [*by, "_unread"]
    ranked = sorted_rank(marked.withColumn("_value", F.coalesce("_value", F.lit(0.0))), "_value", groups, ties, name="_place", total="_size", descending=descending)
    ahead = marked.where("_unread = 0").groupBy(*by).agg(F.count(F.lit(1)).alias("_ahead"))
    joined = null_safe_join(ranked, ahead, list(by)) if by else ranked.withColumn("_ahead", ahead.scalar())
    return joined.withColumn(name, F.col("_place") + F.when(F.col("_unread") == 1, F.coalesce("_ahead", F.lit(0))).otherwise(0)).drop("_value", "_unread", "_place", "_size", "_ahead")


#: What tells clues of one rank and day apart.
CLUE_TIES = ["detector_id", "manufacturer_code", "hospital_code", "drug_code", "purchase_unit"]


def clue_places(clues: DataFrame, by: str, descending: bool = True, name: str = "place") -> DataFrame:
    """Every clue with its place in the order of `sorted_clues`."""
    column = CLUE_SORTS.get(by)
    number = F.col(column).cast("double") if column in clues.columns else F.lit(None).cast("double")
    return _places(clues, number, descending, ["display_rank", "observation_date", *CLUE_TIES], [], name)


def fill_shortage(top: DataFrame, pool: DataFrame, n: int, order: Sequence) -> DataFrame:
    """Complete manufacturers that returned fewer than n rows from another pool."""
    have = top.groupBy("manufacturer_code").agg(F.count(F.lit(1)).alias("_have"))
    best = first_rows(pool.join(top.select("entity_id"), "entity_id", "left_anti"), ["manufacturer_code"], order, n)
    from pyspark.sql import Window

    w = Window.partitionBy("manufacturer_code").orderBy(*order)
    extra = best.withColumn("_i", F.row_number().over(w)).join(have, "manufacturer_code", "left")
    extra = extra.where(F.col("_i") <= n - F.coalesce("_have", F.lit(0))).drop("_i", "_have")
    return top.withColumn("filled", F.lit(False)).unionByName(extra.withColumn("filled", F.lit(True)).select(*top.columns, "filled"))


def page(df: DataFrame, score: str, number: int, size: int) -> DataFrame:
    """One page of the ranking with the total, by ranks over sampled ranges."""
    r = sorted_rank(df, score, [], ["entity_id"], name="rank", total="total_count")
    return r.where((F.col("rank") > (number - 1) * size) & (F.col("rank") <= number * size))


def shortage(df: DataFrame, target: int, limit: int) -> DataFrame:
    return df.groupBy("manufacturer_code").agg(F.count(F.lit(1)).alias("available_count")).selectExpr(
        "manufacturer_code", "available_count", f"least(available_count, {limit}) as returned_count", f"greatest({target} - least(available_count, {limit}), 0) as shortage_count"
    )


def visible_scope(entities: DataFrame, scope: DataFrame, requested: Sequence[str] | None) -> DataFrame:
    """Distinct manufacturers the user may see, intersected with the request."""
    seen = entities.select("manufacturer_code").distinct().join(scope.select("manufacturer_code").distinct(), "manufacturer_code", "left_semi")
    return seen.where(F.col("manufacturer_code").isin(list(requested))) if requested else seen


def resolve_context(registry: DataFrame, requested: str) -> DataFrame:
    """Exact month if registered, else the latest one before it; a status tells which."""
    want = F.to_date(F.lit(requested))
    best = registry.where(F.col("report_month") <= want).agg(F.max("report_month").alias("resolved_month"))
    return best.withColumn("requested_month", want).withColumn(
        "resolution", F.expr("case when resolved_month is null then 'unavailable' when resolved_month = requested_month then 'exact' else 'latest_before' end")
    )


def payload(df: DataFrame, key: Sequence[str], columns: Sequence[str], n: int) -> DataFrame:
    """JSON page per key holding its best n rows."""
    top = first_rows(df, key, [F.desc_nulls_last("p"), F.asc("entity_id"), *[F.asc(c) for c in columns]], n)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("_s"), *columns)))
    return top.groupBy(*key).agg(F.count(F.lit(1)).alias("row_count"), F.to_json(F.transform(rows, lambda x: F.struct(*[x[c].alias(c) for c in columns]))).alias("payload"))


#: What a profile of the selected horizon says in place of the entity's own row, where it says anything.
PROFILE_FIRST = ["involved_amount_source", "risk_level", "risk_band", "main_reason_summary", "reason"]


def horizon_view(frame: DataFrame, profiles: DataFrame, horizon: str) -> tuple[DataFrame, list[str]]:
    """Entities as seen at a horizon, and notices for the caller.

    Rows whose primary horizon is the selected one go alone if there are any. Each row meets its entity's latest profile
    of the month; entities without one are left out. Without any profile of the horizon the rows of that primary horizon
    stand for themselves under a notice; a horizon that neither side knows raises an error.
    """
    key = ["risk_entity_id", "report_month"]
    chosen = profiles.where(F.col("horizon") == horizon)
    if chosen.isEmpty():
        own = frame.where(F.col("primary_horizon") == horizon)
        if own.isEmpty() and not profiles.isEmpty():
            raise ValueError(f"horizon {horizon} is not available")
        return own, ["HORIZON_PROFILE_NOT_AVAILABLE"]
    primary = frame.agg(F.max(F.coalesce(F.col("primary_horizon") == horizon, F.lit(False)))).scalar()
    rows = frame.where(~F.coalesce(primary, F.lit(False)) | (F.col("primary_horizon") == horizon))
    said = [c for c in chosen.columns if c not in [*key, "horizon"]]
    latest = [F.desc_nulls_last("updated_at")] if "updated_at" in said else []
    once = first_rows(chosen, key, [*latest, *[F.asc(c) for c in said if c != "updated_at"]])
    named = once.select(*key, *[F.col(c).alias(f"_p_{c}") for c in said])
    joined = rows.join(named, key)
    replaced = {c: F.coalesce(f"_p_{c}", c) if c in frame.columns else F.col(f"_p_{c}") for c in PROFILE_FIRST if c in said}
    numbers = {f"profile_{c}": F.col(f"_p_{c}").cast("double") for c in ("risk_probability", "involved_amount") if c in said}
    return joined.withColumns({**replaced, **numbers, "selected_horizon": F.lit(horizon)}).drop(*[f"_p_{c}" for c in said]), []
