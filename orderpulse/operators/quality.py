"""Data-quality profiles and validations; every report is one or two aggregates, never a row scan on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.operators.ranking import quantiles


def _inline(df: DataFrame, rows: Sequence[str]) -> DataFrame:
    return df.selectExpr("inline(array(" + ", ".join(rows) + "))")


def field_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count, null rate and distinct count per column, from one long pre-aggregation."""
    rows = ", ".join(f"named_struct('column', '{c}', 'value', cast({c} as string))" for c in columns)
    per = df.selectExpr(f"inline(array({rows}))").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("column").agg(
        F.expr("sum(if(value is null, n, 0)) as null_count"), F.expr("sum(if(value is null, n, 0)) / sum(n) as null_rate"),
        F.expr("count(value) as distinct_count"),
    )


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc_nulls_last("value")).limit(n)


def identifier_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    parts = None
    for k in keys:
        per = df.groupBy(k).agg(F.count(F.lit(1)).alias("n")).agg(
            F.lit(k).alias("identifier"), F.count(k).alias("distinct_count"), F.expr("count_if(n > 1)").alias("repeated_keys"),
            F.expr("sum(if(n > 1, n, 0))").alias("rows_of_repeated_keys"),
        )
        parts = per if parts is None else parts.unionByName(per)
    return parts.withColumn("is_unique", F.col("repeated_keys") == 0)


def one_to_one(df: DataFrame, left: str, right: str, name: str) -> DataFrame:
    pairs = df.select(left, right).distinct()
    per = pairs.groupBy(left).agg(F.count(right).alias("k"))
    right_n = pairs.agg(F.countDistinct(right)).scalar()
    return per.agg(F.lit(name).alias("metric"), F.count(left).alias("left_distinct"), F.expr("count_if(k > 1)").alias("multi_mapping_count")).withColumn("right_distinct", right_n)


def code_consistency(df: DataFrame, a: str, b: str) -> DataFrame:
    pairs = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).where(f"{a} is not null and {b} is not null")
    multi = pairs.groupBy(a).agg(F.count(F.lit(1)).alias("k")).agg(F.expr("count_if(k > 1)"))
    out = pairs.agg(F.sum("n").alias("comparable_rows"), F.expr(f"sum(if({a} = {b}, n, 0)) / sum(n)").alias("equal_ratio"))
    return out.withColumn("multi_map_count", multi.scalar())


def numeric_report(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Null, negative and zero rates with min, median, 95% quantile and max for fields and ratios."""
    rows = ", ".join(f"named_struct('field', '{k}', 'value', cast({e} as double))" for k, e in columns.items())
    long = df.selectExpr(f"inline(array({rows}))").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    rates = long.groupBy("field").agg(
        F.expr("sum(if(value is null, n, 0)) / sum(n) as null_rate"), F.expr("sum(if(value < 0, n, 0)) / sum(n) as negative_rate"),
        F.expr("sum(if(value = 0, n, 0)) / sum(n) as zero_rate"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return rates.join(quantiles(long, ["field"], "value", {"p50": 0.5, "p95": 0.95}, weight="n"), "field", "left")


def raw_validation(orders: DataFrame) -> DataFrame:
    checks = {
        "order_date_parse": "order_date is null", **{f"{c}_not_blank": f"trim(coalesce({c}, '')) = ''" for c in ("manufacturer_code", "hospital_code", "drug_code")},
        "order_quantity_numeric": "order_quantity is null or order_quantity <= 0", "order_amount_numeric": "order_amount is null",
    }
    agg = orders.agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"count_if({c}) as c{i}") for i, c in enumerate(checks.values())])
    rows = ["named_struct('check_name', 'orders_non_empty', 'status', if(n > 0, 'pass', 'fail'), 'invalid_count', if(n > 0, 0L, 1L))"]
    for i, name in enumerate(checks):
        bad = "warn" if name.endswith("numeric") else "fail"
        rows.append(f"named_struct('check_name', '{name}', 'status', if(c{i} = 0, 'pass', '{bad}'), 'invalid_count', c{i})")
    return _inline(agg, rows)


ORDER_CHECKS = {
    "purchase_qty_non_negative": "purchase_qty is null or purchase_qty < 0", "purchase_price_non_negative": "comparable_unit_price is null or comparable_unit_price < 0",
    "conversion_factor_valid": "conversion_factor is null or conversion_factor <= 0", "delivery_qty_gt_purchase_qty": "delivery_qty > purchase_qty",
    "receipt_qty_gt_delivery_qty": "receipt_qty > delivery_qty", "org_code_not_empty": "trim(coalesce(org_code, '')) = ''", "drug_code_not_empty": "trim(coalesce(drug_code, '')) = ''",
}


def order_quality(orders: DataFrame) -> DataFrame:
    """Rows failing each check with the five smallest row ids as samples (a bounded per-check minimum)."""
    rows = ", ".join(f"if({c}, '{n}', null)" for n, c in ORDER_CHECKS.items())
    long = orders.selectExpr("row_uid", f"explode(filter(array({rows}), x -> x is not null)) as check_name")
    from orderpulse.operators.ranking import first_rows

    n = long.groupBy("check_name").agg(F.count(F.lit(1)).alias("row_count"))
    s = first_rows(long, ["check_name"], [F.col("row_uid")], 5).groupBy("check_name").agg(F.array_join(F.array_sort(F.collect_list("row_uid")), ",").alias("sample_refs"))
    return n.join(s, "check_name")


def batch_validation(tables: Mapping[str, DataFrame], unique: Mapping[str, Sequence[str]], refs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Duplicate keys and child ids missing from the parent, one row per check."""
    out = None
    for name, key in unique.items():
        part = tables[name].groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.lit(f"{name}_unique").alias("check_name"), F.expr("count_if(n > 1)").alias("failing"))
        out = part if out is None else out.unionByName(part)
    for child, parent, key in refs:
        part = tables[child].join(tables[parent].select(key).distinct(), key, "left_anti").agg(F.lit(f"{child}_in_{parent}").alias("check_name"), F.count(F.lit(1)).alias("failing"))
        out = out.unionByName(part)
    return out.withColumn("status", F.when(F.col("failing") == 0, "pass").otherwise("fail"))


def backfill_validation(results: DataFrame, dates: Sequence[str], detectors: Sequence[str]) -> DataFrame:
    """Published dates, missing dates, result and hit counts with daily minimum and maximum per rule."""
    day = results.groupBy("detector_id", "observation_date").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit_flag").alias("hits"))
    per = day.groupBy("detector_id").agg(
        F.count(F.lit(1)).alias("published_dates"), F.sum("n").alias("result_count"), F.sum("hits").alias("clue_count"),
        F.min("hits").alias("min_daily_clue_count"), F.max("hits").alias("max_daily_clue_count"),
    )
    spark = results.sparkSession
    want = spark.range(1).selectExpr("explode(array(" + ", ".join(f"'{d}'" for d in detectors) + ")) as detector_id")
    return want.join(per, "detector_id", "left").fillna(0).withColumn("missing_dates", F.lit(len(dates)) - F.col("published_dates"))


def freshness(orders: DataFrame, start: str, end: str, **filters: str) -> DataFrame:
    d = orders.where(F.col("order_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    for c, v in filters.items():
        d = d.where(F.col(c) == v)
    return d.agg(F.max("order_date").alias("max_order_time"), F.count(F.lit(1)).alias("row_count"))


def coverage_profile(orders: DataFrame) -> DataFrame:
    a = orders.groupBy("manufacturer_code", "hospital_code", "drug_code").agg(F.count(F.lit(1)).alias("n"), F.min("order_date").alias("f"), F.max("order_date").alias("l"))
    return a.agg(
        F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("entity_count"), F.countDistinct("manufacturer_code").alias("manufacturer_count"),
        F.countDistinct("hospital_code").alias("hospital_count"), F.min("f").alias("purchase_time_min"), F.max("l").alias("purchase_time_max"),
    )


def missing_summary(df: DataFrame, columns: Sequence[str], limit: float = 0.8) -> DataFrame:
    agg = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return agg.unpivot([], list(columns), "column", "missing_ratio").withColumn("high_missing", F.col("missing_ratio") > limit)


def nonzero_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    agg = df.agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"count_if(coalesce({c}, 0) <> 0) as {c}") for c in columns])
    return _inline(agg, [f"named_struct('field', '{c}', 'non_zero_count', {c}, 'non_zero_rate', {c} / n)" for c in columns])


def name_fallback(lookup: DataFrame) -> DataFrame:
    """How often a display name is only the code."""
    return lookup.agg(
        F.count(F.lit(1)).alias("row_count"), F.expr("avg(if(hospital_display_name = hospital_code, 1D, 0D)) as hospital_fallback_rate"),
        F.expr("avg(if(drug_display_name = drug_group, 1D, 0D)) as drug_fallback_rate"),
        F.expr("if(bool_and(hospital_display_name <> hospital_code), 'ready', 'conditional') as hospital_name_ready"),
    )
