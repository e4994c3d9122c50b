"""Checks that name the failing rows: order checks with samples, contract tables, training frames, table summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.operators.ranking import first_rows

# The fields an order must have, and the severity and rule of each check.
REQUIRED_ORDER_FIELDS = ["order_date", "purchase_qty", "purchase_price", "org_code", "drug_code"]
ORDER_RULES = {
    "order_time_parseable": ("error", "order_date", "try_cast(order_date as timestamp) is null"),
    "purchase_qty_non_negative": ("error", "purchase_qty", "try_cast(purchase_qty as double) is null or try_cast(purchase_qty as double) < 0"),
    "purchase_price_non_negative": ("error", "purchase_price", "try_cast(purchase_price as double) is null or try_cast(purchase_price as double) < 0"),
    "conversion_factor_valid": ("warning", "conversion_factor", "try_cast(conversion_factor as double) is null or try_cast(conversion_factor as double) <= 0"),
    "delivery_qty_gt_purchase_qty": ("warning", "delivery_qty", "try_cast(delivery_qty as double) > try_cast(purchase_qty as double)"),
    "receipt_qty_gt_delivery_qty": ("warning", "receipt_qty", "try_cast(receipt_qty as double) > try_cast(delivery_qty as double)"),
    "org_code_not_empty": ("error", "org_code", "trim(coalesce(cast(org_code as string), '')) = ''"),
    "drug_code_not_empty": ("error", "drug_code", "trim(coalesce(cast(drug_code as string), '')) = ''"),
}
# Prefixes of columns that a model must not see.
FORBIDDEN_PREFIXES = ["label_alive_H", "label_die_H", "next_purchase"]


def order_report(orders: DataFrame, id_col: str = "row_uid", samples: int = 5) -> DataFrame:
    """Rows (check_name, severity, row_count, sample_refs) of every check that fails, samples by the least ids.

    Without a required field that is the only finding; a check whose optional field is missing doesn't run. Every row
    of an order_id that occurs more than once is a finding, a null order_id like any other.
    """
    missing = [c for c in REQUIRED_ORDER_FIELDS if c not in orders.columns]
    if missing:
        return orders.agg(F.lit("required_fields").alias("check_name"), F.lit("error").alias("severity"), F.count(F.lit(1)).alias("row_count"), F.lit(", ".join(missing)).alias("sample_refs"))
    active = {n: rule for n, (_, c, rule) in ORDER_RULES.items() if c in orders.columns}
    if "receipt_qty_gt_delivery_qty" in active and "delivery_qty" not in orders.columns:
        del active["receipt_qty_gt_delivery_qty"]
    found = orders.select(F.col(id_col).cast("string").alias("ref"), F.explode(F.array_compact(F.array(*[F.expr(f"if({r}, '{n}', null)") for n, r in active.items()]))).alias("check_name"))
    severity = {n: s for n, (s, _, _) in ORDER_RULES.items()}
    if "order_id" in orders.columns:
        twice = orders.groupBy("order_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("order_id").alias("_o"))
        again = orders.join(twice, F.col("order_id").eqNullSafe(F.col("_o")), "left_semi")
        found = found.unionByName(again.select(F.col(id_col).cast("string").alias("ref"), F.lit("order_id_unique").alias("check_name")))
        severity["order_id_unique"] = "warning"
    counts = found.groupBy("check_name").agg(F.count(F.lit(1)).alias("row_count"))
    refs = first_rows(found, ["check_name"], [F.asc_nulls_last("ref")], samples).groupBy("check_name").agg(F.array_join(F.array_sort(F.collect_list("ref")), ",").alias("sample_refs"))
    named = F.create_map(*[F.lit(x) for pair in severity.items() for x in pair])
    return counts.join(refs, "check_name").select("check_name", named[F.col("check_name")].alias("severity"), "row_count", "sample_refs")


def duplicate_samples(df: DataFrame, key: str, columns: Sequence[str], keys: int = 50) -> DataFrame:
    """All rows of the `keys` least values of `key` that occur more than once."""
    twice = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key).orderBy(key).limit(keys)
    return df.join(twice, key, "left_semi").select(key, *[c for c in columns if c != key])


def contract_checks(
    tables: Mapping[str, DataFrame], required: Mapping[str, Sequence[str]], unique: Mapping[str, Sequence[str]], counts: Mapping[str, Mapping[str, int | None]],
    refs: Sequence[tuple[str, str, str]], texts: Mapping[str, Sequence[str]], words: Sequence[str],
) -> DataFrame:
    """Rows (table_name, check_name, failing, status): columns, keys, declared row counts, child ids, forbidden text.

    `counts` maps a table to declared numbers: its check fails by the greatest difference from the rows there are, and
    a number that is not declared (None) beside one that is fails by one. Checks of a missing column count it as the failure.
    """
    parts: list[DataFrame] = []

    def add(table: str, check: str, failing: DataFrame) -> None:
        parts.append(failing.toDF("failing").select(F.lit(table).alias("table_name"), F.lit(check).alias("check_name"), F.col("failing").cast("long")))

    for t, columns in required.items():
        gone = len([c for c in columns if c not in tables[t].columns])
        add(t, "required_columns", tables[t].sparkSession.range(1).select(F.lit(gone)))
    for t, key in unique.items():
        add(t, "unique_" + "_".join(key), tables[t].groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))))
    for t, numbers in counts.items():
        told = [n for n in numbers.values() if n is not None]
        if told:
            gap = [F.abs(F.count(F.lit(1)) - n) for n in told] + [F.lit(int(len(told) < len(numbers))).cast("long")]
            add(t, "row_count", tables[t].agg(F.greatest(*gap)))
    for child, parent, key in refs:
        known = tables[parent].select(key).distinct()
        add(child, f"{key}_in_{parent}", tables[child].where(F.col(key).isNotNull()).join(known, key, "left_anti").agg(F.count(F.lit(1))))
    for t, columns in texts.items():
        held = [c for c in columns if c in tables[t].columns]
        bad = reduce(Column.__or__, [F.coalesce(F.col(c).cast("string"), F.lit("")).contains(w) for c in held for w in words], F.lit(False))
        add(t, "no_forbidden_text", tables[t].agg(F.count_if(bad)))
    return reduce(DataFrame.unionByName, parts).withColumn("status", F.when(F.col("failing") == 0, "pass").otherwise("fail"))


def label_distribution(labels: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Rows, known labels and positive rate per horizon whose label column exists."""
    held = [h for h in horizons if f"label_die_H{h}" in labels.columns]
    long = labels.selectExpr("inline(array(" + ", ".join(f"named_struct('horizon', 'H{h}', 'y', cast(label_die_H{h} as double))" for h in held) + "))")
    return long.groupBy("horizon").agg(F.count(F.lit(1)).alias("row_count"), F.count("y").alias("known_labels"), F.avg("y").alias("positive_rate"))


def column_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: type, null count and rate (0 for an empty frame), and whether its name tells of the future."""
    types = dict(df.dtypes)
    sums = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = [
        f"named_struct('column', '{c}', 'dtype', '{types[c]}', 'null_count', _{i}, 'null_rate', _{i} / greatest(_n, 1L), 'forbidden', {str(c.startswith(tuple(FORBIDDEN_PREFIXES))).lower()})"
        for i, c in enumerate(columns)
    ]
    return sums.selectExpr(f"inline(array({', '.join(rows)}))")


def training_warnings(frame: DataFrame, label: str, columns: Sequence[str], limit: float = 0.8) -> DataFrame:
    """Rows (warning, measured): no rows, no known label, one class only, and columns missing in more than `limit` of the rows."""
    aggs = [F.count(F.lit(1)).alias("_n"), F.count(label).alias("_k"), F.min(label).alias("_a"), F.max(label).alias("_z")]
    sums = frame.agg(*aggs, *[F.avg(F.col(c).isNull().cast("double")).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = [
        "named_struct('warning', 'EMPTY_TRAINING_DATASET', 'on', _n = 0, 'measured', 0D)",
        "named_struct('warning', 'NO_KNOWN_LABELS', 'on', _n > 0 and _k = 0, 'measured', 0D)",
        "named_struct('warning', 'SINGLE_CLASS_LABELS', 'on', _k > 0 and _a = _z, 'measured', cast(_a as double))",
        *[f"named_struct('warning', 'HIGH_MISSING_{c}', 'on', coalesce(_{i} > {limit}D, false), 'measured', _{i})" for i, c in enumerate(columns)],
    ]
    return sums.selectExpr(f"inline(array({', '.join(rows)}))").where("on").drop("on")


def table_summaries(tables: Mapping[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Per table: rows, number and names of columns, and the range of its date column, one scan of that column each."""
    parts = []
    for name, (df, day) in tables.items():
        first, last = (F.min(day), F.max(day)) if day else (F.lit(None), F.lit(None))
        parts.append(df.agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).cast("long").alias("column_count"),
            F.lit(",".join(df.columns)).alias("columns"), first.cast("date").alias("first_date"), last.cast("date").alias("last_date"),
        ))
    return reduce(DataFrame.unionByName, parts)
