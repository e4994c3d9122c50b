"""Readers for raw batches and order tables, and writers for result partitions."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderpulse.operators.ranking import first_rows, sorted_rank
from orderpulse.schemas import RAW_TABLES, REQUIRED_RAW_TABLES


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_manifest(spark: SparkSession, batch: str) -> dict:
    """The manifest is one small JSON file; it is read whole through the batch's file system."""
    text = "\n".join(r.value for r in spark.read.text(f"{batch}/manifest.json").collect())
    return json.loads(text)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        if schema is None:
            return reader.csv(path)
        # Columns are matched by name, so the file's order does not matter.
        raw = reader.csv(path)
        return raw.select(
            *[
                F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})").alias(f.name) if f.name in raw.columns
                else F.lit(None).cast(f.dataType).alias(f.name)
                for f in schema
            ],
            *[c for c in raw.columns if c not in schema.names],
        )
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported table format: {path}")


def read_batch(
    spark: SparkSession, batch: str, mapping: Mapping[str, Mapping[str, str]] | None = None,
) -> dict[str, DataFrame]:
    """All tables of a raw batch; an optional table that the manifest does not name is empty."""
    manifest = read_manifest(spark, batch)
    paths = manifest.get("table_paths", {})
    missing = [t for t in REQUIRED_RAW_TABLES if t not in paths]
    if missing:
        raise ValueError(f"batch lacks required tables: {missing}")
    out = {}
    for name, schema in RAW_TABLES.items():
        if name not in paths:
            out[name] = empty(spark, schema)
            continue
        df = read_table(spark, f"{batch}/{paths[name]}", None if mapping and name in mapping else schema)
        out[name] = rename(df, (mapping or {}).get(name, {}))
    return out


def rename(df: DataFrame, mapping: Mapping[str, str], required: Sequence[str] = ()) -> DataFrame:
    """Rename by a mapping and check the required columns."""
    out = df.withColumnsRenamed(dict(mapping))
    missing = [c for c in required if c not in out.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return out


def scoped_orders(
    orders: DataFrame, start: str, end: str, manufacturers: Sequence[str] | None = None, top: int | None = None,
) -> DataFrame:
    """Date window plus manufacturer scope: a list, or the busiest `top`; all of it pushes down to the source."""
    window = orders.where(F.col("order_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    out = window
    if manufacturers:
        out = out.where(F.col("manufacturer_code").isin(list(manufacturers)))
    elif top:
        best = window.where("manufacturer_code <> ''").groupBy("manufacturer_code").agg(F.count(F.lit(1)).alias("n"))
        best = best.orderBy(F.desc("n"), F.asc("manufacturer_code")).limit(top)
        out = out.join(best, "manufacturer_code", "left_semi")
    return out


def project_known(orders: DataFrame, columns: Sequence[str], required: Sequence[str], **filters: object) -> DataFrame:
    """Known columns that the source has, with equality filters on those present."""
    missing = [c for c in required if c not in orders.columns]
    if missing:
        raise ValueError(f"source lacks required columns: {missing}")
    out = orders
    for c, v in filters.items():
        if v is not None and c in orders.columns:
            out = out.where(F.col(c) == v)
    return out.select(*[c for c in columns if c in orders.columns])


def read_orders_table(spark: SparkSession, url: str, table: str, column: str, low: str, high: str, partitions: int, **options: str) -> DataFrame:
    """Database source read in parallel ranges of a date or number column."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=str(partitions), **options
    )
    return reader.load()


def write_result(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Immutable result table: nested values become text, an existing table is refused."""
    flat = df.select(
        *[F.to_json(c).alias(c) if t.startswith(("struct", "map")) else F.col(c) for c, t in df.dtypes]
    )
    flat.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


COMPONENT = ["observation_date", "detector_id"]


def published_components(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows published below a path, or None before the first publication."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def publish_components(results: DataFrame, path: str) -> DataFrame:
    """Write the (date, rule) components that the path does not hold yet, each once; counts of what was written.

    What is there is looked up first, so a rerun or a resumed backfill publishes nothing twice. The key list is one
    pair per date and rule.
    """
    spark = results.sparkSession
    before = published_components(spark, path)
    new = results.join(before.select(*COMPONENT).distinct(), COMPONENT, "left_anti") if before is not None else results
    held = [] if before is None else [tuple(r) for r in before.select(*COMPONENT).distinct().collect()]
    new.write.mode("append").partitionBy(*COMPONENT).parquet(path)
    after = published_components(spark, path)
    if after is None:
        return spark.createDataFrame([], results.select(*COMPONENT).schema.add("rows", "long"))
    counts = after.groupBy(*COMPONENT).agg(F.count(F.lit(1)).alias("rows"))
    if not held:
        return counts
    old = spark.createDataFrame(held, before.select(*COMPONENT).schema)
    return counts.join(old, COMPONENT, "left_anti")


def backfill(compute: Callable[[list[str], list[str]], DataFrame], path: str, spark: SparkSession, dates: Sequence[str], detectors: Sequence[str]) -> DataFrame:
    """Publish what is missing of a range of dates and rules; `compute(dates, rules)` is asked for nothing else."""
    before = published_components(spark, path)
    index = before.select(*COMPONENT).distinct() if before is not None else empty(spark, T.StructType().add("observation_date", T.DateType()).add("detector_id", T.StringType()))
    missing = [(str(d), r) for d, r in pending_components(index, dates, detectors).collect()]
    if not missing:
        return publish_components(before.limit(0), path) if before is not None else index.withColumn("rows", F.lit(0).cast("long"))
    wanted = compute(sorted({d for d, _ in missing}), sorted({r for _, r in missing}))
    return publish_components(wanted, path)


def latest_components(index: DataFrame) -> DataFrame:
    """Newest batch per date and rule."""
    return first_rows(index, ["observation_date", "detector_id"], [F.desc("batch_id")])


def pending_components(published: DataFrame, dates: Sequence[str], detectors: Sequence[str]) -> DataFrame:
    """Expected (date, rule) pairs of a range that are not published yet."""
    spark = published.sparkSession
    want = spark.range(1).selectExpr("explode(array(" + ", ".join(f"date'{d}'" for d in dates) + ")) as observation_date")
    want = want.selectExpr("*", "explode(array(" + ", ".join(f"'{d}'" for d in detectors) + ")) as detector_id")
    return want.join(published.select("observation_date", "detector_id"), ["observation_date", "detector_id"], "left_anti")


def split_components(clues: DataFrame, run_prefix: str) -> DataFrame:
    """Give every rule its own run id and re-rank its clues per date."""
    ranked = sorted_rank(clues.drop("display_rank"), "detector_score", ["observation_date", "detector_id"], ["detector_clue_id"], name="display_rank")
    return ranked.withColumn("run_id", F.concat_ws("-", F.lit(run_prefix), "detector_id", F.col("observation_date").cast("string")))


def split_conservation(source: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows and distinct clues per day and rule before and after the split; `conserved` where none was lost or doubled."""
    key = ["observation_date", "detector_id"]
    side = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(f"{name}_rows"), F.countDistinct("detector_clue_id").alias(f"{name}_clues"), F.countDistinct("run_id").alias(f"{name}_runs"))
    before = side(source.withColumn("run_id", F.lit(None).cast("string")), "source").drop("source_runs")
    both = before.join(side(parts, "component"), key, "full").fillna(0, ["source_rows", "source_clues", "component_rows", "component_clues", "component_runs"])
    ranks = parts.groupBy(*key).agg(F.max("display_rank").alias("last_rank"))
    same = "source_rows = component_rows and source_clues = component_clues and component_runs = 1 and coalesce(last_rank, 0) = component_rows"
    return both.join(ranks, key, "left").withColumn("conserved", F.expr(same))


def canonical_orders(orders: DataFrame) -> DataFrame:
    """Orders under the names that the views share; a missing price is the amount of one piece."""
    price = F.col("purchase_price") if "purchase_price" in orders.columns else F.col("purchase_amount") / F.nullif(F.col("purchase_qty"), F.lit(0.0))
    maker = F.col("manufacturer") if "manufacturer" in orders.columns else F.lit(None).cast("string")
    receipt = F.col("receipt_date") if "receipt_date" in orders.columns else F.lit(None).cast("date")
    own = ["order_id", "drug_code", "org_code", "purchase_qty", "purchase_amount", "delivery_qty", "receipt_qty"]
    return orders.select(
        *own, F.col("order_date").alias("order_time"), price.alias("purchase_price"), maker.alias("manufacturer"), F.col("delivery_date").alias("delivery_time"), receipt.alias("receipt_time"))


def unit_order_events(canonical: DataFrame, mapping: DataFrame) -> DataFrame:
    lines = mapping.select("drug_code", "product_line_code", "product_line_name")
    return canonical.select("order_id", "org_code", "drug_code", "order_time", "purchase_qty", "purchase_amount").join(lines, "drug_code")


def unit_activity(events: DataFrame, month: bool) -> DataFrame:
    """Orders and drugs of each organisation and product line, per month with quantities or over all time with the last order."""
    by = [F.col("org_code"), F.col("product_line_code")]
    orders, drugs = F.countDistinct("order_id"), F.countDistinct("drug_code")
    if month:
        first_day = F.trunc("order_time", "month").cast("date").alias("month_start")
        return events.groupBy(*by, first_day).agg(orders.alias("order_count"), drugs.alias("active_drug_count"), F.sum("purchase_qty").alias("purchase_qty"))
    return events.groupBy(*by).agg(F.max("order_time").alias("last_order_time"), orders.alias("historical_order_count"), drugs.alias("historical_drug_count"))


def create_views(orders: DataFrame, mapping: DataFrame) -> SparkSession:
    """Registers the shared views over the given tables; their names are fixed values."""
    canonical = canonical_orders(orders)
    events = unit_order_events(canonical, mapping)
    made = {
        "v_canonical_orders": canonical,
        "v_unit_order_events": events,
        "v_unit_monthly_agg": unit_activity(events, month=True),
        "v_unit_baseline_snapshot": unit_activity(events, month=False),
    }
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return orders.sparkSession
