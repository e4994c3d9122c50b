"""Entity inflow, sampling and coverage audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.operators.ranking import first_rows, quantiles, sorted_rank
from orderpulse.schemas import ENTITY


def entity_inflow(features: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    """New, returning, retained and one-shot-to-recurring entities per cutoff (one row per entity and cutoff)."""
    index = F.create_map(*[x for i, c in enumerate(sorted(cutoffs)) for x in (F.to_date(F.lit(c)), F.lit(i))])
    w = Window.partitionBy("entity_id").orderBy("_i")
    f = features.select("entity_id", "cutoff_month", "sample_class", F.element_at(index, F.col("cutoff_month")).alias("_i"))
    f = f.withColumns({"_pi": F.lag("_i").over(w), "_ps": F.lag("sample_class").over(w)})
    return f.groupBy("cutoff_month").agg(
        F.count(F.lit(1)).alias("entity_count"),
        F.expr("count_if(_pi is null) as new_entities"),
        F.expr("count_if(_pi < _i - 1) as returning_entities"),
        F.expr("count_if(_pi = _i - 1) as retained_entities"),
        F.expr("count_if(_pi = _i - 1 and _ps = 'one_shot' and sample_class = 'recurring') as one_shot_to_recurring"),
    )


def entity_aggregate(orders: DataFrame) -> DataFrame:
    """Order count, first and last purchase and active months per entity."""
    months = orders.groupBy("manufacturer_code", "hospital_code", "drug_code", F.last_day("order_date").alias("m")).agg(
        F.count(F.lit(1)).alias("n"), F.min("order_date").alias("f"), F.max("order_date").alias("l")
    )
    return months.groupBy("manufacturer_code", "hospital_code", "drug_code").agg(
        F.sum("n").alias("order_count"), F.min("f").alias("first_purchase"), F.max("l").alias("last_purchase"), F.count(F.lit(1)).alias("active_months")
    )


AGE = """case when m < 3 then '00_0_2m' when m < 6 then '01_3_5m' when m < 12 then '02_6_11m' when m < 24 then '03_12_23m'
    when m < 36 then '04_24_35m' else '05_36m_plus' end"""


def age_distribution(entities: DataFrame) -> DataFrame:
    span = "(year(last_purchase) - year(first_purchase)) * 12 + month(last_purchase) - month(first_purchase) + 1"
    return entities.withColumn("m", F.expr(span)).groupBy(F.expr(AGE).alias("entity_age_bucket")).agg(
        F.count(F.lit(1)).alias("entity_count"), F.avg("order_count").alias("avg_order_count"), F.avg("active_months").alias("avg_active_month_count")
    )


def compare_distribution(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Row shares of two extracts per key value, with delta and ratio."""
    x = a.groupBy(key).agg(F.count(F.lit(1)).alias("local_rows"))
    y = b.groupBy(key).agg(F.count(F.lit(1)).alias("source_rows"))
    j = x.join(y, key, "full").fillna(0, ["local_rows", "source_rows"])
    w = Window.partitionBy(F.lit(0))
    s = j.withColumns({"local_share": F.col("local_rows") / F.sum("local_rows").over(w), "source_share": F.col("source_rows") / F.sum("source_rows").over(w)})
    return s.selectExpr("*", "local_share - source_share as share_delta", "local_rows / nullif(source_rows, 0) as row_ratio")


def history_completeness(local: DataFrame, source: DataFrame) -> DataFrame:
    key = ["manufacturer_code", "hospital_code", "drug_code"]
    s = source.select(*key, *[F.col(c).alias(f"s_{c}") for c in ("order_count", "first_purchase", "last_purchase")])
    j = local.join(s, key, "left").selectExpr(
        "*", "order_count / nullif(s_order_count, 0) as coverage", "datediff(first_purchase, s_first_purchase) as first_lag", "datediff(s_last_purchase, last_purchase) as last_gap"
    )
    return j.withColumn(
        "history_gap_note",
        F.expr(
            """case when s_order_count is null then 'entity_not_found_in_source' when coverage >= 0.95 and abs(first_lag) <= 7 and abs(last_gap) <= 7 then 'history_complete_by_rule'
               when first_lag > 7 then 'old_history_missing_in_local' when last_gap > 7 then 'recent_history_missing_in_local' else 'local_order_count_below_source' end"""
        ),
    )


def stratified_sample(entities: DataFrame, per_bucket: int = 10) -> DataFrame:
    """Top and repeatable random entities per frequency bucket; the random order is a hash of the key."""
    key = F.concat_ws("|", "manufacturer_code", "hospital_code", "drug_code")
    b = entities.withColumns({"entity_id": key, "_h": F.md5(key), "bucket": F.expr("case when order_count >= 8 then 'high_frequency' when order_count = 1 then 'one_shot' when active_months <= 3 then 'short_history' else 'regular' end")})
    top = first_rows(b, ["bucket"], [F.desc("order_count"), F.asc("entity_id")], per_bucket).withColumn("sample_reason", F.lit("top"))
    rand = first_rows(b, ["bucket"], [F.col("_h"), F.asc("entity_id")], per_bucket).withColumn("sample_reason", F.lit("random"))
    both = top.unionByName(rand)
    return both.groupBy("entity_id", "bucket").agg(F.array_join(F.array_sort(F.collect_set("sample_reason")), "+").alias("sample_reason"))


def select_manufacturers(entities: DataFrame, n: int, min_rows: int, cap: float = 0.9) -> DataFrame:
    """Manufacturers with enough rows and below the volume quantile, largest first."""
    m = entities.groupBy("manufacturer_code").agg(F.sum("order_count").alias("rows"), F.count(F.lit(1)).alias("entities"))
    limit = quantiles(m, [], "rows", {"q": cap}).select("q").scalar()
    kept = m.withColumn("_q", limit).where((F.col("rows") >= min_rows) & (F.col("rows") <= F.col("_q"))).drop("_q")
    return kept.orderBy(F.desc("rows"), F.asc("manufacturer_code")).limit(n)


def select_choice_pairs(entities: DataFrame, manufacturers: DataFrame, max_pairs: int, substitution_share: float = 0.75) -> DataFrame:
    """Hospital-drug pairs that the chosen manufacturers touch, those with other manufacturers beside them first.

    Up to `substitution_share` of `max_pairs` go to pairs with substitution, the rest to pairs without, and what is
    then left to further pairs with substitution. Order: orders of the chosen manufacturers, number of manufacturers,
    codes. Pairs are counted in one pass with partial sums, so that a hospital or drug of any size is one row per task.
    """
    pair = ["hospital_code", "drug_code"]
    chosen = entities.join(F.broadcast(manufacturers.select("manufacturer_code", F.lit(1).alias("_in"))), "manufacturer_code", "left")
    counted = chosen.groupBy(*pair).agg(
        F.sum(F.when(F.col("_in") == 1, F.col("order_count"))).alias("selected_mfg_order_count"), F.countDistinct(F.when(F.col("_in") == 1, F.col("manufacturer_code"))).alias("selected_mfg_entity_count"),
        F.countDistinct("manufacturer_code").alias("all_manufacturer_count"), F.sum("order_count").alias("all_pair_order_count"), F.count(F.lit(1)).alias("all_pair_entity_count"),
    ).where("selected_mfg_entity_count > 0")
    pairs = counted.withColumn("has_manufacturer_substitution", F.col("all_manufacturer_count") > F.col("selected_mfg_entity_count")).withColumn("_fewer", -F.col("all_manufacturer_count"))
    ranked = sorted_rank(pairs, "selected_mfg_order_count", ["has_manufacturer_substitution"], ["_fewer", *pair], name="selection_rank", total="_size")
    sub = F.col("has_manufacturer_substitution")
    size = lambda c: ranked.agg(F.coalesce(F.max(F.when(c, F.col("_size"))), F.lit(0))).scalar()
    first = int(max_pairs * substitution_share)
    room_with, room_without = F.greatest(F.lit(first), F.lit(max_pairs) - F.col("_without")), F.lit(max_pairs) - F.least(F.col("_with"), F.lit(first))
    kept = ranked.withColumns({"_with": size(sub), "_without": size(~sub)}).where(F.col("selection_rank") <= F.when(sub, room_with).otherwise(room_without))
    reason = F.when(sub, "selected_manufacturer_hospital_drug_with_other_manufacturer_context").otherwise("selected_manufacturer_hospital_drug_single_manufacturer_context")
    return kept.withColumn("choice_set_selection_reason", reason).drop("_fewer", "_size", "_with", "_without")


def extract_coverage(entities: DataFrame, manufacturers: DataFrame, sample: DataFrame) -> DataFrame:
    """Entities and rows covered by the manufacturer scope, the sample, and either."""
    e = entities.withColumn("entity_id", F.concat_ws("|", "manufacturer_code", "hospital_code", "drug_code"))
    e = e.join(manufacturers.select("manufacturer_code", F.lit(1).alias("_m")), "manufacturer_code", "left").join(sample.select("entity_id", F.lit(1).alias("_s")).distinct(), "entity_id", "left")
    a = e.agg(F.sum("order_count").alias("n"), *[F.expr(f"sum(if({c}, order_count, 0)) as r{i}") for i, c in enumerate(["_m = 1", "_s = 1", "_m = 1 or _s = 1"])],
              *[F.expr(f"count_if({c}) as e{i}") for i, c in enumerate(["_m = 1", "_s = 1", "_m = 1 or _s = 1"])])
    rows = ", ".join(f"named_struct('scope', '{s}', 'entity_count', e{i}, 'row_count', coalesce(r{i}, 0), 'row_coverage', coalesce(r{i}, 0) / n)" for i, s in enumerate(["manufacturer", "entity", "union"]))
    return a.selectExpr(f"inline(array({rows}))")
