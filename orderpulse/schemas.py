"""Key columns, table schemas and fixed parameter values."""

from __future__ import annotations

from pyspark.sql import types as T

ENTITY = ["manufacturer_code", "hospital_code", "drug_group"]
ORDER_ENTITY = ["manufacturer_code", "hospital_code", "drug_code"]
PAIR = ["hospital_code", "drug_group"]
HORIZONS = [3, 6, 12]
MAX_MONITOR_GAP_MONTHS = 12
DAYS_PER_MONTH = 30.4375

# Columns of the raw monthly batch tables.
RAW_TABLES: dict[str, T.StructType] = {
    "orders": T.StructType([
        T.StructField("order_id", T.StringType()),
        T.StructField("order_date", T.DateType()),
        T.StructField("manufacturer_code", T.StringType()),
        T.StructField("hospital_code", T.StringType()),
        T.StructField("drug_code", T.StringType()),
        T.StructField("order_quantity", T.DoubleType()),
        T.StructField("order_amount", T.DoubleType()),
        T.StructField("distributor_code", T.StringType()),
        T.StructField("order_status", T.StringType()),
        T.StructField("delivery_status", T.StringType()),
        T.StructField("delivery_date", T.DateType()),
        T.StructField("arrival_date", T.DateType()),
    ]),
    "drug_master": T.StructType([
        T.StructField("drug_code", T.StringType()),
        T.StructField("drug_name", T.StringType()),
        T.StructField("drug_category", T.StringType()),
        T.StructField("product_line_code", T.StringType()),
        T.StructField("product_line_name", T.StringType()),
    ]),
    "hospital_master": T.StructType([
        T.StructField("hospital_code", T.StringType()),
        T.StructField("hospital_name", T.StringType()),
        T.StructField("region_code", T.StringType()),
        T.StructField("region_name", T.StringType()),
        T.StructField("hospital_level", T.StringType()),
    ]),
    "product_line_mapping": T.StructType([
        T.StructField("drug_code", T.StringType()),
        T.StructField("product_line_code", T.StringType()),
        T.StructField("product_line_name", T.StringType()),
    ]),
    "delivery_events": T.StructType([
        T.StructField("order_id", T.StringType()),
        T.StructField("delivery_date", T.DateType()),
        T.StructField("arrival_date", T.DateType()),
        T.StructField("delivery_status", T.StringType()),
    ]),
    "price_reference": T.StructType([
        T.StructField("drug_code", T.StringType()),
        T.StructField("reference_price", T.DoubleType()),
    ]),
}
REQUIRED_RAW_TABLES = ["orders", "drug_master", "hospital_master"]
REQUIRED_ORDER_COLUMNS = [
    "order_date", "manufacturer_code", "hospital_code", "drug_code", "order_quantity", "order_amount",
]

# Columns of the cleaned orders that the daily detectors read.
DETECTOR_ORDERS = T.StructType([
    T.StructField("row_uid", T.StringType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("order_date", T.DateType()),
    T.StructField("manufacturer_code", T.StringType()),
    T.StructField("hospital_code", T.StringType()),
    T.StructField("drug_code", T.StringType()),
    T.StructField("order_quantity", T.DoubleType()),
    T.StructField("order_amount", T.DoubleType()),
    T.StructField("purchase_unit", T.StringType()),
    T.StructField("purchase_unit_price", T.DoubleType()),
    T.StructField("order_phase_code", T.IntegerType()),
    T.StructField("order_terminal_flag", T.IntegerType()),
    T.StructField("order_failure_flag", T.IntegerType()),
    T.StructField("needs_manual_review", T.BooleanType()),
])
NORMAL_PHASES = [60, 70, 80]

STATIC_COLUMNS = [
    "province_code", "city_code", "county_code", "hospital_level_code", "ownership_type_code",
    "drug_category_code",
]
