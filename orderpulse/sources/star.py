"""Order tables of the star schema (lineitem, orders, customer, supplier, part, nation, region) as purchase data.

A supplier nation stands for the manufacturer, a customer nation for the hospital, a brand for the drug, a part
for the SKU and a part type for the product line. Status, lifecycle, unit and delivery fields come from the
flag, discount and tax columns by fixed rules, because the star schema has no such fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse.session import input_bytes

# Declared schemas spare the footer reads that inference would need.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
}

#: Bytes of supplier files up to which their keys and nations are sent to every task that reads order lines.
SENT_BYTES = 32 << 20

FAILED = "l_returnflag = 'R' and l_linestatus = 'O'"
PENDING = "l_returnflag = 'N' and l_linestatus = 'O' and o_orderpriority = '1-URGENT'"
REGION = "lpad(cast(n_regionkey as string), 2, '0')"
NATION = "lpad(cast(c_nationkey as string), 2, '0')"
DELIVERED = "cast(floor(l_quantity * (1 - 4 * l_discount)) as double)"

ORDER_COLUMNS = [
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int)) as row_uid",
    "cast(l_orderkey as string) as order_id",
    "concat_ws('-', l_orderkey, l_linenumber) as order_detail_id",
    "to_date(o_orderdate) as order_date",
    "concat('M', lpad(cast(s_nationkey as string), 2, '0')) as manufacturer_code",
    f"concat('H', {NATION}) as hospital_code",
    "p_brand as drug_code",
    "cast(l_partkey as string) as sku_code",
    "p_type as product_line_code",
    "l_quantity as order_quantity",
    "l_extendedprice * (1 - l_discount) as order_amount",
    "l_extendedprice / l_quantity as purchase_unit_price",
    """case when p_brand = 'Brand#13' then null when p_brand = 'Brand#21' and p_size > 25 then 'BAG'
       else 'BOX' end as purchase_unit""",
    f"""case when {FAILED} then 90 when o_orderstatus = 'F' then 80 when o_orderstatus = 'O' then 70
        else 60 end as order_phase_code""",
    f"case when {PENDING} then 0 else 1 end as order_terminal_flag",
    f"case when {FAILED} then 1 else 0 end as order_failure_flag",
    "o_orderpriority = '5-LOW' and l_tax >= 0.075 as needs_manual_review",
    "case l_returnflag when 'A' then 5 when 'N' then 4 else 3 end as delivery_state_code",
    f"""case when {FAILED} then 'rejected' when {PENDING} then 'pending' when l_returnflag = 'A' then 'received'
        else 'completed' end as order_status""",
    f"{DELIVERED} as delivery_quantity",
    f"cast(floor({DELIVERED} * (1 - 2 * l_tax)) as double) as arrival_quantity",
    "to_date(l_shipdate) as delivery_date",
    "o_orderpriority as order_priority",
    f"{REGION} as province_code",
    f"concat({REGION}, {NATION}) as city_code",
    f"concat({REGION}, {NATION}, '01') as county_code",
    "concat('L', c_nationkey % 3) as hospital_level_code",
    "concat('T', c_nationkey % 2) as ownership_type_code",
    "p_type as drug_category_code",
    "p_name as drug_name",
    "c_mktsegment as customer_segment",
    # Uncleaned text fields, as a source system would deliver them.
    f"""case when l_tax < 0.005 and l_linenumber = 6 then null
        when o_orderstatus = 'P' and l_returnflag = 'A' and l_linenumber = 7 then '医院签收'
        when {FAILED} and o_orderpriority in ('1-URGENT', '2-HIGH') then '拒收'
        when {FAILED} then '已撤销(系统)' when {PENDING} then '待确认' when l_returnflag = 'A' then ' 已收货 '
        when l_returnflag = 'N' and l_linestatus = 'F' then '已完成' when l_returnflag = 'N' then '结算完毕'
        else '部分入库' end as order_status_raw""",
    "concat(n_regionkey * 10000 + c_nationkey * 100 + 1, '.0') as county_code_raw",
    """case c_mktsegment when 'FURNITURE' then '990100' when 'MACHINERY' then null
       else concat(lpad(cast(n_regionkey * 100 + c_nationkey as string), 4, '0'), '00') end as city_code_raw""",
    """case when p_size >= 48 then null when p_size >= 40 and p_type = 'PROMO' then concat(p_brand, 'X.0')
       else concat(' ', p_brand, '.0') end as insurance_drug_code""",
    "cast(case when l_returnflag = 'R' then floor(l_quantity / 10) else 0 end as double) as return_quantity",
    f"cast(case when {FAILED} and l_linenumber = 7 then l_quantity else 0 end as double) as void_quantity",
    "case when p_size % 10 > 0 then cast(p_size % 10 as double) end as conversion_factor",
    """case c_nationkey % 5 when 0 then '三级甲等' when 1 then '二级医院' when 2 then '一级' when 3 then '社区中心'
       else '' end as hospital_level_raw""",
    "case c_nationkey % 4 when 0 then '公立医院' when 1 then '民营' when 2 then '合资' end as ownership_type_raw",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line with the full set of raw and cleaned order columns.

    Customers meet the order heads, of which there are fewer than lines. Lines move for their head and for their part
    only: suppliers are sent to them while their files are small. The other join sides are chosen by statistics and
    adaptive execution.
    """
    line, head, cust, supp, part, nation = (
        table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier", "part", "nation")
    )
    head = head.join(cust, head.o_custkey == cust.c_custkey).join(nation, cust.c_nationkey == nation.n_nationkey)
    if input_bytes(supp) <= SENT_BYTES:
        supp = F.broadcast(supp.select("s_suppkey", "s_nationkey"))
    return (
        line.join(supp, line.l_suppkey == supp.s_suppkey)
        .join(head, line.l_orderkey == head.o_orderkey)
        .join(part, line.l_partkey == part.p_partkey)
        .selectExpr(*ORDER_COLUMNS)
    )


def hospital_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey, "left").selectExpr(
        "concat('H', lpad(cast(n_nationkey as string), 2, '0')) as hospital_code",
        "n_name as hospital_name",
        f"{REGION} as region_code",
        "r_name as region_name",
        "concat('L', n_nationkey % 3) as hospital_level",
    )


def manufacturer_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "concat('M', lpad(cast(n_nationkey as string), 2, '0')) as manufacturer_code",
        "concat('MAKER ', n_name) as manufacturer_name",
    )


def drug_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per brand except two, so that unmapped drugs occur; six product lines."""
    return (
        table(spark, sf_dir, "part")
        .where("p_brand not in ('Brand#3', 'Brand#8')")
        .groupBy("p_brand")
        .agg({"p_name": "min", "p_type": "max"})
        .selectExpr(
            "p_brand as drug_code",
            "`min(p_name)` as drug_name",
            "`max(p_type)` as drug_category",
            "concat('PL', cast(substring(p_brand, 7) as int) % 6) as product_line_code",
            "concat('LINE PL', cast(substring(p_brand, 7) as int) % 6) as product_line_name",
        )
    )


def product_line_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drug_master(spark, sf_dir).select("drug_code", "product_line_code", "product_line_name")
