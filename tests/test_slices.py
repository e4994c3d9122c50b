"""Work in slices: the same rows as in one go, and no shuffle files left behind."""

import datetime as dt
import time

import pytest

from orderpulse import session
from orderpulse.operators import facts, snapshot
from orderpulse.schemas import ENTITY, STATIC_COLUMNS
from orderpulse.sources import star

DAY = dt.date(2000, 1, 3)


@pytest.fixture
def small_slices(monkeypatch):
    monkeypatch.setattr(session, "SLICE_BYTES", 1)


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(i).isShuffle() for i in range(blocks.size()))


def settled(spark, want):
    for _ in range(50):
        if shuffle_files(spark) <= want:
            return True
        time.sleep(0.1)
    return False


def listed(df):
    return sorted((tuple(r.asDict().items()) for r in df.collect()), key=repr)


def test_every_row_is_in_one_slice(spark, tmp_path, small_slices):
    rows = [(None if i % 7 == 0 else f"k{i % 40}", i) for i in range(300)]
    spark.createDataFrame(rows, "k string, v int").write.parquet(path := str(tmp_path / "t"))
    parts = session.slices(spark.read.parquet(path), ["k"])
    assert len(parts) == session.MOST_SLICES
    found = [[tuple(r) for r in p.collect()] for p in parts]
    assert sorted(sum(found, []), key=lambda r: r[1]) == rows
    keys = [{k for k, _ in part} for part in found]
    assert sum(map(len, keys)) == len(set().union(*keys)) == 41 and all(keys)
    assert len(session.slices(spark.createDataFrame(rows, "k string, v int"), ["k"])) == 1


def test_a_cut_frame_leaves_no_shuffle_files(spark):
    frame = spark.range(5000).selectExpr("id % 700 as k", "id as v").groupBy("k").sum("v")
    before = shuffle_files(spark)
    cut = session.cut_lineage(frame)
    assert settled(spark, before)
    assert cut.count() == 700 and cut.where("k = 1").first()[1] == sum(range(1, 5000, 700))
    assert spark.conf.get(session.SWEEP) == "false"


def test_stored_rows_are_read_back_and_removed(spark, tmp_path):
    parts = [spark.range(k, k + 3).selectExpr("id", "if(id = 1, null, cast(id as string)) as s").repartition(2, "id") for k in (0, 3, 6)]
    before = shuffle_files(spark)
    rows, path = session.stored(iter(parts), spark)
    assert sorted((r["id"], r["s"]) for r in rows.collect()) == [(i, None if i == 1 else str(i)) for i in range(9)]
    assert settled(spark, before)
    session.remove(spark, path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def order_rows():
    out = []
    for i in range(400):
        maker = None if i % 31 == 0 else f"m{i % 3}"
        unit = None if i % 11 == 0 else "BAG" if i % 3 == 2 and i % 5 == 0 else "BOX"
        price = None if i % 23 == 0 else 2.0 + (i * 7 % 13) / 4
        out.append((maker, f"h{i % 4}", f"d{i % 2}", None if i % 37 == 0 else f"o{i // 2}", f"r{i}", DAY + dt.timedelta(days=i * 17 % 200), float(1 + i % 9), None if i % 29 == 0 else 1.5 * i, price, unit))
    return out


SCHEMA = "manufacturer_code string, hospital_code string, drug_code string, order_id string, row_uid string, order_date date, order_quantity double, order_amount double, purchase_unit_price double, purchase_unit string"


def test_snapshot_in_slices(spark, tmp_path, monkeypatch):
    spark.createDataFrame(order_rows(), SCHEMA).write.parquet(path := str(tmp_path / "orders"))
    dates = ["2000-04-01", "2000-06-30", "2000-07-20"]
    whole = listed(snapshot.detector_snapshot(spark.read.parquet(path), dates))
    monkeypatch.setattr(session, "SLICE_BYTES", 1)
    before = shuffle_files(spark)
    made = snapshot.detector_snapshot(spark.read.parquet(path), dates)
    assert settled(spark, before)
    assert len(whole) > 30 and listed(made) == whole


def test_months_in_slices(spark, tmp_path, small_slices):
    events = [
        (m, "h", "g", o, f"r{i % 60}", DAY + dt.timedelta(days=i * 3 % 90), None if i % 5 else float(i), None if i % 4 == 0 else f"p{i % 3}", i % 3)
        for i in range(200) for m in ["m1" if i % 2 else "m2" if i % 3 else None] for o in [None if i % 17 == 0 else f"o{i % 90}"]
    ]
    frame = spark.createDataFrame(events, "manufacturer_code string, hospital_code string, drug_group string, order_detail_id string, row_uid string, purchase_time date, q double, c string, phase int").selectExpr(
        *ENTITY, "order_detail_id", "row_uid", "purchase_time", "last_day(purchase_time) as purchase_month",
        *[f"q as raw_sensitive_{k}" for k in ("purchase_quantity", "purchase_amount", "delivery_quantity", "arrival_quantity")],
        *[f"if(phase = {i % 3}, null, c) as {c}" for i, c in enumerate(STATIC_COLUMNS)],
        "phase as order_phase_code", "5 as delivery_state_code", "phase as order_failure_flag", "1 as order_terminal_flag")
    frame.write.parquet(path := str(tmp_path / "events"))
    read = spark.read.parquet(path)
    assert len(session.slices(read, ["order_detail_id"])) == session.MOST_SLICES
    one, many = facts.entity_month(read), facts.settled_entity_month(read)
    assert one.dtypes == many.dtypes and listed(one) == listed(many) and many.count() == 9
    lean, left_out = facts.settled_entity_month(read, attributes=False), [*STATIC_COLUMNS, *[f"last_{c}_in_month" for c in facts.STATUS]]
    assert lean.dtypes == one.dtypes and listed(lean.drop(*left_out)) == listed(one.drop(*left_out))
    assert all(r[c] is None for r in lean.collect() for c in left_out)


def test_order_lines_move_for_their_head_and_their_part(spark, tmp_path):
    """Suppliers and customers cost the lines no shuffle of their own."""
    names = {"lineitem": 40, "orders": 20, "customer": 6, "supplier": 5, "part": 4}
    for t, n in names.items():
        columns = [c.rsplit(" ", 1) for c in star.SCHEMAS[t].split(", ")]
        value = {"bigint": "cast(id % {m} as bigint)", "int": "cast(id % 3 as int)", "string": "'x'", "double": "cast(id % 7 + 1 as double)", "timestamp_ntz": "timestamp_ntz'2000-01-05 00:00:00'"}
        sizes = {"l_orderkey": 25, "l_partkey": 5, "l_suppkey": 6, "o_custkey": 7}
        spark.range(n).selectExpr(*[f"{value[k].format(m=sizes.get(c, n))} as {c}" for c, k in columns]).write.parquet(f"{tmp_path}/{t}.parquet")
    spark.range(2).selectExpr("cast(id as int) as n_nationkey", "'N' as n_name", "cast(id as int) as n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = star.raw_orders(spark, str(tmp_path))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(l_") == 2 and "hashpartitioning(l_suppkey" not in plan
        # Heads 0 to 19 of 25, parts 0 to 3 of 5, suppliers 0 to 4 of 6, customers 0 to 5 of 7, nations 0 and 1 of 3.
        want = [i for i in range(40) if i % 25 < 20 and i % 5 < 4 and i % 6 < 5 and (i % 25) % 7 < 6 and ((i % 25) % 7) % 3 < 2]
        assert rows.count() == len(want) > 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
