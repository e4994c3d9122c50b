"""Checks on small frames whose failing rows are known."""

from orderpulse.operators import checks as K


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_order_report_names_each_failing_row(spark):
    schema = "row_uid string, order_id string, order_date string, purchase_qty string, purchase_price double, conversion_factor double, delivery_qty double, receipt_qty double, org_code string, drug_code string"
    good = ("r0", "o0", "2024-01-01", "2", 1.0, 1.0, 2.0, 2.0, "h", "d")
    bad = [
        ("r1", "o1", "not a day", "2", 1.0, 1.0, 2.0, 2.0, "h", "d"), ("r2", "o2", "2024-01-01", "x", -1.0, 1.0, 2.0, 2.0, "h", "d"),
        ("r3", "o3", "2024-01-01", "2", 1.0, 0.0, 3.0, 4.0, " ", None), *[(f"s{k}", "o9", "2024-01-01", "2", 1.0, 1.0, None, 2.0, "h", "d") for k in range(7)],
        ("t1", None, "2024-01-01", "2", 1.0, 1.0, 2.0, 2.0, "h", "d"), ("t2", None, "2024-01-01", "2", 1.0, 1.0, 2.0, 2.0, "h", "d"),
    ]
    orders = spark.createDataFrame([good, *bad], schema)
    assert rows(K.order_report(orders), "check_name", "severity", "row_count", "sample_refs") == sorted([
        ("order_time_parseable", "error", 1, "r1"), ("purchase_qty_non_negative", "error", 1, "r2"), ("purchase_price_non_negative", "error", 1, "r2"),
        ("conversion_factor_valid", "warning", 1, "r3"), ("delivery_qty_gt_purchase_qty", "warning", 1, "r3"), ("receipt_qty_gt_delivery_qty", "warning", 1, "r3"),
        ("org_code_not_empty", "error", 1, "r3"), ("drug_code_not_empty", "error", 1, "r3"), ("order_id_unique", "warning", 9, "s0,s1,s2,s3,s4"),
    ])
    assert K.order_report(orders.where("row_uid = 'r0'")).count() == 0
    assert rows(K.order_report(orders.drop("org_code", "purchase_qty")), "check_name", "row_count", "sample_refs") == [("required_fields", 13, "purchase_qty, org_code")]
    assert ("delivery_qty_gt_purchase_qty",) not in rows(K.order_report(orders.drop("delivery_qty")), "check_name")
    assert ("receipt_qty_gt_delivery_qty",) not in rows(K.order_report(orders.drop("delivery_qty")), "check_name")


def test_duplicate_samples_keep_whole_keys(spark):
    df = spark.createDataFrame([("b", 1), ("b", 2), ("a", 3), ("c", 4), ("c", 5), ("c", 6), (None, 7), (None, 8)], "k string, v int")
    assert rows(K.duplicate_samples(df, "k", ["v"]), "k", "v") == [("b", 1), ("b", 2), ("c", 4), ("c", 5), ("c", 6)]
    assert rows(K.duplicate_samples(df, "k", ["v"], 1), "k", "v") == [("b", 1), ("b", 2)]


def test_contract_checks_fail_where_they_should(spark):
    parents = spark.createDataFrame([("p1", "fine"), ("p2", "it is certain"), ("p2", None)], "id string, note string")
    children = spark.createDataFrame([("p1",), ("p3",), ("p3",), (None,)], "id string")
    found = K.contract_checks(
        {"parents": parents, "children": children}, {"parents": ["id", "note"], "children": ["id", "code"]}, {"parents": ["id"]},
        {"parents": {"full": 3, "persisted": 5}, "children": {"full": 4, "persisted": None}}, [("children", "parents", "id")], {"parents": ["note", "other"]}, ["certain", "proven"],
    )
    assert rows(found, "table_name", "check_name", "failing", "status") == sorted([
        ("parents", "required_columns", 0, "pass"), ("children", "required_columns", 1, "fail"), ("parents", "unique_id", 2, "fail"), ("parents", "row_count", 2, "fail"),
        ("children", "row_count", 1, "fail"), ("children", "id_in_parents", 2, "fail"), ("parents", "no_forbidden_text", 1, "fail"),
    ])
    none = K.contract_checks({"p": parents.limit(0)}, {}, {"p": ["id"]}, {"p": {"full": None, "persisted": None}}, [], {"p": ["note"]}, ["certain"])
    assert rows(none, "check_name", "failing") == [("no_forbidden_text", 0), ("unique_id", 0)]


def test_training_frames(spark):
    df = spark.createDataFrame([(1, 1, None), (1, None, None), (1, 0, 2.0)], "label_die_H3 int, label_die_H6 int, x double")
    assert rows(K.label_distribution(df, [3, 6, 12]), "horizon", "row_count", "known_labels", "positive_rate") == [("H3", 3, 3, 1.0), ("H6", 3, 2, 0.5)]
    assert rows(K.column_report(df, ["label_die_H6", "x"]), "column", "dtype", "null_count", "forbidden") == [("label_die_H6", "int", 1, True), ("x", "double", 2, False)]
    warned = lambda d, label, limit=0.6: [w for (w,) in rows(K.training_warnings(d, label, ["x"], limit), "warning")]
    assert warned(df, "label_die_H3") == ["HIGH_MISSING_x", "SINGLE_CLASS_LABELS"] and warned(df, "label_die_H6", 0.7) == []
    assert warned(df.where("label_die_H6 is null"), "label_die_H6") == ["HIGH_MISSING_x", "NO_KNOWN_LABELS"]
    assert warned(df.limit(0), "label_die_H3") == ["EMPTY_TRAINING_DATASET"]
    assert rows(K.column_report(df.limit(0), ["x"]), "null_count", "null_rate") == [(0, 0.0)]


def test_table_summaries(spark):
    df = spark.sql("select date'2024-01-02' as d, 1 as n union all select date'2023-05-06', 2")
    got = rows(K.table_summaries({"a": (df, "d"), "b": (df.select("n"), None)}), "table_name", "row_count", "column_count", "columns")
    assert got == [("a", 2, 2, "d,n"), ("b", 2, 1, "n")]
