"""Group priors learn from every first purchase whose label is known, whenever it was."""

import duckdb

from orderpulse.catalog import base, models

COLUMNS = "manufacturer_code string, drug_category_code string, province_code string, hospital_level_code string, first_purchase_time date, label_window_end_H6 date, label_repeat_H6 int"


def test_priors_cover_every_closed_window(spark, monkeypatch):
    rows = [("m1", "d1", "p1", "l1", f"{y}-03-01", f"{y}-09-01", y % 2) for y in range(1992, 2001)]
    rows += [("m2", "d1", "p1", "l1", "1997-05-01", "1997-11-01", 1), ("m2", "d2", "p2", "l2", "2001-01-01", "2001-07-01", None)]
    samples = spark.createDataFrame(rows, COLUMNS.replace("date", "string")).selectExpr(*[f"cast({n} as {t}) as {n}" for n, t in (c.split() for c in COLUMNS.split(", "))])
    monkeypatch.setattr(models.EV, "samples", lambda spark, sf: samples)
    got = {tuple(r) for r in base.QUERIES["model_group_priors"](spark, "").select("group_name", "group_key", "group_count", "group_positive_count", "smoothed_repeat_rate").collect()}
    assert {r[:4] for r in got if r[0] == "manufacturer"} == {("manufacturer", "m1", 9, 4), ("manufacturer", "m2", 1, 1)}
    con = duckdb.connect()
    con.execute(f"create table fps ({COLUMNS.replace('string', 'varchar')})")
    con.executemany("insert into fps values (?, ?, ?, ?, ?, ?, ?)", rows)
    want = {tuple(r) for r in con.execute(f"select group_name, group_key, group_count, group_positive_count, smoothed_repeat_rate from ({base.ORACLES['model_group_priors']})").fetchall()}
    assert got == want
