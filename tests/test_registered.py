"""A cross-section of the registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, canon

SF = "/root/testdata/sf0.001"
NAMES = [
    "clean_status_lifecycle", "clean_order_eligibility", "fact_entity_month", "fact_purchase_sequence", "feature_asof_counters",
    "feature_trailing_windows", "feature_interval_statistics", "feature_baseline_scores", "score_rule_baseline", "snapshot_gap_median_mad",
    "snapshot_market_reference", "detector_purchase_interval_ipi", "detector_low_price_warning", "event_aggregates_batch",
    "event_user_aggregates_stream", "label_alive", "metric_roc_auc", "metric_topk_ranking", "survival_state", "candidates_top_pct_min_fill",
    "rule_rate_drop_test", "serve_page", "audit_stratified_sample",
]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns, dtype=object)
    cur = duck.execute(entry.oracle_sql()[name])
    want = pd.DataFrame(cur.fetchall(), columns=[c[0] for c in cur.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(canon(got), canon(want))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
