"""Registered market queries against their SQL, on the tables of the driver."""

import pytest

from tests.compare import difference
from tidemark import catalog

SF = "/root/testdata/sf0.01"
QUICK = "symbols ohlcv_last_n quote_filter symbol_summary status_counts clean_bars validate_ohlcv missing_bars return_spikes zero_volume ohlc_sanity price_gaps upsert_bars price_matrix_wide universe_summary corr_matrix ema rsi macd atr alpha_002 skew_60 kurt_60 cs_rank_vol barrier_labels purged_splits covariance parametric_var position_limits market_impact ledger_pnl positions quote_stream_dedup quote_bars_tumbling quality_stats quote_liveness gate_rate var_gate history_source history_report quote_feed quote_upsert bars_window risk_log quality_gate breaker_stream price_fill quote_bars_stream covariance_cached ledger_log ohlcv_json metrics_text all_metrics backtest_daily ic_decay order_gate_summary feature_matrix ensemble_pipeline".split()


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    assert difference(spark, catalog.queries()[name], catalog.oracle_sql()[name], SF) == ""


def test_flagship_has_rows(spark):
    assert catalog.flagship(spark, "/root/testdata/sf0.001").limit(1).count() == 1
