import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["value_top10", "quant_scores", "stock_risk", "template_backtest", "market_regime", "universe", "event_marks_stream", "f_score", "csv_dataset", "provider_payloads", "annual_facts", "instant_facts", "annual_pairs", "filing_counts", "insider_scores", "crsp_delisted", "linked_statements", "market_index", "aligned_prices", "quarterly_ratios", "restated_series", "schedules", "index_report", "source_coverage", "metrics_panel", "theme_fit", "alerts", "ic_breakdowns", "earnings_events", "style_weights", "mandate_terms", "style_tilts", "best_templates", "signal_stability", "portfolio_weights", "value_book_decisions", "tilted_candidates", "neutral_styles", "company_panel", "mandate_check", "data_quality", "cross_section"]


def plain(v):
    return round(v, 5) if isinstance(v, float) and not math.isnan(v) else None if v is None or isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    for t in os.listdir(SF):
        duckdb.sql(f"create or replace view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=str)
    sql = entry.oracle_sql()[name]
    theirs = sorted(([plain(v) for v in r] for r in duckdb.sql(f"select {', '.join(cols)} from ({sql})").fetchall()), key=str)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert all(x == y or isinstance(x, float) and abs(x - y) < 1e-4 for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
