"""Registered queries against their oracle SQL on the smallest given tables."""

import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="given tables not present")

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402
from tallyspark.plans.views import TABLES  # noqa: E402
from tools.check import rows  # noqa: E402

CHECKED = [
    "survey_overview_latest", "sector_comparison", "benefit_coverage", "normalisation_report", "governance_scores", "portfolio_overview", "risk_candidates",
    "sector_position", "aligned_statements", "activity_by_account", "user_sessions", "best_subscription", "revenue_by_month", "missing_ranking", "consistency_issues",
    "board_composition", "precedence_merge", "change_set", "document_facts", "statement_lines", "condensed_line_items", "stream_daily_counts", "flattened_tree",
    "exported_portfolio", "exported_group", "stored_pages", "activity_export", "headed_chunks", "headline_backfill", "stream_lockouts", "document_currency", "pages_cited", "survey_overview_by_year",
    "roster_matches", "files_by_name", "condensed_records_lateral", "late_daily_counts", "imported_years", "extracted_fields", "pay_table_gaps", "verification_summary", "stated_board_counts",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "sector" in df.columns


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, str(SF))
    cur = con.execute(entry.oracle_sql()[name])
    want_names, want = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(df.columns) == sorted(want_names)
    assert rows(df.columns, df.collect()) == rows(want_names, want)
