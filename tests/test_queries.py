import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["f1_overview", "f5_site_risk", "f7_barrier_analysis", "f8_patterns", "g1_weekly_trend", "d9_review_queue", "e4_latest_review", "b15_import_guard",
           "b18_file_overrides", "c4_negation_window", "c12_languages", "c34_detected_rules", "j2_similar_reports", "k6_signals", "l11_split_rows", "n4_weekly_stream",
           "c6_longest_matches", "c15_report_scores", "c30_findings", "c32_replaced_analyses", "c35_phrase_use", "b20_error_channel", "b21_failing_import", "n5_full_trend", "l13_unique_texts",
           "l14_orders_dictionary", "d8_export_table", "d11_detail_pages"]


def shown(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


def test_names_match():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    relation = con.sql(entry_points.oracle_sql()[name])
    columns = sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    expected = sorted([shown(r[i]) for i in at] for r in relation.fetchall())
    got = entry_points.queries()[name](spark, folder)
    assert sorted(got.columns) == columns
    assert sorted([shown(r[c]) for c in columns] for r in got.collect()) == expected
