"""The driver's contract, and queries against their SQL on the smallest data."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from cardiolake.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["rr_window_features", "rhythm_spans", "windows_table", "choose_segments", "class_table", "ectopic_runs", "rhythm_rates", "beat_table_learning_test", "alarm_state_machine", "refractory_dedup", "roc_auc", "gaussian_nb", "parse_annotations", "grouping_sets", "index_crosscheck", "label_index_files", "beat_waveform_features", "markers_snapped", "peaks_chunks", "qrs_width_chunks", "fold_preview", "group_split", "stratified_split", "group_folds", "knn_embeddings", "bayes_predictions", "st_t_summary", "annotations_lateral", "page_list_rows", "causal_filter_stream", "ectopy_alert", "windows_with_waveform", "explorer_view", "quality_episodes", "record_notes", "parts_consolidated"]


def normal(frame, columns):
    rows = [tuple("" if pd.isna(v) else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)]
    return sorted(rows)


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(plans.QUERIES) >= 60


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no data")
@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found, want = plans.QUERIES[name](spark, SF).toPandas(), con.execute(plans.ORACLE_SQL[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    assert normal(found, columns) == normal(want, columns)
