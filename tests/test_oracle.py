"""Registered queries against their SQL in DuckDB at the smallest scale."""

import duckdb
import pytest

from evenhand.plans import catalog
from tools.compare import TABLES, compare

SF = "/root/testdata/sf0.001"
FAMILIES = {
    "metrics": "weighted_auc site_balanced_auc auc_by_site pr_auc_by_site cumulative_counts roc_points threshold_metrics weighted_threshold_metrics brier fold_metrics",
    "tests": "mid_ranks mann_whitney kruskal_wallis chi2_independence bh_fdr cliffs_delta spearman",
    "resampling": "stratified_bootstrap_ci class_bootstrap_ci paired_bootstrap",
    "sources": "csv_round_trip entity_records box_xml id_list line_manifest incremental_append incremental_stream",
    "rules": "first_failing_rule eligibility_filter map_label_rules extract_token slugify coerce_numeric",
    "joins": "membership_join pairwise_overlap best_container nearest_neighbour_scan",
    "aggregates": "collection_summary entry_rollup numeric_summary category_distribution bag_size_stats",
    "windows": "first_per_key earliest_group zscore_within pick_probes concentration adaptive_top_bottom gap_stats farthest_points",
    "splits": "stratified_kfold repeated_kfold inner_kfold holdout_split strata_weights leave_one_site_out",
    "harmonise": "median_impute combat_fit combat_fit_balanced eb_shrink combat_apply combat_new_site fit_apply_chain map_destination_prior",
    "select": "within_site_auc_rank anova_f abs_corr_matrix corr_prune_topk",
    "audit": "frame_fingerprint snapshot_diff evaluate_gate lattice_report position_features",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for names in FAMILIES.values() for n in names.split()])
def test_query_agrees(spark, duck, name):
    q = catalog()[name]
    df = q.build(spark, SF)
    cur = duck.execute(q.sql)
    assert compare(df.columns, [tuple(r) for r in df.collect()], [d[0] for d in cur.description], cur.fetchall()) is None


def test_catalog_is_named_plainly():
    for name, q in catalog().items():
        assert name.replace("_", "").isalnum() and not name.startswith("op")
        assert q.sql is None or "SELECT" in q.sql
