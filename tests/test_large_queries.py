"""Whole queries on the large-data path give the same answer as their twins."""
import pytest
import twin

from tidewright import plans

FOLDER = "/root/testdata/sf0.001"
NAMES = ["q_gauge_frame", "jon_asof_nearest", "jon_cascade_matchup", "jon_profile_lookup", "jon_point_in_polygon", "jon_space_time_pairs", "win_fill_runs", "win_regimes",
         "win_error_concentration", "win_rolling_median", "agg_residual_block", "agg_rank_sum", "agg_two_sample_ks", "agg_separation", "top_track_holdout", "ras_coverage_height"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, large_path, name):
    q = plans.registered()[name]
    assert twin.compare(plans.runner(q)(spark, FOLDER), twin.duck(FOLDER).execute(q.sql)) == ""
