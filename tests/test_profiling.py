"""The flagship query's work."""

from tallyward.operators import profile
from workload import profiling

SF_DIR = "/root/testdata/sf0.001"


def test_flagship_query_profiles_the_whole_table(spark, monkeypatch):
    seen, build = [], profile.build_profile
    monkeypatch.setattr(profiling.profile, "build_profile", lambda frame, name: seen.append(frame.columns) or build(frame, name))
    rows = profiling.verified_totals(spark, SF_DIR).collect()
    assert seen == [spark.read.parquet(f"{SF_DIR}/orders.parquet").columns] and len(rows) > 0
