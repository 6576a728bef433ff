"""Derived images against plain counting."""

from datetime import datetime

from voxelarium.plans import tables


def test_events_of_all_users_count(spark, tmp_path):
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = [(u, kinds[u % 5], datetime(2024, 1, u % 30 + 1), u % 7 + 0.25) for u in range(0, 1500, 3)]
    spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for u, kind, ts, value in rows:
        vox = u % 8 + 1 + u // 8 % 19 * 8 + kinds.index(kind) * 152
        want[vox, ts.day] = want.get((vox, ts.day), 0) + round(value * 100)
    got = tables.vec_ev(spark, str(tmp_path)).data.collect()
    assert {(r.vox, r.t): r.value for r in got} == want
    assert sum(r.value for r in got) == sum(round(v * 100) for *_, v in rows)
