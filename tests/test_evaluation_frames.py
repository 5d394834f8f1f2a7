"""The registered evaluation queries score the whole table, not its first frames."""

import datetime as dt

from pyspark.sql import functions as F

from trackloom.plans import registry as R


def test_evaluation_scores_all_frames(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(k * 60 + f, k, start + dt.timedelta(hours=12 * f, minutes=1), '{"k": 1}') for k in range(1, 5) for f in range(60)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, props string").write.parquet(str(tmp_path / "events.parquet"))
    sf = str(tmp_path)
    t, p = R.truth_and_predictions(spark, sf)
    assert t.count() == R.states(spark, sf).count() == 240
    assert p.agg(F.countDistinct("frame_id")).head()[0] == t.agg(F.countDistinct("frame_id")).head()[0] == 60
    r = R.QUERIES["a11_mota"](spark, sf).head()
    assert r.matches + r.misses == 240 and r.matches + r.false_positives == p.count()
