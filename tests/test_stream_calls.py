"""What a micro-batch costs a key: a few calls to the state store however many frames it holds, and none from Python where an aggregation will do."""

import pandas as pd

from trackloom.streaming import behaviour as B


class Value:
    def __init__(self, calls):
        self.calls, self.now = calls, None

    def exists(self):
        self.calls.append("exists")
        return self.now is not None

    def get(self):
        self.calls.append("get")
        return self.now

    def update(self, new):
        self.calls.append("update")
        self.now = new

    def clear(self):
        self.calls.append("clear")
        self.now = None


class Handle:
    def __init__(self):
        self.calls, self.timers = [], []

    def getValueState(self, name, schema, *more):
        return Value(self.calls)

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.append(at)


class At:
    """Times of a batch and of a timer."""

    def __init__(self, watermark, expired):
        self.getCurrentWatermarkInMs, self.getExpiryTimeInMs = lambda: watermark, lambda: expired


def test_forty_frames_cost_a_key_a_few_calls():
    handle, p = Handle(), B.Convoy(3, 100)
    p.init(handle)
    rows = pd.DataFrame([(f, 1, 2, 0.05, 0.0) for f in reversed(range(40))], columns=["frame_id", "a", "b", "distance", "heading_diff"])
    list(p.handleInputRows(("s",), iter([rows]), None))
    assert handle.timers == [B._time(0)]
    out = pd.concat(p.handleExpiredTimer(("s",), At(B._time(29), 0), At(0, handle.timers[0])))
    assert out["frame_id"].tolist() == [2] and len(handle.calls) < 20
    assert sorted(p.waiting.now[0]) == list(range(30, 40)) and handle.timers[-1] == B._time(30)
    assert p.runs.now == ([1], [2], [30])


def test_jaywalking_is_an_aggregation(spark, tmp_path):
    schema = "sequence_id string, track_id long, frame_id int, class_name string, event_role string, zone_id string"
    plan = B.jaywalking(spark.readStream.schema(schema).parquet(str(tmp_path)))._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan
