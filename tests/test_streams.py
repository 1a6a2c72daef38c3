import datetime as dt

import pandas as pd

from signalweave.streaming import streams

T0 = dt.datetime(2026, 6, 18)


def test_event_batches_keep_earlier_assignments(spark, tmp_path):
    path = str(tmp_path / "events")
    run = streams.assign_batches(spark, path, 0.9)
    schema = "id long, at long, content_hash string, vec array<double>"
    run(spark.createDataFrame([(1, 1, "a", [1.0, 0.0]), (2, 2, "b", [0.0, 1.0])], schema), 0)
    second = spark.createDataFrame([(3, 3, "c", [1.0, 0.01]), (4, 4, "b", [0.0, 1.0]), (5, 5, "e", [0.7, -0.7]), (6, 6, "f", [0.71, -0.7]), (7, 7, "f", [0.71, -0.7])], schema)
    for _ in range(2):  # a batch that is run again changes nothing
        run(second, 1)
    assert spark.read.parquet(path).count() == 7
    assert {r.id: r.event_id for r in spark.read.parquet(path).collect()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5, 6: 5, 7: 5}


class _State:
    """What a key's function sees of its state."""

    def __init__(self, watermark):
        self.watermark, self.kept, self.timeouts = watermark, None, []

    exists = property(lambda self: self.kept is not None)
    get = property(lambda self: self.kept)

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, kept):
        self.kept = kept

    def setTimeoutTimestamp(self, at):
        self.timeouts.append(at)


def test_a_repository_has_one_timeout_however_many_hours_it_waits_for():
    hour, run, state = 3_600_000, streams._rises(3_600_000), _State(0)
    frame = pd.DataFrame({"captured_at": pd.to_datetime([h * hour for h in reversed(range(100))], unit="ms"), "id": range(100), "stars": range(100, 0, -1)})
    assert list(run((7,), iter([frame]), state)) == [] and state.timeouts == [hour - 1]
    state.watermark = 50 * hour
    out = pd.concat(run((7,), iter([]), state))
    assert out["stars"].tolist() == list(range(2, 51)) and set(out["gained"]) == {1}
    assert state.timeouts == [hour - 1, 51 * hour - 1] and len(state.kept[0]) == 50 and state.kept[3] == 50
