import pandas as pd

from quillspark.streaming import trace as S


class _State(dict):
    """A value, a map and timers that count their calls."""

    calls = 0

    def __getattribute__(self, name):
        if not name.startswith("_") and name not in ("calls", "items"):
            _State.calls += 1
        return dict.__getattribute__(self, name)

    def get(self):
        return dict.get(self, 0)

    def exists(self):
        return 0 in self

    def update(self, value):
        self[0] = value

    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, key, value):
        self[key] = value

    def getValue(self, key):
        return dict.get(self, key)

    def containsKey(self, key):
        return key in self

    def listTimers(self):
        return []

    def registerTimer(self, at):
        self[1] = at


def test_state_is_read_and_written_once_for_a_notebook():
    s = S.Sessions(60_000, 600_000)
    s.session, s.cells, s.handle = _State(), _State(), _State()
    at = pd.Timestamp("2024-01-01")
    frame = lambda a, b: pd.DataFrame([(1, i, f"c{i % 3}", i % 3, i, "k", i == 50, "h", at + pd.Timedelta(seconds=i)) for i in range(a, b)], columns="nb_id seq cell_id document_index execution_count kernel_id restart source_hash ts".split())
    _State.calls = 0
    out = pd.concat([x for a in (0, 100) for x in s.handleInputRows((1,), iter([frame(a, a + 100)]), None)])
    assert _State.calls < 30
    assert (out["kind"] == "event").sum() == 200 and out["session_no"].max() == 1
    closed = out[out["kind"] == "closed"].iloc[0]
    assert (closed["events"], closed["cells"]) == (50, 3)
    assert {k: v[1] for k, v in s.cells.items()} == {("c0",): 50, ("c1",): 50, ("c2",): 50}
