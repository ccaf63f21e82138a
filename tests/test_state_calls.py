"""Keyed state is met in few calls, each of which goes to Spark and back."""

from types import SimpleNamespace

from pyspark.sql import Row

from gazeloom.streaming import streams


class State:
    def __init__(self, calls):
        self.calls, self.held = calls, {}

    def __getattr__(self, name):
        def call(*given):
            self.calls.append(name)
            if name in ("get", "iterator"):
                return iter(list(self.held.items() if name == "iterator" else self.held.get("", [])))
            if name == "removeKey":
                del self.held[given[0]]
            else:
                self.held[given[0] if name == "updateValue" else ""] = given[-1]

        return call


def processor(made):
    calls = []
    made.init(SimpleNamespace(**dict.fromkeys(("getMapState", "getListState", "getValueState"), lambda *_: State(calls))))
    return made, calls


def test_a_key_is_read_in_one_call():
    made, calls = processor(streams.Admission(None))
    row = lambda n, device, unbind=False: Row(event_id=n, ts=n, device=device, is_active=True, max_devices=2, unbind=unbind)
    run = lambda *rows: (calls.clear(), [(r.outcome, r.requests) for r in made.handleInputRows(("k",), iter(rows), None)])[1]
    assert run(row(2, "b"), row(1, "a"), row(3, "c")) == [("accepted", 1), ("accepted", 2), ("device_limit", 2)] and len(calls) == 4
    assert run(row(4, "a")) == [("accepted", 3)] and calls == ["iterator", "updateValue"]
    assert run(row(5, "c")) == [("device_limit", 3)] and calls == ["iterator"]
    assert run(row(6, "a", True), row(7, "#")) == [("accepted", 4)] and sorted(calls) == ["iterator", "removeKey", "updateValue", "updateValue"]


def test_a_session_is_read_and_written_in_two_calls():
    made, calls = processor(streams.RecentTurns(2, None))
    for turns, want in (((3, 1, 2), '[[2, null, "2"], [3, null, "3"]]'), ((4,), '[[3, null, "3"], [4, null, "4"]]')):
        calls.clear()
        assert [r.turns for r in made.handleInputRows((1,), iter([Row(turn=t, role=None, text=str(t)) for t in turns]), None)] == [want]
        assert calls == ["get", "put"]
