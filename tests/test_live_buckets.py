"""Live state with many sessions in a bucket: few calls to the store, one frame."""

from agentmeter.streaming import live
from tests.test_streaming import Handle, frame


def test_a_session_costs_three_calls_and_a_bucket_one_frame():
    calls = []

    class Counted(Handle):
        def getMapState(self, name, *_):
            held = super().getMapState(name)
            for call in ("containsKey", "getValue", "updateValue"):
                setattr(held, call, (lambda plain, call: lambda *x: (calls.append(call), plain(*x))[1])(getattr(held, call), call))
            return held

    state = live.LiveState(60_000)
    state.init(Counted())
    for start in (0, 100):
        rows = [(s, (start + r) * 1_000_000, "request", start + r, 1, 10, s, False) for r in range(50) for s in range(20)]
        (got,) = state.handleInputRows((7,), iter([frame(rows[:300]), frame(rows[300:])]), None)
        assert sorted(got.session_id) == list(range(20)) and set(got.task_nano_usd) == {500 if start == 0 else 1000}
        assert len(calls) <= 20 * 3
        calls.clear()
