"""The step loop over a stream: one small state per run, steps in the order they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hushframe.plans.planner import STALL, STEPS


class Loop:
    """(steps seen, last signature, stalls, stopped) of a run."""

    def __init__(self, most: int = STEPS, stall: int = STALL, state: tuple[int, str | None, int, bool] = (0, None, 0, False)):
        self.most, self.stall, self.state = most, stall, state

    def step(self, signature: str, kind: str | None, executed: bool | None) -> str | None:
        """Why the run stops at this step, or None; a stopped run stays stopped."""
        n, last, stalls, stopped = self.state
        if stopped:
            return None
        n += 1
        stalls = stalls + 1 if signature == last else 0
        why = None
        if kind is None or kind == "noop":
            why = "done"
        elif not executed:
            why = "action failed"
        elif stalls >= self.stall:
            why = "stalled"
        elif n == self.most:
            why = "done" if self.most == 1 else "limit"
        self.state = (n, signature, stalls, why is not None)
        return why


def watch_loops(steps: DataFrame, most: int = STEPS, stall: int = STALL, idle: str = "1 hour") -> DataFrame:
    """(run_id, stopped_at, reason) as each run stops, from a stream of (run_id long, n int, signature, kind, executed). Idle runs are forgotten."""
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        loop, out = Loop(most, stall, state.get if state.exists else (0, None, 0, False)), []
        for frame in frames:
            for row in frame.sort_values("n").itertuples():
                if (why := loop.step(row.signature, row.kind, row.executed)) is not None:
                    out.append((key[0], loop.state[0], why))
        state.update(loop.state)
        state.setTimeoutDuration(ms)
        yield pd.DataFrame(out, columns=["run_id", "stopped_at", "reason"])

    return steps.groupBy("run_id").applyInPandasWithState(
        run, "run_id long, stopped_at int, reason string", "n int, last string, stalls int, stopped boolean", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
