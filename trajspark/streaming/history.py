"""The last actions of each episode while its steps stream in, in any order: `steps.history` and `steps.runs` with state.

State of an episode: the next step that is due, the last values, the length of the current run, and steps that came too early. A step goes out as soon as all
before it have, so its history is the one that a batch job would find. Steps that repeat one already out are dropped, which makes replayed input harmless.
With `patience`, an episode that gets nothing for so many milliseconds is closed: what waits goes out in order, as if the missing steps did not exist, and its state goes. Memory then
grows with the steps that wait and with open episodes, not with the stream. Such a stream never ends by itself, because time alone can close episodes; a backlog that is read once
(`available_now`) goes without patience, and steps behind a gap stay in the state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

OUT = "episode_id long, step_index int, value string, history array<string>, run_length int"
_STATE = "due int, history string, run int, waiting string"


class Episode:
    """What is known of an episode: steps go in, steps with history come out."""

    def __init__(self, depth: int, due: int = 0, history: list | None = None, run: int = 0, waiting: dict | None = None):
        self.depth, self.due, self.history, self.run, self.waiting = depth, due, history or [], run, waiting or {}

    def take(self, step: int, value: str | None) -> None:
        if step >= self.due:
            self.waiting[step] = value

    def _out(self, step: int) -> tuple:
        value = self.waiting.pop(step)
        self.run = self.run + 1 if self.due and self.history and self.history[-1] == value else 1
        row = (step, value, [x for x in self.history[-self.depth :] if x is not None], self.run)
        self.history, self.due = [*self.history, value][-max(self.depth, 1) :], step + 1
        return row

    def ready(self) -> Iterator[tuple]:
        while self.due in self.waiting:
            yield self._out(self.due)

    def rest(self) -> Iterator[tuple]:
        for step in sorted(self.waiting):
            yield self._out(step)

    def state(self) -> tuple:
        return self.due, json.dumps(self.history), self.run, json.dumps(self.waiting)

    @classmethod
    def of(cls, depth: int, state: tuple) -> "Episode":
        due, history, run, waiting = state
        return cls(depth, due, json.loads(history), run, {int(k): v for k, v in json.loads(waiting).items()})


def with_history(steps: DataFrame, depth: int = 5, patience: int | None = None) -> DataFrame:
    """episode_id, step_index, value, history (up to `depth` values before), run_length of a stream of steps (episode_id, step_index, value)."""

    def advance(key, frames, state):
        episode = Episode.of(depth, state.get) if state.exists else Episode(depth)
        if state.hasTimedOut:
            out = list(episode.rest())
            state.remove()
        else:
            for frame in frames:
                for step, value in zip(frame["step_index"], frame["value"]):
                    episode.take(int(step), value)
            out = list(episode.ready())
            state.update(episode.state())
            if patience:
                state.setTimeoutDuration(patience)
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=["episode_id", "step_index", "value", "history", "run_length"])

    rows = steps.select(F.col("episode_id").cast("long").alias("episode_id"), F.col("step_index").cast("int").alias("step_index"), F.col("value").cast("string").alias("value")).where("episode_id IS NOT NULL AND step_index >= 0")
    return rows.groupBy("episode_id").applyInPandasWithState(advance, OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if patience else GroupStateTimeout.NoTimeout)
