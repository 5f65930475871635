"""Utterances in a stream of frames, with state for each key: the streaming form of operators.utterances.

Frames of a key arrive in order from batch to batch and in any order inside a batch. Control rows in the same stream end
the running utterance ("finish") or forget it ("reset"). Each key's state is five numbers, kept by the state store, so a
restart from the checkpoint goes on where the stream stopped. Where `idle_ms` is given, that much processing time without
a frame ends an utterance that its source never finished; leave it out with the availableNow trigger, which would wait
for such timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.utterances import FIRST_BLOCK, MOST, NEXT_BLOCK, SILENCE

STATE = "n long, start long, quiet int, frames int, waiting int, handed int"
EVENTS = "type string, n long, start long, frames int"
FRAME_BYTES = 3200


class UtteranceMachine:
    """One key's frames, one by one; `emit` gathers (type, n, start, frames)."""

    def __init__(self, threshold: float, silence: int = SILENCE, most: int = MOST, first: int = FIRST_BLOCK, after: int = NEXT_BLOCK, state=(0, -1, 0, 0, 0, 0)):
        self.threshold, self.silence, self.most, self.first, self.after = threshold, silence, most, first, after
        self.n, self.start, self.quiet, self.frames, self.waiting, self.handed = state
        self.out: list[tuple] = []

    def state(self) -> tuple:
        return self.n, self.start, self.quiet, self.frames, self.waiting, self.handed

    def frame(self, level: float) -> None:
        self.n += 1
        speaks = level > self.threshold
        if self.start < 0:
            if not speaks:
                return
            self.start = self.n
            self.out.append(("speech_start", self.n, self.start, 0))
        self.quiet = 0 if speaks else self.quiet + 1
        self.frames += 1
        self.waiting += 1
        if self.waiting >= (self.after if self.handed else self.first):
            self.hand_on()
        if self.quiet >= self.silence or self.frames >= self.most:
            self.finish()

    def hand_on(self) -> None:
        self.out.append(("block", self.n, self.start, self.waiting))
        self.waiting, self.handed = 0, self.handed + 1

    def finish(self) -> None:
        if self.start >= 0:
            if self.waiting:
                self.hand_on()
            self.out.append(("final", self.n, self.start, self.frames))
        self.reset()

    def reset(self) -> None:
        self.start, self.quiet, self.frames, self.waiting, self.handed = -1, 0, 0, 0, 0


def processor(key_column: str, order: list[str], level: str, control: str | None, threshold: float, silence: int, most: int, idle_ms: int | None) -> StatefulProcessor:
    class Utterances(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.kept = handle.getValueState("utterance", STATE)

        def run(self, k: tuple, machine: UtteranceMachine) -> Iterator[pd.DataFrame]:
            self.kept.update(machine.state())
            if machine.out:
                rows = pd.DataFrame(machine.out, columns=["type", "n", "start", "frames"])
                rows.insert(0, key_column, k[0])
                yield rows

        def machine(self) -> UtteranceMachine:
            state = self.kept.get() if self.kept.exists() else (0, -1, 0, 0, 0, 0)
            return UtteranceMachine(threshold, silence, most, state=tuple(state))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            machine = self.machine()
            for row in pd.concat(rows).sort_values(order).to_dict("records"):
                what = row.get(control) if control else None
                if what == "finish":
                    machine.finish()
                elif what == "reset":
                    machine.reset()
                else:
                    machine.frame(row[level])
            if idle_ms is not None:
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
            if idle_ms is not None and machine.start >= 0:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + idle_ms)
            yield from self.run(key, machine)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            machine = self.machine()
            machine.finish()
            yield from self.run(key, machine)

        def close(self) -> None:
            pass

    return Utterances()


def stream_utterances(frames: DataFrame, key: str, order: list[str], level: str, threshold: float, control: str | None = None, silence: int = SILENCE, most: int = MOST, idle_ms: int | None = None) -> DataFrame:
    """Events of every utterance as they happen: key, type (speech_start, block, final), n, start, frames."""
    kind = frames.schema[key].dataType.simpleString()
    machine = processor(key, order, level, control, threshold, silence, most, idle_ms)
    return frames.groupBy(key).transformWithStateInPandas(machine, f"{key} {kind}, {EVENTS}", "Append", "None" if idle_ms is None else "ProcessingTime")
