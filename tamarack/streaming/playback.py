"""State of spoken answers in a stream: parts in order, results of a cancelled question, messages as frames.

* `in_order` holds parts that come early in a map state and gives them on by number. A part that is missing holds the
  later ones up until it comes, until `wait_ms` of event time have gone by, or until its session is done; then it is skipped
  and counted.
* `current_only` knows each session's epoch, which every question raises; results of an older one are dropped and counted.
  The state of a session that is silent for `idle_ms` goes; leave that out with the availableNow trigger, which would wait
  for it.
* `stream_frames` cuts each session's bytes into frames of one size; what fills no frame yet is carried as state.

State is in the store, so a restart from the checkpoint goes on where the stream stopped, and a part that comes twice is
given on once. Rows of a session may come in any order inside a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.framing import FRAME_BYTES


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


class InOrder(StatefulProcessor):
    def __init__(self, session: str, seq: str, part: str, done: str | None, wait_ms: int | None):
        self.names, self.done, self.wait_ms = (session, seq, part), done, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "n long")
        self.held = handle.getMapState("held", "seq long", "part string")

    def _release(self, key: tuple, skip: bool, n: int, came: dict) -> tuple[list[tuple], bool]:
        """Held and new parts as far as they go on without a gap, or all of them, and whether parts are left. Each access to the
        state is a call, so what goes on at once isn't held."""
        held = {k[0]: v[0] for k, v in self.held.iterator()}
        parts, out, start = held | came, [], n
        for seq in sorted(parts):
            if seq != n and not skip:
                break
            out.append((key[0], seq, parts[seq], seq - n))
            if seq in held:
                self.held.removeKey((seq,))
            came.pop(seq, None)
            n = seq + 1
        for seq, part in came.items():
            self.held.updateValue((seq,), (part,))
        if n != start:
            self.next.update((n,))
        return out, len(parts) > len(out)

    def _next(self) -> int:
        found = self.next.get()
        return found[0] if found else 0

    def _frame(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=[*self.names, "skipped"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, finished, came = self._next(), False, {}
        for pdf in rows:
            for seq, part, done in zip(pdf[self.names[1]], pdf[self.names[2]], pdf[self.done] if self.done else [False] * len(pdf)):
                if done:
                    finished = True
                elif seq >= n:  # what was given on or skipped doesn't come again
                    came[int(seq)] = part
        out, left = self._release(key, finished, n, came)
        if self.wait_ms is not None:
            waiting = list(self.handle.listTimers())
            for old in waiting if out else []:  # another gap, another wait
                self.handle.deleteTimer(old)
            if (out or not waiting) and left:
                self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.wait_ms)
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._frame(self._release(key, True, self._next(), {})[0])

    def close(self) -> None:
        pass


def in_order(parts: DataFrame, session: str, seq: str, part: str, done: str | None = None, wait_ms: int | None = None) -> DataFrame:
    """session, seq, part and skipped (how many before it never came) in order from number 0. `done` is a column of rows that
    end a session's waiting; with `wait_ms` the stream needs a watermark."""
    schema = f"{session} {_kind(parts, session)}, {seq} long, {part} string, skipped long"
    return parts.groupBy(session).transformWithStateInPandas(InOrder(session, seq, part, done, wait_ms), schema, "Append", "None" if wait_ms is None else "EventTime")


class CurrentOnly(StatefulProcessor):
    def __init__(self, columns: list[str], order: list[str], opens: str, epoch: str, idle_ms: int | None):
        self.columns, self.order, self.opens, self.epoch, self.idle_ms = columns, order, opens, epoch, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("epoch", "epoch long, dropped long", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, dropped = self.state.get() if self.state.exists() else (0, 0)
        out = []
        for row in pd.concat(rows).sort_values(self.order).to_dict("records"):
            if row[self.opens]:
                now = now + 1
            elif row[self.epoch] < now:
                dropped += 1
            else:
                out.append((*[row[c] for c in self.columns], now, dropped))
        self.state.update((now, dropped))
        if out:
            yield pd.DataFrame(out, columns=[*self.columns, "current", "dropped"])

    def close(self) -> None:
        pass


def current_only(events: DataFrame, session: str, order: list[str], opens: str, epoch: str, idle_ms: int | None = None) -> DataFrame:
    """Results of the epoch that is open when they come, with it and the number of results dropped before. A row where `opens`
    is true opens the session's next epoch; the others are results of the epoch in their column `epoch`."""
    schema = ", ".join(f"{c} {_kind(events, c)}" for c in events.columns)
    machine = CurrentOnly(events.columns, order, opens, epoch, idle_ms)
    return events.groupBy(session).transformWithStateInPandas(machine, f"{schema}, current long, dropped long", "Append", "None" if idle_ms is None else "ProcessingTime")


class Frames(StatefulProcessor):
    def __init__(self, session: str, order: list[str], payload: str, size: int):
        self.session, self.order, self.payload, self.size = session, order, payload, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rest", "n long, rest binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, rest = self.state.get() or (0, b"")
        buffer = bytearray(rest)
        for payload in pd.concat(rows).sort_values(self.order)[self.payload]:
            buffer += payload or b""
            whole = len(buffer) // self.size
            if whole:
                cut = [bytes(buffer[i * self.size : (i + 1) * self.size]) for i in range(whole)]
                del buffer[: whole * self.size]
                yield pd.DataFrame({self.session: [key[0]] * whole, "n": range(n, n + whole), "frame": cut})
                n += whole
        self.state.update((n, bytes(buffer)))

    def close(self) -> None:
        pass


def stream_frames(messages: DataFrame, session: str, order: list[str], payload: str, size: int = FRAME_BYTES) -> DataFrame:
    """session, n and frame: the bytes of a session's messages, which come in order from batch to batch, in frames of `size`."""
    return messages.groupBy(session).transformWithStateInPandas(Frames(session, order, payload, size), f"{session} {_kind(messages, session)}, n long, frame binary", "Append", "None")
