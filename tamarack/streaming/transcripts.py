"""Growing transcripts in a stream: partial results when the text has changed, a final one when its source finishes.

Rows of a key arrive in order from batch to batch. A row carries the text so far, or a control: "finish" gives the final
text, unless it is blank, and "reset" forgets it. The state of a key is its last text. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def step(last: str, text: str | None, control: str | None) -> tuple[str, tuple[str, str] | None]:
    """The text to remember, and the event (type, text) that a row causes."""
    if control in ("finish", "reset"):
        said = last.strip()
        return "", ("final", said) if control == "finish" and said else None
    text = text or ""
    return text, ("partial", text) if text != last else None


def stream_transcripts(rows: DataFrame, key: str, order: str, text: str, control: str) -> DataFrame:
    """key, order, type (partial or final), text."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, order)}

    class Transcripts(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", "text string")

        def handleInputRows(self, k, batches, timerValues) -> Iterator[pd.DataFrame]:
            last, out = (self.last.get()[0] if self.last.exists() else ""), []
            for row in pd.concat(batches).sort_values(order).to_dict("records"):
                last, event = step(last, row[text] if isinstance(row[text], str) else None, row[control])
                if event:
                    out.append((k[0], row[order], *event))
            self.last.update((last,))
            if out:
                yield pd.DataFrame(out, columns=[key, order, "type", "text"])

        def close(self) -> None:
            pass

    return rows.groupBy(key).transformWithStateInPandas(Transcripts(), f"{key} {kinds[key]}, {order} {kinds[order]}, type string, text string", "Append", "None")
