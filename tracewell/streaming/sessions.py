"""Session state over streams: the same marks as the batch windows.

State is keyed by session and expires by processing time.  Rows of a batch are
taken in order of seq within their session; across batches they are taken as
they arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.operators.session import DRAFT_CHARS, DRAFT_TTL_S, SESSION_TTL_S

MARKS = "session_id long, seq long, turn long, exposure string, last_source string, unredacted boolean"
_STATE = "turn long, exposure string, last_source string, unredacted boolean"


def _marks(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    turn, exposure, last, unredacted = state.get if state.exists else (0, None, None, False)
    rows = []
    for event in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples():
        if event.role == "user":
            turn, exposure, unredacted = turn + 1, None, False
        rows.append((key[0], event.seq, turn, exposure, last, unredacted))
        if event.untrusted:
            exposure = last = event.label
            unredacted = unredacted or bool(event.uncleaned)
    state.update((turn, exposure, last, unredacted))
    state.setTimeoutDuration(SESSION_TTL_S * 1000)
    yield pd.DataFrame(rows, columns=["session_id", "seq", "turn", "exposure", "last_source", "unredacted"])


def stream_marks(events: DataFrame) -> DataFrame:
    """A stream of events (session_id, seq, role, untrusted, label, uncleaned)
    with the marks in force before each."""
    return events.groupBy("session_id").applyInPandasWithState(_marks, MARKS, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


DRAFTS = "session_id long, message_id string, text string"


def _assembled(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    message, text = state.get if state.exists else (None, "")
    rows = []
    for event in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples():
        text = ((text if event.message_id == message else "") + event.delta)[:DRAFT_CHARS]
        message = event.message_id
        if event.final:
            rows.append((key[0], message, text))
            message, text = None, ""
    state.update((message, text))
    state.setTimeoutDuration(DRAFT_TTL_S * 1000)
    yield pd.DataFrame(rows, columns=["session_id", "message_id", "text"])


def stream_messages(deltas: DataFrame) -> DataFrame:
    """A stream of deltas (session_id, message_id, seq, delta, final) as whole
    messages; another message's delta drops an unfinished one."""
    return deltas.groupBy("session_id").applyInPandasWithState(_assembled, DRAFTS, "message_id string, text string", "append", GroupStateTimeout.ProcessingTimeTimeout)
