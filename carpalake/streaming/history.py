"""The result history over a stream: keyed state holds a session's last total and its place."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import CAP

ACCEPTED = "session_id long, ts timestamp, event_id long, months_total double, male int, place long"
STATE = "last double, place long"


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, place = state.get if state.exists else (None, 0)
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    kept = []
    for r in rows.itertuples():
        if r.is_clear:
            last, place = None, 0
        elif last is None or r.months_total != last:
            last, place = float(r.months_total), place + 1
            kept.append((key[0], r.ts, r.event_id, r.months_total, r.male, place))
    state.update((last, place))
    yield pd.DataFrame(kept, columns=[c.split()[0] for c in ACCEPTED.split(", ")])


def accepted(log: DataFrame) -> DataFrame:
    """The entries of a streaming log that the history takes, in the order of ts within each trigger; place counts from the last clear event.

    log: session_id, ts, event_id, months_total, male, is_clear. State per session is one number and one count. Rows that
    come in a later trigger follow those of earlier ones, whatever their ts.
    """
    return log.groupBy("session_id").applyInPandasWithState(_update, ACCEPTED, STATE, "append", GroupStateTimeout.NoTimeout)


NEWEST = "session_id long, rn int, ts timestamp, event_id long, months_total double, male int"


def _newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, cap: int) -> Iterator[pd.DataFrame]:
    entries = json.loads(state.get[0]) if state.exists else []
    for r in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
        if r.is_clear:
            entries = []
        elif not entries or entries[0][2] != r.months_total:
            entries = [[r.ts.value, int(r.event_id), float(r.months_total), int(r.male)], *entries][:cap]
    state.update((json.dumps(entries),))
    rows = [(key[0], i, pd.Timestamp(int(ts)), int(event), total, int(male)) for i, (ts, event, total, male) in enumerate(entries, 1)]
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in NEWEST.split(", ")])


def newest(log: DataFrame, cap: int = CAP) -> DataFrame:
    """After each trigger, the newest `cap` entries of each session that had rows in it, rn 1 first (none after a clear event).

    log and order as in accepted(). State per session is these entries, so it is bounded. Use it with output mode update; a
    session's rows replace its rows of triggers before.
    """
    return log.groupBy("session_id").applyInPandasWithState(partial(_newest, cap=cap), NEWEST, "entries string", "update", GroupStateTimeout.NoTimeout)
