"""Sessions as a stream with resets: a start records its baseline and forgets what was shown; what is not heard of for long is forgotten."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .injector import MAX_BYTES, MAX_LINES, budget, fingerprint

#: What the state needs: one entry a fingerprint, read and written by itself.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TURN = "session string, started boolean, baseline string, path string, kind string, message string"
OUTPUT = "session string, baseline string, path string, kind string, message string, fingerprint string, more long"
DAY = 24 * 60 * 60 * 1000


def _line(row: tuple[str, str, str]) -> str:
    return f"{row[1]}: {row[0]}: {row[2]}"


class Sessions(StatefulProcessor):
    """State of a session: its baseline, and an entry for each fingerprint that was shown."""

    def __init__(self, ttl: int = DAY):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getMapState("shown", "fingerprint string", "at int", self.ttl)
        self.baseline = handle.getValueState("baseline", "sha string", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        start: str | None = None
        known: dict[str, bool] = {}  # fingerprints of this turn, and whether they were shown before it
        every: dict[int, list] = {}
        unsaid: dict[int, list] = {}
        for batch in rows:
            for r in batch.itertuples(index=False):
                if r.started:
                    start = max(start or "", r.baseline or "")
                one = (r.path, r.kind or "", r.message or "") if isinstance(r.path, str) else None
                if one is None or (f := fingerprint(*one)) in known:
                    continue
                known[f] = self.shown.containsKey((f,))
                for lists in (every,) if known[f] else (every, unsaid):
                    same = lists.setdefault(len(_line(one).encode()), [])
                    insort(same, one)
                    del same[MAX_LINES:]  # no more lines of one length can be shown
        if start is not None:  # before anything of this turn is shown
            self.shown.clear()
            self.baseline.clear()
            if start:
                self.baseline.update((start,))
        fresh = sorted(one for same in (unsaid if start is None else every).values() for one in same)
        n_fresh = len(known) if start is not None else len(known) - sum(known.values())
        told = [fresh[i] for i in budget([_line(one) for one in fresh], MAX_LINES, MAX_BYTES)]
        for one in told:
            self.shown.updateValue((fingerprint(*one),), (1,))
        sha = self.baseline.get()[0] if self.baseline.exists() else None
        if told:
            yield pd.DataFrame([(key[0], sha, *one, fingerprint(*one), n_fresh - len(told)) for one in told], columns=["session", "baseline", "path", "kind", "message", "fingerprint", "more"])

    def close(self) -> None:
        pass


def sessions(turns: DataFrame, ttl: int = DAY) -> DataFrame:
    """turns (TURN), a stream -> what each turn shows (OUTPUT).

    A row with ``started`` begins the session anew: its baseline (null or empty: there is none) is kept and told with what is shown, and all that
    was shown may be shown again, in this turn already. Of several starts in one turn the greatest baseline stays. Rows without a path, and
    repeats within a turn, show nothing. ``ttl`` is in milliseconds since an entry was last written. The stream's session must set the state
    store to PROVIDER, and a stream that is to end by itself must turn off batches without data, which processing time asks for without end.
    """
    return turns.groupBy("session").transformWithStateInPandas(Sessions(ttl), OUTPUT, "Append", "ProcessingTime")
