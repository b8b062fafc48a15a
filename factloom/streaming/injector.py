"""A session's advisory as a stream: what was shown stays unsaid, what was cut by the caps comes again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MAX_LINES, MAX_BYTES = 10, 2000
OUTPUT = "session string, path string, kind string, message string, fingerprint string, more long"
STATE = "shown array<string>"


def fingerprint(path: str, kind: str, message: str) -> str:
    return hashlib.sha256("\0".join((path, kind, message)).encode()).hexdigest()[:16]


def budget(lines: list[str], max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES) -> list[int]:
    """Which lines fit: one that is too long is passed over, not the end."""
    out, used = [], 0
    for i, line in enumerate(lines):
        size = len(line.encode()) + 1
        if len(out) < max_lines and used + size <= max_bytes:
            out.append(i)
            used += size
    return out


def _turn(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    shown = set(state.get[0]) if state.exists else set()
    rows = {(r.path, r.kind, r.message) for b in batches for r in b.itertuples()}
    fresh = [(*r, f) for r in sorted(rows) if (f := fingerprint(*r)) not in shown]
    fit = budget([f"{k}: {p}: {m}" for p, k, m, _ in fresh])
    told = [fresh[i] for i in fit]
    state.update((sorted(shown | {f for *_, f in told}),))
    if told:
        yield pd.DataFrame([(key[0], *t, len(fresh) - len(told)) for t in told], columns=["session", "path", "kind", "message", "fingerprint", "more"])


def inject(findings: DataFrame) -> DataFrame:
    """findings (session, path, kind, message), a stream of turns -> what each turn shows, with how many rows were cut.

    State is the fingerprints shown in a session; only rows that fit the caps enter it.
    """
    return findings.groupBy("session").applyInPandasWithState(_turn, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
