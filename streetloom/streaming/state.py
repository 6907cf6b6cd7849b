"""Streams with a state for each key: entries that live for a time, revisions that must follow each other."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship


def live_entries(stream: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(key, value, expires, event): writes ``(key, value, at timestamp, ttl_seconds long)`` of a cache as they are kept
    (``put``), and each key once more when the watermark passes its end (``expired``). The last write of a key counts."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            value, expires = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "value": [value], "expires": [expires], "event": ["expired"]})
            return
        rows = pd.concat([b[["at", "value", "ttl_seconds"]] for b in batches]).sort_values("at", kind="stable")
        value, ttl = rows["value"].iloc[-1], int(rows["ttl_seconds"].iloc[-1])
        expires = int(rows["at"].iloc[-1].value // 1_000_000_000) + ttl
        if state.exists and state.get[1] > expires:
            return
        now = state.getCurrentWatermarkMs()
        if expires * 1000 <= now:  # dead on arrival
            if state.exists:
                state.remove()
            yield pd.DataFrame({"key": [key[0]], "value": [value], "expires": [expires], "event": ["expired"]})
            return
        state.update((value, expires))
        state.setTimeoutTimestamp(expires * 1000)
        yield pd.DataFrame({"key": [key[0]], "value": [value], "expires": [expires], "event": ["put"]})

    ship(stream.sparkSession)
    x = stream.withWatermark("at", late).groupBy("key")
    return x.applyInPandasWithState(step, "key string, value string, expires long, event string", "value string, expires long", "update", GroupStateTimeout.EventTimeTimeout)


def revisions(stream: DataFrame) -> DataFrame:
    """(view, revision, reviewer, accepted, current): saves ``(view, base long, reviewer, at long)`` of reviews. A save is
    accepted if it was made on the view's current revision (0 at first), which it raises by one; one made on an older
    revision is refused and told the current one."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = state.get[0] if state.exists else 0
        rows = pd.concat([b[["at", "base", "reviewer"]] for b in batches]).sort_values(["at", "reviewer"], kind="stable")
        out = []
        for base, reviewer in zip(rows["base"], rows["reviewer"]):
            ok = base == current
            current += int(ok)
            out.append((key[0], current if ok else int(base), reviewer, bool(ok), current))
        state.update((current,))
        yield pd.DataFrame(out, columns=["view", "revision", "reviewer", "accepted", "current"])

    ship(stream.sparkSession)
    out = "view string, revision long, reviewer string, accepted boolean, current long"
    return stream.groupBy("view").applyInPandasWithState(step, out, "current long", "update", GroupStateTimeout.NoTimeout)
