"""Continuity by peer, as a stream: gaps and resets of sequences, silence and its end, lost connections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RECORD = "peer string, kind string, detected_at long, last_seen_at long, last_event_id string, expected long, observed long, missing long, silence_ms long"
STATE = "last_seen long, last_event string, last_seq long, silent boolean"


class Peer:
    """What is known of one peer; ``see`` takes its frames in arrival order."""

    def __init__(self, peer: str, last_seen: int | None = None, last_event: str | None = None, last_seq: int | None = None, silent: bool = False):
        self.peer, self.last_seen, self.last_event, self.last_seq, self.silent = peer, last_seen, last_event, last_seq, silent

    def record(self, kind: str, now: int, **more: int) -> dict:
        empty = dict.fromkeys(("expected", "observed", "missing", "silence_ms"))
        return {"peer": self.peer, "kind": kind, "detected_at": now, "last_seen_at": self.last_seen, "last_event_id": self.last_event} | empty | more

    def see(self, event: str, seq: int | None, now: int) -> list[dict]:
        out = []
        if self.silent:
            out.append(self.record("silence_end", now, silence_ms=now - self.last_seen))
            self.silent = False
        if seq is not None:
            if self.last_seq is not None and seq != self.last_seq + 1:
                ahead = seq > self.last_seq + 1
                out.append(self.record("sequence_gap" if ahead else "sequence_reset", now, expected=self.last_seq + 1, observed=seq, **({"missing": seq - self.last_seq - 1} if ahead else {})))
            self.last_seq = seq
        self.last_seen, self.last_event = now, event
        return out

    def lost(self, now: int) -> list[dict]:
        return [self.record("connection_lost", now)]

    def sweep(self, now: int, after_ms: int) -> list[dict]:
        """Declares silence once the peer was quiet for ``after_ms`` or longer."""
        if self.silent or self.last_seen is None or now - self.last_seen < after_ms:
            return []
        self.silent = True
        return [self.record("silence", now, silence_ms=now - self.last_seen)]


def track(frames: DataFrame, silence_after_ms: int | None = None) -> DataFrame:
    """Gap records of a stream of (peer, event_id, sequence, received_ms, lost).

    State is one small row for each peer. Within a micro-batch a peer's frames are taken by arrival, then event id;
    silence is found by a processing-time timeout.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        peer = Peer(key[0], *(state.get if state.exists else ()))
        out: list[dict] = []
        if state.hasTimedOut:
            out += peer.sweep(state.getCurrentProcessingTimeMs(), silence_after_ms or 0)
        else:
            rows = pd.concat(list(parts)).sort_values(["received_ms", "event_id"], kind="stable")
            for event, seq, at, lost in zip(rows.event_id, rows.sequence, rows.received_ms, rows.lost, strict=True):
                out += peer.lost(int(at)) if lost else peer.see(event, None if pd.isna(seq) else int(seq), int(at))
        state.update((peer.last_seen, peer.last_event, peer.last_seq, peer.silent))
        if silence_after_ms and not peer.silent:
            state.setTimeoutDuration(silence_after_ms)
        if out:
            frame = pd.DataFrame(out)
            for c in ("detected_at", "last_seen_at", "expected", "observed", "missing", "silence_ms"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    timeout = GroupStateTimeout.ProcessingTimeTimeout if silence_after_ms else GroupStateTimeout.NoTimeout
    return frames.groupBy("peer").applyInPandasWithState(run, RECORD, STATE, "append", timeout)
