"""Speech segments of live frames, by the group rule of the batch form.

A frame of ``on`` or more opens a group, which ends where the next one begins. A group is quiet
from its first frame below on - 0.15; it closes speech at the first quiet frame that is
``min_silence`` samples after that. Speech begins with a group that follows a closed one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from utterlake.operators.segment import FRAME, PAD

STATE = "seen bigint, begun bigint, quiet bigint, closed boolean, seq bigint"
OUTPUT = "key string, seq bigint, start_sample bigint, end_sample bigint"


class Open(NamedTuple):
    """The group at hand: samples ``seen``, where its speech has ``begun`` and where it went
    ``quiet`` (-1: not yet), whether it has ``closed``; ``seq`` segments so far. Before the first
    group it counts as closed."""

    seen: int = 0
    begun: int = -1
    quiet: int = -1
    closed: bool = True
    seq: int = 0


def advance(state: Open, p: np.ndarray, on: float, min_silence: int) -> tuple[Open, list[tuple[int, int, int]]]:
    """The state after the frames ``p``, and (seq, start, end) of the segments that they close."""
    n = len(p)
    if not n:
        return state, []
    at = state.seen + FRAME * np.arange(1, n + 1)
    loud, soft = p >= on, p < on - 0.15
    # group 0 is the one at hand
    group = np.cumsum(loud)
    count = int(group[-1]) + 1
    never = np.iinfo(np.int64).max
    quiet = np.full(count, never)
    np.minimum.at(quiet, group[soft], at[soft])
    if state.quiet >= 0:
        quiet[0] = state.quiet
    long = soft & (at - quiet[group] >= min_silence)
    closed = np.zeros(count, bool)
    closed[group[long]] = True
    closed[0] |= state.closed
    opens = np.append(False, closed[:-1])
    begun = np.full(count, state.begun)
    begun[1:] = np.where(opens[1:], at[loud], -1)
    # a group that goes on has the beginning of the last that opened
    last = np.maximum.accumulate(np.where(opens, np.arange(count), 0))
    begun = begun[last]
    seq = state.seq + np.cumsum(opens)
    ends = closed.copy()
    ends[0] &= not state.closed
    out = [(int(seq[g]), max(0, int(begun[g]) - PAD - FRAME), int(quiet[g]) + PAD - FRAME) for g in np.flatnonzero(ends)]
    q = int(quiet[-1])
    return Open(int(at[-1]), int(begun[-1]), -1 if q == never else q, bool(closed[-1]), int(seq[-1])), out


def speaking(state: Open) -> tuple[int, int] | None:
    """(seq, start) of the segment that goes on."""
    return None if state.closed else (state.seq, max(0, state.begun - PAD - FRAME))


def segments(frames: DataFrame, on: float = 0.7, min_silence: int = 8000) -> DataFrame:
    """(key, seq, start_sample, end_sample) of closed segments, from a stream of (key string,
    seq_no bigint, p double) whose frames arrive in order within a key. State is one row a key."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = Open(*state.get) if state.exists else Open()
        p = pd.concat(list(batches)).sort_values("seq_no")["p"].to_numpy(float)
        now, out = advance(now, p, on, min_silence)
        state.update(tuple(now))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["key", "seq", "start_sample", "end_sample"])

    return frames.groupBy("key").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
