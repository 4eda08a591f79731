"""What of a live stream goes to a recognizer, and when it has to answer.

Works on places of samples, not on samples: the audio itself is cut by the intervals later.
For each call (a chunk that has arrived, with the detector's events in it) the actions are
rows: ``open`` a segment at a place, ``send`` an interval, ``infer`` on what has been sent,
``finish`` the segment, or ``skip`` it because too little speech was sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "held bigint, arrived bigint, voice boolean, waiting bigint, sent bigint"
OUTPUT = "key string, seq_no bigint, action string, begin bigint, end bigint"


class Held(NamedTuple):
    """Samples from ``held`` to ``arrived`` are kept; ``voice``: within speech; ``waiting`` samples
    were sent since the last inference, ``sent`` in this segment."""

    held: int = 0
    arrived: int = 0
    voice: bool = False
    waiting: int = 0
    sent: int = 0


class Limits(NamedTuple):
    keep: int = 16000  # samples kept through silence, so that a padded start is still there
    infer_above: int = 8000  # inference once more than this is waiting
    least_speech: int = 0  # a segment of fewer samples is skipped


def route(s: Held, samples: int, start: int | None, end: int | None, last: bool, limits: Limits) -> tuple[Held, list[tuple[str, int, int]]]:
    """The state after a call of ``samples`` more samples with the detector's first ``start`` and
    last ``end`` in it (places in the whole stream; either may be missing), and its actions.

    Speech is sent from its start, or from what is still held, up to its end, or to what has
    arrived. An end finishes the segment, as does the ``last`` call; a segment in which nothing
    was sent falls back to what is held.
    """
    arrived = s.arrived + samples
    out: list[tuple[str, int, int]] = []
    first = max(s.held, start) if start is not None else s.held
    upto = min(arrived, max(s.held, end)) if end is not None else arrived
    spoken = start is not None or s.voice or end is not None
    if start is not None and (end is None or first < upto):
        out.append(("open", first, first))
    waiting, sent = s.waiting, s.sent
    if spoken and first < upto:
        out.append(("send", first, upto))
        waiting, sent = waiting + upto - first, sent + upto - first
    voice = spoken and end is None
    held = arrived if voice else max(upto if end is not None else s.held, arrived - limits.keep)
    if end is None and not last:
        if waiting > limits.infer_above:
            out.append(("infer", arrived, arrived))
            waiting = 0
        return Held(held, arrived, voice, waiting, sent), out
    if sent < limits.least_speech:
        out.append(("skip", arrived, arrived))
    else:
        if not sent and held < arrived:
            out += [("open", held, held), ("send", held, arrived)]
        out.append(("finish", arrived, arrived))
    # the next segment begins with nothing held
    return Held(arrived, arrived), out


def _given(x: object) -> int | None:
    return None if x is None or pd.isna(x) else int(x)


def routed_table(calls: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The same from a table: a sorted pass over each key, none is gathered."""
    ordered = calls.select("key", "seq_no", "samples", "start", "end", "last").where("key is not null").repartition("key").sortWithinPartitions("key", "seq_no")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = None, Held()
        for b in batches:
            rows = []
            for c in b.itertuples(index=False):
                if c.key != key:
                    key, now = c.key, Held()
                now, actions = route(now, _given(c.samples) or 0, _given(c.start), _given(c.end), bool(_given(c.last)), limits)
                rows += [(key, c.seq_no, *a) for a in actions]
            yield pd.DataFrame(rows, columns=["key", "seq_no", "action", "begin", "end"])

    return ordered.mapInPandas(run, OUTPUT)


def routed(calls: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(key, seq_no, action, begin, end) from a stream of (key string, seq_no bigint, samples bigint,
    start bigint, end bigint, last boolean), calls in order within a key. State is one row a
    key; a null ``samples`` is none, a null ``last`` false."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = Held(*state.get) if state.exists else Held()
        rows = []
        for c in pd.concat(list(batches)).sort_values("seq_no").itertuples(index=False):
            now, actions = route(now, _given(c.samples) or 0, _given(c.start), _given(c.end), bool(_given(c.last)), limits)
            rows += [(key[0], c.seq_no, *a) for a in actions]
        state.update(tuple(now))
        yield pd.DataFrame(rows, columns=["key", "seq_no", "action", "begin", "end"])

    return calls.groupBy("key").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
