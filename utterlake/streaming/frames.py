"""Live chunks of samples cut into frames of a fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from utterlake.operators.segment import FRAME


def reframe(chunks: DataFrame, size: int = FRAME) -> DataFrame:
    """(key, frame, pcm): frames of ``size`` samples from a stream of (key string, seq_no bigint,
    pcm array<float>) whose chunks arrive in order within a key. What is left over waits for
    the next chunk; a null chunk is empty. State is less than a frame a key."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, rest = state.get if state.exists else (0, [])
        pieces = [np.asarray(rest, np.float32)]
        pieces += [np.asarray(x, np.float32) for x in pd.concat(list(batches)).sort_values("seq_no")["pcm"] if x is not None]
        pcm = np.concatenate(pieces)
        whole = len(pcm) // size
        state.update((number + whole, pcm[whole * size :].tolist()))
        frames = pcm[: whole * size].reshape(whole, size)
        yield pd.DataFrame({"key": [key[0]] * whole, "frame": range(number, number + whole), "pcm": list(frames)})

    return chunks.groupBy("key").applyInPandasWithState(run, "key string, frame bigint, pcm array<float>", "number bigint, rest array<float>", "append", GroupStateTimeout.NoTimeout)
