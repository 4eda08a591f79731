"""Segmentation of frames, chunks and sessions, as windows and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FRAME = 512  # samples of a frame at 16 kHz
PAD = 1600  # 100 ms


def speech_segments(frames: DataFrame, key: str, order: list[str], p: str = "p", on: float = 0.7, min_silence: int = 8000) -> DataFrame:
    """(key, seq, start_sample, end_sample): segments by hysteresis.

    Speech begins at a frame of probability ``on`` or more; it ends at the first frame below
    on - 0.15 once ``min_silence`` samples have passed since, unless a frame of ``on`` comes
    before. Starts and ends are padded by PAD. end_sample is null while speech goes on. Each
    frame of ``on`` opens a group; a group closes speech or hands on to the next one.
    """
    w = Window.partitionBy(key).orderBy(*order)
    off = F.lit(on) - F.lit(0.15)
    f = frames.select(key, F.col(p).alias("p"), (F.row_number().over(w) * FRAME).cast("bigint").alias("cur"))
    w = Window.partitionBy(key).orderBy("cur")
    f = f.withColumn("grp", F.sum((F.col("p") >= on).cast("int")).over(w))
    g = Window.partitionBy(key, "grp")
    f = f.withColumn("te", F.min(F.when(F.col("p") < off, F.col("cur"))).over(g))
    closes = F.max(((F.col("p") < off) & (F.col("cur") - F.col("te") >= min_silence)).cast("int"))
    groups = f.where("grp > 0").groupBy(key, "grp").agg(F.min("cur").alias("begun"), F.min("te").alias("te"), closes.alias("closed"))
    w = Window.partitionBy(key).orderBy("grp")
    groups = groups.withColumn("opens", F.coalesce(F.lag("closed").over(w) == 1, F.lit(True)))
    groups = groups.withColumn("seq", F.sum(F.col("opens").cast("int")).over(w))
    return groups.groupBy(key, "seq").agg(
        F.greatest(F.lit(0), F.min("begun") - PAD - FRAME).alias("start_sample"),
        F.max(F.when(F.col("closed") == 1, F.col("te") + PAD - FRAME)).alias("end_sample"),
    )


def chunks(files: DataFrame, key: str, seconds: str, step: float) -> DataFrame:
    """(key, chunk, begin_s, end_s): steps of ``step`` seconds, the last one short."""
    n = F.greatest(F.lit(1), F.ceil(F.round(F.col(seconds) / step, 9))).cast("int")
    out = files.where(F.col(seconds) > 0).select(key, F.col(seconds).alias("_s"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return out.select(key, "chunk", (F.col("chunk") * step).alias("begin_s"), F.least((F.col("chunk") + 1) * step, F.col("_s")).alias("end_s"))


def trigger_cadence(df: DataFrame, key: str, order: list[str], samples: str, threshold: int, flush: bool = False) -> DataFrame:
    """(key, chunk, waiting): the chunks (numbered from 0 within the key) at which more than
    ``threshold`` samples have gathered since the last one; the count starts again there. With
    ``flush`` the last chunk is one too, if anything is waiting.

    The running count starts again at places that depend on itself, so a sorted pass over each
    key keeps it; its state is two numbers, and no key is gathered anywhere.
    """
    w = Window.partitionBy(key).orderBy(*order)
    numbered = df.select(F.col(key).alias("_key"), (F.row_number().over(w) - 1).cast("bigint").alias("chunk"), F.coalesce(F.col(samples), F.lit(0)).cast("bigint").alias("n"), F.lead(F.lit(1)).over(w).isNull().alias("last"))
    # the window has sorted each part of the table by key and place already
    ordered = numbered.sortWithinPartitions("_key", "chunk")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = 0
        for b in batches:
            keys, chunks, counts, lasts = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
            rows, said = [], []
            for i, (chunk, n, last) in enumerate(zip(chunks, counts, lasts)):
                waiting = n if chunk == 0 else waiting + n
                if waiting > threshold or flush and last and waiting > 0:
                    rows.append(i)
                    said.append(waiting)
                    waiting = 0
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([keys.take(at), b.column(1).take(at), pa.array(said, pa.int64())], ["_key", "chunk", "waiting"])

    return ordered.mapInArrow(run, f"_key {kind}, chunk bigint, waiting bigint").withColumnRenamed("_key", key)


def accumulated(df: DataFrame, key: list[str], order: list[str], pcm: str) -> DataFrame:
    """(key.., pcm): the chunks of each key joined in order, null ones left out. For keys of bounded
    length, such as a speech segment."""
    held = F.sort_array(F.collect_list(F.when(F.col(pcm).isNotNull(), F.struct(*order, F.col(pcm).alias("_pcm")))))
    return df.groupBy(*key).agg(F.flatten(F.transform(held, lambda x: x["_pcm"])).alias("pcm"))


def gathered(df: DataFrame, key: str, order: list[str], pcm: str) -> DataFrame:
    """``df`` with ``gathered``: samples of the key up to each row (the growing frame's length)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("gathered", F.sum(F.coalesce(F.size(pcm), F.lit(0))).over(w))


def frames(df: DataFrame, key: str, order: list[str], pcm: str, size: int = FRAME) -> DataFrame:
    """(key, frame, pcm): the samples of a key in frames of ``size``, carried over from chunk to
    chunk; what is left over at the end is no frame."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.coalesce(F.size(pcm), F.lit(0))).over(w), F.lit(0))
    placed = df.where(F.size(pcm) > 0).select(key, before.alias("_before"), F.col(pcm).alias("_pcm"))
    # pieces of frames, so that single samples never become rows
    first, last = F.floor(F.col("_before") / size), F.floor((F.col("_before") + F.size("_pcm") - 1) / size)
    piece = placed.select(key, "_before", "_pcm", F.explode(F.sequence(first, last)).alias("frame"))
    a = F.greatest(F.lit(0), F.col("frame") * size - F.col("_before")).cast("int")
    b = F.least(F.size("_pcm"), (F.col("frame") + 1) * size - F.col("_before")).cast("int")
    piece = piece.select(key, "frame", F.struct("_before", F.slice("_pcm", a + 1, b - a).alias("x")).alias("piece"))
    whole = piece.groupBy(key, "frame").agg(F.flatten(F.transform(F.sort_array(F.collect_list("piece")), lambda x: x["x"])).alias("pcm"))
    return whole.where(F.size("pcm") == size)


def speech_only(segments: DataFrame, least: int = 4000) -> DataFrame:
    """Closed segments of at least ``least`` samples."""
    return segments.where(F.col("end_sample") - F.col("start_sample") >= least)


def joined_text(df: DataFrame, key: str, order: list[str], text: str, sep: str = " ") -> DataFrame:
    """(key, said): the texts of a session in order, null ones left out. For keys of bounded length."""
    held = F.sort_array(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(*order, F.col(text).alias("_text")))))
    return df.groupBy(key).agg(F.array_join(F.transform(held, lambda x: x["_text"]), sep).alias("said"))


def redecoded(files: DataFrame, key: str, seconds: str, step: float = 2.0, unfixed: int = 2) -> DataFrame:
    """(key, chunk, end_s, keeps_prefix): re-decoding of all audio so far at every ``step`` seconds;
    from chunk ``unfixed`` on the text so far, but for its last tokens, is kept as prefix (see
    :func:`utterlake.functions.pcm.drop_tail`)."""
    return chunks(files, key, seconds, step).select(key, "chunk", "end_s", (F.col("chunk") >= unfixed).alias("keeps_prefix"))


def initial_buffer(df: DataFrame, key: str, order: list[str], samples: str, need: int = 16000) -> DataFrame:
    """``df`` with gathered (running samples) and gate: wait until ``need`` samples have gathered,
    first at the row that reaches it, next after."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("gathered", F.sum(samples).over(w))
    return df.withColumn("gate", F.when(F.col("gathered") < need, "wait").when(F.col("gathered") - F.col(samples) < need, "first").otherwise("next"))


def merge_events(events: DataFrame, key: list[str], order: str, kind: str, sample: str) -> DataFrame:
    """(key.., start, end): of the events of one call the first if it is a start and the last if
    it is an end."""
    return events.groupBy(*key).agg(
        F.min_by(F.when(F.col(kind) == "start", F.col(sample)), order).alias("start"),
        F.max_by(F.when(F.col(kind) == "end", F.col(sample)), order).alias("end"),
    )


def sessions(df: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """(key, session_start, session_end, n): events no further apart than ``gap``; the end is the
    last event's time."""
    w = F.session_window(F.col(time), gap)
    return df.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("session_start"), F.max(time).alias("session_end")).select(key, "session_start", "session_end", "n")
