"""Models supplied by the caller, run over batches of rows.

A factory is named by an import path, ``module:name``, and called once per task; what it
returns does the work. There is no model here: without a factory the rows pass unchanged.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.functions.pcm import long_enough
from utterlake.functions.text import display_candidates


class Backend(Protocol):
    """A recognizer of whole audio."""

    def transcribe(self, audio: Any, init_prompt: str = "") -> Any: ...

    def warmup(self, audio: Any, init_prompt: str = "") -> Any: ...

    def use_vad(self) -> None: ...

    def set_translate_task(self) -> None: ...


class OnlineProcessor(Protocol):
    """A recognizer of audio that arrives in chunks."""

    def insert_audio_chunk(self, audio: Any) -> None: ...

    def process_iter(self, start_time: float | None = None) -> Any: ...

    def finish(self) -> Any: ...


def _factory(named: str) -> tuple[str, str]:
    module, _, name = named.partition(":")
    if not module or not name:
        raise ValueError("name the factory as module:name")
    return module, name


def apply(df: DataFrame, factory: str | None, schema: str, **options: object) -> DataFrame:
    """``df`` through the callable that ``factory(**options)`` returns (a pandas frame to another);
    ``schema`` is its output's. An error in it fails the task, which Spark tries again; if it
    goes on failing, so does the job."""
    if factory is None:
        return df
    module, name = _factory(factory)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = getattr(importlib.import_module(module), name)(**options)
        for b in batches:
            if len(b):
                yield model(b)

    return df.mapInPandas(run, schema)


def transcribe(df: DataFrame, factory: str, pcm: str = "pcm", prompt: str | None = None, out: str = "text", **options: object) -> DataFrame:
    """``df`` with ``out``: what the :class:`Backend` that ``factory(**options)`` returns makes of the
    audio (null for null audio), as a string. It is warmed up with the first audio of a task."""
    module, name = _factory(factory)
    place = df.columns.index(pcm)
    said = None if prompt is None else df.columns.index(prompt)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Backend = getattr(importlib.import_module(module), name)(**options)
        warm = False
        for b in batches:
            texts = []
            for row in b.itertuples(index=False):
                audio, before = row[place], "" if said is None else row[said] or ""
                if audio is None:
                    texts.append(None)
                    continue
                if not warm:
                    model.warmup(audio, before)
                    warm = True
                text = model.transcribe(audio, before)
                texts.append(None if text is None else str(text))
            yield b.assign(**{out: pd.Series(texts, index=b.index, dtype=object)})

    return df.mapInPandas(run, schema)


def online(df: DataFrame, factory: str, key: str, order: str, pcm: str = "pcm", **options: object) -> DataFrame:
    """(key, seq, text): what the :class:`OnlineProcessor` that ``factory(**options)`` returns says to
    each chunk, and at the end of each key to finish (seq null). One is made for each key; chunks
    pass in order, and no key is gathered. Answers of None are left out."""
    module, name = _factory(factory)
    kinds = df.schema[key].dataType.simpleString(), df.schema[order].dataType.simpleString()
    ordered = df.select(F.col(key).alias("_key"), F.col(order).alias("_seq"), F.col(pcm).alias("_pcm")).repartition("_key").sortWithinPartitions("_key", "_seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = getattr(importlib.import_module(module), name)
        now: list = []  # the key at hand and its processor
        for b in batches:
            rows = []
            for k, seq, audio in b.itertuples(index=False):
                if now and now[0] != k:
                    rows.append((now[0], None, now[1].finish()))
                    now = []
                if not now:
                    now = [k, make(**options)]
                if audio is not None:
                    now[1].insert_audio_chunk(audio)
                    rows.append((k, seq, now[1].process_iter()))
            yield frame(rows)
        if now:
            yield frame([(now[0], None, now[1].finish())])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(k, s, str(t)) for k, s, t in rows if t is not None], columns=["_key", "_seq", "text"], dtype=object)

    return ordered.mapInPandas(run, f"_key {kinds[0]}, _seq {kinds[1]}, text string").withColumnsRenamed({"_key": key, "_seq": "seq"})


def correct(df: DataFrame, factory: str | None, candidates: str = "topk", previous: str = "previous_transcript", pcm: str | None = None, out: str = "corrected", **options: object) -> DataFrame:
    """``df`` with ``out``: the best candidate as corrected, and ``corrected_by``: 'model' or 'top1'.

    ``factory(**options)`` returns a callable (candidates, previous, audio or None) -> what comes
    after ``previous``, or None. Where it gives None, raises, or the audio of ``pcm`` is too
    short, and without a factory, the first candidate stands. Candidates go without U+FFFD at
    their ends and without blank ones; ``out`` is empty where none is left.
    """
    cleaned = display_candidates(F.col(candidates))
    d = df.withColumn("_cleaned", cleaned).withColumn("_ask", cleaned.isNotNull() & (long_enough(F.col(pcm)) if pcm else F.lit(True)))
    top = F.coalesce(F.trim(F.get("_cleaned", 0)), F.lit(""))
    if factory is None:
        return d.withColumns({out: top, "corrected_by": F.lit("top1")}).drop("_cleaned", "_ask")
    module, name = _factory(factory)
    places = d.columns.index("_cleaned"), d.columns.index(previous), None if pcm is None else d.columns.index(pcm), d.columns.index("_ask")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields) + ", _suffix string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = getattr(importlib.import_module(module), name)(**options)
        c, p, a, ask = places
        for b in batches:
            suffixes = []
            for row in b.itertuples(index=False, name=None):
                suffix = None
                if row[ask]:
                    try:
                        suffix = model(list(row[c]), row[p] or "", None if a is None else row[a])
                    except Exception:  # one bad row must not end the run; corrected_by tells
                        suffix = None
                suffixes.append(suffix)
            yield b.assign(_suffix=pd.Series(suffixes, index=b.index, dtype=object))

    told = d.mapInPandas(run, schema)
    by_model = F.col("_suffix").isNotNull()
    whole = F.when(by_model, F.concat(F.coalesce(F.col(previous), F.lit("")), F.col("_suffix"))).otherwise(top)
    return told.withColumns({out: whole, "corrected_by": F.when(by_model, "model").otherwise("top1")}).drop("_cleaned", "_ask", "_suffix")
