"""Writers of results, samples and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_lines(df: DataFrame, column: str, path: str) -> None:
    """A log of one value a line."""
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").write.mode("append").text(path)


def per_key_json(df: DataFrame, key: str, path: str) -> None:
    """One folder of JSON per key."""
    df.withColumn("_key", F.col(key)).write.mode("overwrite").partitionBy("_key").json(path)


def batch_summary(df: DataFrame, path: str) -> None:
    """Counts, mean latencies over given values, and all results, as one JSON object. The results
    are one array, as the format asks; use per_key_json where they are many."""
    given = lambda c: F.avg(F.when(F.col(c) != 0, F.col(c)))
    df.agg(
        F.count(F.lit(1)).alias("total_files"),
        given("first_token_latency_ms").alias("average_first_token_latency_ms"),
        given("last_token_latency_ms").alias("average_last_token_latency_ms"),
        F.sort_array(F.collect_list(F.struct("file", "duration", "transcription", "first_token_latency_ms", "last_token_latency_ms"))).alias("results"),
    ).coalesce(1).write.mode("overwrite").json(path)


def evaluation_summary(evaluation: DataFrame, path: str) -> None:
    """The one row that :func:`utterlake.plans.evaluate.evaluation` gives, as one JSON object."""
    evaluation.coalesce(1).write.mode("overwrite").json(path)


def single_file(result: DataFrame, folder: str, scored: DataFrame | None = None) -> None:
    """What a run over one file leaves: final_transcription.txt, segments_with_timing.json and, with
    ``scored``, evaluation_result.json, each a folder with one part. ``result``: one row of
    audio_file, duration, segments, final_text; ``scored``: one row of file, reference,
    generated, cer, mer and latencies (those of 0 are written as missing)."""
    one = result.limit(1).coalesce(1)
    one.select(F.coalesce("final_text", F.lit("")).alias("value")).write.mode("overwrite").text(f"{folder}/final_transcription.txt")
    one.select("audio_file", "duration", "segments").write.mode("overwrite").json(f"{folder}/segments_with_timing.json")
    if scored is not None:
        latency = lambda c: F.when(F.col(c) != 0, F.col(c)).alias(c)
        scored.limit(1).coalesce(1).select("file", "reference", "generated", "cer", "mer", F.length("reference").alias("ref_length"), F.length("generated").alias("gen_length"), latency("first_token_latency_ms"), latency("last_token_latency_ms")).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/evaluation_result.json")
