"""Readers of the files that transcript pipelines write."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from utterlake.functions.text import base_name, stem

HISTORY = "audio_path string, duration double, final_text string, first_token_latency_ms double, last_token_latency_ms double, history array<struct<end_time: double, previous_transcript: string, topk: array<string>, source: string>>"
BATCH = "total_files int, processed_files int, average_first_token_latency_ms double, average_last_token_latency_ms double, results array<struct<file: string, duration: double, transcription: string, first_token_latency_ms: double, last_token_latency_ms: double>>"
EVALUATION = "total_files int, matched_files int, unmatched_files int, average_cer double, average_mer double, per_file_results array<struct<file: string, reference: string, generated: string, cer: double, mer: double, ref_length: int, gen_length: int>>"
CORRECTION = "k_best_candidates array<string>, num_candidates int, chunk_size int, previous_transcript string, continuation_transcript string, audio_path string, timestamp double"
AUDIO_KEYS = ("k_best_candidates", "previous_transcript", "continuation_transcript", "audio_path")
TEXT_KEYS = ("k_best_candidates", "continuation_transcript")


def audio_files(spark: SparkSession, path: str, depth: int | None = None, extensions: tuple[str, ...] = ("wav", "mp3", "flac", "m4a"), any_case: bool = True) -> DataFrame:
    """(path, length) of the audio files below ``path``, by path, without their content: of all
    folders below, or with ``depth`` 0 of ``path`` alone, with 1 of it and its own folders. A
    path that names one file which is no audio is an error."""
    r = spark.read.format("binaryFile")
    if depth is None:
        files = r.option("recursiveFileLookup", "true").load(path)
    else:
        root = path.rstrip("/")
        if depth > 1:
            raise ValueError("depth is 0, 1 or None for all")
        files = r.load(root + "/*")  # of folders that a glob meets it lists what is in them
        files = files.where(F.size(F.split(F.substring_index("path", root.rsplit("/", 1)[-1] + "/", -1), "/")) <= depth + 1)
    name = F.lower("path") if any_case else F.col("path")
    last = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in last.lstrip(".") and last.rsplit(".", 1)[-1].lower() not in extensions and "*" not in last and files.where(F.col("path").endswith("/" + last)).limit(1).count():
        raise ValueError(f"{path} is no audio file")
    return files.where(name.rlike(rf"\.({'|'.join(extensions)})$")).select("path", "length").orderBy("path")


def audio(spark: SparkSession, path: str, rate: int = 16000) -> DataFrame:
    """(path, pcm array<float>, rate): WAV files as mono samples at their own rate resampled
    linearly to ``rate``. A file that cannot be read has a null pcm."""

    @pandas_udf("array<float>")
    def decode(content: pd.Series) -> pd.Series:
        def one(b: bytes) -> np.ndarray | None:
            try:
                with wave.open(io.BytesIO(b)) as w:
                    if w.getsampwidth() != 2:
                        return None
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
                    x = x.reshape(-1, w.getnchannels()).mean(1)
                    n = round(len(x) / w.getframerate() * rate)
                    return x if w.getframerate() == rate or not n else np.interp(np.arange(n) * len(x) / n, np.arange(len(x)), x).astype(np.float32)
            except (wave.Error, EOFError, ValueError):
                return None

        return content.map(one)

    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.wav$"))
    return r.select("path", decode("content").alias("pcm"), F.lit(rate).alias("rate"))


# Reference files whose texts are in another language than asked for.
LANGUAGE_OF_FILE = {"/WSYue-ASR-eval/Short/content.json": "yue"}


def _last_of(rows: DataFrame) -> DataFrame:
    """(file, text): of rows (keys, text, place) each text under each of its keys, the last stands."""
    return rows.select(F.explode("keys").alias("file"), "text", "place").groupBy("file").agg(F.max_by("text", "place").alias("text"))


def _objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of JSON lists with their place (file, number), in the order of the file."""
    return spark.read.schema(schema).json(path, multiLine=True).select("*", F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).alias("place"))


def references(spark: SparkSession, path: str, language: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """(file, text): a JSON list of objects with audio_path and text_<language>; each non-empty text
    under its file name and its stem; of equal keys the last stands. ``overrides`` names the
    language of files by the end of their path (LANGUAGE_OF_FILE)."""
    for end, other in (LANGUAGE_OF_FILE if overrides is None else overrides).items():
        language = other if path.endswith(end) else language
    df = _objects(spark, path, f"audio_path string, text_{language} string")
    p = F.coalesce("audio_path", F.lit(""))
    return _last_of(df.select(F.array(base_name(p), stem(p)).alias("keys"), F.col(f"text_{language}").alias("text"), "place").where("text <> ''"))


def flat_references(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): a JSON object of file to text as it is, or a list of objects with audio_path and
    text_zh (else text) under the name up to its first dot; empty texts stay."""
    whole = spark.read.text(path, wholetext=True)
    listed = whole.where(F.ltrim("value").startswith("[")).select(F.posexplode(F.from_json("value", "array<struct<audio_path: string, text_zh: string, text: string>>")).alias("place", "x"))
    listed = listed.select(F.array(stem(F.coalesce("x.audio_path", F.lit("")), first_dot=True)).alias("keys"), F.coalesce("x.text_zh", "x.text", F.lit("")).alias("text"), "place")
    flat = whole.where(F.ltrim("value").startswith("{")).select(F.explode(F.from_json("value", "map<string, string>")).alias("file", "text"))
    return _last_of(listed).unionByName(flat)


def batch_transcriptions(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): the results of a batch file under the file name as written and its stem."""
    r = spark.read.schema(BATCH).json(path, multiLine=True).select(F.posexplode("results").alias("place", "x"))
    return _last_of(r.select(F.array(F.coalesce("x.file", F.lit("")), stem(F.coalesce("x.file", F.lit("")))).alias("keys"), F.coalesce("x.transcription", F.lit("")).alias("text"), "place"))


def transcript_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text) of *_transcription.txt files, each under its name without that and with .wav."""
    r = spark.read.text(folder, wholetext=True, pathGlobFilter="*_transcription.txt").select(base_name(F.input_file_name()).alias("n"), F.regexp_replace("value", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "").alias("text"))
    name = F.replace(F.regexp_replace(F.coalesce(F.try_url_decode("n"), "n"), r"\.txt$", ""), F.lit("_transcription"), F.lit(""))
    return _last_of(r.select(F.array(name, F.concat(name, F.lit(".wav"))).alias("keys"), "text", F.col("n").alias("place")))


def transcripts(spark: SparkSession, folder: str, batch_file: str = "batch_transcriptions.json") -> DataFrame:
    """(file, text): the batch file of a folder if there is one, else its transcript files; an error
    if there is neither."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{batch_file}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = batch_transcriptions(spark, f"{folder}/{batch_file}") if fs.exists(path) else transcript_files(spark, folder)
    if not out.limit(1).count():
        raise ValueError(f"no transcripts in {folder}")
    return out


def histories(spark: SparkSession, path: str) -> DataFrame:
    """Decoding histories, one JSON object per file; unreadable files have only nulls and are dropped."""
    return spark.read.schema(HISTORY).json(path, multiLine=True, mode="PERMISSIVE").where("audio_path is not null")


def json_lines(spark: SparkSession, path: str, schema: str = CORRECTION) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of a JSON-lines file: blank lines are skipped, a line that is no JSON
    object of the schema is kept apart as text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_bad"), parsed.where(bad).select("value")


def with_defaults(samples: DataFrame) -> DataFrame:
    """Correction samples with what optional fields stand for where they are missing: no transcript
    before, and as many candidates as are listed."""
    return samples.withColumns({"previous_transcript": F.coalesce("previous_transcript", F.lit("")), "num_candidates": F.coalesce("num_candidates", F.size("k_best_candidates"))})


def in_memory(spark: SparkSession, audio: list, instructions: list[str], responses: list[str]) -> DataFrame:
    """(audio array<float>, instruction, response) of three lists of one length."""
    if not len(audio) == len(instructions) == len(responses):
        raise ValueError("the lists differ in length")
    return spark.createDataFrame([([float(v) for v in a], i, r) for a, i, r in zip(audio, instructions, responses)], "audio array<float>, instruction string, response string")


def dummy(spark: SparkSession, rows: int = 4, samples: int = 16000) -> DataFrame:
    """``rows`` equal rows of noise with a fixed instruction and response, to try a pipeline without data."""
    noise = F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda i: ((F.xxhash64(i) / F.lit(float(1 << 63)))).cast("float"))
    return spark.range(rows).select(noise.alias("audio"), F.lit("Transcribe this audio.").alias("instruction"), F.lit("This is a test transcription.").alias("response"))


def tabular(spark: SparkSession, path: str, rename: dict[str, str] | None = None) -> DataFrame:
    """JSON, JSON lines, CSV (all strings, so that it is read once) or Parquet by extension, with
    columns renamed to canonical names."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext == "json":
        df = spark.read.json(path, multiLine=True)
    elif ext == "jsonl":
        df = spark.read.json(path)
    elif ext == "csv":
        df = spark.read.csv(path, header=True)
    elif ext == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"no reader for .{ext}")
    return df.withColumnsRenamed(rename or {})


def is_correction_format(spark: SparkSession, path: str, audio: bool = True) -> bool:
    """Whether the first non-blank line has the keys of a correction sample."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if not first:
        return False
    keys = AUDIO_KEYS if audio else TEXT_KEYS
    import json

    try:
        row = json.loads(first[0]["value"])
    except ValueError:
        return False
    return isinstance(row, dict) and all(k in row for k in keys)
