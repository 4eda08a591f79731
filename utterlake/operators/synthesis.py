"""Training samples from decoding histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utterlake.functions.metrics import align_prefix
from utterlake.functions.text import canonical_text


def histories(df: DataFrame, key: str = "audio_path") -> DataFrame:
    """(key, idx, end_time, duration, previous_transcript, topk): entries in order, with the time
    since the entry before (skipped entries count)."""
    e = df.select(key, F.posexplode("history").alias("idx", "h")).select(key, "idx", F.coalesce("h.end_time", F.lit(0.0)).alias("end_time"), F.coalesce("h.previous_transcript", F.lit("")).alias("previous_transcript"), "h.topk")
    w = Window.partitionBy(key).orderBy("idx")
    return e.withColumn("duration", F.col("end_time") - F.lag("end_time", 1, 0.0).over(w))


def synthesize(df: DataFrame, key: str = "audio_path", reference: str = "final_text", candidates: int = 4, chunk_ms: int = 500, initial_s: float = 1.0) -> DataFrame:
    """Correction samples: what the reference says after each committed transcript.

    The committed transcript is aligned to a prefix of the reference. After a short chunk (the
    first below ``initial_s``, others below ``chunk_ms``) the whole rest is the continuation,
    else as many characters as the best candidate adds. Entries without candidates, without
    anything left, or whose best candidate adds nothing are left out.
    """
    canon = lambda c: canonical_text(c)
    refs = df.select(key, canon(F.coalesce(F.col(reference), F.lit(""))).alias("ref")).where("ref <> ''")
    e = histories(df, key).withColumn("prev", canon(F.col("previous_transcript")))
    # candidates are normalized one row each, since the normalizer isn't an expression
    c = e.select(key, "idx", F.posexplode(F.slice(F.filter("topk", lambda x: x.isNotNull()), 1, candidates)).alias("k", "c")).withColumn("c", canon(F.col("c"))).where("c <> ''")
    best = c.groupBy(key, "idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("k_best_candidates"))
    s = e.drop("topk").join(best, [key, "idx"]).join(refs, key)
    s = s.withColumn("at", align_prefix("prev", "ref")).where(F.col("at") < F.length("ref"))
    short = F.col("duration") < F.when(F.col("idx") == 0, initial_s).otherwise(chunk_ms / 1000)
    more = F.length(F.col("k_best_candidates")[0]) - F.length("prev")
    s = s.withColumn("continuation_transcript", F.when(short, F.substring("ref", F.col("at") + 1, F.length("ref"))).when(more > 0, F.substring("ref", F.col("at") + 1, more)))
    return s.where("continuation_transcript <> ''").select("k_best_candidates", F.lit(candidates).alias("num_candidates"), F.lit(chunk_ms).alias("chunk_size"), F.col("prev").alias("previous_transcript"), "continuation_transcript", key, F.col("end_time").alias("timestamp"))
