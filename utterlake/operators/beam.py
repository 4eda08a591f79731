"""One block of k-best beam search as a dataflow; the model's log-probabilities are data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score(cum: Column, length: Column) -> Column:
    return cum / F.greatest(F.lit(1), length)


def expand(beams: DataFrame, group: str, stop: list[int], k: int) -> DataFrame:
    """(group, rank, cum, tokens, done, score): the ``k`` best continuations of each group.

    ``beams``: group, beam int, cum double, tokens array<int>, positions array<struct<greedy int,
    alts array<struct<token int, lp double>>>>. At each position every alternative leaves the
    greedy path there; the greedy path itself goes on to its stop token or the end. A missing
    log-probability counts 0. A beam without positions stays as it is, done. Ties keep the
    order beam, position, alternative, the greedy path last.
    """
    name, group = group, "_group"
    beams = beams.withColumnRenamed(name, group)
    stops = F.array(*[F.lit(x).cast("int") for x in stop])
    none = F.coalesce(F.size("positions"), F.lit(0)) <= 0
    kept = beams.where(none).select(group, "cum", "tokens", F.lit(True).alias("done"), F.array(F.col("beam"), F.lit(-1), F.lit(-1)).alias("ord"))
    pos = beams.where(~none).select(group, "beam", "cum", "tokens", F.posexplode("positions").alias("p", "x"))
    lp = F.coalesce(F.get(F.filter("x.alts", lambda a: a["token"] == F.col("x.greedy")), 0)["lp"], F.lit(0.0))
    w = Window.partitionBy(group, "beam").orderBy("p")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    pos = pos.withColumn("stopped", F.coalesce(F.max(F.array_contains(stops, F.col("x.greedy")).cast("int")).over(before), F.lit(0)))
    pos = pos.where("stopped = 0").withColumn("lp", lp)
    pos = pos.withColumn("sofar", F.col("cum") + F.coalesce(F.sum("lp").over(before), F.lit(0.0))).withColumn("path", F.coalesce(F.collect_list("x.greedy").over(before), F.array().cast("array<int>")))
    alts = pos.select(group, "beam", "p", "tokens", "sofar", "path", F.col("x.greedy").alias("g"), F.posexplode("x.alts").alias("a", "alt")).where("alt.token <> g")
    alts = alts.select(group, (F.col("sofar") + F.col("alt.lp")).alias("cum"), F.concat("tokens", "path", F.array("alt.token")).alias("tokens"), F.array_contains(stops, F.col("alt.token")).alias("done"), F.array("beam", "p", "a").alias("ord"))
    last = pos.groupBy(group, "beam").agg(F.max_by(F.struct((F.col("sofar") + F.col("lp")).alias("cum"), F.concat("tokens", "path", F.array("x.greedy")).alias("tokens"), F.array_contains(stops, F.col("x.greedy")).alias("done")), "p").alias("s"))
    greedy = last.select(group, "s.cum", "s.tokens", "s.done", F.array(F.col("beam"), F.lit(1 << 30), F.lit(0)).alias("ord"))
    every = kept.unionByName(alts).unionByName(greedy)
    ended = F.size("tokens") - F.coalesce(F.array_contains(stops, F.try_element_at("tokens", F.lit(-1))), F.lit(False)).cast("int")
    every = every.withColumn("score", score(F.col("cum"), ended))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "ord"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col(group).alias(name), "rank", "cum", "tokens", "done", "score")
