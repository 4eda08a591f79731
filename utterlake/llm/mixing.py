"""Mixing sources to target weights.

Tokens are added up per source, repetition rates derived from the weights, and each
document comes out floor(rate) times, plus once more by a draw that depends on a seed
and its identity alone, with the fraction as its chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterlake.llm.common import hash_unit


def corpus_of(path: Column) -> Column:
    """The corpus named by a dataset path: its directory, in lower case, whatever the mount, the
    file, doubled slashes and outer blanks. Null for a null path or one without a directory."""
    p = F.regexp_replace(F.lower(F.trim(path)), r"[\\/]+", "/")
    folder = F.regexp_replace(p, r"/[^/]*$", "")
    name = F.element_at(F.split(folder, "/"), -1)
    return F.when(F.contains(p, F.lit("/")) & (name != "") & ~name.isin(".", ".."), name)


def tokens_of(text: Column) -> Column:
    """Words, and each Chinese character one; 0 for null."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(r"[㐀-䶿一-鿿]|[^\s\p{P}㐀-䶿一-鿿]+"))


def rates(sizes: DataFrame, entries: DataFrame, strict: bool = False) -> DataFrame:
    """(config_id, source, weight, max_repeat, size, target_share, rate): how often a source's
    documents are used in each configuration.

    ``sizes``: source, size (tokens). ``entries``: config_id, entry_no, path, weight, max_repeat,
    one per dataset of a configuration. Equal rows count once; a corpus that several entries
    name gets the sum of their weights and the greatest max_repeat (null: 1). A null weight is 1; weights
    of 0 or less leave the entry out. target_share is the weight's part of all weights of
    sources that have any tokens; a source without has rate 0.

    The total is as large as one use of all sources taken part, and is dealt out by weight;
    a source that would pass its max_repeat is held there and the others share what it
    lacks, in proportion, until no further one passes. With ``strict`` the total is instead
    the largest at which every source reaches its share exactly.
    """
    e = entries.select("config_id", "entry_no", corpus_of(F.col("path")).alias("source"), F.coalesce(F.col("weight"), F.lit(1)).cast("double").alias("weight"), F.coalesce(F.col("max_repeat"), F.lit(1)).cast("double").alias("max_repeat")).distinct()
    e = e.where("weight > 0 and source is not null").groupBy("config_id", "source").agg(F.sum("weight").alias("weight"), F.max("max_repeat").alias("max_repeat"))
    s = e.join(sizes, "source", "left").withColumn("size", F.coalesce(F.col("size"), F.lit(0)).cast("double"))
    cfg = Window.partitionBy("config_id")
    has = F.col("size") > 0
    s = s.withColumn("target_share", F.when(has, F.col("weight")).otherwise(0.0) / F.nullif(F.sum(F.when(has, F.col("weight")).otherwise(0.0)).over(cfg), F.lit(0.0)))
    s = s.withColumn("target_share", F.coalesce("target_share", F.lit(0.0)))
    reach = F.col("max_repeat") * F.col("size") / F.col("target_share")  # total at which it is used up
    s = s.withColumn("_reach", F.when(F.col("target_share") > 0, reach))
    if strict:
        s = s.withColumn("_total", F.min("_reach").over(cfg))
        rate = F.col("target_share") * F.col("_total") / F.col("size")
    else:
        # sources in the order in which they are used up; one is held at its maximum if the
        # rest of the total, dealt to it and those after, would still pass it
        order = cfg.orderBy(F.col("_reach").asc_nulls_last(), "source")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        s = s.withColumn("_total", F.sum("size").over(cfg))
        s = s.withColumn("_used", F.coalesce(F.sum(F.col("max_repeat") * F.col("size")).over(before), F.lit(0.0)))
        s = s.withColumn("_left", 1.0 - F.coalesce(F.sum("target_share").over(before), F.lit(0.0)))
        level = (F.col("_total") - F.col("_used")) / F.nullif(F.col("_left"), F.lit(0.0))
        s = s.withColumn("_held", F.when(F.col("target_share") > 0, level >= F.col("_reach")).otherwise(False))
        # held sources come first; the level of the first that isn't holds for all after it
        s = s.withColumn("_level", F.min(F.when(~F.col("_held") & (F.col("target_share") > 0), F.struct("_reach", "source", level.alias("x")))).over(cfg)["x"])
        rate = F.when(F.col("_held"), F.col("max_repeat")).otherwise(F.col("target_share") * F.col("_level") / F.col("size"))
    rate = F.when(has, F.least(F.coalesce(rate, F.lit(0.0)), F.col("max_repeat"))).otherwise(0.0)
    return s.select("config_id", "source", "weight", "max_repeat", "size", "target_share", rate.alias("rate"))


def mix(docs: DataFrame, rated: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """(config_id, source, id, copy, tokens): the mixture; ``copy`` counts from 1.

    ``docs``: id, source, tokens, one row per document. The rates (a row per configuration and
    source, far fewer than documents) are joined to the documents; a source that holds a
    third of all rows is split by the adaptive join or met by a broadcast.
    """
    r = rated.where("rate > 0").select("config_id", "source", "rate", "max_repeat")
    d = docs.select(F.col(id_col), "source", "tokens").join(r, "source")
    whole = F.floor("rate")
    draw = hash_unit(F.col("config_id"), F.col(id_col), seed=seed) < F.col("rate") - whole
    n = F.least(whole + draw.cast("int"), F.floor("max_repeat")).cast("int")
    return d.withColumn("_n", n).where("_n > 0").select("config_id", "source", id_col, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"), "tokens")


def shares(mixed: DataFrame, rated: DataFrame) -> DataFrame:
    """(config_id, source, weight, max_repeat, size, target_share, rate, documents, tokens,
    reached_share): what came of each source; reached_share is its part of the tokens."""
    got = mixed.groupBy("config_id", "source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    out = rated.join(got, ["config_id", "source"], "left").fillna(0, ["documents", "tokens"])
    whole = F.sum("tokens").over(Window.partitionBy("config_id"))
    return out.withColumn("reached_share", F.coalesce(F.col("tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)))
