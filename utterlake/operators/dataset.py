"""Prompts, weights, samples, splits: building instruction data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterlake.functions import pcm as P

# The wording of the two prompts.
PROMPT_AUDIO = (
    "Given the audio and the following ASR transcription candidates, predict the correct continuation.",
    "Previous confirmed transcript: ",
    "K-best candidates for the continuation:",
    "Based on the audio, what is the correct text that should be appended after ",
)

PROMPT_TEXT = (
    "Given the following ASR transcription candidates, predict the correct continuation.",
    "Previous confirmed transcript: ",
    "K-best candidates for the continuation:",
    "Based on the context and candidates, what is the correct text that should be appended after ",
)


def numbered(candidates: Column) -> Column:
    return F.array_join(F.transform(candidates, lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x)), "\n")


def prompt(candidates: Column, previous: Column, most: int, audio: bool = True) -> Column:
    """The instruction for a correction, with or without audio, with the first ``most`` candidates
    numbered. A null transcript is empty; null candidates are left out."""
    head, said, best, ask = PROMPT_AUDIO if audio else PROMPT_TEXT
    q = F.concat(F.lit('"'), F.coalesce(previous, F.lit("")), F.lit('"'))
    listed = numbered(F.filter(F.slice(candidates, 1, most), lambda x: x.isNotNull()))
    return F.concat(F.lit(f"{head}\n\n{said}"), q, F.lit(f"\n\n{best}\n"), listed, F.lit(f"\n\n{ask}"), q, F.lit("?"))


def wrapped(instruction: Column, response: Column, bos: str = "<s>", eos: str = "</s>", audio: bool = False) -> Column:
    return F.concat(F.lit(bos + ("<|audio|>\n" if audio else "")), instruction, F.lit("\n"), response, F.lit(eos))


def chat(system: str, user: Column, answer: Column) -> Column:
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", answer))


def hash_key(seed: int, *ids: Column) -> Column:
    """A sort key that is random in the ids and the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.concat_ws("-", *[i.cast("string") for i in ids])))


def hash_place(df: DataFrame, by: str, seed: int, *ids: str) -> DataFrame:
    """``df`` with ``place``: a random order within each ``by``, the same in every engine."""
    w = Window.partitionBy(by).orderBy(hash_key(seed, *[F.col(i) for i in ids]), *ids)
    return df.withColumn("place", F.row_number().over(w))


def sample(df: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """``n`` rows drawn without replacement; the top n by hash, so no full sort."""
    return df.orderBy(hash_key(seed, *[F.col(i) for i in ids]), *ids).limit(n)


def split(df: DataFrame, share: float, seed: int, *ids: str) -> DataFrame:
    """``df`` with ``part``: validation for about ``share`` of the rows, else train."""
    u = F.conv(F.substring(hash_key(seed, *[F.col(i) for i in ids]), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("part", F.when(u < int(share * (1 << 32)), "validation").otherwise("train"))


def replicate(df: DataFrame, weight: str) -> DataFrame:
    """Rows as often as their weight says, at least once; ``copy`` counts from 1."""
    w = F.greatest(F.coalesce(F.col(weight), F.lit(1)).cast("int"), F.lit(1))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), w)))


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``done``: what a resumed run still has to do."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def last_given(df: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """The last non-null ``value`` up to each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def previous_best(df: DataFrame, key: str, order: list[str], candidates: str, out: str) -> DataFrame:
    """The best candidate of the row before, empty for a key's first: what the next row builds on."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(out, F.coalesce(F.lag(F.get(candidates, 0)).over(w), F.lit("")))


def shuffled(df: DataFrame, seed: int, *ids: str) -> DataFrame:
    """``df`` in an order that is random in the ids and the same in every engine (a sort by range
    partitions)."""
    return df.orderBy(hash_key(seed, *[F.col(i) for i in ids]), *ids)


def union(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables, by column name; a column that a table lacks is null there."""
    if not tables:
        raise ValueError("no tables")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def collate(df: DataFrame, batch: str, tokens: str, prompt: str, fill: int = 0, ignore: int = -100) -> DataFrame:
    """``df`` with input_ids, attention_mask and labels: tokens filled up to the longest of their
    ``batch``; labels are ``ignore`` in the first ``prompt`` places and in the filling."""
    longest = df.groupBy(batch).agg(F.max(F.size(tokens)).alias("_longest"))
    d = df.join(longest, batch)
    to = F.col("_longest")
    labels = P.label_mask(P.pad(F.col(tokens), to, F.lit(None).cast("int")), F.col(prompt), ignore)
    return d.withColumns({"input_ids": P.pad(F.col(tokens), to, F.lit(fill).cast("int")), "attention_mask": P.attention_mask(F.col(tokens), to), "labels": labels}).drop("_longest")
