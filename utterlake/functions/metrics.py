"""Edit-distance metrics and prefix alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from utterlake.functions import text as T

#: Most distinct tokens of a pair of texts: as many as there are code points from 256 on, without
#: surrogates and U+FEFF.
MOST_TOKENS = 0x110000 - 0x100 - 0x801


def cer(reference: Column, hypothesis: Column, hint: Column) -> Column:
    """Edits by characters over the reference's length, in the form that cer_form gives. An
    empty reference scores 0 against nothing and 1 against anything."""
    both = F.concat(F.trim(F.coalesce(reference, F.lit(""))), F.trim(F.coalesce(hypothesis, F.lit(""))))
    lang = T.resolve_language(hint, both)
    return rate(T.cer_form(reference, lang), T.cer_form(hypothesis, lang))


def rate(ref: Column, hyp: Column) -> Column:
    n = F.length(ref)
    return F.when(n == 0, F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(ref, hyp) / n)


def _as_text(tokens: Column, known: Column) -> Column:
    """Each token as the character numbered by its place among the ``known`` ones."""
    places = F.transform(tokens, lambda t: F.array_position(known, t) + 0xFF)
    # past the surrogates, and past U+FEFF, which a decoder drops where it comes first
    points = F.transform(places, lambda p: p + F.when(p >= 0xFEFF - 0x800, 0x801).when(p >= 0xD800, 0x800).otherwise(0))
    return F.decode(F.unhex(F.array_join(F.transform(points, lambda p: F.lpad(F.hex(p), 8, "0")), "")), "UTF-32")


def with_token_rate(df: DataFrame, ref: str, hyp: str, out: str) -> DataFrame:
    """``df`` with ``out``: edits by tokens over the number of reference tokens, of two columns of
    token lists. Each distinct token of a pair becomes one character, so that the JVM's edit
    distance of strings counts tokens; every step is a column of its own, so that it is
    evaluated once a row. A pair of more than MOST_TOKENS distinct tokens is an error."""
    d = df.withColumn("_known", F.array_distinct(F.concat(ref, hyp)))
    for c in (ref, hyp):
        d = d.withColumn(f"_{c}_text", _as_text(F.col(c), F.col("_known")))
    edits = F.when(F.size("_known") > MOST_TOKENS, F.raise_error(F.lit("too many distinct tokens"))).otherwise(F.levenshtein(f"_{ref}_text", f"_{hyp}_text"))
    rate_ = F.when(F.size(ref) == 0, F.when(F.size(hyp) == 0, 0.0).otherwise(1.0)).otherwise(edits / F.size(ref))
    return d.withColumn(out, rate_).drop("_known", f"_{ref}_text", f"_{hyp}_text")


def with_mer(df: DataFrame, reference: str, hypothesis: str, hint: str, out: str = "mer") -> DataFrame:
    """``df`` with the mixed error rate; each side resolves its own language. An empty reference
    scores 0 against nothing and 1 against anything."""
    d = df.withColumn("_rt", T.mixed_tokens(F.col(reference), F.col(hint))).withColumn("_ht", T.mixed_tokens(F.col(hypothesis), F.col(hint)))
    return with_token_rate(d, "_rt", "_ht", out).drop("_rt", "_ht")


def prefix_end(previous: str, reference: str) -> int:
    """The length of the reference's prefix nearest to ``previous`` by edit distance; of equally
    near ones that whose length is nearest, then the shorter; 0 if either is empty."""
    # the empty prefix is n edits away, and one of more than 2 * n characters is more
    reference = reference[: 2 * len(previous)]
    n, m = len(previous), len(reference)
    if not n or not m:
        return 0
    ref = np.frombuffer(reference.encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.arange(m + 1, dtype=np.int64)
    row = place.copy()
    for c in previous:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (ref != ord(c)))
        row = np.minimum.accumulate(new - place) + place
    best = np.flatnonzero(row == row.min())
    return int(best[np.argmin(np.abs(best - n))])


#: Pairs aligned together, and cells of a row of theirs.
_TOGETHER, _CELLS = 64, 1 << 20


def prefix_ends(previous: list[str], reference: list[str]) -> np.ndarray:
    """prefix_end of each pair: those of like length go through the recurrence together."""
    out = np.zeros(len(previous), np.int32)
    reference = [r[: 2 * len(p)] for p, r in zip(previous, reference)]
    todo = [i for i in range(len(previous)) if previous[i] and reference[i]]
    todo.sort(key=lambda i: (len(previous[i]), len(reference[i])))
    while todo:
        most = max(1, min(_TOGETHER, _CELLS // (1 + max(len(reference[i]) for i in todo[:_TOGETHER]))))
        part, todo = todo[:most], todo[most:]
        n = np.array([len(previous[i]) for i in part])
        m = np.array([len(reference[i]) for i in part])

        def padded(texts: list[str], width: int, fill: int) -> np.ndarray:
            codes = np.full((len(texts), width), fill, np.int32)
            for k, t in enumerate(texts):
                codes[k, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32)
            return codes

        prev, ref = padded([previous[i] for i in part], n.max(), -1), padded([reference[i] for i in part], m.max(), -2)
        place = np.arange(m.max() + 1, dtype=np.int32)
        row = np.broadcast_to(place, (len(part), len(place))).copy()
        for j in range(n.max()):
            first = np.searchsorted(n, j, side="right")  # shorter ones are done
            old = row[first:]
            new = np.empty_like(old)
            new[:, 0] = j + 1
            np.minimum(old[:, 1:] + 1, old[:, :-1] + (ref[first:] != prev[first:, j : j + 1]), out=new[:, 1:])
            new -= place
            np.minimum.accumulate(new, axis=1, out=new)
            new += place
            row[first:] = new
        row[place > m[:, None]] = np.iinfo(np.int32).max
        # of the nearest those whose length is nearest, then the shorter
        best = row == row.min(1, keepdims=True)
        away = np.where(best, np.abs(place - n[:, None].astype(np.int32)), np.iinfo(np.int32).max)
        out[part] = away.argmin(1)
    return out


@pandas_udf(IntegerType())
def align_prefix(previous: pd.Series, reference: pd.Series) -> pd.Series:
    """prefix_end for columns; quadratic in the lengths, where nested expressions are cubic."""
    return pd.Series(prefix_ends(previous.fillna("").tolist(), reference.fillna("").tolist()), dtype="int32")


def given(c: str) -> Column:
    """A measured value: null where it is null, NaN or zero (which marks a missing one)."""
    return F.when((F.col(c) != 0) & ~F.isnan(c), F.col(c))


def latency_means(df: DataFrame, by: list[str], first: str, last: str) -> DataFrame:
    """(by.., files, average_first, average_last): means over the measured values."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.avg(given(first)).alias("average_first"), F.avg(given(last)).alias("average_last"))


def latency_spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by.., least, median, greatest) of values that are neither null nor NaN."""
    d = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return d.groupBy(*by).agg(F.min(value).alias("least"), F.median(value).alias("median"), F.max(value).alias("greatest"))


def first_and_last(df: DataFrame, by: list[str], order: str, first: str, last: str) -> DataFrame:
    """(by.., first, last): the ``first`` of the least and the ``last`` of the greatest place, of rows
    where both are neither null nor NaN."""
    ok = [F.col(c).isNotNull() & ~F.isnan(c) for c in (first, last)]
    return df.where(ok[0] & ok[1]).groupBy(*by).agg(F.min_by(first, order).alias("first"), F.max_by(last, order).alias("last"))


def percent(c: Column) -> Column:
    return c * 100


def milliseconds(seconds: Column) -> Column:
    """Null for null and for 0, which marks a missing measurement."""
    return F.when(seconds != 0, seconds * 1000)


def masked_loss(log_probs: Column, labels: Column, ignore: int = -100) -> Column:
    """Mean of -log p over the labels that are not ``ignore``, where log_probs[i] is that of labels[i + 1]
    (each place predicts the next); null if none is left."""
    kept = F.filter(F.arrays_zip(log_probs.alias("p"), F.slice(labels, F.lit(2), F.greatest(F.lit(0), F.size(labels) - 1)).alias("y")), lambda x: x["y"].isNotNull() & (x["y"] != ignore) & x["p"].isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a - x["p"])
    return F.when(F.size(kept) > 0, total / F.size(kept))
